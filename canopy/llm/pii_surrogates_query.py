"""op3: PII surrogates in ``documents``."""

from __future__ import annotations

from canopy.llm.pii_surrogates import replace_entities
from canopy.llm.registry import query
from canopy.sources.tables import table

#: The key of the surrogates; a deployment passes its own.
SECRET = "canopy"


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), SECRET)
