"""op12: exact dedup of ``documents``."""

from __future__ import annotations

from canopy.llm.exact_dedup import mark_copies
from canopy.llm.registry import query
from canopy.sources.tables import table


@query("op12_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)""")
def op12_exact_dedup(spark, sf_dir):
    return mark_copies(table(spark, sf_dir, "documents"), ["doc_id"])
