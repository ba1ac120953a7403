"""op4: quality rules over ``documents``."""

from __future__ import annotations

from canopy.llm.quality_rules import quality
from canopy.llm.registry import query
from canopy.sources.tables import table


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "perplexity", "kept")
