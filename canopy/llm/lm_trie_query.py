"""op10: LM scoring of ``documents``."""

from __future__ import annotations

from canopy.llm.compress_classifier_query import held_out
from canopy.llm.lm_trie import score, train
from canopy.llm.registry import query
from canopy.sources.tables import table


@query("op10_lm_trie")
def op10_lm_trie(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out"))
    return score(docs, train(docs.where("not held_out").select("text"))).drop("text")
