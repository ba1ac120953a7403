"""Importing this module registers the subpackage's queries."""

from canopy.llm.registry import ORACLE, QUERIES  # noqa: F401
from canopy.llm import chat_format_query, compress_classifier_query, decontaminate_query, exact_dedup_query, importance_resampling_query, line_dedup_query, lm_trie_query, pii_surrogates_query, quality_rules_query, sentencepiece_query, simhash_query, spelling_query, url_lists_query  # noqa: F401


def llm_queries():
    return dict(QUERIES)


def llm_oracles():
    return dict(ORACLE)
