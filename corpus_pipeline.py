"""The corpus pipeline: ``documents`` through five operators of ``canopy.llm``, one written table per stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Defined cases, for every stage: further columns of the input are dropped, so their names can't clash; an empty table gives an
empty one; a null or empty text has no words; very long texts are read whole; rows that share a ``doc_id`` or are repeated are judged
each for itself, but where a stage says otherwise. What a stage does with them:

* quality rules: texts without words go (too short), as do all under 50 words; a null language is a language of its own; equal texts
  are judged alike.
* line dedup: a null or empty text stays as it is; rows that share a ``doc_id`` count as one document; a null ``doc_id`` comes before all
  others, so its lines go first.
* simhash near-dedup: texts without words are one group; of a group the smallest ``doc_id`` stays (null last), of equal ids the smallest
  fingerprint, and of rows that agree in id and text one.
* benchmark decontamination: texts without words stay; items without words match nothing.
* sentencepiece encoding: a null or empty text is the end id alone; every row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import shared_folder
from canopy.llm.decontaminate import decontaminate
from canopy.llm.line_dedup import dedup_lines
from canopy.llm.quality_rules import keep_good
from canopy.llm.sentencepiece_bpe import encode
from canopy.llm.simhash import keep_one
from canopy.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return keep_good(docs.select(COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters that 5 or more documents share stay only in the last of them."""
    kept = dedup_lines(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 4 or fewer bits, the one with the smallest id stays."""
    return keep_one(docs.select(COLUMNS), shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 benchmark words go."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token ids."""
    encoded = encode(docs.select(COLUMNS), public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", sentencepiece),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
