"""op6: quality classifier over ``documents``, learnt from ``labels.quality``."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.llm.compress_classifier import classify, fit
from canopy.llm.registry import query
from canopy.sources.tables import table


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query("op6_compression_classifier")
def op6_compression_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", F.col("quality").alias("label"))
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
