"""op5: SimHash near-duplicates over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.llm.registry import query
from canopy.llm.simhash import near_duplicates
from canopy.sources.tables import table


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    groups = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
