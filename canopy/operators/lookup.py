"""Dictionary lookup (K1-K3): a left join with a keyed dictionary.

The planner replicates the dictionary to every executor when its size in bytes lies below
``spark.sql.autoBroadcastJoinThreshold`` (by statistics, or by the sizes that AQE sees at run time); above it the
lookup is a shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LookupError_(KeyError):
    pass


@dataclass
class Lookup:
    table: DataFrame      # keys + fields, all fields as text
    keys: list[str]
    fields: list[str]


def memlookup_load(dictionary: DataFrame, keys: list[str], fields: list[str],
                   dedupe: str | None = None) -> Lookup:
    """K1. Load a dictionary keyed by ``keys`` with text ``fields``.

    Keys must be unique: duplicates raise, unless ``dedupe='max'`` keeps the greatest value per field."""
    d = dictionary.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields])
    if dedupe == "max":
        d = d.groupBy(*keys).agg(*[F.max(f).alias(f) for f in fields])
    else:
        dup = d.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
        if dup:
            raise LookupError_(f"duplicate keys in dictionary on {keys}")
    return Lookup(d, list(keys), list(fields))


def memlookup_find(df: DataFrame, lookup: Lookup, key_cols: list[str], field: str, out: str | None = None) -> DataFrame:
    """K2. ``df`` plus the text value of ``field`` for its key (NULL if the key is missing)."""
    if field not in lookup.fields:
        raise LookupError_(f"unknown field {field}")
    if len(key_cols) != len(lookup.keys):
        raise LookupError_("key arity differs from the dictionary")
    right = lookup.table.select(*[F.col(k).alias(f"__lk{i}") for i, k in enumerate(lookup.keys)],
                                F.col(field).alias(out or field))
    cond = None
    for i, k in enumerate(key_cols):
        c = F.col(k) == F.col(f"__lk{i}")
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"__lk{i}" for i in range(len(key_cols))])


def lookup_aggregate(df: DataFrame, lookup: Lookup, key_cols: list[str], field: str, group_by: list[str] | None = None,
                     cast: str = "int") -> DataFrame:
    """K3. ``max(memlookup_find(...)::int)``, optionally per group."""
    v = memlookup_find(df, lookup, key_cols, field, "__v")
    agg = F.max(F.col("__v").cast(cast)).alias(f"max_{field}")
    return v.groupBy(*group_by).agg(agg) if group_by else v.agg(agg)
