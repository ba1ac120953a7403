"""URL filters: dated list entries against captures, as the lists stood on the day of each fetch.

An entry names a key (a domain with everything below it, or a host with a path prefix), a list (``block`` or ``allow``), a
day and an action (``add`` or ``remove``). A key's entries in order become validity intervals: an ``add`` opens one, the next
entry of the key and list closes it. A capture has the keys of all its host's suffixes and path prefixes, and
the longest active one decides; with both lists active on one key ``block`` does.

The as-of join runs on distinct (key, day) pairs of captures that the lists name at all, so that a host with a third of
all captures is as many rows as it has days there, in one sorted window with the key's entries. The answers go back
to the captures by an ordinary join on (key, day), where a hot pair is a splittable skewed join key.

Defined cases: captures with a null or unreadable URL or a null day match nothing and are kept; entries with a null key, day,
list or action are left out; of entries of one key, list and day ``remove`` counts last; repeated entries change nothing,
repeated captures are judged each for itself; empty tables on either side match nothing; other columns of the captures pass
through, columns named like a new one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host, null if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """All keys that can name a URL: suffixes of its host, and its host with each path prefix, ending in a slash."""
    host, path = host_of(url), F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^?#]*)", 1)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>")))))


def validity(entries: DataFrame) -> DataFrame:
    """``entries(key, list, day, action)`` -> intervals ``key, list, since, until`` (until excluded, null if open)."""
    known = entries.select("key", "list", "day", "action").dropna().where(F.col("action").isin("add", "remove"))
    # The last action of a day is what holds from that day on.
    daily = known.groupBy("key", "list", "day").agg(F.max("action").alias("action"))
    of_key = Window.partitionBy("key", "list").orderBy("day")
    turns = (daily.withColumn("before", F.lag("action").over(of_key))
             .where(~F.col("action").eqNullSafe(F.col("before")) & ((F.col("action") == "add") | F.col("before").isNotNull())))
    return (turns.withColumn("until", F.lead("day").over(of_key)).where(F.col("action") == "add")
            .select("key", "list", F.col("day").alias("since"), "until"))


def as_of(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """``probes(key, day)``, distinct -> ``key, day, list, since`` of the interval that holds on the day, one row for each list."""
    listed = intervals.select("key", "list").distinct()
    asked = probes.join(listed, "key").select("key", "list", "day", F.lit(1).alias("kind"),
                                              F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    opened = intervals.select("key", "list", F.col("since").alias("day"), F.lit(0).alias("kind"), "since", "until")
    order = Window.partitionBy("key", "list").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = opened.unionByName(asked).select(
        "key", "list", "day", "kind", F.last(F.when(F.col("kind") == 0, F.struct("since", "until")), ignorenulls=True).over(order).alias("at"))
    return (seen.where((F.col("kind") == 1) & (F.col("at.until").isNull() | (F.col("day") < F.col("at.until"))) & F.col("at").isNotNull())
            .select("key", "day", "list", F.col("at.since").alias("since")))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with ``url`` and ``fetched_on``) with ``decided_by`` (the longest active key), ``decided_list``,
    ``listed_since`` and ``blocked``."""
    new = ["decided_by", "decided_list", "listed_since", "blocked"]
    rows = captures.drop(*new)
    asked = (rows.select("url", F.col("fetched_on").cast("date").alias("day")).where(F.col("day").isNotNull()).distinct()
             .withColumn("key", F.explode(keys_of(F.col("url")))))
    active = as_of(asked.select("key", "day").distinct(), validity(entries))
    longest = F.max(F.struct(F.length("key").alias("n"), "key", "list", "since"))
    decided = (asked.join(active, ["key", "day"]).groupBy("url", "day").agg(longest.alias("by"))
               .select(F.col("url").alias("__url"), F.col("day").alias("__day"), F.col("by.key").alias("decided_by"),
                       F.col("by.list").alias("decided_list"), F.col("by.since").alias("listed_since")))
    judged = rows.join(decided, (rows["url"] == decided["__url"]) & (rows["fetched_on"].cast("date") == decided["__day"]), "left")
    return judged.drop("__url", "__day").withColumn("blocked", F.coalesce(F.col("decided_list") == "block", F.lit(False)))
