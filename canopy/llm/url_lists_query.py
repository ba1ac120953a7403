"""op2: URL filters over ``pages``.

The tables have neither lists nor fetch days, so both are derived from ``pages`` by digits of md5: a day for each
page, and dated entries for hosts, domains and path prefixes that occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.llm.registry import query
from canopy.llm.url_lists import filter_urls, host_of
from canopy.sources.tables import table


def _digit(text, place: int):
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), place, 1)) - 1


def fetches(pages):
    """``page_id, url, fetched_on`` of each page."""
    page = F.col("page_id").cast("string")
    days = 64 * _digit(page, 1) + 4 * _digit(page, 2) + F.floor(_digit(page, 3) / 4)
    return pages.select("page_id", "url", F.date_add(F.lit("2021-01-01").cast("date"), days.cast("int")).alias("fetched_on"))


def dated_entries(pages):
    """List entries ``key, list, day, action`` for part of the hosts, of their domains and of their path prefixes."""
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.regexp_extract("url", "://[^/?#]+/([^/?#]+)/", 1).alias("dir")).distinct()
    keys = (hosts.select(F.col("host").alias("key"))
            .union(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)))
            .union(hosts.where(F.col("dir") != "").select(F.concat("host", F.lit("/"), "dir", F.lit("/"))))
            .where(F.col("key") != "").distinct().where(_digit(F.col("key"), 1) < 6))
    day = F.date_add(F.lit("2021-01-01").cast("date"), (48 * _digit(F.col("key"), 2) + _digit(F.col("key"), 3)).cast("int"))
    name = F.when(_digit(F.col("key"), 4) < 4, "allow").otherwise("block")
    turns = F.array(
        F.struct(day.alias("day"), F.lit("add").alias("action")),
        F.struct(F.when(_digit(F.col("key"), 5) < 10, F.date_add(day, (30 + 20 * _digit(F.col("key"), 6)).cast("int"))).alias("day"), F.lit("remove").alias("action")),
        F.struct(F.when(_digit(F.col("key"), 5) < 5, F.date_add(day, (90 + 20 * _digit(F.col("key"), 6)).cast("int"))).alias("day"), F.lit("add").alias("action")))
    return (keys.select("key", name.alias("list"), F.explode(turns).alias("turn"))
            .select("key", "list", "turn.day", "turn.action").where(F.col("day").isNotNull()))


def _d(text: str, place: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5({text}), {place}, 1)) - 1)"


_HOST = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"

_SQL = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, (DATE '2021-01-01' + (64 * {_d('page_id::VARCHAR', 1)} + 4 * {_d('page_id::VARCHAR', 2)}
             + {_d('page_id::VARCHAR', 3)} // 4)::INTEGER)::DATE AS fetched_on FROM pages),
keys AS (SELECT DISTINCT key FROM (
    SELECT host AS key FROM p
    UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM p
    UNION ALL SELECT host || '/' || regexp_extract(url, '://[^/?#]+/([^/?#]+)/', 1) || '/' FROM p
              WHERE regexp_extract(url, '://[^/?#]+/([^/?#]+)/', 1) <> '') WHERE key <> '' AND {_d('key', 1)} < 6),
k AS (SELECT key, CASE WHEN {_d('key', 4)} < 4 THEN 'allow' ELSE 'block' END AS list,
        (DATE '2021-01-01' + (48 * {_d('key', 2)} + {_d('key', 3)})::INTEGER)::DATE AS day, {_d('key', 5)} AS e, {_d('key', 6)} AS g FROM keys),
iv AS (SELECT key, list, day AS since, CASE WHEN e < 10 THEN (day + (30 + 20 * g)::INTEGER)::DATE END AS until FROM k
       UNION ALL SELECT key, list, (day + (90 + 20 * g)::INTEGER)::DATE, NULL FROM k WHERE e < 5),
m AS (SELECT page_id, key, list, since, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC) AS rn
      FROM p JOIN iv ON since <= fetched_on AND (until IS NULL OR fetched_on < until)
       AND (host = key OR ends_with(host, '.' || key) OR starts_with(host || regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)', 1) || '/', key) AND contains(key, '/')))
SELECT p.page_id, p.url, p.fetched_on, m.key AS decided_by, m.list AS decided_list, m.since AS listed_since,
       coalesce(m.list = 'block', false) AS blocked
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.rn = 1"""


@query("op2_url_lists", _SQL)
def op2_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(fetches(pages), dated_entries(pages))
