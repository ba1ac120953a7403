"""op13: spelling variants in the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.importance_resampling_query import CRC_TABLE, crc32
from canopy.llm.line_dedup import lower_ascii
from canopy.llm.registry import query
from canopy.llm.spelling import spelling_forms
from canopy.sources.tables import table

#: Words of the contract: at least so many code points and occurrences; one run in 31 loses a letter.
LEAST_LETTERS, LEAST_COUNT, SLIP = 7, 2, 31


def counted_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the runs of letters, each of which loses a letter by the hash of its document and itself.

    Runs with fewer than ``LEAST_LETTERS`` letters can't become words, so only longer ones leave the texts.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS), F.lit(0))
    owner = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    words = docs.select(owner.alias("owner"), F.explode(runs).alias("run")).select("owner", lower_ascii(F.col("run")).alias("run"))
    hashed = words.withColumn("h", F.crc32(F.concat("owner", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return (hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


@query("op13_spelling", rf"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7),
keyed AS (SELECT doc_id::VARCHAR || ':' || r AS k, r FROM runs),
hashed AS ({crc32('keyed', 'k')}),
words AS (SELECT w, count(*) AS n
          FROM (SELECT CASE WHEN crc % 31 = 0 THEN left(r, (crc % length(r))::BIGINT) || substr(r, (crc % length(r))::BIGINT + 2) ELSE r END AS w
                FROM keyed JOIN hashed USING (k)) WHERE length(w) >= 7 GROUP BY w HAVING count(*) >= 2),
spots AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words),
cut AS (SELECT w, n, i, left(w, i - 1) AS head, substr(w, i + 1) AS tail FROM spots),
shorter AS (SELECT DISTINCT c.w AS a, o.w AS b, o.n AS bn, c.n AS an FROM cut c JOIN words o ON o.w = c.head || c.tail),
near AS (SELECT x.w AS w, y.w AS o, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.w <> y.w
         UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY m DESC, o COLLATE C) AS o, max(m) AS m FROM near GROUP BY w),
forms AS (SELECT w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN o END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
          FROM words LEFT JOIN best USING (w)),
chain AS (SELECT word, word AS at, form AS next FROM forms
          UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, form, c.at AS root, n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL""")
def op13_spelling(spark, sf_dir):
    return spelling_forms(counted_words(table(spark, sf_dir, "documents")))
