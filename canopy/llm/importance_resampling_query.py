"""op11: importance resampling of ``documents`` towards ``benchmark``."""

from __future__ import annotations

from canopy.llm.importance_resampling import resample
from canopy.llm.registry import query
from canopy.sources.tables import table

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by its rule, as DuckDB has no such function: a table of 256 entries by eight shifts each, then one step a byte.
CRC_TABLE = """
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab"""


def crc32(words: str, column: str) -> str:
    """SQL for ``(column, crc)`` over the distinct values of ``column`` in the table ``words``."""
    return f"""
  SELECT {column}, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, octet_length(encode({column})) + 1),
           lambda i: ('0x' || substr(hex(encode({column})), 2 * i - 1, 2))::UBIGINT)),
           lambda c, b: xor(tab[(xor(c, b) % 256)::BIGINT + 1], c // 256)), 4294967295) AS crc
  FROM (SELECT DISTINCT {column} FROM {words}), (SELECT list_transform(tab, lambda x: x) AS tab FROM crc_table)"""


@query("op11_importance_resampling", rf"""
WITH crc_table AS ({CRC_TABLE}),
d AS (SELECT doc_id, {LOWERED.join(("regexp_extract_all(", r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"))} AS w FROM documents),
b AS (SELECT {LOWERED.join(("regexp_extract_all(", r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"))} AS w FROM benchmark),
fd AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
every AS (SELECT f FROM fd UNION SELECT f FROM fb),
dealt AS (SELECT f, crc % 10000 AS bucket FROM ({crc32('every', 'f')})),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN dealt USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN dealt USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM fd) AS all_s, (SELECT count(*) FROM fb) AS all_t),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
                                        / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
          FROM (SELECT DISTINCT bucket FROM dealt) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
total AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
          FROM fd JOIN dealt USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5)
                                                              / 4294967296)))::BIGINT AS score
           FROM d LEFT JOIN total USING (doc_id)),
entered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN entered USING (doc_id)""")
def op11_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
