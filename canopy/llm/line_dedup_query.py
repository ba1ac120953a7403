"""op1: line dedup over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.llm.line_dedup import dedup_lines
from canopy.llm.registry import query
from canopy.sources.tables import table

_KEY = r"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

#: Steps of the SQL form, used by the pipeline's SQL as well: ``{src}`` is the table of documents.
LINES_SQL = f"""
  SELECT doc_id, pos, line, {_KEY} AS key
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{src}}))"""

REPEATED_SQL = """
  SELECT key, max(doc_id) AS keeper FROM {lines} WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5"""


@query("op1_line_dedup", f"""
WITH lines AS ({LINES_SQL.format(src='documents')}),
rep AS ({REPEATED_SQL.format(lines='lines')}),
marked AS (SELECT l.*, (r.key IS NOT NULL AND l.doc_id <> r.keeper) AS gone FROM lines l LEFT JOIN rep r ON l.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
