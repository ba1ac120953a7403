"""Hierarchy queries (H1-H13) on ``part`` as a tree: id = p_partkey, parent = p_partkey div 2.

The row with p_partkey 0 has parent 0, i.e. no parent and no start element: its path is NULL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import paths as P
from canopy.operators import hierarchy as H
from canopy.plans.registry import query
from canopy.sources.tables import table


def part_tree(spark, sf_dir, divisor: int = 2):
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_size", F.expr(f"p_partkey div {divisor}").alias("parent"))


def part_hier(spark, sf_dir):
    return H.refresh_hierarchy(part_tree(spark, sf_dir), "p_partkey", "parent", no_cycle=0)


def _tree_cte(divisor: int = 2) -> str:
    return f"""
WITH RECURSIVE t AS (
  SELECT p_partkey AS id, p_name, p_size,
         CASE WHEN p_partkey // {divisor} = 0 THEN NULL ELSE p_partkey // {divisor} END AS par
  FROM part),
walk(node, head, path) AS (
  SELECT id, id, [id] FROM t WHERE id <> 0
  UNION ALL
  SELECT w.node, t.par, list_prepend(t.par, w.path)
  FROM walk w JOIN t ON t.id = w.head
  WHERE t.par IS NOT NULL AND t.par <> t.id),
best AS (SELECT node, arg_max(path, len(path)) AS path FROM walk GROUP BY node),
h AS (SELECT t.id AS p_partkey, t.p_name, t.par, b.path FROM t LEFT JOIN best b ON b.node = t.id)
"""


TREE = _tree_cte(2)


@query("H1", TREE + """
SELECT p_partkey, array_to_string(path, '/') AS hier_path,
       CASE WHEN p_partkey = 0 THEN true
            ELSE NOT EXISTS (SELECT 1 FROM t c WHERE c.par = h.p_partkey) END AS hier_leaf
FROM h""")
def h1(spark, sf_dir):
    return part_hier(spark, sf_dir).select(
        "p_partkey", F.array_join("__hier", "/").alias("hier_path"), F.col("__hier_leaf").alias("hier_leaf"))


@query("H2", _tree_cte(3) + """
SELECT p_partkey, array_to_string(path, '/') AS hier_path,
       CASE WHEN p_partkey = 0 THEN true
            ELSE NOT EXISTS (SELECT 1 FROM t c WHERE c.par = h.p_partkey) END AS hier_leaf
FROM h""")
def h2(spark, sf_dir):
    out = H.refresh_hierarchy_unsafe(part_tree(spark, sf_dir, 3), "p_partkey", "parent", no_cycle=1,
                                     max_levels=20, hierarchy_number=2)
    return out.select("p_partkey", F.array_join("__hier2", "/").alias("hier_path"),
                      F.col("__hier_leaf2").alias("hier_leaf"))


@query("H3", TREE + """
SELECT p_partkey, len(path) AS lvl,
       list_position(list_reverse(path), 3) AS lvl_from_3
FROM h""")
def h3(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.get_level("__hier").alias("lvl"), P.get_level("__hier", 3).alias("lvl_from_3"))


@query("H4", TREE + """
SELECT p_partkey, path[1] AS root_node,
       CASE WHEN list_contains(path, 3) THEN 3 END AS root_3
FROM h""")
def h4(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.root_id("__hier").alias("root_node"),
                    P.root_id("__hier", F.lit(3).cast("bigint")).alias("root_3"))


@query("H5", TREE + """
SELECT p_partkey, array_to_string(path, ' then ') AS path_text,
       CASE WHEN list_contains(path, 3)
            THEN array_to_string(list_slice(path, list_position(path, 3), len(path)), '/') END AS path_from_3
FROM h""")
def h5(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.connect_by_path("__hier", " then ").alias("path_text"),
                    P.connect_by_path("__hier", "/", 3).alias("path_from_3"))


@query("H6", TREE + """
SELECT p_partkey,
       CASE WHEN len(path) >= 1 THEN path[len(path)] END AS up0,
       CASE WHEN len(path) >= 2 THEN path[len(path) - 1] END AS up1,
       CASE WHEN list_position(list_reverse(path), 3) - 1 >= 2 THEN path[len(path) - 2] END AS up2_from_3
FROM h""")
def h6(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.get_parent("__hier", 0).alias("up0"), P.get_parent("__hier", 1).alias("up1"),
                    P.get_parent("__hier", 2, 3).alias("up2_from_3"))


@query("H7", TREE + """
SELECT p_partkey, CASE WHEN path IS NOT NULL THEN list_contains(path, 3) END AS in_3 FROM h""")
def h7(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.is_subtree("__hier", 3).alias("in_3"))


@query("H8", TREE + """
SELECT p_partkey,
       CASE WHEN path IS NOT NULL THEN list_contains(path[1:len(path) - 1], 3) END AS in_3_strict
FROM h""")
def h8(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return h.select("p_partkey", P.is_subtree_strict("__hier", 3).alias("in_3_strict"))


CUSTOM_PRED = "<parent>.p_partkey = <child>.parent and <child>.p_size > 10"


def _custom_sql(start: str, with_leaf: bool) -> str:
    leaf = """, NOT EXISTS (SELECT 1 FROM r c JOIN b t ON t.p_partkey = c.p_partkey
                         WHERE t.parent = r.p_partkey AND t.p_size > 10) AS is_leaf""" if with_leaf else ""
    return f"""
WITH RECURSIVE b AS (SELECT p_partkey, p_name, p_size, p_partkey // 2 AS parent FROM part),
r(p_partkey, lvl, cbp, cbr) AS (
  SELECT p_partkey, 1, CAST(p_partkey AS VARCHAR), p_name FROM b WHERE {start}
  UNION ALL
  SELECT t.p_partkey, r.lvl + 1, r.cbp || '/' || CAST(t.p_partkey AS VARCHAR), r.cbr
  FROM r JOIN b t ON r.p_partkey = t.parent AND t.p_size > 10)
SELECT p_partkey, lvl{leaf}, cbp, cbr FROM r"""


@query("H9", _custom_sql("p_partkey = 1", True))
def h9(spark, sf_dir):
    out = H.custom_hierarchy(part_tree(spark, sf_dir), ["p_partkey"], CUSTOM_PRED,
                             start_condition="p_partkey = 1", connect_by_root=["p_name varchar"],
                             connect_by_path=[("p_partkey", "/")])
    return out.select("p_partkey", F.col("__level").alias("lvl"), F.col("__chier_leaf").alias("is_leaf"),
                      F.col("__cbp_p_partkey").alias("cbp"), F.col("__cbr_p_name").alias("cbr"))


@query("H10", _custom_sql("p_partkey IN (2, 3)", False))
def h10(spark, sf_dir):
    tree = part_tree(spark, sf_dir)
    start = tree.filter(F.col("p_partkey").isin(2, 3)).select("p_partkey")
    out = H.custom_hierarchy(tree, ["p_partkey"], CUSTOM_PRED, start_with=start,
                             connect_by_root=["p_name varchar"], connect_by_path=[("p_partkey", "/")], leaf=False)
    return out.select("p_partkey", F.col("__level").alias("lvl"),
                      F.col("__cbp_p_partkey").alias("cbp"), F.col("__cbr_p_name").alias("cbr"))


_SUBTREE_CTE = """
WITH RECURSIVE s(id) AS (
  SELECT CAST({v} AS BIGINT)
  UNION
  SELECT p.p_partkey FROM part p JOIN s ON p.p_partkey // 2 = s.id WHERE p.p_partkey <> s.id)
"""


@query("H11", _SUBTREE_CTE.format(v=3) + "SELECT id AS node FROM s")
def h11(spark, sf_dir):
    return H.subtree_nodes(part_tree(spark, sf_dir), "p_partkey", "parent", 3).select(F.col("id").alias("node"))


@query("H11_array", _SUBTREE_CTE.format(v=5) + """
SELECT array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS subtree FROM s""")
def h11_array(spark, sf_dir):
    out = H.subtree(part_tree(spark, sf_dir), "p_partkey", "parent", 5, limit=None)  # the whole list, as the SQL has it
    return out.select(F.array_join("subtree", ",").alias("subtree"))


@query("H12", TREE + """
SELECT h.p_partkey, u1.p_name AS p_name_up1, u2.p_name AS p_name_up2
FROM h
LEFT JOIN t u1 ON u1.id = CASE WHEN len(h.path) >= 2 THEN h.path[len(h.path) - 1] END
LEFT JOIN t u2 ON u2.id = CASE WHEN len(h.path) >= 3 THEN h.path[len(h.path) - 2] END""")
def h12(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    out = H.parent_values(h, "__hier", "p_partkey", "p_name", levels=(1, 2))
    return out.select("p_partkey", "p_name_up1", "p_name_up2")


@query("H13", TREE + """
SELECT p_partkey, list_position(list_reverse(path), 3) AS rel_level
FROM h WHERE list_contains(path, 3)""")
def h13(spark, sf_dir):
    h = part_hier(spark, sf_dir)
    return H.subtree_scan(h, "__hier", 3).select("p_partkey", "rel_level")
