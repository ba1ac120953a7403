"""Goldens of the hierarchy operators (FIXTURES.md section 2) and the doubling walk against a level loop."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.functions import paths as P
from canopy.operators import hierarchy as H

TREE = [(1, None, "one"), (2, 1, "two"), (3, 1, "three"), (4, 2, "four"), (5, 2, "five"), (6, 3, "six")]


@pytest.fixture()
def tree(spark):
    return spark.createDataFrame(TREE, "isn long, parentisn long, value string")


def test_tree_paths_and_helpers(tree):
    h = H.refresh_hierarchy(tree, "isn", "parentisn")
    rows = {r["isn"]: r for r in h.select(
        "isn", "__hier", "__hier_leaf", P.get_level("__hier").alias("lvl"), P.get_level("__hier", 2).alias("lvl2"),
        P.root_id("__hier", 2).alias("root2"), P.connect_by_path("__hier", " then ", 2).alias("path2"),
        P.connect_by_path("__hier", " then ").alias("path"), P.get_parent("__hier", 1).alias("up1"),
        P.get_parent("__hier", 2).alias("up2"), P.is_subtree("__hier", 2).alias("in2"),
        P.is_subtree_strict("__hier", 2).alias("in2s")).collect()}
    assert [rows[i]["__hier"] for i in range(1, 7)] == [[1], [1, 2], [1, 3], [1, 2, 4], [1, 2, 5], [1, 3, 6]]
    assert [rows[i]["__hier_leaf"] for i in range(1, 7)] == [False, False, False, True, True, True]
    assert [rows[i]["lvl"] for i in range(1, 7)] == [1, 2, 2, 3, 3, 3]
    assert [rows[i]["lvl2"] for i in range(1, 7)] == [None, 1, None, 2, 2, None]
    assert [rows[i]["root2"] for i in range(1, 7)] == [None, 2, None, 2, 2, None]
    assert [rows[i]["path2"] for i in range(1, 7)] == [None, "2", None, "2 then 4", "2 then 5", None]
    assert rows[6]["path"] == "1 then 3 then 6"
    assert [rows[i]["up1"] for i in range(1, 7)] == [None, 1, 1, 2, 2, 3]
    assert [rows[i]["up2"] for i in range(1, 7)] == [None, None, None, 1, 1, 1]
    assert [rows[i]["in2"] for i in range(1, 7)] == [False, True, False, True, True, False]
    assert [rows[i]["in2s"] for i in range(1, 7)] == [False, False, False, True, True, False]


def test_edge_rules(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (3, 3, 3), (4, 4, 99), (5, 5, 4), (6, None, 2), (7, 0, 2)],
                               "pk int, id long, parent long")
    out = {r["pk"]: (r["__hier"], r["__hier_leaf"]) for r in H.refresh_hierarchy(df, "id", "parent").collect()}
    assert out == {1: ([1], False), 2: ([1, 2], True), 3: ([3], False), 4: ([99, 4], False),
                   5: ([99, 4, 5], True), 6: ([1, 2], False), 7: ([1, 2], True)}


def test_cycle_modes(spark):
    cyc = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long")
    with pytest.raises(H.HierarchyError, match="Cycle"):
        H.refresh_hierarchy(cyc, "id", "parent").collect()
    out = {r["id"]: r["__hier"] for r in H.refresh_hierarchy(cyc, "id", "parent", no_cycle=1).collect()}
    assert out == {1: [3, 2, 1], 2: [1, 3, 2], 3: [2, 1, 3], 4: [3, 2, 1, 4]}


def test_depth_limit(spark):
    ok = spark.range(1, 102).selectExpr("id", "id - 1 AS parent")
    deepest = H.refresh_hierarchy(ok, "id", "parent").agg(F.max(F.size("__hier"))).first()[0]
    assert deepest == 101
    bad = spark.range(1, 103).selectExpr("id", "id - 1 AS parent")
    with pytest.raises(H.HierarchyError):
        H.refresh_hierarchy(bad, "id", "parent").collect()
    assert H.refresh_hierarchy_unsafe(bad, "id", "parent", 0, 150).count() == 102
    with pytest.raises(H.HierarchyError):
        H.refresh_hierarchy_unsafe(ok, "id", "parent", 0, 50).collect()


def test_hierarchy_number_names(tree):
    h = H.refresh_hierarchy(tree, "isn", "parentisn", hierarchy_number=3)
    assert h.columns[-2:] == ["__hier3", "__hier_leaf3"]


def _level_loop(rows, no_cycle):
    """Brute force of the reference: paths grow one parent per step."""
    parent = {}
    for i, p in rows:
        if i not in (None, 0) and p not in (None, 0) and p != i:
            parent[i] = min(parent.get(i, p), p)
    out = []
    for i, p in rows:
        p = None if p == 0 else p
        start = i if i not in (None, 0) else p
        if start is None:
            out.append(None)
            continue
        path = [start]
        while path[0] in parent:
            nxt = parent[path[0]]
            if nxt in path:
                break
            path.insert(0, nxt)
        out.append(path)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_doubling_matches_level_loop(spark, seed):
    rnd = random.Random(seed)
    n = 300
    rows = []
    for i in range(1, n + 1):
        p = rnd.choice([0, None] + [rnd.randint(1, i - 1) if i > 1 else 0] * 6 + [rnd.randint(1, n + 20)])
        rows.append((i, p))
    rows += [(None, 5), (0, 7), (12, 3)]  # NULL id, id 0, duplicate id
    df = spark.createDataFrame([(k, i, p) for k, (i, p) in enumerate(rows)], "k int, id long, parent long")
    got = {r["k"]: r["__hier"] for r in H.refresh_hierarchy(df, "id", "parent", no_cycle=1).collect()}
    want = _level_loop(rows, 1)
    assert [got[k] for k in range(len(rows))] == want


def test_custom_hierarchy_goldens(tree):
    pred = "<parent>.isn = <child>.parentisn and <child>.value like '%o%'"
    a = H.custom_hierarchy(tree, ["isn"], pred, start_with=tree.filter("isn = 1").select("isn"),
                           connect_by_root=["value varchar"], connect_by_path=[("value", "#")])
    assert a.columns == ["isn", "parentisn", "value", "__level", "__chier_leaf", "__cbp_value", "__cbr_value"]
    got = sorted((r["isn"], r["__level"], r["__chier_leaf"], r["__cbr_value"], r["__cbp_value"]) for r in a.collect())
    assert got == [(1, 1, False, "one", "one"), (2, 2, False, "one", "one#two"), (4, 3, True, "one", "one#two#four")]
    b = H.custom_hierarchy(tree, ["isn"], pred, start_condition="isn = 2",
                           connect_by_root=["value varchar"], connect_by_path=[("value", "#")])
    got = sorted((r["isn"], r["__level"], r["__chier_leaf"], r["__cbr_value"], r["__cbp_value"]) for r in b.collect())
    assert got == [(2, 1, False, "two", "two"), (4, 2, True, "two", "two#four")]
    with pytest.raises(ValueError):
        H.custom_hierarchy(tree, ["isn"], pred)
    old = H.custom_hierarchy(tree, ["isn"], pred, start_condition="isn = 2", leaf=False)
    assert "__chier_leaf" not in old.columns


def test_custom_hierarchy_reached_twice_in_one_step(spark):
    # node 3 has two parents in the frontier of the same step: it appears twice
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id long, p long")
    pred = "<child>.id = 3 and <parent>.id <> 3"
    with pytest.raises(H.HierarchyError, match="no equality"):
        H.custom_hierarchy(df, ["id"], pred, start_condition="id in (1, 2)")
    out = H.custom_hierarchy(df, ["id"], pred, start_condition="id in (1, 2)", allow_pairs=True)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3, 3]


def test_subtree(tree):
    assert H.subtree(tree, "isn", "parentisn", 1).first()["subtree"] == ["1", "2", "3", "4", "5", "6"]
    assert H.subtree(tree, "isn", "parentisn", 2).first()["subtree"] == ["2", "4", "5"]
    assert H.subtree(tree, "isn", "parentisn", 4).first()["subtree"] == ["4"]
    assert H.subtree(tree, "isn", "parentisn", 42).first()["subtree"] == ["42"]


def test_subtree_text_order_and_limit(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (10, 1)], "id long, p long")
    assert H.subtree(df, "id", "p", 1).first()["subtree"] == ["1", "10", "2"]
    with pytest.raises(H.HierarchyError):
        H.subtree(df, "id", "p", 1, limit=2).collect()


def test_subtree_cycle_safe(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, p long")
    assert sorted(r["id"] for r in H.subtree_nodes(df, "id", "p", 1).collect()) == [1, 2, 3]


def test_parent_values_and_subtree_scan(tree):
    h = H.refresh_hierarchy(tree, "isn", "parentisn")
    pv = {r["isn"]: (r["value_up1"], r["value_up2"]) for r in H.parent_values(h, "__hier", "isn", "value").collect()}
    assert pv[4] == ("two", "one") and pv[1] == (None, None)
    sc = {r["isn"]: r["rel_level"] for r in H.subtree_scan(h, "__hier", 2).collect()}
    assert sc == {2: 1, 4: 2, 5: 2}


def test_api_parity_options(spark, tree, tmp_dir):
    h = H.refresh_hierarchy(tree, "isn", "parentisn", id_type="int", index_level=3)
    assert h.schema["__hier"].dataType.elementType.typeName() == "integer"
    pred = "<parent>.isn = <child>.parentisn"
    out = H.custom_hierarchy(tree, ["isn"], pred, start_condition="isn = 1", output_path=tmp_dir + "/ch")
    assert out.count() == 6
    again = H.custom_hierarchy(tree, ["isn"], pred, start_condition="isn = 3", output_path=tmp_dir + "/ch")
    assert sorted(r["isn"] for r in again.collect()) == [3, 6]  # replaced, not appended


def test_hot_parent_star(spark):
    # a third of all nodes hang under one parent: the hot key of the joins
    n = 3000
    rows = [(i, 1 if i <= n // 3 else i // 2) for i in range(2, n + 1)] + [(1, 0)]
    df = spark.createDataFrame(rows, "id long, parent long")
    got = {r["id"]: r["__hier"] for r in H.refresh_hierarchy(df, "id", "parent").collect()}
    assert got == dict(zip([i for i, _ in rows], _level_loop(rows, 0)))


def test_hot_parent_without_adaptive_execution(spark):
    """A third of all nodes under one parent: answered from the broadcast table, and children of a hot parent lie apart."""
    n = 6000
    rows = [(i, 1 if i <= n // 3 else i // 2) for i in range(2, n + 1)] + [(1, 0)]
    df = spark.createDataFrame(rows, "id long, parent long").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["id"]: r["__hier"] for r in H.refresh_hierarchy(df, "id", "parent").collect()}
        assert got == dict(zip([i for i, _ in rows], _level_loop(rows, 0)))
        base = H._DealtBase(df, ["parent"])
        assert base.hot_keys == [(1,)] and base.hot.count() == n // 3 - 1 and base.cold.count() == n - base.hot.count()
        base.forget()
        out = H.custom_hierarchy(df, ["id"], "<parent>.id = <child>.parent", start_condition="id = 1", connect_by_path=[("id", "/")])
        assert {r["id"]: r["__cbp_id"] for r in out.collect()} == {k: "/".join(map(str, v)) for k, v in got.items()}
        assert H.subtree_nodes(df, "id", "parent", 1).count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_round_writes_open_chains_only(spark):
    df = spark.range(1, 2000).selectExpr("id AS x", "id div 2 AS p").where("p > 0")
    chains = H._Chains(spark, 101)
    chains.put(df.selectExpr("x", "array(x) AS seg", "p AS nxt"))
    written = [chains.open]
    while chains.open:
        before = chains.closed().count()
        chains.put(H._step(chains.frontier(), chains.closed().unionByName(chains.frontier()), chains.open))
        written.append(chains.closed().count() - before + chains.open)
    assert written == sorted(written, reverse=True) and written[-1] < written[0] and chains.closed().count() == df.count()


def test_walks_are_cut_before_the_first_repeat(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 1, 3],), ([5, 5],), ([4],), ([1, 2, 3, 2, 1],)], "seg array<int>")
    assert [r[0] for r in df.select(H._first_repeat_cut(F.col("seg"))).collect()] == [[1, 2, 3], [1, 2], [5], [4], [1, 2, 3]]


@pytest.mark.parametrize("steps", [1, 4])
@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_levels_are_the_same_whatever_the_layout(spark, monkeypatch, steps, limit):
    """One level a job over a dealt base, or several over a broadcast one; cycles, two ways of different length, repeated visits."""
    rng = random.Random(3)
    edges = [(i, rng.randint(1, 60), rng.choice("ab{}'")) for i in range(2, 61)] + [(1, 9, "a"), (100, 1, "x"), (100, 2, "y")]
    df = spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "k int, id long, p long, v string")
    monkeypatch.setattr(H, "SMALL_STEPS", steps)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = H.custom_hierarchy(df, ["k"], "<parent>.id = <child>.p and <child>.v <> '{'", start_condition="id = 1",
                                 connect_by_path=[("v", "'{}")], connect_by_root=["k int"])
        got = sorted((r["k"], r["__level"], r["__cbp_v"], r["__cbr_k"], r["__chier_leaf"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = {k: e for k, e in enumerate(edges)}
    level, seen, want = [(k, e[2], k) for k, e in rows.items() if e[0] == 1], set(), []
    n = 1
    while level:
        want += [(k, n, path, root) for k, path, root in level]
        seen |= {k for k, _, _ in level}
        level = [(c, path + "'{}" + e[2], root) for k, path, root in level for c, e in rows.items()
                 if e[1] == rows[k][0] and e[2] != "{" and c not in seen]
        n += 1
    inner = {k for k, *_ in want if any(rows[c][1] == rows[k][0] and rows[c][2] != "{" for c, *_ in want)}
    assert got == sorted((k, n, path, root, k not in inner) for k, n, path, root in want)


def test_subtree_array_of_a_whole_large_table(spark, tmp_dir):
    """The registered query returns subtrees of more than the 100,000 ids that the operator's default allows."""
    from canopy.plans.hier import h11_array
    n = 520_000
    spark.range(n).selectExpr("id AS p_partkey", "'x' AS p_name", "1 AS p_size").write.parquet(f"{tmp_dir}/part.parquet")
    want, level = [], [5]
    while level:
        want += level
        level = [c for i in level for c in (2 * i, 2 * i + 1) if c < n]
    assert len(want) > H.SUBTREE_ARRAY_LIMIT
    assert [r[0] for r in h11_array(spark, tmp_dir).collect()] == [",".join(sorted(map(str, want)))]


@pytest.mark.parametrize("small", [100_000, 10])
def test_large_levels_and_bases_are_not_broadcast(spark, monkeypatch, small):
    """Above the bounds in rows no base, level or visited set goes through the driver, though all are small in bytes."""
    df = spark.range(1, 200).selectExpr("id", "id div 2 AS p", "CAST(id % 7 AS string) AS v")
    want = sorted((i, i.bit_length(), 2 * i > 199, "/".join(str(i >> k) for k in range(i.bit_length() - 1, -1, -1))) for i in range(1, 200))
    expand, plans = H._expand, []

    def kept(*args):
        found = expand(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(H, "SMALL_ROWS", small, raising=False)
    monkeypatch.setattr(H, "FEW_ROWS", 0 if small == 10 else 10_000, raising=False)
    monkeypatch.setattr(H, "_expand", kept)
    out = H.custom_hierarchy(df, ["id"], "<parent>.id = <child>.p", start_condition="id = 1", connect_by_path=[("id", "/")])
    assert sorted((r["id"], r["__level"], r["__chier_leaf"], r["__cbp_id"]) for r in out.collect()) == want
    assert any("Broadcast" in p for p in plans) == (small != 10)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() or small != 10
    assert sorted(r["id"] for r in H.subtree_nodes(df, "id", "p", 1).collect()) == list(range(1, 200))
