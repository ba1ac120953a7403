"""Hierarchy operators (H1, H2, H9-H13) as Spark jobs.

``refresh_hierarchy`` (H1/H2) builds a root-first path array per row by **pointer doubling**:
the parent map is a function (one parent per id), so each round joins the open nodes with the
node table on ``next = id`` and doubles the covered chain. ceil(log2(levels)) shuffle joins cover
the 100-level limit instead of one join per level. A round writes the nodes that are still open, and those it has closed once.

``custom_hierarchy`` (H9/H10) and ``subtree`` (H11) expand level by level, since their
predicate can be any join condition; the visited set is an anti join against the written output.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from canopy import store
from canopy.session import scratch_path, written

HIER_DEPTH_LIMIT = 100        # levels of H1 / H9 (a path may hold limit + 1 elements)
SUBTREE_ARRAY_LIMIT = 100000  # H11 array form
HOT_FROM = 100_000            # open chains from which hot ancestors are looked for
SMALL_STEPS = 4               # levels that one job expands while the base is small enough to be broadcast
SMALL_ROWS = 100_000          # a base of more rows is dealt, whatever its size in bytes: each job would send it through the driver
FEW_ROWS = 10_000             # levels and visited rows above this are joined by a shuffle, as a broadcast is sent through the driver


class HierarchyError(RuntimeError):
    pass


def _hier_names(hierarchy_number: int | None) -> tuple[str, str]:
    if hierarchy_number is None or hierarchy_number == 1:
        return "__hier", "__hier_leaf"
    return f"__hier{hierarchy_number}", f"__hier_leaf{hierarchy_number}"


def _first_repeat_cut(seg: Column) -> Column:
    """Cut a bottom-up walk before its first repeated element: the distinct elements keep their order, and they are the walk
    up to the first place where the two differ."""
    distinct = F.array_distinct(seg)
    differ = F.array_position(F.zip_with(seg, distinct, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, seg).otherwise(F.slice(seg, 1, (differ - 1).cast("int")))


def _has_repeat(seg: Column) -> Column:
    return F.size(F.array_distinct(seg)) < F.size(seg)


class _Chains:
    """The state of pointer doubling in the shared folder. A round writes the nodes that it has moved on: those whose chain is
    complete go to ``open=false`` and are never written again, the others are the next round's frontier."""

    def __init__(self, spark, max_len: int):
        self.spark, self.max_len, self.folder, self.rounds = spark, max_len, scratch_path(spark, "chains"), 0
        self.open = self.cyclic = 0

    def put(self, df: DataFrame) -> None:
        """Writes ``(x, seg, nxt)`` rows; the counts come from the write."""
        repeat = _has_repeat(F.col("seg"))
        self.schema = df.schema
        df = df.withColumn("open", F.col("nxt").isNotNull() & ~repeat & (F.size("seg") <= self.max_len))
        seen = Observation()
        counted = df.observe(seen, F.count_if("open").alias("open"), F.count_if(repeat).alias("cyclic"))
        counted.write.partitionBy("open").parquet(f"{self.folder}/{self.rounds}")
        self.rounds += 1
        self.open, self.cyclic = seen.get["open"], self.cyclic + seen.get["cyclic"]

    def _read(self, rounds, is_open: bool) -> DataFrame:
        found = [p for k in rounds if store.exists(self.spark, p := f"{self.folder}/{k}/open={str(is_open).lower()}")]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)

    def frontier(self) -> DataFrame:
        return self._read([self.rounds - 1], True)

    def closed(self) -> DataFrame:
        return self._read(range(self.rounds), False)


def _step(frontier: DataFrame, nodes: DataFrame, n_open: int) -> DataFrame:
    """Each chain of the frontier goes on with the chain of the node it points at.

    Nodes that many chains point at (one chain in ``4 * partitions``, so at most that many nodes) are answered from a
    broadcast table: a hot ancestor is no key of the shuffle."""
    spark = frontier.sparkSession
    right = nodes.select(F.col("x").alias("rx"), F.col("seg").alias("rseg"), F.col("nxt").alias("rnxt"))
    share, hot = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), []
    if n_open > HOT_FROM:  # a smaller frontier is no burden for one task
        hot = [r[0] for r in frontier.groupBy("nxt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n_open // share).collect()]
    joined = frontier.where(~F.col("nxt").isin(hot)).join(right, F.col("nxt") == F.col("rx"), "left") if hot else frontier.join(
        right, F.col("nxt") == F.col("rx"), "left")
    if hot:
        few = right.where(F.col("rx").isin(hot))
        joined = joined.unionByName(frontier.where(F.col("nxt").isin(hot)).join(F.broadcast(few), F.col("nxt") == F.col("rx"), "left"))
    end = F.col("rx").isNull()
    return joined.select("x", F.when(end, F.concat("seg", F.array("nxt"))).otherwise(F.concat("seg", "rseg")).alias("seg"),
                         F.when(~end, F.col("rnxt")).alias("nxt"))


def node_paths(edges: DataFrame, max_levels: int = HIER_DEPTH_LIMIT, no_cycle: int = 0) -> DataFrame:
    """Paths for every node of a parent function.

    ``edges`` has columns ``(x, p)``: one row per node ``x`` with its parent ``p`` (no NULLs,
    no self-loops). Returns ``(x, path)`` with ``path`` root-first. A parent without an edge row
    ends the chain as its root.
    """
    max_len = max_levels + 1
    chains = _Chains(edges.sparkSession, max_len)
    chains.put(edges.select(F.col("x"), F.array(F.col("x")).alias("seg"), F.col("p").alias("nxt")))
    while chains.open:
        chains.put(_step(chains.frontier(), chains.closed().unionByName(chains.frontier()), chains.open))
        if no_cycle == 0 and chains.cyclic:
            raise HierarchyError("Cycle found in the table")
    state = chains.closed()
    walk = _first_repeat_cut(F.col("seg")) if no_cycle > 0 else F.col("seg")
    done = state.select("x", "nxt", walk.alias("walk"), _has_repeat(F.col("seg")).alias("cyc"))
    too_deep = done.filter((F.size("walk") > max_len) | (F.col("nxt").isNotNull() & ~F.col("cyc"))).limit(1).count()
    if too_deep:
        raise HierarchyError(f"hierarchy depth increased {max_levels} levels. Check it manually")
    return done.select("x", F.reverse("walk").alias("path"))


def refresh_hierarchy(df: DataFrame, id_col: str, parent_col: str, no_cycle: int = 0,
                      hierarchy_number: int | None = None, max_levels: int = HIER_DEPTH_LIMIT,
                      primary_key: list[str] | None = None, id_type: str | None = None,
                      index_level: int | None = None) -> DataFrame:
    """H1 (H2 with ``max_levels``). Returns ``df`` with ``__hier`` (root-first path) and ``__hier_leaf``.

    Rules kept: parent 0 counts as NULL; the path starts at the id, or at the parent when the id
    is 0/NULL; a self-loop is a root; a dangling parent is the root of its chain; duplicate ids
    take the smallest parent; leaf = no child row, or a child row whose id is NULL.
    ``primary_key`` is accepted for API parity: rows are rebuilt, not updated, so it is not needed.
    ``id_type`` (e.g. ``'bigint'``) casts id and parent, and so the path elements, to that type.
    ``index_level`` was a physical hint (reorganise and index at that level); here every doubling
    round is checkpointed instead, so it has no effect.
    """
    if id_type:
        df = df.withColumn(id_col, F.col(id_col).cast(id_type)).withColumn(parent_col, F.col(parent_col).cast(id_type))
    hier, leaf = _hier_names(hierarchy_number)
    rid, rpar = F.col(id_col), F.col(parent_col)
    parent = F.when(rpar != 0, rpar)
    start = F.when(F.coalesce(rid, F.lit(0)) != 0, rid).when(F.coalesce(rpar, F.lit(0)) != 0, rpar)
    base = df.withColumn("__par", parent).withColumn("__start", start)

    edges = (base.filter(rid.isNotNull() & (rid != 0) & F.col("__par").isNotNull() & (F.col("__par") != rid))
             .groupBy(rid.alias("x")).agg(F.min("__par").alias("p")))
    paths = node_paths(edges, max_levels=max_levels, no_cycle=no_cycle)
    children = (base.filter(F.col("__par").isNotNull())
                .groupBy(F.col("__par").alias("x"))
                .agg(F.max(rid.isNull()).alias("__null_child")))
    nodes = (paths.join(children, "x", "full")
             .select(F.col("x").alias("__node"), F.col("path").alias("__path"), "__null_child"))

    out = base.join(nodes, F.col("__start") == F.col("__node"), "left")
    path = F.when(F.col("__start").isNotNull(), F.coalesce(F.col("__path"), F.array(F.col("__start"))))
    is_leaf = (F.when(rid.isNull(), F.lit(False))
               .when(rid == 0, F.lit(True))
               .otherwise(F.coalesce(F.col("__null_child"), F.lit(True))))
    return out.select(*df.columns, path.alias(hier), is_leaf.alias(leaf))


def refresh_hierarchy_unsafe(df: DataFrame, id_col: str, parent_col: str, no_cycle: int, max_levels: int,
                             hierarchy_number: int | None = None, primary_key: list[str] | None = None,
                             id_type: str | None = None, index_level_period: int | None = None) -> DataFrame:
    """H2: H1 with a caller-set depth limit (``index_level_period`` is a physical hint, see H1)."""
    return refresh_hierarchy(df, id_col, parent_col, no_cycle=no_cycle, hierarchy_number=hierarchy_number,
                             max_levels=max_levels, primary_key=primary_key, id_type=id_type)


class _Levels:
    """The levels of an expansion, each written once as Parquet into the shared folder. All of them are one scan that
    reads only the columns in use, and the planner knows the size of the last: it broadcasts a small frontier, so that
    the base is streamed and not shuffled. The rows of the last and of all are known; above ``FEW_ROWS`` none is broadcast."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.folder = scratch_path(self.spark, "levels")
        self.paths: list[str] = []
        self.written = self.rows = self.last_rows = 0
        self.add(df)

    def add(self, df: DataFrame) -> bool:
        """Writes a level; False if it holds no row. The rows are counted while they are written."""
        seen = Observation()
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        if self.paths and not seen.get["n"]:
            return False
        self.paths.append(path)
        self.last_rows = seen.get["n"]
        self.rows += self.last_rows
        return True

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class _DealtBase:
    """The base of an expansion, dealt once by the child's side of the predicate's equalities: written as a bucketed table, so that
    no level shuffles it. A large frontier is shuffled to the buckets, a small one is broadcast and the base is streamed.

    Children of a hot parent (one child in ``4 * buckets``, so at most that many parents) would fill a bucket: they lie in a plain
    table of their own, which the few frontier rows with such keys meet."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.spark, self.keys, self.names = df.sparkSession, keys, []
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = scratch_path(self.spark, "base")
        per = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
        total = df.agg(F.count(F.lit(1))).scalar()
        found = per.where((F.col("__n") > 1_000) & (F.col("__n") * (4 * self.buckets) > total)).drop("__n").collect()
        self.hot_keys = [tuple(r) for r in found if None not in tuple(r)]
        self.hot = None
        if self.hot_keys:
            df.where(self.is_hot(keys)).write.parquet(f"{folder}/hot")
            self.hot = self.spark.read.schema(df.schema).parquet(f"{folder}/hot")
            df = df.where(~F.coalesce(self.is_hot(keys), F.lit(False)))
        name = f"canopy_base_{folder.rsplit('-', 1)[1]}"
        df.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{folder}/cold").saveAsTable(name)
        self.names.append(name)
        self.cold = self.spark.table(name)

    def is_hot(self, columns: list[str]) -> Column:
        cond = F.lit(False)
        for key in self.hot_keys:
            one = F.lit(True)
            for c, v in zip(columns, key):
                one = one & (F.col(f"`{c}`") == F.lit(v))
            cond = cond | one
        return cond

    def forget(self) -> None:
        """Takes the bucketed table out of the catalog; its files stay in the scratch folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _is_small(df: DataFrame) -> bool:
    """Whether the planner, by bytes, would broadcast the table."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def _shuffled(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join that must not broadcast it if it has more than a few rows."""
    return df.hint("merge") if rows > FEW_ROWS else df


def _quoted(text: str) -> str:
    return "'" + _plain(text.replace("\\", "\\\\").replace("'", "\\'")) + "'"


def _plain(text: str) -> str:
    """Braces name tables in the statement; in other texts they are doubled."""
    return text.replace("{", "{{").replace("}", "}}")


def _expand(frontier: DataFrame, base: DataFrame, visited: DataFrame, primary_key: list[str], connect_by: str, columns: list[str],
            paths: list[tuple[str, str]], roots: list[str], level: int, steps: int, hint: str = "", visited_hint: str = "") -> DataFrame:
    """``steps`` levels from ``level`` on, below the rows of ``frontier`` in the level before, in one statement. ``hint`` is for the
    join of the frontier ``h`` with the base ``t``, ``visited_hint`` for the one with the visited rows ``v``.

    With several steps rows are reached along all walks, and of each row only the visits of its earliest level stay: a walk that
    goes on from a later visit reaches its rows one step after they were reached from the earlier one, so none of its rows
    stays either."""
    predicate = _plain(connect_by).replace("<parent>", "h").replace("<child>", "t")
    own = [f"t.`{_plain(c)}`" for c in columns] + ["<level> AS __level"]
    own += [f"concat(h.`__cbp_{f}`, {_quoted(d)}, coalesce(CAST(t.`{f}` AS STRING), '')) AS `__cbp_{f}`" for f, d in paths]
    own += [f"h.`__cbr_{r}`" for r in roots]
    same = " AND ".join(f"x.`{k}` = v.`{k}`" for k in primary_key)
    parts = [f"s{level - 1} AS (SELECT * FROM {{frontier}} WHERE __level = {level - 1})"]
    for n in range(level, level + steps):
        chosen = ", ".join(own).replace("<level>", str(n))
        joined = f"SELECT {hint}{chosen} FROM s{n - 1} h JOIN {{base}} t ON ({predicate})"
        parts.append(f"s{n} AS (SELECT {visited_hint}x.* FROM ({joined}) x LEFT ANTI JOIN {{visited}} v ON {same})")
    every = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(level, level + steps))
    if steps > 1:
        keys = ", ".join(f"`{k}`" for k in primary_key)
        every = f"SELECT * EXCEPT (__first) FROM (SELECT *, min(__level) OVER (PARTITION BY {keys}) AS __first FROM ({every})) WHERE __level = __first"
    return frontier.sparkSession.sql(f"WITH {', '.join(parts)} {every}", frontier=frontier, base=base, visited=visited)


_EQUALITY = re.compile(r"<(parent|child)>\.`?(\w+)`?\s*=\s*<(parent|child)>\.`?(\w+)`?", re.IGNORECASE)


def equal_columns(connect_by: str) -> tuple[list[str], list[str]]:
    """Columns of parent and child that the predicate sets equal. They only decide how the base is dealt."""
    parents, children = [], []
    for a, x, b, y in _EQUALITY.findall(connect_by):
        if a.lower() != b.lower():
            x, y = (x, y) if a.lower() == "parent" else (y, x)
            parents.append(x)
            children.append(y)
    return parents, children


def _fresh(df: DataFrame, name: str) -> DataFrame:
    """Re-alias every column so both sides of a self join get their own attribute ids."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias(name)


def _check_equi(joined: DataFrame, connect_by: str) -> None:
    """Raises for a predicate without an equality between parent and child: its join tests every pair."""
    plan = joined._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        raise HierarchyError(f"no equality between <parent> and <child> in {connect_by!r}: every pair of rows would be "
                             "compared; pass allow_pairs=True if the tables are small")


def _pred(connect_by: str) -> Column:
    return F.expr(connect_by.replace("<parent>", "h").replace("<child>", "t"))


def _field_name(spec: str) -> str:
    return spec.split(" ")[0]


def custom_hierarchy(df: DataFrame, primary_key: list[str], connect_by: str,
                     start_with: DataFrame | None = None, start_condition: str | None = None,
                     connect_by_root: list[str] | None = None,
                     connect_by_path: list[tuple[str, str]] | None = None,
                     leaf: bool = True, max_levels: int = HIER_DEPTH_LIMIT,
                     output_path: str | None = None, index_level: int | None = None,
                     allow_pairs: bool = False) -> DataFrame:
    """H9 (``leaf=False`` gives H10). Level-by-level CONNECT BY with any parent/child predicate.

    ``connect_by`` uses ``<parent>`` and ``<child>`` as table names, e.g.
    ``"<parent>.id = <child>.parent_id and <child>.value like '%o%'"``.
    Rows already in the output before a step are excluded by primary key; a row reached twice in
    one step appears twice. Columns: source, ``__level``, ``__chier_leaf``, ``__cbp_*``, ``__cbr_*``.
    With ``output_path`` the result replaces that table (the reference truncates its output table
    first) and is read back from it. ``index_level`` is a physical hint without effect here.
    A predicate without an equality between parent and child raises unless ``allow_pairs``.
    """
    if output_path is not None:
        res = custom_hierarchy(df, primary_key, connect_by, start_with, start_condition, connect_by_root,
                               connect_by_path, leaf, max_levels, allow_pairs=allow_pairs)
        res.write.mode("overwrite").parquet(output_path)
        return df.sparkSession.read.parquet(output_path)
    if (start_with is None) == (start_condition is None):
        raise ValueError("You must fill exactly one of start_with or start_condition")
    roots = [_field_name(r) for r in (connect_by_root or [])]
    paths = list(connect_by_path or [])
    src_cols = df.columns
    t = df.alias("t")
    if start_with is not None:
        keys = start_with.select(*primary_key).alias("s")
        cond = None
        for k in primary_key:
            c = F.col(f"t.{k}") == F.col(f"s.{k}")
            cond = c if cond is None else cond & c
        first = t.join(keys, cond, "inner").select("t.*")
    else:
        first = t.filter(F.expr(start_condition)).select("t.*")

    def as_text(c: str) -> Column:
        return F.coalesce(F.col(f"t.{c}").cast("string"), F.lit(""))

    level1 = first.alias("t").select(
        "t.*", F.lit(1).alias("__level"),
        *[as_text(f).alias(f"__cbp_{f}") for f, _ in paths],
        *[F.col(f"t.{r}").alias(f"__cbr_{r}") for r in roots])
    extra = ["__level"] + [f"__cbp_{f}" for f, _ in paths] + [f"__cbr_{r}" for r in roots]

    levels = _Levels(level1)
    parent_cols, child_cols = equal_columns(connect_by)
    known = bool(child_cols) and set(child_cols) <= set(df.columns)
    small = known and _is_small(df)
    if small:  # in bytes of its files; what a broadcast takes goes by rows
        df = written(df, "base")
        small = df.count() <= SMALL_ROWS
    base = _DealtBase(df, child_cols) if known and not small else None

    level = 2
    while True:
        ahead = SMALL_STEPS if small and level + SMALL_STEPS <= max_levels else 1
        # The anti join needs no distinct on the visited keys.
        how = (levels.all().select(*primary_key), primary_key, connect_by, src_cols, paths, roots, level, ahead)
        visited_hint = "/*+ MERGE(v) */ " if levels.rows > FEW_ROWS else ""
        hint = "/*+ BROADCAST(t) */ " if small else "/*+ MERGE(h) */ " if levels.last_rows > FEW_ROWS else ""
        found = _expand(levels.last(), base.cold if base else df, *how, hint, visited_hint)
        if base and base.hot is not None:
            found = found.unionByName(_expand(levels.last().where(base.is_hot(parent_cols)), base.hot, *how, "", visited_hint))
        if level == 2 and not allow_pairs:
            _check_equi(found, connect_by)
        if not levels.add(found):
            break
        if level > max_levels:
            raise HierarchyError(f"hierarchy depth increased {max_levels} levels. Check it manually")
        level += ahead
    if base:
        base.forget()
    out = levels.all()

    if not leaf:
        return out.select(*src_cols, *extra)
    parents = (_fresh(out, "h").join(_shuffled(_fresh(out, "t"), levels.rows), _pred(connect_by), "left_semi")
               .select(*[F.col(f"h.{k}").alias(k) for k in primary_key]).distinct()
               .withColumn("__nonleaf", F.lit(True)))
    res = out.join(_shuffled(parents, levels.rows), primary_key, "left").withColumn("__chier_leaf", F.col("__nonleaf").isNull())
    return res.select(*src_cols, "__level", "__chier_leaf",
                      *[f"__cbp_{f}" for f, _ in paths], *[f"__cbr_{r}" for r in roots])


def subtree_nodes(df: DataFrame, id_col: str, parent_col: str, value) -> DataFrame:
    """H11, DataFrame form: every id below ``value`` (itself included) as one row each; cycle safe."""
    spark = df.sparkSession
    edges = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")) \
        .filter(F.col("id").isNotNull() & F.col("parent").isNotNull())
    base = _DealtBase(edges, ["parent"])
    levels = _Levels(spark.range(1).select(F.lit(value).cast(df.schema[id_col].dataType).alias("id")))
    while True:
        last = levels.last().withColumnRenamed("id", "parent")
        below = base.cold.join(_shuffled(last, levels.last_rows), "parent", "left_semi")
        if base.hot is not None:
            below = below.unionByName(base.hot.join(last.where(base.is_hot(["parent"])), "parent", "left_semi"))
        if not levels.add(below.select("id").distinct().join(_shuffled(levels.all(), levels.rows), "id", "left_anti")):
            base.forget()
            return levels.all()


def subtree(df: DataFrame, id_col: str, parent_col: str, value, limit: int | None = SUBTREE_ARRAY_LIMIT) -> DataFrame:
    """H11, array form: one row with the distinct ids as text, sorted as text; error above ``limit`` (None: whole subtrees of any
    size). Ranges of the texts are sorted by many tasks; the last one only puts the sorted runs together."""
    nodes = subtree_nodes(df, id_col, parent_col, value)
    if limit is not None and (n := nodes.count()) > limit:
        raise HierarchyError(f"Target array size is more than {limit} elements ({n})")
    texts = nodes.select(F.col("id").cast("string").alias("text")).where("text is not null")
    runs = (texts.repartitionByRange("text").groupBy(F.spark_partition_id().alias("range"))
            .agg(F.sort_array(F.collect_list("text")).alias("run")))
    ordered = F.sort_array(F.collect_list(F.struct("range", "run")))
    return runs.agg(F.flatten(F.transform(ordered, lambda r: r["run"])).alias("subtree"))


def parent_values(df: DataFrame, hier_col: str, id_col: str, value_col: str, levels=(1, 2)) -> DataFrame:
    """H12. Self left joins on the n-up parent id, adding ``<value>_up<n>`` columns."""
    from canopy.functions.paths import get_parent
    out = df
    for n in levels:
        look = df.select(F.col(id_col).alias(f"__pid{n}"), F.col(value_col).alias(f"{value_col}_up{n}"))
        out = out.withColumn(f"__pid{n}", get_parent(hier_col, n)).join(look, f"__pid{n}", "left").drop(f"__pid{n}")
    return out


def subtree_scan(df: DataFrame, hier_col: str, node_id) -> DataFrame:
    """H13. Rows in the subtree of ``node_id`` with their level relative to it."""
    from canopy.functions.paths import get_level, is_subtree
    return df.filter(is_subtree(hier_col, node_id)).withColumn("rel_level", get_level(hier_col, node_id))
