"""Array, JSON, string and generator functions: goldens (FIXTURES.md section 3) and set properties."""

import random

from pyspark.sql import functions as F

from canopy.functions import arrays as A
from canopy.functions import generate as D
from canopy.functions import jsonmap as J
from canopy.functions import strings as S


def one(spark, expr, ddl="a array<int>, b array<int>", row=None):
    return spark.createDataFrame([row], ddl).select(expr.alias("r")).first()["r"]


def test_array_goldens(spark):
    r = ([1, 2, 3], [2, 3, 4])
    assert one(spark, A.array_intersect("a", "b"), row=r) == ["2", "3"]
    assert one(spark, A.array_merge("a", "b"), row=r) == ["1", "2", "3", "4"]
    assert one(spark, A.array_minus("a", "b"), row=r) == ["1"]
    long = ([1, 2, 3, 1, 2, 3, 1, 2, 3, 4], None)
    assert one(spark, A.array_sort("a"), row=long) == ["1", "1", "1", "2", "2", "2", "3", "3", "3", "4"]
    assert one(spark, A.array_uniq("a"), row=long) == ["1", "2", "3", "4"]
    assert one(spark, A.array_sort("a"), row=([2, 10], None)) == ["10", "2"]
    assert one(spark, A.array_merge("a", "b"), row=(None, [3, 1, 3])) == ["3", "1", "3"]
    assert one(spark, A.array_intersect("a", "b"), row=(None, [1])) is None
    assert one(spark, A.array_minus("a", "b"), row=(None, [1])) is None
    assert one(spark, A.array_minus("a", "b"), row=([2, 1], None)) == ["2", "1"]
    assert one(spark, A.array_intersect("a", "b"), row=([1], [2])) == []


def test_array_properties(spark):
    rnd = random.Random(7)
    rows = [([rnd.randint(0, 30) for _ in range(rnd.randint(0, 8))], [rnd.randint(0, 30) for _ in range(rnd.randint(0, 8))])
            for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = df.select("a", "b", A.array_intersect("a", "b").alias("i"), A.array_merge("a", "b").alias("m"),
                    A.array_minus("a", "b").alias("x"), A.array_uniq("a").alias("u")).collect()
    for r in got:
        sa, sb = {str(v) for v in r["a"]}, {str(v) for v in r["b"]}
        assert r["i"] == sorted(sa & sb)
        assert r["m"] == sorted(sa | sb)
        assert r["x"] == sorted(sa - sb)
        assert r["u"] == sorted(sa)


def test_json_goldens(spark):
    js = '{"number": 4711, "handle": "someone", "email": "x"}'
    df = spark.createDataFrame([(js,), ("",), (None,)], "js string")
    r = df.select(J.json_set("js", "email", "v").alias("s"), J.json_get("js", "email").alias("e"),
                  J.json_get("js", "number").alias("i"), J.json_get("js", "zz").alias("z"),
                  J.json_check("js", "email", "x").alias("c1"), J.json_check("js", "email", "y").alias("c2"),
                  J.json_check("js", "number", "4711").alias("c3"),
                  J.json_check("js", "zz", F.lit(None)).alias("c4")).collect()
    assert r[0]["e"] == "x" and r[0]["i"] == "4711" and r[0]["z"] is None
    assert (r[0]["c1"], r[0]["c2"], r[0]["c3"], r[0]["c4"]) == (True, False, False, True)
    assert r[1]["s"] == '{"email":"v"}' and r[2]["s"] == '{"email":"v"}'
    assert '"email":"v"' in r[0]["s"] and '"number":4711' in r[0]["s"]


def test_json_roundtrip(spark):
    df = spark.createDataFrame([('{"a": 1}', "k", "v1"), (None, "a.b", "x y"), ('{"k": "old"}', "k", "new")],
                               "js string, k string, v string")
    for r in df.collect():
        got = df.filter(F.col("k") == r["k"]).select(J.json_get(J.json_set("js", r["k"], F.col("v")), r["k"])).collect()
        assert {g[0] for g in got} >= {r["v"]}


def test_put_to_str(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "l array<string>")
    r = df.select(S.put_to_str("l").alias("a"), S.put_to_str("l", ",", "in_table.").alias("b"),
                  S.put_to_str("l", "|", "in_table.").alias("c")).collect()
    assert (r[0]["a"], r[0]["b"], r[0]["c"]) == ("a,b,c", "in_table.a,in_table.b,in_table.c",
                                                 "in_table.a|in_table.b|in_table.c")
    assert r[1]["b"] == "in_table."


def test_query_text_normalisers(spark):
    df = spark.createDataFrame([("select  *\n\tfrom   t  where x",)], "q string")
    r = df.select(S.query_short("q").alias("s"), S.query_collapsed("q").alias("c")).first()
    assert r["s"] == "select*from twhere x"  # pairs are removed, a lone blank stays
    assert r["c"] == "select * from t where x"


def test_generators_repeatable_and_shaped(spark):
    df = spark.range(500).select(
        "id", D.generate_integer(9, "id").alias("i"), D.generate_string(7, "id").alias("s"),
        D.generate_string(7, "id", use_upper=0).alias("l"), D.generate_domain("id").alias("d"),
        D.generate_email(5, 4, "id").alias("e"), D.generate_point(1.0, 2.0, 3.0, 4.0, "id").alias("p"),
        D.generate_text(20, "id").alias("t"))
    a, b = df.collect(), df.collect()
    assert a == b
    assert all(len(r["i"]) == 9 and r["i"].isdigit() for r in a)
    assert all(r["l"].islower() and len(r["l"]) == 7 for r in a)
    assert any(not r["s"].islower() for r in a)
    assert {r["d"] for r in a} == set(D.DOMAINS)
    assert all(1.0 <= float(r["p"]["lat"]) <= 2.0 and r["p"]["wkt"].startswith("POINT(") for r in a)
    assert all(set(r["t"]) <= set(D.TEXT_SYMBOLS) for r in a)
    assert one(spark, D.generate_integer(0, F.lit(1)), "x int", (1,)) == ""
