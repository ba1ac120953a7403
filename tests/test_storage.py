"""Size/skew reports and the text index."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import skew as SK
from canopy.operators import textindex as X


def _catalog(spark):
    rel = spark.createDataFrame([(123, "t", 1, "a", "r"), (200, "empty", 1, "h", "r"), (300, "sys", 2, "h", "r")],
                                "relfilenode long, relname string, relnamespace long, relstorage string, relkind string")
    sch = spark.createDataFrame([(1, "public"), (2, "pg_catalog")], "oid long, nspname string")
    return rel, sch


def test_table_sizes_and_skew(spark):
    gb = 1024 ** 3
    listing = spark.createDataFrame(
        [(0, "123", 2 * gb), (0, "123.1", gb), (1, "123.2", 0), (2, "123", gb), (0, "200", 0), (1, "200", 0),
         (0, "300", gb)], "segment_id int, relfilenode string, size long")
    rel, sch = _catalog(spark)
    mb = {r["tablename"]: float(r["size_mb"]) for r in SK.table_sizes_mb(listing, rel, sch).collect()}
    assert mb["t"] == 4 * gb / 1e6 and "sys" in mb
    sk = {r["table_name"]: r for r in SK.get_skew(listing, rel, sch).collect()}
    assert set(sk) == {"t", "empty"}
    t = sk["t"]
    assert float(t["total_size_gb"]) == 4.0 and float(t["seg_max_size_gb"]) == 3.0 and float(t["seg_min_size_gb"]) == 0
    assert float(t["seg_gap_min_max_percent"]) == 100.0 and t["nb_empty_seg"] == 1
    assert float(sk["empty"]["seg_gap_min_max_percent"]) == 0.0 and sk["empty"]["nb_empty_seg"] == 2
    assert SK.get_skew(listing, rel, sch, min_total_gb=1).count() == 1


def test_shard_stats(spark):
    s = spark.createDataFrame([(10, 1, 1000), (30, 3, 3000)], "docs long, deldocs long, size long")
    r = SK.shard_stats(s).first()
    assert r["status"] == "ok" and float(r["docs_skew"]) == 1.0 and float(r["deleted_percent"]) == 10.0
    e = SK.shard_stats(spark.createDataFrame([(0, 0, 0)], "docs long, deldocs long, size long")).first()
    assert e["status"] == "empty" and e["docs_skew"] is None


def test_key_skew(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"))
    r = SK.key_skew(df, bucket=F.col("k"), buckets=4).first()
    assert r["total_rows"] == 100 and r["empty_buckets"] == 1 and r["max_rows"] == 34
    assert SK.key_skew(df, ["k"], buckets=8).first()["total_rows"] == 100
    assert SK.partition_skew(df.repartition(3)).first()["total_rows"] == 100


def test_postings_and_checks(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "Hello, hello WORLD! é_x", "en"), (2, None, None), (3, "a-b a", "fr")],
                                 "doc_id long, text string, lang string")
    post = {(r["field"], r["term"], r["doc_id"]): r["tf"] for r in X.postings(docs, "doc_id", ["text", "lang"],
                                                                           ["text_intl", "string"]).collect()}
    assert post[("text", "hello", 1)] == 2 and post[("text", "world", 1)] == 1 and post[("text", "é_x", 1)] == 1
    assert post[("lang", "en", 1)] == 1 and post[("text", "a", 3)] == 2 and not any(k[2] == 2 for k in post)
    res = X.create_index(docs, tmp_dir + "/idx", "doc_id", "text", ["text", "lang"], ["text_intl", "string"],
                         history_path=tmp_dir + "/history")
    assert res.ok and X.read_index(spark, tmp_dir + "/idx").count() == len(post)
    assert spark.read.parquet(tmp_dir + "/history").first()["action"].startswith("Created index")
    assert not X.create_index(docs, tmp_dir + "/idx", "doc_id", "text", ["text"], ["text"]).ok
    assert not X.create_index(docs.withColumn("doc_id", F.col("doc_id").cast("int")), tmp_dir + "/i2", "doc_id",
                              "text", ["text"], ["text"]).ok
    assert not X.create_index(docs, tmp_dir + "/i3", "doc_id", "nope", ["text"], ["text"]).ok
    assert not X.create_index(None, tmp_dir + "/i4", "doc_id", "text", ["text"], ["text"]).ok
    deleted = spark.createDataFrame([(1,)], "doc_id long")
    left = X.expunge(X.read_index(spark, tmp_dir + "/idx"), deleted)
    assert left.filter(F.col("doc_id") == 1).count() == 0 and left.count() > 0
    X.expunge_index(spark, tmp_dir + "/idx", deleted)
    left = left.select("field", "term", "doc_id", "tf")
    assert sorted(map(tuple, X.read_index(spark, tmp_dir + "/idx").collect())) == sorted(map(tuple, left.collect()))
    with pytest.raises(ValueError):
        X.postings(docs, "doc_id", ["text"], [])


def test_terms_of_other_languages(spark):
    from canopy.operators.textindex import terms
    df = spark.createDataFrame([("Größe éà, über_2 日本!",)], "v string")
    assert df.select(terms(df["v"], "text_intl").alias("t")).first()["t"] == ["größe", "éà", "über_2", "日本"]


def test_index_of_segments_with_deletes(spark, tmp_dir):
    """A reader never sees a deleted document, before a merge and after it; an id may come again in a later segment."""
    from canopy import store
    path = tmp_dir + "/segments"

    def docs(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    def ids():
        return sorted((r["doc_id"], r["term"]) for r in X.read_index(spark, path).collect())

    assert X.create_index(docs((1, "a"), (40_000, "b"), (-7, "c"), (0, "d"), (32_768, "e"), (32_769, "f")), path, "doc_id", "text", ["text"], ["text"]).ok
    X.expunge_index(spark, path, spark.createDataFrame([(1,), (-7,), (32_768,), (None,), (99,)], "doc_id long"))
    assert ids() == [(0, "d"), (32_769, "f"), (40_000, "b")]
    X.add_documents(docs((1, "again"), (2, "new")), path, "doc_id")
    assert ids() == [(0, "d"), (1, "again"), (2, "new"), (32_769, "f"), (40_000, "b")]
    X.expunge_index(spark, path, spark.createDataFrame([(2,), (0,)], "doc_id long"))
    before = ids()
    assert before == [(1, "again"), (32_769, "f"), (40_000, "b")]
    X.merge_index(spark, path)
    assert ids() == before and len(X.vacuum_index(spark, path)) == 4 and ids() == before
    assert len(store.names(spark, path + "/segments")) == 1 and store.names(spark, path + "/deletes") == []
    with pytest.raises(FileNotFoundError):
        X.read_index(spark, tmp_dir + "/nothing")


def test_bitmaps_give_their_ids_back(spark):
    import random
    rng = random.Random(2)
    ids = sorted({rng.randint(-200_000, 200_000) for _ in range(500)} | {0, 1, -1, 32_767, 32_768, 32_769, -32_768, -32_767, 2**40})
    maps = X.bitmaps(spark.createDataFrame([(i,) for i in ids + ids[:9]], "doc_id long"), "doc_id")
    assert sorted(r[0] for r in X.bitmap_ids(maps).collect()) == ids


def test_terms_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None), (4, "z")], "doc_id long, text string")
    post = X.postings(df, "doc_id", ["text"], ["text"])
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in post.collect()) == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (4, "z", 1)]
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_lambda_for_each_term(spark):
    """Terms that begin alike, one term 200,000 times in a row, other scripts, null and empty texts; other types are one term."""
    import collections
    texts = {1: "a ab a_b ab. A b; aa AA aaa a", 2: "the " * 200_000 + "then the_ THE", 3: "Été été ÉTÉ, नमस्ते \U00010437\U00010437 \U0001040f \U0001040f", 4: None, 5: "", 6: " ., \n", 7: "x\ny\r\nx x"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    found = X.field_postings(df, "doc_id", "text", "text_intl")
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    got = {(r["doc_id"], r["term"]): r["tf"] for r in rows}
    split = df.where("text <> ''").select("doc_id", F.explode(X.terms(F.col("text"), "text")).alias("t")).collect()
    assert got == collections.Counter((r["doc_id"], r["t"]) for r in split) and len(rows) == len(got)
    assert got[2, "the"] == 200_001 and got[1, "a"] == 3 and got[1, "ab"] == 2 and got[3, "été"] == 3 and got[7, "x"] == 3
    assert {k for k, _ in got} == {1, 2, 3, 7}
    plain = X.field_postings(df, "doc_id", "text", "string").where("doc_id <> 2").collect()
    assert {r["doc_id"]: (r["term"], r["tf"]) for r in plain} == {k: (t, 1) for k, t in texts.items() if t is not None and k != 2}
