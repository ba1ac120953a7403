"""Session helpers: shared checkpoint folder, scratch paths."""

from canopy.session import checkpoint_dir, cut_lineage, scratch_path


def test_scratch_paths_live_in_the_checkpoint_folder(spark):
    base = checkpoint_dir(spark).rstrip("/")
    p1, p2 = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert p1.startswith(base) and p2.startswith(base) and p1 != p2


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    import os
    before = set(os.listdir(checkpoint_dir(spark).replace("file:", "")))
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS v"))
    assert sorted(r["v"] for r in df.collect()) == list(range(0, 20, 2))
    assert set(os.listdir(checkpoint_dir(spark).replace("file:", ""))) - before  # written to the shared folder
