"""Round trips through the epoch tables."""

import pytest

from sequora.sources import sinks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_epochs_are_replaced_dropped_and_kept(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "x long, epoch long")
    sinks.overwrite_epochs(make([(1, 1), (2, 1), (3, 2), (4, 3)]), path)
    for _ in range(2):
        sinks.overwrite_epochs(make([(9, 2)]), path)
    assert rows_of(spark.read.parquet(path).select("x", "epoch")) == [(1, 1), (2, 1), (4, 3), (9, 2)]
    sinks.drop_epochs(spark, path, [1])
    assert rows_of(spark.read.parquet(path).select("x", "epoch")) == [(4, 3), (9, 2)]


def test_newest_and_mark(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, None, "c"), (2, None, "d"), (None, 1, "e")], "k long, v long, t string")
    assert {r.t for r in sinks.newest(rows, ["k"], "v").collect()} == {"b", "d", "e"}
    marked = sinks.mark(rows, rows.where("t = 'b'").select("k", "v"), ["k", "v"], "hit")
    assert {r.t for r in marked.collect() if r.hit} == {"b"} and marked.count() == 5
    again = sinks.mark(marked, rows.where("t = 'a'"), ["k", "v"], "hit")
    assert {r.t for r in again.collect() if r.hit} == {"a", "b"}


def test_release(spark, tmp_path):
    assert sinks.pack_epochs([(3, 5), (1, 4), (2, 5), (4, 99)], 10) == [[1, 2], [3], [4]]
    assert sinks.pack_epochs([], 10) == []
    rows = spark.createDataFrame([(i, e) for e in (5, 6, 7) for i in range(e)] + [(1, None)], "x long, epoch long")
    assert sinks.write_release(rows, f"{tmp_path}/r", 1 << 30) == [[5, 6, 7]]
    assert rows_of(spark.read.parquet(f"{tmp_path}/r").select("x", "epoch")) == rows_of(rows)
    assert sinks.write_release(rows, f"{tmp_path}/r", 1) == [[5], [6], [7]]
    assert sinks.write_release(rows.limit(0), f"{tmp_path}/e", 10) == []


def test_marks_write_their_epochs_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append(spark.createDataFrame([(1, "a", False, 1), (2, "b", False, 2), (3, "c", False, 2)], "slot long, sig string, hit boolean, epoch long"), path)
    hits = spark.createDataFrame([(3, "c", 2)], "slot long, sig string, epoch long")
    assert sinks.mark_epochs(spark, path, hits, ["slot", "sig"], "hit") == [2]
    assert rows_of(spark.read.parquet(path).select("sig", "hit", "epoch")) == [("a", False, 1), ("b", False, 2), ("c", True, 2)]


def test_steps_from_legs_to_release(spark, tmp_path):
    from sequora.__main__ import STEPS, options

    for step, *more in (["phase1", "--profit-floor-usd", "1"], ["phase2"], ["phase3", "--n-min", "2", "--wr-min", "0.2", "--slip-min", "0.1", "--fg-median-max", "500", "--no-geometry"], ["phase4", "--min-enrichment", "0.5", "--min-near-cnt", "1", "--trusted-top-n", "1"], ["dataset"]):
        STEPS[step](spark, options().parse_args([step, "--data", "/root/testdata/sf0.001", "--out", str(tmp_path), *more]))
    legs = spark.read.parquet(f"{tmp_path}/release/legs")
    ids = spark.read.parquet(f"{tmp_path}/release/sandwiches.parquet").select("sandwich_id")
    assert legs.count() and legs.select("sandwich_id").distinct().count() == ids.count() == ids.distinct().count()
    assert spark.read.parquet(f"{tmp_path}/cohorts.parquet").count()
    with pytest.raises(SystemExit):
        STEPS["reset"](spark, options().parse_args(["reset", "--data", "x", "--out", "y"]))
