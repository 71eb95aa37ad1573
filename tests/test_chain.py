"""Every query over the chain tables against SQL of its own in DuckDB, and small cases by hand."""

import duckdb
import pandas as pd
import pytest
from test_reports import SF, plain

from sequora.operators import association, classes, distributions, ordered, sandwiches
from sequora.plans import chain_queries
from sequora.sources import files


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def kept():
    """Metrics and what follows from them are made once, so that each test is about its own step."""
    made = {}
    patch = pytest.MonkeyPatch()
    for name in ("metrics", "features", "pairs"):
        real = getattr(chain_queries.Chain, name)

        def once(self, real=real, name=name):
            if name not in made:
                made[name] = real(self).cache()
            return made[name]

        patch.setattr(chain_queries.Chain, name, once)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(chain_queries.QUERIES))
def test_query(spark, duck, name):
    mine = plain(chain_queries.QUERIES[name](spark, SF).toPandas())
    if name in chain_queries.ORACLE_SQL:
        pd.testing.assert_frame_equal(mine, plain(duck.execute(chain_queries.ORACLE_SQL[name]).df()), check_dtype=False)
    assert len(mine.columns)


def test_passes_over_many_chunks_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)
    leaders = [(s, None if s % 13 == 0 else f"L{s // 9 % 3}") for s in range(5, 200) if s % 17 not in (3, 4, 5)]
    got = {r.slot: r.rotation for r in ordered.rotations(spark.createDataFrame(leaders, "slot long, leader string"), 2).collect()}
    want, n, before = {}, 0, (None, None)
    for slot, leader in leaders:
        if leader is None or leader != before[1] or slot - before[0] > 2:
            n += 1
        want[slot], before = n, (slot, leader)
    assert got == want
    sums = ordered.prefix_sum(spark.createDataFrame([(s, s % 5) for s, _ in leaders], "k long, v long"), "k", "v", "b").collect()
    assert all(r.b == sum(s % 5 for s, _ in leaders if s < r.k) for r in sums)
    starts, points = [(3, 30), (50, 500), (51, 510), (120, 1200)], [(p,) for p in (1, 3, 49, 50, 119, 120, 900)]
    found = ordered.as_of(spark.createDataFrame(points, "k long"), spark.createDataFrame(starts, "k long, v long"), "k", "v").collect()
    assert {r.k: r.v for r in found} == {1: None, 3: 30, 49: 30, 50: 500, 119: 510, 120: 1200, 900: 1200}
    means = ordered.rolling_mean(spark.createDataFrame([(i, i * i % 11) for i in range(60)], "i long, v long").withColumnRenamed("i", "at").selectExpr("at", "at as i", "v"), "at", "i", "v", 3, 2, "m", 10).collect()
    assert {r.i: r.m for r in means} == {i: sum(k * k % 11 for k in range(i - 3, i + 3)) / 6 if 3 <= i <= 57 else None for i in range(60)}


def leg(sid, kind, slot, position, signers, **more):
    base = {"limit_type": "output", "limit_amount": 1.0, "actual_amount": 2.0, "owners_b": ["o"], "fee": 5000, "from_token": "SOL", "to_token": "T", "from_amount": 1.0, "to_amount": 2.0, "in_bundle": True, "programs": ["p"], "pool_dex": "d", "ts": 0}
    return {**base, "sid": sid, "type": kind, "slot": slot, "position": position, "sig": f"{sid}{kind}{slot}.{position}", "signers": signers, **more}


LEG = "sid string, type string, slot long, position long, ts long, sig string, signers array<string>, programs array<string>, fee long, from_token string, to_token string, from_amount double, to_amount double, limit_type string, limit_amount double, actual_amount double, owners_b array<string>, in_bundle boolean, pool_dex string"


def test_consumption_by_class(spark):
    cases = [("output", 1.0, 4.0, 0.25, "ok"), ("input", 4.0, 1.0, 0.25, "ok"), ("output", 0.0, 3.0, 0.0, "no_protection"), ("output", 0.0, 0.0, 0.0, "no_protection"), ("output", 1 + 1e-12, 1.0, 1.0, "ok"), ("output", 2.0, 1.0, None, "above_one"), ("input", 0.0, 1.0, None, "limit_nonpositive"), ("input", -1.0, 1.0, None, "limit_nonpositive"), ("output", 1.0, 0.0, None, "actual_nonpositive"), ("", 1.0, 1.0, None, "empty_type")]
    legs = spark.createDataFrame([leg("s", "victim", 1, i, ["v"], limit_type=t, limit_amount=a, actual_amount=b) for i, (t, a, b, _, _) in enumerate(cases)], LEG)
    got = {r.position: (r.sc, r.reason) for r in sandwiches.victim_consumption(legs).collect()}
    assert got == {i: (sc, why) for i, (*_, sc, why) in enumerate(cases)}


def test_unknown_leaders_equal_none(spark):
    legs = spark.createDataFrame([leg("s", "frontRun", 1, 1, ["a"]), leg("s", "victim", 2, 1, ["v"]), leg("s", "backRun", 3, 1, ["a"]), leg("t", "frontRun", 9, 1, ["a"]), leg("t", "backRun", 9, 3, ["a"])], LEG)
    rows = {r.sid: r for r in sandwiches.geometry_classes(sandwiches.geometry(legs, spark.createDataFrame([(1, "L")], "slot long, leader string"))).collect()}
    assert rows["s"].cross_leader is None and rows["s"].geom_class == "same_leader_multi_slot" and rows["s"].v_front_leader == 0
    assert rows["t"].geom_class == "single_slot" and rows["t"].n_victims == 0


def test_nulls_pass_no_gate(spark):
    features = spark.createDataFrame([("a", 500, None, 0.95, 10.0, 99.0, 0), ("b", 500, 0.9, None, 10.0, 99.0, 0), ("c", 500, 0.9, 0.95, 10.0, 99.0, 0), ("d", 1, None, None, None, 0.0, 3)], "signer string, sandwich_count long, sol_win_rate double, mean_sc double, front_gap_p50 double, usd_net_total double, jito_count long")
    assert {r.signer: r.tier for r in classes.classify(features).collect()} == {"a": "unclassified", "b": "unclassified", "c": "signal", "d": "jito_only"}


def test_gapped_turns_are_counted_slot_by_slot(spark):
    leaders = spark.createDataFrame([(s, "A") for s in (1, 2, 3, 4)] + [(s, "B") for s in (5, 6, 7, 8)], "slot long, leader string")
    rows = spark.createDataFrame([("x", "1", 3, 6, True, True), ("x", "2", 1, 2, True, False)], "signer string, sid string, front_slot long, back_slot long, cross_block boolean, cross_leader boolean")
    r = association.boundary_suppression(rows, leaders).first()
    assert (r.n, r.observed, r.expected) == (2, 1, 3 / 4 + 1 / 4)


def test_bins_close_at_the_end(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 1.0, 1.1, None)], "x double")
    assert {(r.bin, r.n) for r in distributions.histogram(rows, "x", [0, 0.5, 1.0]).collect()} == {(0, 2), (1, 2)}


def test_ingest_tables(spark):
    with pytest.raises(ValueError, match="missing: y"):
        files.require(spark.range(1), ["id", "y"])
    known = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "token string, usd_price double")
    fresh = spark.createDataFrame([("A", 3.0), ("B", None), ("C", None)], "token string, usd_price double")
    counts = spark.createDataFrame([("A", 5.0)], "token string, sandwich_count double")
    assert [tuple(r) for r in files.merged_prices(known, fresh, counts, ["SOL"]).collect()] == [("A", 5.0, 3.0), ("B", 0.0, 2.0), ("SOL", 0.0, None)]
    fetched = spark.createDataFrame([(s,) for s in (5, 6, 7, 9)], "slot long")
    assert files.frontier(fetched, 5).first()[0] == 7 and files.frontier(fetched, 4).first()[0] is None
    assert {r.slot for r in files.missing_slots(spark, 4, 9, fetched).collect()} == {4, 8}


@pytest.mark.parametrize("name", ["report_pattern", "report_bundle_epochs"])
def test_sums_at_half_a_cent(spark, name, monkeypatch):
    larger = SF.replace("sf0.001", "sf0.01")
    monkeypatch.setattr(chain_queries.Chain, "metrics", lambda c: sandwiches.metrics(c.legs, c.leaders, c.counts, c.bundles, c.prices))  # not those kept
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events"):
        con.execute(f"create view {t} as select * from '{larger}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(chain_queries.QUERIES[name](spark, larger).toPandas()), plain(con.execute(chain_queries.ORACLE_SQL[name]).df()), check_dtype=False)


def test_rounding_scales_first(spark):
    rows = spark.createDataFrame([(431.84499999999997, 2), (-431.84499999999997, 2), (-0.0, 1), (None, 1)], "x double, n long")
    assert [r.x for r in chain_queries.rounded(rows, 2).collect()] == [431.85, -431.85, 0.0, None]
