"""Matching, components, permutation tests and streams against small hand-made and brute-force cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from sequora.operators import association, graph, matching, permutation
from sequora.plans import procedures, reports
from sequora.sources import ledger
from sequora.streaming import replay

SF = "/root/testdata/sf0.001"
LEG = "slot long, pos long, pool long, signer long, side string, amount double, leader long"


def test_tight_motif_wins_over_wide_one(spark):
    # signer 1 goes in twice; the same-leader round trip (slots 1) is claimed before the one that crosses leaders
    rows = [(1, 0, 5, 1, "O", 10.0, 7), (1, 1, 5, 2, "O", 3.0, 7), (1, 2, 5, 1, "F", 10.0, 7), (2, 0, 5, 3, "O", 2.0, 8), (2, 1, 5, 1, "F", 10.0, 8)]
    got = matching.claimed_motifs(spark.createDataFrame(rows, LEG)).collect()
    assert [(r.f_slot, r.f_pos, r.b_slot, r.b_pos, r.victims, r.cross_leader) for r in got] == [(1, 0, 1, 2, 1, False)]


def test_groups_grow_only_as_needed(spark):
    # two fronts of 5 match one back of 10; the dust pair and the pair without a victim match nothing
    rows = [(1, 0, 5, 1, "O", 5.0, 7), (1, 1, 5, 1, "O", 5.0, 7), (1, 2, 5, 2, "O", 1.0, 7), (1, 3, 5, 1, "F", 10.0, 7), (2, 0, 6, 1, "O", 4.0, 7), (2, 1, 6, 1, "F", 4.0, 7), (3, 0, 8, 1, "O", 1e-9, 7), (3, 1, 8, 2, "O", 1.0, 7), (3, 2, 8, 1, "F", 1e-9, 7), (None, 1, 8, 2, "O", 1.0, 7)]
    got = matching.claimed_motifs(spark.createDataFrame(rows, LEG)).collect()
    assert [(r.pool, r.fronts, r.backs, r.front_amount, r.back_amount) for r in got] == [(5, 2, 1, 10.0, 10.0)]
    assert matching.claimed_motifs(spark.createDataFrame([], LEG)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    legs = ledger.legs(spark, SF).where("slot < 700").withColumn("pool", F.col("pool") % 4).select(*matching.NEEDED).cache()
    for at, (low, high) in enumerate(((-10_000, 100), (100, 300), (300, 301), (301, 700))):
        part = legs.where(f"slot >= {low} and slot < {high}").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(legs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    batch = key(matching.claimed_motifs(legs))
    assert batch and key(replay.match_stream(stream)) == batch
    ends = [(p, s, o) for p, s, o in ((r[4], r[5], r[0]) for r in batch)]
    assert len(ends) == len(set(ends))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(300, 300), (None, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0
    stars = graph.star_edges(spark.createDataFrame([("k", 3), ("k", 1), ("k", 1), (None, 2)], "k string, v long"), "k", "v")
    assert sorted(map(tuple, stars.collect())) == [(1, 1), (1, 3)]


def test_permutation(spark):
    lead = [1, 2, 3, 4, 9] * 40
    turns = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lead)], "rotation long, leader long")
    near = [("a", 5 * k + 5) for k in range(1, 30)]
    spread = [("b", int(x)) for x in np.random.default_rng(1).integers(1, 200, 30)]
    got = {r.entity: r for r in permutation.permutation_test(spark.createDataFrame([*near, *spread, (None, 3)], "entity string, rotation long"), turns, 99).collect()}
    assert set(got) == {"a", "b"} and got["a"].observed == 29 and got["a"].p >= 0.01
    assert all(r.q_bonferroni == min(1.0, 2 * r.p) for r in got.values())


def test_observed_statistic_equals_sql(spark):
    want = {(r.entity, r.observed) for r in reports.spark_query("max_cooccurrence")(spark, SF).collect()}
    assert {(r.entity, r.observed) for r in procedures.permutation_test(spark, SF).collect()} == want


def test_pairs_of_accounts_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    held = {a: frozenset(rng.sample(range(9), rng.randrange(7))) for a in range(300)}
    flagged = spark.createDataFrame([(a, leader) for a, ls in held.items() for leader in ls] + [(None, 1), (7, None)], "account long, leader long")
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3}
    for near in (association.NEAR, 0):  # broadcast, and joined
        monkeypatch.setattr(association, "BLOCK", 4)
        monkeypatch.setattr(association, "NEAR", near)
        got = [tuple(r) for r in association.shared_leader_edges(flagged).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = procedures.QUERIES["shared_leader_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")] and "Aggregate" not in plan[: plan.index("Generate")]
