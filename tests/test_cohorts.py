"""Cohort edges: one leader flagged for two accounts joins them."""

from sequora.operators import graph
from sequora.plans import reports


def test_one_flagged_leader_joins_its_accounts(spark):
    met = [(1, 7), (2, 7), (3, 8), (4, 9)]  # account, leader: 1 and 2 share one leader only
    legs = [pair for pair in met for _ in range(3)]
    spark.createDataFrame(legs, "account long, leader long").createOrReplaceTempView("legs")
    ctes, select = reports.REPORTS["cohort_edges"]
    assert {(r.node, r.root) for r in graph.components(spark.sql(f"with {ctes} {select}")).collect()} == {(1, 1), (2, 1)}
