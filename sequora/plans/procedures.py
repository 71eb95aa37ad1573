"""Queries over the ledger that need more than one SQL statement: matching, components, permutation tests, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import association, graph, matching, permutation
from ..sources import ledger
from ..streaming import replay
from . import reports


def claimed_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.claimed_motifs(ledger.legs(spark, sf_dir))


def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts linked by the first and the last leg of a motif."""
    return graph.components(reports.spark_query("motif_account_edges")(spark, sf_dir))


def cohort_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts linked by three flagged leaders in common, or by one that is flagged for both."""
    return graph.components(reports.spark_query("cohort_edges")(spark, sf_dir))


def shared_leader_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.shared_leader_edges(reports.spark_query("flagged_leaders")(spark, sf_dir))


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger.register(spark, sf_dir)
    acts = spark.sql(f"with {reports.steps(reports.PAIRS, reports.ROTATIONS, reports.ACTS)} select entity, rotation from acts")
    turns = spark.sql(f"with {reports.steps(reports.ROTATIONS)} select rotation, leader from rotations")
    return permutation.permutation_test(acts, turns)


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, each event_id once."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    events = events.withColumn("ts", events["ts"].cast("timestamp"))  # watermarks need an instant
    once = replay.first_seen(events, "event_id", "ts", "2 hours")
    return replay.run_to_table(once.select("event_id", "user_id", "event_type", "value"), "first-events")


def _components_sql(report: str) -> str:
    ctes, select = reports.REPORTS[report]
    views = ledger.LEGS_SQL.replace("{day}", ledger.DUCKDB_DAY)
    return f"""with recursive {views}, {ctes}, links as (select a, b from ({select}) q), ways as (select a, b from links union select b, a from links),
      reach(node, root) as (select a, a from ways group by a having min(b) >= a union select w.b, r.root from reach r join ways w on w.a = r.node where w.b > r.root)
      select node, min(root) as root from reach group by node"""


QUERIES = {
    "claimed_motifs": claimed_motifs,
    "entity_components": entity_components,
    "cohort_components": cohort_components,
    "shared_leader_edges": shared_leader_edges,
    "permutation_test": permutation_test,
    "stream_first_events": stream_first_events,
}
ORACLE_SQL = {
    "entity_components": _components_sql("motif_account_edges"),
    "cohort_components": _components_sql("cohort_edges"),
    "stream_first_events": "select distinct event_id, user_id, event_type, value from events",
}
