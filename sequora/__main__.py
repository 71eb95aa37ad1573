"""Command line: the steps from a ledger's legs to a release, each reading and writing Parquet folders.

python -m sequora STEP --data FOLDER --out FOLDER [options]

Steps: sandwich (claimed motifs of order-table legs), phase1 (metrics and features), phase2 (sensitivity), phase3
(classes and the merged list), phase4 (leaders), report (overview), dataset (release), jito (bundle marks), leader
(rotations), reset (drops the tables).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import association, classes, distributions, entities, matching, ordered, sandwiches
from .sources import chain, files, ledger, sinks


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sequora")
    p.add_argument("step", choices=sorted(STEPS))
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--out", required=True)
    p.add_argument("--start-epoch", type=int)
    p.add_argument("--end-epoch", type=int)
    p.add_argument("--category", choices=classes.CATEGORIES)
    p.add_argument("--cross-leader", choices=("include", "exclude", "only"), default="include")
    p.add_argument("--entity-merge", choices=("none", *entities.MODES), default="none")
    p.add_argument("--entity-degree-cap", type=int, default=entities.DEGREE_CAP)
    p.add_argument("--profit-floor-usd", type=float, default=entities.FLOOR_USD)
    p.add_argument("--n-min", type=int, default=classes.N_MIN)
    p.add_argument("--wr-min", type=float, default=classes.WR_MIN)
    p.add_argument("--slip-min", type=float, default=classes.SC_MIN)
    p.add_argument("--fg-median-max", type=float, default=classes.GAP_MAX)
    p.add_argument("--signal-usd-min", type=float, default=classes.USD_MIN)
    p.add_argument("--oneshot", action="store_true")
    p.add_argument("--no-geometry", action="store_true")
    p.add_argument("--multi-variant", choices=("all", "multi_front", "multi_back", "both"), default="all")
    p.add_argument("--min-enrichment", type=float, default=association.MIN_ETA)
    p.add_argument("--min-near-cnt", type=int, default=association.MIN_NEAR)
    p.add_argument("--trusted-top-n", type=int, default=association.TRUSTED)
    p.add_argument("--csv-top-n", type=int, default=20)
    p.add_argument("--max-part-mb", type=int, default=95)
    p.add_argument("--sections", default="1,2,3,4,5,6")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--yes", action="store_true", help="reset asks for it")
    return p


def scoped(legs: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The legs of the epochs asked for, from the first slot of the first up to the last's end."""
    low = F.lit(True) if a.start_epoch is None else F.col("slot") >= a.start_epoch * chain.EPOCH
    high = F.lit(True) if a.end_epoch is None else F.col("slot") < (a.end_epoch + 1) * chain.EPOCH
    return legs.where(low & high)


def tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    legs = scoped(chain.legs(spark, a.data), a)
    prices = chain.prices(spark)
    sandwiches.require_price(prices)
    return {"legs": legs, "leaders": chain.leaders(legs), "counts": chain.slot_counts(legs), "bundles": chain.bundles(legs), "prices": prices}


def metrics(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    t = tables(spark, a)
    m = sandwiches.cross_leader_scope(sandwiches.metrics(**t), a.cross_leader)
    if a.category:
        m = m.where(F.col("category") == a.category)
    if a.entity_merge != "none":
        anchored = entities.anchors(entities.key_sets(t["legs"]), a.entity_merge, degree_cap=a.entity_degree_cap)
        m = entities.named(m, anchored, entities.resolve(anchored))
    return sandwiches.variant(m, a.multi_variant)


def phase1(spark: SparkSession, a: argparse.Namespace) -> None:
    m = metrics(spark, a)
    if a.dry_run:
        distributions.shares(m, "category").show()
        return
    kept, features = entities.profit_floor(m, entities.features(m), a.profit_floor_usd)
    kept.write.mode("overwrite").parquet(f"{a.out}/per_sandwich_metrics")
    features.write.mode("overwrite").parquet(f"{a.out}/signer_features")
    sinks.write_outputs(entities.summary(spark.read.parquet(f"{a.out}/per_sandwich_metrics"), spark.read.parquet(f"{a.out}/signer_features")), f"{a.out}/signer_summary")


def _features(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return files.require(spark.read.parquet(f"{a.out}/signer_features"), ["signer", "sandwich_count", "sol_win_rate", "mean_sc", "front_gap_p50", "usd_net_total"])


def phase2(spark: SparkSession, a: argparse.Namespace) -> None:
    features = _features(spark, a)
    gates = (a.n_min, a.wr_min, a.slip_min, a.fg_median_max)
    grid = [(f"n{n}-wr{w}", n, w, a.slip_min, a.fg_median_max) for n in (a.n_min // 2, a.n_min, a.n_min * 2) for w in (a.wr_min - 0.05, a.wr_min, a.wr_min + 0.05)]
    sinks.write_outputs(classes.gate_funnel(features, *gates, a.signal_usd_min), f"{a.out}/funnel")
    sinks.write_outputs(classes.sensitivity(features, grid), f"{a.out}/sensitivity")
    sinks.write_outputs(classes.stage_tables(features, [1, 10, 50, 100, 500]), f"{a.out}/stages")


def phase3(spark: SparkSession, a: argparse.Namespace) -> None:
    m = spark.read.parquet(f"{a.out}/per_sandwich_metrics")
    of = classes.classify(_features(spark, a), a.n_min, a.wr_min, a.slip_min, a.fg_median_max, a.signal_usd_min, a.oneshot)
    of.write.mode("overwrite").parquet(f"{a.out}/classified")
    bots = classes.annotated(spark.read.parquet(f"{a.out}/classified").where("tier <> 'unclassified'"), None)
    sinks.write_outputs(bots.join(classes.usd_split(m), "signer", "left"), f"{a.out}/bot_attackers")
    sinks.write_outputs(classes.tier_totals(spark.read.parquet(f"{a.out}/classified")), f"{a.out}/tiers")
    by_category = m.select("signer", "category").groupBy("signer").agg(F.mode("category", deterministic=True).alias("category"))
    sinks.write_outputs(classes.merged(bots.join(by_category, "signer", "left")), f"{a.out}/all_attackers")
    if not a.no_geometry:
        leaders = tables(spark, a)["leaders"]
        sinks.write_outputs(distributions.geometry_profile(m, distributions.all_front_baseline(m), association.boundary_suppression(m, leaders)), f"{a.out}/geometry")


def phase4(spark: SparkSession, a: argparse.Namespace) -> None:
    bots = spark.read.parquet(f"{a.out}/bot_attackers.parquet").select("signer")
    m = spark.read.parquet(f"{a.out}/per_sandwich_metrics").join(bots, "signer", "left_semi")
    leaders = tables(spark, a)["leaders"]
    pairs = association.without_trusted(association.scored(m.select("signer", F.col("front_slot").alias("slot")), leaders, a.min_enrichment, a.min_near_cnt), association.turns(leaders), a.trusted_top_n)
    pairs.write.mode("overwrite").parquet(f"{a.out}/pairs")
    stored = spark.read.parquet(f"{a.out}/pairs")
    sinks.write_outputs(association.cohorts(stored), f"{a.out}/cohorts")
    sinks.write_outputs(association.peak_counts(stored), f"{a.out}/peak_offsets")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    t, wanted = tables(spark, a), set(a.sections.split(","))
    if "1" in wanted:
        sinks.write_outputs(files.coverage(t["counts"], t["legs"], t["bundles"], chain.EPOCH), f"{a.out}/report-coverage")
    if "2" in wanted:
        sinks.write_outputs(association.strongest(association.encounters(sandwiches.headers(t["legs"]).select("signer", F.col("front_slot").alias("slot")), t["leaders"])), f"{a.out}/report-leaders")
    m = metrics(spark, a)
    for section, by in (("3", ["distance"]), ("4", ["pattern"]), ("5", ["pattern", "distance"])):
        if section in wanted:
            sinks.write_outputs(m.groupBy(*by).agg(F.count("*").alias("sandwiches"), F.count_distinct("signer").alias("signers"), F.sum("victim_count").alias("victims"), F.sum("usd_net").alias("usd_net"), F.count("usd_net").alias("priced")), f"{a.out}/report-{'-'.join(by)}")
    if "6" in wanted:
        sinks.write_outputs(m.where("jito_bundle").groupBy("signer").agg(F.count("*").alias("n"), F.sum("victim_count").alias("victims"), F.sum("usd_net").alias("usd_net")), f"{a.out}/report-bundles")


def dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    bots = classes.without_rejected(spark.read.parquet(f"{a.out}/bot_attackers.parquet"))
    m = spark.read.parquet(f"{a.out}/per_sandwich_metrics").join(bots.select("signer"), "signer", "left_semi")
    rows = sinks.release_sandwiches(m)
    sinks.write_outputs(rows, f"{a.out}/release/sandwiches")
    category = m.groupBy("signer").agg(F.mode("category", deterministic=True).alias("category"))
    sinks.write_outputs(sinks.release_attackers(rows, bots.join(category, "signer", "left")), f"{a.out}/release/attackers")
    legs = sinks.with_epoch(sinks.release_legs(tables(spark, a)["legs"], rows), "slot", chain.EPOCH)
    sinks.write_release(legs, f"{a.out}/release/legs", a.max_part_mb << 20)
    best = classes.selected(bots, a.csv_top_n, spark.createDataFrame([], "prefix string"))
    chosen = rows.join(best.select(F.col("signer").alias("attacker")), "attacker", "left_semi")
    sinks.write_outputs(sinks.csv_slice(legs, chosen), f"{a.out}/release/legs_slice")


def sandwich(spark: SparkSession, a: argparse.Namespace) -> None:
    matching.claimed_motifs(ledger.legs(spark, a.data)).write.mode("overwrite").parquet(f"{a.out}/motifs")


def leader(spark: SparkSession, a: argparse.Namespace) -> None:
    ordered.rotation_extents(ordered.rotations(tables(spark, a)["leaders"])).write.mode("overwrite").parquet(f"{a.out}/rotations")


def jito(spark: SparkSession, a: argparse.Namespace) -> None:
    t = tables(spark, a)
    sandwiches.bundle_verdicts(t["legs"], t["bundles"]).write.mode("overwrite").parquet(f"{a.out}/bundle_verdicts")


def reset(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.yes:
        raise SystemExit("reset drops all tables: say --yes")
    sinks.drop_tables(spark, a.data)


STEPS = {f.__name__: f for f in (phase1, phase2, phase3, phase4, report, dataset, sandwich, leader, jito, reset)}


def main(arguments: list[str] | None = None) -> None:
    a = options().parse_args(arguments)
    spark = SparkSession.builder.appName(f"sequora {a.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    STEPS[a.step](spark, a)


if __name__ == "__main__":
    main()
