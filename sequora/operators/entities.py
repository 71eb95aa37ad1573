"""Entities behind sandwiches: anchor keys, merging, features of an entity, profit floor and summaries.

Defined cases: entities without a measured value have null there; sums of nothing are null where the value is unknown
and zero where it counts; an entity of one sandwich has no deviation and no interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import graph

MODES = ("legacy", "feepayer", "owner", "owner+guard")
#: Count buckets by their first and last count.
COUNT_BUCKETS = ((1, 10), (11, 50), (51, 100), (101, 500), (501, 1000), (1001, None))
REASON_ORDER = ("ok", "no_protection", "empty_type", "limit_nonpositive", "actual_nonpositive", "uncomputable", "above_one", "unclassified", "no_victim")
FLOOR_USD, DEGREE_CAP = 100.0, 50


def key_sets(legs: DataFrame) -> DataFrame:
    """sid with arrays of candidate keys: all_signers, feepayers, owners (of both sides), front_owners, back_owners."""
    own = legs.where(F.col("type").isin("frontRun", "backRun"))
    side = lambda kind, x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == kind, x)))))  # noqa: E731  # a sandwich's own legs
    sets = own.groupBy("sid").agg(
        side("frontRun", F.col("signers")).alias("f_sign"), side("backRun", F.col("signers")).alias("b_sign"),
        side("frontRun", F.slice("signers", 1, 1)).alias("f_pay"), side("backRun", F.slice("signers", 1, 1)).alias("b_pay"),
        side("frontRun", F.col("owners_b")).alias("front_owners"), side("backRun", F.col("owners_b")).alias("back_owners"),
    )
    return sets.select("sid", F.array_union("f_sign", "b_sign").alias("all_signers"), F.array_union("f_pay", "b_pay").alias("feepayers"), F.array_intersect("front_owners", "back_owners").alias("owners"), "front_owners", "back_owners")


def anchors(sets: DataFrame, mode: str, token_accounts: DataFrame | None = None, degree_cap: int = DEGREE_CAP) -> DataFrame:
    """(sid, key): the keys that name a sandwich's entity.

    owner takes the owners of both sides, but for token accounts (key), else the fee payers; owner+guard also leaves out
    keys of more than ``degree_cap`` sandwiches, and falls back to fee payers that are not such keys.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    exploded = lambda rows, column: rows.select("sid", F.explode(column).alias("key")).where("key is not null").distinct()
    if mode in ("legacy", "feepayer"):
        return exploded(sets, "all_signers" if mode == "legacy" else "feepayers")
    owners = exploded(sets, "owners")
    if token_accounts is not None:
        owners = owners.join(token_accounts.select("key").distinct(), "key", "left_anti").select("sid", "key")
    payers = exploded(sets, "feepayers")
    found = owners.unionByName(payers.join(owners.select("sid").distinct(), "sid", "left_anti"))
    if mode == "owner":
        return found
    hot = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > degree_cap).select("key")
    kept = found.join(hot, "key", "left_anti").select("sid", "key")
    spare = payers.join(hot, "key", "left_anti").select("sid", "key")
    return kept.unionByName(spare.join(kept.select("sid").distinct(), "sid", "left_anti"))


def resolve(anchored: DataFrame) -> DataFrame:
    """(key, entity): keys linked by sandwiches, over all of them at once; the entity is its least key."""
    least = anchored.groupBy("sid").agg(F.min("key").alias("a"))
    return graph.components(anchored.join(least, "sid").select("a", F.col("key").alias("b")).distinct()).select(F.col("node").alias("key"), F.col("root").alias("entity"))


def named(sandwiches: DataFrame, anchored: DataFrame, entities: DataFrame) -> DataFrame:
    """The sandwiches with their entity as signer; those without an anchor keep theirs."""
    of = anchored.groupBy("sid").agg(F.min("key").alias("key")).join(entities, "key").select("sid", "entity")
    met = sandwiches.join(of, "sid", "left")
    return met.withColumn("signer", F.coalesce("entity", "signer")).drop("entity")


def merge_diagnostics(entities: DataFrame, anchored: DataFrame) -> DataFrame:
    """(size, entities, keys, sandwiches): how many entities there are of each number of keys."""
    sizes = entities.groupBy("entity").agg(F.count("*").alias("size"))
    per = anchored.join(entities, "key").groupBy("entity").agg(F.count_distinct("sid").alias("sandwiches"))
    return sizes.join(per, "entity", "left").groupBy("size").agg(F.count("*").alias("entities"), F.sum("size").alias("keys"), F.coalesce(F.sum("sandwiches"), F.lit(0)).alias("sandwiches"))


def key_degrees(anchored: DataFrame, top: int = 20) -> DataFrame:
    """The keys of the most sandwiches."""
    return anchored.groupBy("key").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "key").limit(top)


def tripwires(entities: DataFrame, sandwiches: DataFrame, most_keys: int, most_share: float) -> DataFrame:
    """Entities of too many keys or too large a share of all sandwiches."""
    sizes = entities.groupBy("entity").agg(F.count("*").alias("keys"))
    counts = sandwiches.groupBy(F.col("signer").alias("entity")).agg(F.count("*").alias("n"))
    total = sandwiches.agg(F.count("*").alias("all"))  # one row
    met = sizes.join(counts, "entity", "left").join(F.broadcast(total)).withColumn("share", F.coalesce("n", F.lit(0)) / F.when(F.col("all") > 0, F.col("all"))).drop("all")
    return met.where((F.col("keys") > most_keys) | (F.col("share") > most_share))


def entropy(rows: DataFrame, key: str, value: str, support: int | None = None) -> DataFrame:
    """(key, entropy, top_share, kinds): Shannon's entropy as a share of that of a fixed alphabet, or of the values met."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    # sum of n ln n, so that one more aggregation suffices
    sums = counts.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.max("n").alias("m"), F.count("*").alias("k"))
    raw = F.ln("t") - F.col("s") / F.col("t")
    most = F.ln(F.lit(float(support))) if support else F.when(F.col("k") > 1, F.ln("k"))
    return sums.select(key, F.least(F.greatest(F.coalesce(raw / most, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("entropy"), (F.col("m") / F.col("t")).alias("top_share"), F.col("k").alias("kinds"))


def intervals(rows: DataFrame, key: str = "signer", slot: str = "front_slot") -> DataFrame:
    """(key, avg_interval_slots, interval_cv, burstiness, active_slot_count, duty_cycle) over distinct active slots."""
    active = rows.select(key, slot).distinct()
    step = active.select(key, slot, (F.col(slot) - F.lag(slot).over(Window.partitionBy(key).orderBy(slot))).alias("d"))
    sums = step.groupBy(key).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("*").alias("active_slot_count"), (F.max(slot) - F.min(slot)).alias("span"))
    return sums.select(key, F.col("mean").alias("avg_interval_slots"), ratio(F.col("sd"), F.col("mean")).alias("interval_cv"), ratio(F.col("sd") - F.col("mean"), F.col("sd") + F.col("mean")).alias("burstiness"), "active_slot_count", (F.col("active_slot_count") / (F.when(F.col("span") > 0, F.col("span")) + 1)).alias("duty_cycle"))


def _percentiles(x: Column, name: str, at: dict[str, float]) -> list[Column]:
    return [F.percentile(x, q).alias(f"{name}_{suffix}") for suffix, q in at.items()]


def features(m: DataFrame) -> DataFrame:
    """One row an entity (``signer``) of per-sandwich metrics: counts, profits, gaps, consumption, shapes and concentrations."""
    sol, n = F.col("token_a") == "SOL", F.count("*")
    scored = ~F.col("sc_anomaly") & ~F.col("sc_unprotected")
    profit, sol_profit = F.col("profit_a"), F.when(sol, F.col("profit_a"))
    rate = lambda c: F.avg(c.cast("int"))
    gap_columns = []
    for side in ("front", "back"):
        g = F.col(f"{side}_gap")
        gap_columns += [*_percentiles(g, f"{side}_gap", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), ratio(F.stddev_samp(g), F.avg(g)).alias(f"{side}_gap_cv"), rate(g <= 1).alias(f"{side}_gap_le1_ratio"), F.count(g).alias(f"{side}_gap_n")]
    sc = F.when(scored, F.col("sc"))
    weight = F.when(scored, F.col("sc_victim_n"))
    out = m.groupBy("signer").agg(
        n.alias("sandwich_count"), F.min("front_slot").alias("first_slot"), F.max("front_slot").alias("last_slot"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct(F.hour(F.timestamp_seconds("ts"))).alias("active_hours"),
        rate(F.col("is_profitable")).alias("win_rate"), F.count("is_profitable").alias("win_rate_n"), F.coalesce(F.sum("fee_sol"), F.lit(0.0)).alias("fee_sol_total"), F.coalesce(F.sum("usd_net"), F.lit(0.0)).alias("usd_net_total"),
        F.count_if(sol).alias("sol_count"), F.count_if(~sol).alias("nonsol_count"), F.avg(sol_profit).alias("sol_avg_profit"), F.percentile(sol_profit, 0.5).alias("sol_profit_median"),
        rate(F.when(sol, F.col("is_profitable_sol"))).alias("sol_win_rate"), F.sum(F.when(sol, profit - F.col("fee_sol"))).alias("sol_net_profit"),
        ratio(F.max(sol_profit), F.sum(F.when(sol & (profit > 0), profit))).alias("sol_profit_top1_share"),
        ratio(F.abs(F.avg(F.when(sol & (profit < 0), profit))), F.avg(F.when(sol & (profit > 0), profit))).alias("sol_loss_magnitude_ratio"),
        rate(F.when(~sol, F.col("is_profitable"))).alias("nonsol_win_rate"), *gap_columns, rate(F.col("front_gap") <= 100).alias("fg100_ratio"),
        F.avg(sc).alias("mean_sc"), *_percentiles(sc, "sc", {"median": 0.5, "p90": 0.9}), F.stddev_samp(sc).alias("sc_std"), F.count(sc).alias("sc_scoreable_n"),
        ratio(F.sum(sc * weight), F.sum(F.when(sc.isNotNull(), weight))).alias("sc_victim_weighted_mean"), F.count_if(F.col("sc_unprotected")).alias("sc_unprotected_n"),
        rate(F.col("jito_bundle")).alias("jito_rate"), F.count_if(F.col("jito_bundle")).alias("jito_count"), F.count_if(F.col("jito_colocated")).alias("jito_colocated_count"),
        F.count_if(~F.col("cross_block")).alias("in_block_count"), F.count_if(F.col("cross_block")).alias("cross_block_count"), F.count_if(F.col("cross_leader")).alias("cross_leader_count"),
        F.avg("victim_count").alias("victim_count_mean"), F.percentile("victim_count", 0.5).alias("victim_count_p50"), F.max("victim_count").alias("victim_count_max"),
        F.count_distinct("token_b").alias("token_b_nunique"),
    )
    span = F.col("last_slot") - F.col("first_slot")
    settled = F.col("sc_unprotected_n") + F.col("sc_scoreable_n")
    out = out.select("*", span.alias("active_slot_span"), ratio(F.col("sandwich_count"), span).alias("sandwich_frequency"), (F.col("sc_scoreable_n") / F.col("sandwich_count")).alias("sc_coverage"), ratio(F.col("sc_unprotected_n"), settled).alias("unprotected_rate"), (1 - settled / F.col("sandwich_count")).alias("sc_anomaly_rate"))
    shaped = m.withColumn("shape", F.concat_ws("/", "front_count", "back_count", "victim_count")).withColumn("hour", F.hour(F.timestamp_seconds("ts")))
    for value, support in (("hour", 24), ("shape", None), ("pool_dex", None), ("token_b", None)):
        one = entropy(shaped, "signer", value, support)
        kept = [F.col("entropy").alias(f"{value}_entropy")] + ([F.col("top_share").alias(f"{value}_top_share")] if value in ("pool_dex", "token_b") else [])
        out = out.join(one.select("signer", *kept), "signer", "left")
    return out.join(intervals(m), "signer", "left").join(top_reason(m), "signer", "left")


def top_reason(m: DataFrame) -> DataFrame:
    """(signer, sc_reason_top): the commonest reason of sandwiches without a figure, ties by the reasons' own order."""
    order = F.coalesce(*[F.when(F.col("sc_reason") == r, i) for i, r in enumerate(REASON_ORDER)])
    return m.where("sc_anomaly").groupBy("signer", "sc_reason").agg(F.count("*").alias("n")).groupBy("signer").agg(F.max_by("sc_reason", F.struct("n", -order)).alias("sc_reason_top"))


def profit_floor(m: DataFrame, features: DataFrame, floor: float = FLOOR_USD) -> tuple[DataFrame, DataFrame]:
    """The sandwiches and entities of at least ``floor`` net USD.

    Entities of bundles only stay if they made anything, or if nothing of theirs has a price.
    """
    priced, usd = F.col("win_rate_n") > 0, F.col("usd_net_total")
    bundled = F.col("jito_count") >= F.col("sandwich_count")
    kept = features.where((priced & (usd >= floor)) | (bundled & (~priced | (usd > 0))))
    return m.join(kept.select("signer"), "signer", "left_semi"), kept


def count_bucket(n: Column) -> Column:
    """Labels such as 1-10 and 1001+."""
    return F.coalesce(*[F.when((n >= lo) & (n <= hi) if hi else n >= lo, f"{lo}-{hi}" if hi else f"{lo}+") for lo, hi in COUNT_BUCKETS], F.lit("unknown"))


def summary(m: DataFrame, features: DataFrame) -> DataFrame:
    """Features with USD and SOL totals and the count bucket; USD sums stay null where nothing has a price."""
    sol, usd = F.col("token_a") == "SOL", F.col("usd_gross")
    sums = m.groupBy("signer").agg(
        F.sum(usd).alias("usd_total_profit"), F.count_if(usd > 0).alias("usd_positive_count"), F.count_if(usd < 0).alias("usd_negative_count"), F.count(usd).alias("usd_priced_count"),
        (F.count(usd) / F.count("*")).alias("usd_price_coverage"), F.coalesce(F.sum(F.when(sol, F.col("profit_a"))), F.lit(0.0)).alias("sol_total_profit"), F.count_if(sol).alias("sol_sandwich_count"),
    )
    return features.join(sums, "signer", "left").withColumn("count_bucket", count_bucket(F.col("sandwich_count")))
