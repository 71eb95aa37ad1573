"""Classes of entities: tracks and gates, tiers, sensitivity to the gates, merged lists and verdicts of experts.

A null never passes a gate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

# Fixed values.
N_MIN, WR_MIN, SC_MIN, GAP_MAX, USD_MIN = 100, 0.85, 0.90, 75, 10.0
ONESHOT_N, ONESHOT_USD = 5, 100.0
TIERS = ("jito_and_signal", "jito_only", "signal_and_oneshot", "signal", "oneshot", "unclassified")
BOT_TYPES = {"jito_only": "Jito Bot", "signal": "Signal Bot", "jito_and_signal": "Jito Bot + Signal Bot", "oneshot": "Oneshot Bot", "signal_and_oneshot": "Signal Bot + Oneshot Bot"}
ATOMS = {"Jito Bot": "jito", "Signal Bot": "signal", "Oneshot Bot": "oneshot"}
CATEGORIES = ("standard", "multi_split", "diff_signer_owner", "diff_signer_transfer")


def _passes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def economic_pool(n_min: int = N_MIN, wr_min: float = WR_MIN, usd_min: float = USD_MIN) -> Column:
    return _passes((F.col("usd_net_total") >= usd_min) & (F.col("sandwich_count") >= n_min) & (F.col("sol_win_rate") >= wr_min))


def signal_gates(sc_min: float = SC_MIN, gap_max: float = GAP_MAX) -> Column:
    return _passes((F.col("mean_sc") >= sc_min) & (F.col("front_gap_p50") <= gap_max))


def classify(features: DataFrame, n_min: int = N_MIN, wr_min: float = WR_MIN, sc_min: float = SC_MIN, gap_max: float = GAP_MAX, usd_min: float = USD_MIN, oneshot: bool = False, oneshot_n: int = ONESHOT_N, oneshot_usd: float = ONESHOT_USD) -> DataFrame:
    """Features with in_pool, is_jito, is_signal, is_oneshot, tier and bot_type.

    A verified bundle alone makes a Jito bot; a signal bot is of the economic pool and passes both signal gates; few but
    dear sandwiches make a oneshot bot where that track is on.
    """
    pool = economic_pool(n_min, wr_min, usd_min)
    once = _passes((F.col("sandwich_count") <= oneshot_n) & (F.col("sol_win_rate") >= wr_min) & (F.col("usd_net_total") >= oneshot_usd)) if oneshot else F.lit(False)
    out = features.withColumns({"in_pool": pool, "is_jito": _passes(F.col("jito_count") > 0), "is_signal": pool & signal_gates(sc_min, gap_max), "is_oneshot": once})
    jito, signal, one = F.col("is_jito"), F.col("is_signal"), F.col("is_oneshot")
    tier = F.when(jito & signal, "jito_and_signal").when(jito, "jito_only").when(signal & one, "signal_and_oneshot").when(signal, "signal").when(one, "oneshot").otherwise("unclassified")
    out = out.withColumn("tier", tier)
    names = F.create_map(*[F.lit(x) for pair in BOT_TYPES.items() for x in pair])
    return out.withColumn("bot_type", F.try_element_at(names, F.col("tier")))


def tier_totals(classified: DataFrame) -> DataFrame:
    """A row a tier, empty ones too: entities, sandwiches, SOL and USD net, and their shares of all."""
    tiers = classified.sparkSession.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "tier string, turn int")
    sums = classified.groupBy("tier").agg(F.count("*").alias("entities"), F.sum("sandwich_count").alias("sandwiches"), F.sum("sol_net_profit").alias("sol_net"), F.sum("usd_net_total").alias("usd_net"))
    met = tiers.join(sums, "tier", "left").fillna(0, ["entities", "sandwiches", "sol_net", "usd_net"])
    whole = Window.partitionBy(F.lit(1))  # six rows
    return met.select("tier", "turn", "entities", "sandwiches", "sol_net", "usd_net", ratio(F.col("entities"), F.sum("entities").over(whole)).alias("entity_share"), ratio(F.col("sandwiches"), F.sum("sandwiches").over(whole)).alias("sandwich_share"))


def bots_and_others(classified: DataFrame) -> DataFrame:
    """Bots against all others: entities, sandwiches, USD net, and what part of it is positive."""
    return classified.groupBy((F.col("tier") != "unclassified").alias("is_bot")).agg(F.count("*").alias("entities"), F.sum("sandwich_count").alias("sandwiches"), F.sum("usd_net_total").alias("usd_net"), F.sum(F.greatest("usd_net_total", F.lit(0.0))).alias("usd_positive"), F.sum("fee_sol_total").alias("fee_sol"))


def usd_split(m: DataFrame) -> DataFrame:
    """USD net of an entity in SOL and other tokens, and how many of the others have a price."""
    sol = F.col("token_a") == "SOL"
    return m.groupBy("signer").agg(
        F.coalesce(F.sum("usd_net"), F.lit(0.0)).alias("usd_total_profit"), F.avg("usd_net").alias("usd_avg_profit"), F.sum("fee_sol").alias("fee_sol_paid"),
        F.coalesce(F.sum(F.when(sol, F.col("usd_net"))), F.lit(0.0)).alias("usd_profit_sol_part"), F.coalesce(F.sum(F.when(~sol, F.col("usd_net"))), F.lit(0.0)).alias("usd_profit_nonsol_part"),
        ratio(F.count(F.when(~sol, F.col("usd_net"))), F.count_if(~sol)).alias("usd_price_coverage"),
    )


def gate_funnel(features: DataFrame, n_min: int = N_MIN, wr_min: float = WR_MIN, sc_min: float = SC_MIN, gap_max: float = GAP_MAX, usd_min: float = USD_MIN) -> DataFrame:
    """How many entities pass the gates one after the other, either signal gate alone, and both."""
    usd, n, wr = (_passes(x) for x in (F.col("usd_net_total") >= usd_min, F.col("sandwich_count") >= n_min, F.col("sol_win_rate") >= wr_min))
    sc, gap = _passes(F.col("mean_sc") >= sc_min), _passes(F.col("front_gap_p50") <= gap_max)
    pool = usd & n & wr
    steps = {"all_entities": F.lit(True), "usd": usd, "usd_n": usd & n, "pool": pool, "sc_only": pool & sc & ~gap, "gap_only": pool & ~sc & gap, "both": pool & sc & gap, "neither": pool & ~sc & ~gap}
    return features.agg(*[F.count_if(test).alias(name) for name, test in steps.items()])


def sensitivity(features: DataFrame, settings: list[tuple]) -> DataFrame:
    """Signal bots, their sandwiches and USD net for each (name, n_min, wr_min, sc_min, gap_max), none left out."""
    names = ("setting", "n_min", "wr_min", "sc_min", "gap_max")
    grid = F.array(*[F.struct(*[F.lit(float(v) if i > 1 else v).alias(n) for i, (n, v) in enumerate(zip(names, s, strict=True))]) for s in settings])  # a dozen
    met = features.select("sandwich_count", "sol_win_rate", "mean_sc", "front_gap_p50", "usd_net_total", F.inline(grid))
    passes = _passes((F.col("usd_net_total") >= USD_MIN) & (F.col("sandwich_count") >= F.col("n_min")) & (F.col("sol_win_rate") >= F.col("wr_min")) & (F.col("mean_sc") >= F.col("sc_min")) & (F.col("front_gap_p50") <= F.col("gap_max")))
    return met.groupBy("setting", "n_min", "wr_min", "sc_min", "gap_max").agg(F.count_if(passes).alias("bots"), F.sum(F.when(passes, F.col("sandwich_count")).otherwise(0)).alias("sandwiches"), F.sum(F.when(passes, F.col("usd_net_total")).otherwise(0.0)).alias("usd_net"))


def stage_tables(features: DataFrame, sweep: list[int]) -> DataFrame:
    """For every stage of the gates and threshold k: entities, sandwiches and USD at most and at least k sandwiches."""
    stages = {"1 all": F.lit(True), "2 usd": _passes(F.col("usd_net_total") >= USD_MIN), "3a sc": _passes(F.col("mean_sc") >= SC_MIN), "3b gap": _passes(F.col("front_gap_p50") <= GAP_MAX), "4 both": signal_gates()}
    named = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in stages.items()]), lambda x: x.isNotNull())
    cut = features.select(F.explode(named).alias("stage"), "sandwich_count", "usd_net_total")
    each = cut.select("stage", F.explode(F.array(*[F.lit(k) for k in sweep])).alias("k"), "sandwich_count", "usd_net_total")
    low, high = F.col("sandwich_count") <= F.col("k"), F.col("sandwich_count") >= F.col("k")
    return each.groupBy("stage", "k").agg(F.count_if(low).alias("n_at_most"), F.count_if(high).alias("n_at_least"), F.sum(F.when(low, F.col("sandwich_count")).otherwise(0)).alias("sandwiches_at_most"), F.sum(F.when(high, F.col("sandwich_count")).otherwise(0)).alias("sandwiches_at_least"), F.sum(F.when(high, F.col("usd_net_total")).otherwise(0.0)).alias("usd_at_least"))


def merged(rows: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """One row an attacker over categories: sums, the types of all, and behaviour of the category of most sandwiches."""
    labels = labels or {c: c.replace("multi_split", "multi-split") for c in CATEGORIES}
    rank = F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(CATEGORIES)], F.lit(len(CATEGORIES)))
    atoms = F.transform(F.split("bot_type", r" \+ "), lambda a: F.try_element_at(F.create_map(*[F.lit(x) for pair in ATOMS.items() for x in pair]), a))
    grouped = rows.withColumns({"rank": rank, "atoms": atoms}).groupBy("signer").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("atoms")))), "+").alias("bot_type"),  # at most a row a category
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "category"))), lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in labels.items() for v in pair]), x["category"]), x["category"])), "+").alias("attack_type"),
        F.count_distinct("category").alias("n_categories"), F.min_by("category", F.struct(-F.col("sandwich_count"), F.col("rank"))).alias("primary_category"),
        *[F.min_by(c, F.struct(-F.col("sandwich_count"), F.col("rank"))).alias(c) for c in ("win_rate", "sol_win_rate", "mean_sc", "front_gap_p50")],
        F.sum("sandwich_count").alias("sandwiches"), F.coalesce(F.sum("usd_net_total"), F.lit(0.0)).alias("usd_net"), F.coalesce(F.sum("sol_net_profit"), F.lit(0.0)).alias("sol_net"),
        *[F.sum(F.when(F.col("category") == c, F.col("sandwich_count")).otherwise(0)).alias(f"sw_{c}") for c in CATEGORIES],
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("usd_net_total"))), F.lit(0.0)).alias(f"usd_{c}") for c in CATEGORIES],
    )
    return grouped


def annotated(bots: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Bots with the experts' verdict (signer, selected, verdict, case_id), and why there is none.

    Jito bots that are nothing else were not asked about; without verdicts there was no audit.
    """
    if verdicts is None:
        return bots.withColumns({"expert_verdict": F.lit("no_audit_for_tag"), "expert_case_id": F.lit(None).cast("string")})
    chosen = verdicts.where("selected").dropDuplicates(["signer"]).select("signer", F.col("verdict").alias("v"), F.col("case_id").alias("expert_case_id"))
    met = bots.join(chosen, "signer", "left")
    return met.withColumn("expert_verdict", F.coalesce("v", F.when(F.col("bot_type") == "Jito Bot", "not_audited"))).drop("v")


def without_rejected(bots: DataFrame) -> DataFrame:
    return bots.where(F.coalesce(F.col("expert_verdict") != "no", F.lit(True)))


def resolve_prefixes(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, signer) of prefixes that just one name starts with; prefixes are a short list."""
    met = names.select("signer").distinct().join(F.broadcast(prefixes), F.col("signer").startswith(F.col("prefix")))
    return met.groupBy("prefix").agg(F.count("*").alias("n"), F.min("signer").alias("signer")).where("n = 1").select("prefix", "signer")


def selected(bots: DataFrame, top: int, prefixes: DataFrame) -> DataFrame:
    """The attackers of the highest profit, and those that a prefix names."""
    best = bots.orderBy(F.desc_nulls_last("usd_net_total"), "signer").limit(top).select("signer")
    return best.unionByName(resolve_prefixes(bots, prefixes).select("signer")).distinct()


def audit_sample(rows: DataFrame, stratum: str, quotas: Mapping[str, int], seed: int) -> DataFrame:
    """Rows drawn by strata, a blinded number each: a row's place is the hash of its signer and the seed."""
    place = F.xxhash64(F.lit(seed), "signer")
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    drawn = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(place, "signer"))).where(F.col("_n") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0)))
    blind = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + 1), "signer"), "signer"))  # the quotas bound the rows
    return drawn.drop("_n").withColumn("case", F.concat(F.lit("case-"), F.lpad(blind.cast("string"), 4, "0")))


def anchors_of(rows: DataFrame, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """The sandwich at each share of an entity's own slots, in order."""
    order = Window.partitionBy("signer").orderBy("front_slot", "sid")
    n = F.count("*").over(Window.partitionBy("signer"))
    turn = rows.select("signer", "sid", "front_slot", F.row_number().over(order).alias("turn"), n.alias("n"))
    asked = turn.select("*", F.explode(F.array(*[F.lit(q) for q in at])).alias("share"))
    return asked.where(F.col("turn") == F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n")))).select("signer", "share", "sid", "front_slot")
