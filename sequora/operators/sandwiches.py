"""Sandwiches from their legs: headers, scopes, patterns, geometry, slippage consumption, gaps, bundles and net profit.

Every function takes DataFrames and returns one, a row a sandwich unless it says otherwise.  Legs are ordered by
(slot, position).  Unknown values are null throughout: a leg whose leader is unknown equals no other leader, an unpriced
sandwich has no profit in USD, and a null never passes a gate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import common_first, motif_id, ratio
from . import ordered

# Fixed values.
FRONT, BACK, VICTIM, ADVERSE, TRANSFER = "frontRun", "backRun", "victim", "adverse", "transfer"
CORE = (FRONT, BACK, VICTIM)
SC_FLOOR, SC_CEILING_TOLERANCE = 0.01, 1e-9
REASONS = ("no_victim", "unclassified", "empty_type", "limit_nonpositive", "actual_nonpositive", "uncomputable", "above_one", "ok", "no_protection")
LONG_SPAN, TX_PER_SLOT = 100, 1272
LAMPORTS = 1e9


def place(*more: str) -> Column:
    return F.struct("slot", "position", *more)


def _only(kind: str, x: Column | str) -> Column:
    return F.when(F.col("type") == kind, F.col(x) if isinstance(x, str) else x)


def headers(legs: DataFrame) -> DataFrame:
    """sid, ends, counts, flags, tokens, signers, owners, profit in token A and the fee of the attacker's own legs."""
    first = lambda kind, x: F.min_by(x, _when_place(kind))
    last = lambda kind, x: F.max_by(x, _when_place(kind))
    own = F.col("type").isin(FRONT, BACK)
    out = legs.groupBy("sid").agg(
        first(FRONT, F.col("slot")).alias("front_slot"), last(BACK, F.col("slot")).alias("back_slot"),
        first(FRONT, F.col("sig")).alias("front_sig"), first(BACK, F.col("sig")).alias("back_sig"),
        first(FRONT, F.col("ts")).alias("ts"), first(FRONT, F.col("from_token")).alias("token_a"), first(FRONT, F.col("to_token")).alias("token_b"),
        first(FRONT, F.col("signers")).alias("front_signers"), first(BACK, F.col("signers")).alias("back_signers"),
        first(FRONT, F.col("pool_dex")).alias("pool_dex"),
        *[F.count_if(F.col("type") == kind).alias(f"{name}_count") for kind, name in ((FRONT, "front"), (BACK, "back"), (VICTIM, "victim"), (ADVERSE, "adverse"), (TRANSFER, "transfer"))],
        F.sum(_only(FRONT, "from_amount")).alias("front_a"), F.sum(_only(FRONT, "to_amount")).alias("front_b"),
        F.sum(_only(BACK, "from_amount")).alias("back_b"), F.sum(_only(BACK, "to_amount")).alias("back_a"),
        F.array_distinct(F.flatten(F.collect_list(_only(FRONT, "owners_b")))).alias("front_owners"),  # a sandwich's own legs
        F.array_distinct(F.flatten(F.collect_list(_only(BACK, "owners_b")))).alias("back_owners"),
        (F.sum(F.when(own, F.col("fee"))) / LAMPORTS).alias("fee_sol"),
    )
    out = out.where("front_count > 0 and back_count > 0")
    return out.select(
        "*", motif_id(F.col("front_sig"), F.col("back_sig")).alias("motif_id"),
        F.arrays_overlap("front_signers", "back_signers").alias("signer_same"),
        (F.size(F.array_except("back_owners", "front_owners")) == 0).alias("owner_same"),
        (F.col("front_count") > 1).alias("multi_front"), (F.col("back_count") > 1).alias("multi_back"), (F.col("transfer_count") > 0).alias("has_transfer"),
        (F.col("front_slot") != F.col("back_slot")).alias("cross_block"),
        # the whole inventory of B sold at the back's price
        (ratio(F.col("front_b") * F.col("back_a"), F.col("back_b")) - F.col("front_a")).alias("profit_a"),
        (F.col("back_a") - F.col("front_a")).alias("diff_a"), (F.col("back_b") - F.col("front_b")).alias("diff_b"),
        common_first(F.col("front_signers"), F.col("back_signers"), F.element_at("front_signers", 1)).alias("signer"),
    )


def _when_place(kind: str) -> Column:
    return F.when(F.col("type") == kind, F.struct("slot", "position"))


def scope() -> Column:
    """The category of a sandwich; null for those of different signers with several fronts or backs."""
    multi = F.col("multi_front") | F.col("multi_back")
    return F.when(F.col("signer_same"), F.when(multi, "multi_split").otherwise("standard")).when(~multi, F.when(F.col("owner_same"), "diff_signer_owner").otherwise("diff_signer_transfer"))


def pattern() -> Column:
    multi = F.col("multi_front") | F.col("multi_back")
    return (
        F.when(F.col("signer_same") & ~multi, "1 standard")
        .when(F.col("signer_same"), "2 multi-front/back")
        .when(F.col("owner_same") & ~multi, "3 diff-signer (owner)")
        .when(F.col("has_transfer") & ~multi, "4 diff-signer (transfer)")
        .when(multi, "5 diff-signer x multi")
        .otherwise("6 other")
    )


def distance(cross_leader: Column, cross_block: Column) -> Column:
    return F.when(cross_leader, "cross-leader multi-slot").when(cross_block, "same-leader multi-slot").otherwise("single-slot")


def variant(rows: DataFrame, which: str) -> DataFrame:
    """Those with several fronts only, several backs only, both, or all."""
    multi = {"all": F.lit(True), "multi_front": F.col("multi_front") & ~F.col("multi_back"), "multi_back": ~F.col("multi_front") & F.col("multi_back"), "both": F.col("multi_front") & F.col("multi_back")}
    return rows.where(multi[which])


def cross_leader_scope(rows: DataFrame, which: str) -> DataFrame:
    """With, without or only those that cross leaders."""
    return rows if which == "include" else rows.where(F.col("cross_leader") if which == "only" else ~F.coalesce("cross_leader", F.lit(False)))


def geometry(legs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Where a sandwich's victims lie to the producers of its first front's and its last back's slot."""
    once = leaders.groupBy("slot").agg(F.min("leader").alias("leader"))
    placed = legs.where(F.col("type").isin(*CORE)).select("sid", "type", "slot", "position").join(once, "slot", "left")
    ends = placed.groupBy("sid").agg(
        F.min_by("slot", _when_place(FRONT)).alias("front_slot"), F.max_by("slot", _when_place(BACK)).alias("back_slot"),
        F.min_by("leader", _when_place(FRONT)).alias("front_leader"), F.max_by("leader", _when_place(BACK)).alias("back_leader"),
        F.min_by("leader", _when_place(VICTIM)).alias("first_victim_leader"), F.count_if(F.col("type") == VICTIM).alias("n_victims"),
        # victims by slot, so that they needn't meet the ends in another join
        F.collect_list(F.when(F.col("type") == VICTIM, F.struct("slot", "leader"))).alias("v"),
    )
    where = lambda test: F.size(F.filter("v", test)).cast("long")
    return ends.select(
        "sid", "front_slot", "back_slot", "front_leader", "back_leader", "n_victims",
        (F.col("front_slot") != F.col("back_slot")).alias("cross_block"),
        (F.col("front_leader") != F.col("back_leader")).alias("cross_leader"),
        where(lambda x: x["leader"] == F.col("front_leader")).alias("v_front_leader"),
        where(lambda x: x["leader"] == F.col("back_leader")).alias("v_back_leader"),
        (F.col("first_victim_leader") == F.col("front_leader")).alias("first_v_front_leader"),
        where(lambda x: x["slot"] == F.col("front_slot")).alias("v_same_block_as_front"),
    )


def geometry_classes(rows: DataFrame) -> DataFrame:
    """The three shapes, and the five of those that cross leaders."""
    xl, nv, vf = F.coalesce("cross_leader", F.lit(False)), F.coalesce("n_victims", F.lit(0)), F.coalesce("v_front_leader", F.lit(0))
    shape = F.when(xl, "cross_leader").when(F.coalesce("cross_block", F.lit(False)), "same_leader_multi_slot").otherwise("single_slot")
    return rows.select(
        "*", shape.alias("geom_class"),
        (xl & (nv > 0) & (vf == nv)).alias("xl_all_victims_front_leader"),
        (xl & F.coalesce("first_v_front_leader", F.lit(False))).alias("xl_first_victim_front_leader"),
        (xl & (nv > 0) & (vf == 0)).alias("xl_no_victim_front_leader"),
        (xl & (nv == 1) & (vf == 1)).alias("xl_single_victim_same_leader"),
        (xl & (nv == 1) & (vf == 0)).alias("xl_single_victim_diff_leader"),
    )


def broken_geometry(rows: DataFrame) -> DataFrame:
    """Rows that cross leaders within a block: none, if flags and slots agree."""
    return rows.where(F.col("cross_leader") & ~F.col("cross_block"))


def victim_consumption(legs: DataFrame) -> DataFrame:
    """A row a victim leg: the share of its slippage tolerance that was consumed, and why it has none."""
    kind, limit, actual = F.col("limit_type"), F.col("limit_amount"), F.col("actual_amount")
    known, out = kind.isin("output", "input"), kind == "output"
    share = F.when(out, ratio(limit, actual)).otherwise(ratio(actual, limit))
    reason = (
        F.when(~known | kind.isNull(), "empty_type")
        .when(limit < 0, "limit_nonpositive")
        .when(limit == 0, F.when(out, "no_protection").otherwise("limit_nonpositive"))
        .when(actual <= 0, "actual_nonpositive")
        .when(share <= 1 * (1 + SC_CEILING_TOLERANCE), "ok")
        .when(share.isNotNull(), "above_one")
        .otherwise("unclassified")
    )
    rows = legs.where(F.col("type") == VICTIM).select("sid", "sig", "slot", "position", reason.alias("reason"), share.alias("share"))
    return rows.select("sid", "sig", "slot", "position", "reason", F.when(F.col("reason") == "ok", F.least("share", F.lit(1.0))).when(F.col("reason") == "no_protection", 0.0).alias("sc"))


def sandwich_consumption(sandwiches: DataFrame, victims: DataFrame) -> DataFrame:
    """The highest consumption of protected victims; an anomalous victim voids it, and so does having none."""
    priority = F.coalesce(*[F.when(F.col("reason") == r, i) for i, r in enumerate(REASONS)])
    protected = F.col("sc") >= SC_FLOOR
    grouped = victims.withColumn("priority", priority).groupBy("sid").agg(F.count("*").alias("n"), F.count_if(~F.col("reason").isin("ok", "no_protection")).alias("odd"), F.count_if(protected).alias("protected"), F.max(F.when(protected, F.col("sc"))).alias("top"), F.min("priority").alias("worst"))
    met = sandwiches.select("sid").join(grouped, "sid", "left").fillna(0, ["n", "odd", "protected"])
    anomaly = (F.col("odd") > 0) | (F.col("n") == 0)
    unprotected = ~anomaly & (F.col("protected") == 0)
    reason = F.when(unprotected, "no_protection").otherwise(F.coalesce(F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("worst")), F.lit("no_victim")))
    return met.select("sid", F.when(~anomaly & ~unprotected, F.col("top")).alias("sc"), anomaly.alias("sc_anomaly"), unprotected.alias("sc_unprotected"), reason.alias("sc_reason"), F.col("n").alias("sc_victim_n"), F.col("odd").alias("sc_victim_anomaly_n"), F.col("protected").alias("sc_victim_protected_n"))


def gaps(legs: DataFrame, counts: DataFrame) -> DataFrame:
    """Transactions between the last front and the first victim, and between the last victim and the first back.

    A slot's coordinate is the number of transactions before it; beyond ``LONG_SPAN`` slots the span is reckoned at
    ``TX_PER_SLOT`` a slot instead.  counts may hold a slot more than once: the largest counts.
    """
    starts = ordered.prefix_sum(counts.groupBy("slot").agg(F.max("tx_count").alias("tx_count")), "slot", "tx_count", "start")
    ends = legs.groupBy("sid").agg(*[F.max(_when_place(FRONT)).alias("f"), F.min(_when_place(VICTIM)).alias("v1"), F.max(_when_place(VICTIM)).alias("v2"), F.min(_when_place(BACK)).alias("b")])
    points = ends.select("sid", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("at")) for i, c in enumerate(("f", "v1", "v2", "b"))])).alias("p")).select("sid", "p.which", "p.at.slot", "p.at.position")
    met = points.join(starts.select("slot", "start"), "slot", "left")
    at = lambda i, x: F.max(F.when(F.col("which") == i, F.col(x)))
    wide = met.groupBy("sid").agg(*[at(i, x).alias(f"{x}{i}") for i in range(4) for x in ("slot", "position", "start")])

    def gap(a: int, b: int) -> Column:
        span = F.col(f"slot{b}") - F.col(f"slot{a}")
        far = F.lit(TX_PER_SLOT) * (span - 1)
        near = F.col(f"start{b}") + F.col(f"position{b}") - F.col(f"start{a}") - F.col(f"position{a}")
        return F.when(span > LONG_SPAN, far).otherwise(near).cast("long")

    return wide.select("sid", gap(0, 1).alias("front_gap"), gap(2, 3).alias("back_gap"))


def bundle_verdicts(legs: DataFrame, bundles: DataFrame) -> DataFrame:
    """(sid, bundle_id): sandwiches of which one bundle holds a front, a victim and a back."""
    held = bundles.select("bundle_id", F.explode("transactions").alias("sig")).distinct()
    core = legs.where(F.col("type").isin(*CORE)).select("sid", "type", "sig")
    kinds = core.join(held, "sig").groupBy("sid", "bundle_id").agg(F.count_distinct("type").alias("kinds"))
    return kinds.where("kinds = 3").groupBy("sid").agg(F.min("bundle_id").alias("bundle_id"))


def verified_bundles(sandwiches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """sid of verdicts whose sandwich has one signer and made a profit in token A."""
    return sandwiches.where(F.col("signer_same") & (F.col("profit_a") > 0)).join(verdicts, "sid", "left_semi").select("sid")


def bundle_candidates(legs: DataFrame) -> DataFrame:
    """sid of sandwiches in one slot of which every core leg is bundled."""
    return legs.where(F.col("type").isin(*CORE)).groupBy("sid").agg(F.count_distinct("slot").alias("slots"), F.count_if(~F.col("in_bundle")).alias("loose")).where("slots = 1 and loose = 0").select("sid")


def net_usd(sandwiches: DataFrame, prices: DataFrame, sol: str = "SOL") -> DataFrame:
    """token_a_price, usd_gross, usd_fee and usd_net, null where the token has no price."""
    sol_price = prices.where(F.col("token") == sol).agg(F.max("usd").alias("sol_usd"))  # one row
    named = prices.where("usd is not null").dropDuplicates(["token"]).select(F.col("token").alias("token_a"), F.col("usd").alias("token_a_price"))
    met = sandwiches.join(named, "token_a", "left").join(F.broadcast(sol_price))
    gross = F.col("profit_a") * F.col("token_a_price")
    fee = F.coalesce("fee_sol", F.lit(0.0)) * F.col("sol_usd")
    return met.select("*", gross.alias("usd_gross"), F.when(gross.isNotNull(), fee).alias("usd_fee"), (gross - fee).alias("usd_net")).drop("sol_usd")


def require_price(prices: DataFrame, token: str = "SOL") -> float:
    """The price that fees are reckoned in; without it no net figure would be net, so its absence is an error."""
    found = prices.where(F.col("token") == token).agg(F.max("usd")).first()[0]
    if found is None:
        raise ValueError(f"no price of {token}: fees cannot be priced")
    return float(found)


def metrics(legs: DataFrame, leaders: DataFrame, counts: DataFrame, bundles: DataFrame, prices: DataFrame) -> DataFrame:
    """Per-sandwich metrics: headers, scope, shape, consumption, gaps, bundle flags and net profit."""
    top = headers(legs)
    shape = geometry_classes(geometry(legs, leaders)).drop("front_slot", "back_slot", "cross_block")
    sc = sandwich_consumption(top, victim_consumption(legs))
    verdicts = bundle_verdicts(legs, bundles)
    marked = verified_bundles(top, verdicts).withColumn("verified", F.lit(True))
    near = bundle_candidates(legs).withColumn("colocated", F.lit(True))
    out = top.join(shape, "sid").join(sc, "sid").join(gaps(legs, counts), "sid").join(marked, "sid", "left").join(near, "sid", "left")
    out = net_usd(out, prices)
    return out.select(
        "*", scope().alias("category"), pattern().alias("pattern"), distance(F.col("cross_leader"), F.col("cross_block")).alias("distance"),
        F.coalesce("verified", F.lit(False)).alias("jito_bundle"), F.coalesce("colocated", F.lit(False)).alias("jito_colocated"),
        (F.col("usd_net") > 0).alias("is_profitable"), F.when(F.col("token_a") == "SOL", F.col("profit_a") > F.col("fee_sol")).alias("is_profitable_sol"),
    ).drop("verified", "colocated")


def leg_rows(sandwiches: DataFrame, arrays: Mapping[str, str]) -> DataFrame:
    """Leg rows of sandwiches that hold theirs in arrays of structs, by kind in the order given."""
    each = [F.transform(F.coalesce(F.col(column), F.array().cast(sandwiches.schema[column].dataType)), lambda x, i, k=kind, n=n: F.struct(F.lit(n).alias("turn"), F.lit(k).alias("type"), i.alias("at"), x.alias("leg"))) for n, (kind, column) in enumerate(arrays.items())]
    kept = [c for c in sandwiches.columns if c not in arrays.values()]
    return sandwiches.select(*kept, F.explode(F.concat(*each)).alias("x")).select(*kept, "x.turn", "x.type", "x.at", "x.leg.*")


def program_rows(legs: DataFrame) -> DataFrame:
    """(sid, program) of the attacker's own legs."""
    return legs.where(F.col("type").isin(FRONT, BACK)).select("sid", F.explode("programs").alias("program")).distinct()


def entry_programs(legs: DataFrame, known: list[str]) -> DataFrame:
    """(sid, program): of the unknown programs of a sandwich's own legs the one called least."""
    rows = legs.where(F.col("type").isin(FRONT, BACK)).select("sid", F.explode("programs").alias("program")).where(~F.col("program").isin(known))
    return rows.groupBy("sid", "program").agg(F.count("*").alias("n")).groupBy("sid").agg(F.min_by("program", F.struct("n", "program")).alias("program"))


def leg_tips(legs: DataFrame, bundles: DataFrame, tips: DataFrame) -> DataFrame:
    """sid, sig, tip: zero outside bundles, the bundle's tip (bundle_id, tip) inside, null where that is unknown."""
    held = bundles.select("bundle_id", F.explode("transactions").alias("sig")).groupBy("sig").agg(F.min("bundle_id").alias("bundle_id"))
    met = legs.select("sid", "sig", "in_bundle").join(held, "sig", "left").join(tips.dropDuplicates(["bundle_id"]), "bundle_id", "left")
    return met.select("sid", "sig", F.when(~F.col("in_bundle"), 0.0).otherwise(F.col("tip")).alias("tip"))


def stricter(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
