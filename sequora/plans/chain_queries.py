"""Queries of the sandwich operators over the chain tables, each with SQL of its own for another engine.

The SQL says the same with other means and shares no text with the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import association, classes, distributions, entities, ordered, sandwiches, slippage
from ..sources import chain, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPOCH = 40_000
GATES = {"n_min": 3, "wr_min": 0.5, "sc_min": 0.3, "gap_max": 90.0, "usd_min": 10.0}


class Chain:
    """The chain tables of one folder, and what is derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.legs = chain.legs(spark, sf_dir)
        self.leaders, self.counts, self.bundles, self.prices = chain.leaders(self.legs), chain.slot_counts(self.legs), chain.bundles(self.legs), chain.prices(spark)

    def metrics(self) -> DataFrame:
        return sandwiches.metrics(self.legs, self.leaders, self.counts, self.bundles, self.prices)

    def features(self) -> DataFrame:
        return entities.features(self.metrics())

    def classified(self) -> DataFrame:
        return classes.classify(self.features(), **GATES, oneshot=True, oneshot_n=8, oneshot_usd=20.0)

    def acts(self) -> DataFrame:
        return sandwiches.headers(self.legs).select("signer", F.col("front_slot").alias("slot"))

    def pairs(self) -> DataFrame:
        return association.scored(self.acts(), self.leaders, 1.05, 3)


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    # scaled first, as SQL engines do: 431.845 is stored a little lower and still goes up; a sum near zero may come out on either side of it
    return rows.select(*[(F.round(F.col(f"`{c}`") * 10.0**places, 0) / 10.0**places + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes])


# SQL of the derived tables ----------------------------------------------------------------------------------------
HEADS = """
heads as (
  select sid, arg_min(slot, o) filter (type = 'frontRun') as front_slot, arg_max(slot, o) filter (type = 'backRun') as back_slot, arg_min(sig, o) filter (type = 'frontRun') as front_sig, arg_min(sig, o) filter (type = 'backRun') as back_sig,
    arg_min(ts, o) filter (type = 'frontRun') as ts, arg_min(from_token, o) filter (type = 'frontRun') as token_a, arg_min(to_token, o) filter (type = 'frontRun') as token_b, arg_min(signers, o) filter (type = 'frontRun') as fs, arg_min(signers, o) filter (type = 'backRun') as bs,
    arg_min(pool_dex, o) filter (type = 'frontRun') as pool_dex, count(*) filter (type = 'frontRun') as front_count, count(*) filter (type = 'backRun') as back_count, count(*) filter (type = 'victim') as victim_count, count(*) filter (type = 'adverse') as adverse_count, count(*) filter (type = 'transfer') as transfer_count,
    sum(from_amount) filter (type = 'frontRun') as front_a, sum(to_amount) filter (type = 'frontRun') as front_b, sum(from_amount) filter (type = 'backRun') as back_b, sum(to_amount) filter (type = 'backRun') as back_a,
    flatten(list(owners_b) filter (type = 'frontRun')) as fo, flatten(list(owners_b) filter (type = 'backRun')) as bo, sum(fee) filter (type in ('frontRun', 'backRun')) / 1e9 as fee_sol
  from (select *, slot * 1048576 + position as o from legs) group by sid
), sw as (
  select *, len(list_intersect(fs, bs)) > 0 as signer_same, len([x for x in bo if not list_contains(fo, x)]) = 0 as owner_same, front_count > 1 as multi_front, back_count > 1 as multi_back, transfer_count > 0 as has_transfer, front_slot <> back_slot as cross_block,
    front_b * back_a / nullif(back_b, 0) - front_a as profit_a, back_a - front_a as diff_a, back_b - front_b as diff_b, coalesce(list_min(list_intersect(fs, bs)), fs[1]) as signer
  from heads where front_count > 0 and back_count > 0
)"""
GEOMETRY = """
placed as (select l.sid, l.type, l.slot, l.slot * 1048576 + l.position as o, r.leader from legs l left join leaders r on r.slot = l.slot where l.type in ('frontRun', 'backRun', 'victim')),
ends as (
  select sid, min(slot) filter (type = 'frontRun') as fslot, max(slot) filter (type = 'backRun') as bslot, max(case when type = 'frontRun' and o = fo then leader end) as fl, max(case when type = 'backRun' and o = bo then leader end) as bl, max(case when type = 'victim' and o = vo then leader end) as vl, count(*) filter (type = 'victim') as n_victims
  from (select *, min(o) filter (type = 'frontRun') over (partition by sid) as fo, max(o) filter (type = 'backRun') over (partition by sid) as bo, min(o) filter (type = 'victim') over (partition by sid) as vo from placed) group by sid
), geo as (
  select e.sid, any_value(fslot) as front_slot, any_value(bslot) as back_slot, any_value(fl) as front_leader, any_value(bl) as back_leader, any_value(n_victims) as n_victims, any_value(fslot <> bslot) as cross_block, any_value(fl <> bl) as cross_leader,
    count(*) filter (p.type = 'victim' and p.leader = e.fl) as v_front_leader, count(*) filter (p.type = 'victim' and p.leader = e.bl) as v_back_leader, any_value(vl = fl) as first_v_front_leader, count(*) filter (p.type = 'victim' and p.slot = e.fslot) as v_same_block_as_front
  from ends e join placed p on p.sid = e.sid group by e.sid
), shapes as (
  select *, case when coalesce(cross_leader, false) then 'cross_leader' when cross_block then 'same_leader_multi_slot' else 'single_slot' end as geom_class,
    coalesce(cross_leader, false) and n_victims > 0 and v_front_leader = n_victims as xl_all_victims_front_leader, coalesce(cross_leader and first_v_front_leader, false) as xl_first_victim_front_leader, coalesce(cross_leader, false) and n_victims > 0 and v_front_leader = 0 as xl_no_victim_front_leader,
    coalesce(cross_leader, false) and n_victims = 1 and v_front_leader = 1 as xl_single_victim_same_leader, coalesce(cross_leader, false) and n_victims = 1 and v_front_leader = 0 as xl_single_victim_diff_leader
  from geo
)"""
CONSUMED = """
consumed as (
  select sid, sig, slot, position, case when limit_type not in ('output', 'input') then 'empty_type' when limit_type = 'output' and limit_amount = 0 then 'no_protection' when limit_amount <= 0 then 'limit_nonpositive' when actual_amount <= 0 then 'actual_nonpositive'
      when case limit_type when 'output' then limit_amount / actual_amount else actual_amount / limit_amount end <= 1.000000001 then 'ok' else 'above_one' end as reason,
    case limit_type when 'output' then limit_amount / nullif(actual_amount, 0) when 'input' then actual_amount / nullif(limit_amount, 0) end as share
  from legs where type = 'victim'
), victims as (select *, case reason when 'ok' then least(share, 1.0) when 'no_protection' then 0.0 end as sc from consumed),
collapsed as (
  select s.sid, count(v.sid) as n, count(*) filter (v.reason not in ('ok', 'no_protection')) as odd, count(*) filter (v.sc >= 0.01) as protected, max(v.sc) filter (v.sc >= 0.01) as top,
    min(list_position(['no_victim', 'unclassified', 'empty_type', 'limit_nonpositive', 'actual_nonpositive', 'uncomputable', 'above_one', 'ok', 'no_protection'], v.reason)) as worst
  from sw s left join victims v on v.sid = s.sid group by s.sid
), sc as (
  select sid, case when odd = 0 and n > 0 and protected > 0 then top end as sc, odd > 0 or n = 0 as sc_anomaly, odd = 0 and n > 0 and protected = 0 as sc_unprotected,
    case when odd = 0 and n > 0 and protected = 0 then 'no_protection' else coalesce(['no_victim', 'unclassified', 'empty_type', 'limit_nonpositive', 'actual_nonpositive', 'uncomputable', 'above_one', 'ok', 'no_protection'][worst], 'no_victim') end as sc_reason,
    n as sc_victim_n, odd as sc_victim_anomaly_n, protected as sc_victim_protected_n
  from collapsed
)"""
GAPS = """
starts as (select slot, coalesce(sum(tx_count) over (order by slot rows between unbounded preceding and 1 preceding), 0) as start from (select slot, max(tx_count) as tx_count from slot_counts group by slot)),
marks as (select sid, max(o) filter (type = 'frontRun') as f, min(o) filter (type = 'victim') as v1, max(o) filter (type = 'victim') as v2, min(o) filter (type = 'backRun') as b from (select *, slot * 1048576 + position as o from legs) group by sid),
gap as (
  select m.sid, cast(case when m.v1 // 1048576 - m.f // 1048576 > 100 then 1272 * (m.v1 // 1048576 - m.f // 1048576 - 1) else s2.start + m.v1 % 1048576 - s1.start - m.f % 1048576 end as bigint) as front_gap,
    cast(case when m.b // 1048576 - m.v2 // 1048576 > 100 then 1272 * (m.b // 1048576 - m.v2 // 1048576 - 1) else s4.start + m.b % 1048576 - s3.start - m.v2 % 1048576 end as bigint) as back_gap
  from marks m left join starts s1 on s1.slot = m.f // 1048576 left join starts s2 on s2.slot = m.v1 // 1048576 left join starts s3 on s3.slot = m.v2 // 1048576 left join starts s4 on s4.slot = m.b // 1048576
)"""
BUNDLED = """
held as (select bundle_id, unnest(transactions) as sig from bundles),
verdicts as (select sid, min(bundle_id) as bundle_id from (select l.sid, h.bundle_id from legs l join held h on h.sig = l.sig where l.type in ('frontRun', 'victim', 'backRun') group by 1, 2 having count(distinct l.type) = 3) group by sid),
colocated as (select sid from legs where type in ('frontRun', 'victim', 'backRun') group by sid having count(distinct slot) = 1 and bool_and(in_bundle))"""
METRICS = f"""{HEADS}, {GEOMETRY}, {CONSUMED}, {GAPS}, {BUNDLED},
m as (
  select w.*, g.n_victims, g.front_leader, g.back_leader, g.cross_leader, g.v_front_leader, g.v_same_block_as_front, g.geom_class, g.xl_all_victims_front_leader, g.xl_first_victim_front_leader, g.xl_no_victim_front_leader, g.xl_single_victim_same_leader, g.xl_single_victim_diff_leader,
    c.* exclude (sid), q.front_gap, q.back_gap, p.usd as token_a_price, w.profit_a * p.usd as usd_gross, case when p.usd is not null then w.fee_sol * 150.0 end as usd_fee, w.profit_a * p.usd - w.fee_sol * 150.0 as usd_net,
    w.profit_a * p.usd - w.fee_sol * 150.0 > 0 as is_profitable, case when w.token_a = 'SOL' then w.profit_a > w.fee_sol end as is_profitable_sol, v.sid is not null and w.signer_same and w.profit_a > 0 as jito_bundle, k.sid is not null as jito_colocated,
    case when signer_same and not (multi_front or multi_back) then 'standard' when signer_same then 'multi_split' when not (multi_front or multi_back) then case when owner_same then 'diff_signer_owner' else 'diff_signer_transfer' end end as category,
    case when signer_same then case when multi_front or multi_back then '2 multi-front/back' else '1 standard' end when multi_front or multi_back then '5 diff-signer x multi' when owner_same then '3 diff-signer (owner)' when has_transfer then '4 diff-signer (transfer)' else '6 other' end as pattern,
    case when g.cross_leader then 'cross-leader multi-slot' when w.cross_block then 'same-leader multi-slot' else 'single-slot' end as distance
  from sw w join shapes g on g.sid = w.sid join sc c on c.sid = w.sid join gap q on q.sid = w.sid left join prices p on p.token = w.token_a left join verdicts v on v.sid = w.sid left join colocated k on k.sid = w.sid
)"""
FEATURES = f"""{METRICS},
f as (
  select signer, count(*) as sandwich_count, min(front_slot) as first_slot, max(front_slot) as last_slot, avg(is_profitable::int) as win_rate, count(is_profitable) as win_rate_n, sum(fee_sol) as fee_sol_total, coalesce(sum(usd_net), 0) as usd_net_total,
    count(*) filter (token_a = 'SOL') as sol_count, avg(is_profitable_sol::int) as sol_win_rate, sum(profit_a - fee_sol) filter (token_a = 'SOL') as sol_net_profit, median(profit_a) filter (token_a = 'SOL') as sol_profit_median,
    max(profit_a) filter (token_a = 'SOL') / nullif(sum(profit_a) filter (token_a = 'SOL' and profit_a > 0), 0) as sol_profit_top1_share, abs(avg(profit_a) filter (token_a = 'SOL' and profit_a < 0)) / nullif(avg(profit_a) filter (token_a = 'SOL' and profit_a > 0), 0) as sol_loss_magnitude_ratio,
    quantile_cont(front_gap, 0.5) as front_gap_p50, quantile_cont(back_gap, 0.9) as back_gap_p90, stddev_samp(front_gap) / nullif(avg(front_gap), 0) as front_gap_cv, avg((front_gap <= 1)::int) as front_gap_le1_ratio, avg((front_gap <= 100)::int) as fg100_ratio,
    avg(sc) as mean_sc, quantile_cont(sc, 0.9) as sc_p90, count(sc) as sc_scoreable_n, sum(sc * sc_victim_n) / nullif(sum(sc_victim_n) filter (sc is not null), 0) as sc_victim_weighted_mean, count(*) filter (sc_unprotected) as sc_unprotected_n,
    count(*) filter (jito_bundle) as jito_count, count(*) filter (jito_colocated) as jito_colocated_count, count(*) filter (cross_block) as cross_block_count, count(*) filter (cross_leader) as cross_leader_count, count(distinct token_b) as token_b_nunique
  from m group by signer
)"""
CLASSIFIED = f"""{FEATURES},
k as (
  select *, in_pool and coalesce(mean_sc >= 0.3 and front_gap_p50 <= 90, false) as is_signal, jito_count > 0 as is_jito, coalesce(sandwich_count <= 8 and sol_win_rate >= 0.5 and usd_net_total >= 20, false) as is_oneshot
  from (select *, coalesce(usd_net_total >= 10 and sandwich_count >= 3 and sol_win_rate >= 0.5, false) as in_pool from f)
), t as (
  select *, case when is_jito then case when is_signal then 'jito_and_signal' else 'jito_only' end when is_signal then case when is_oneshot then 'signal_and_oneshot' else 'signal' end when is_oneshot then 'oneshot' else 'unclassified' end as tier from k
)"""
TURNS = """
numbered as (select slot, leader, sum(fresh) over (order by slot) as rotation from (select *, case when lag(leader) over (order by slot) = leader and slot - lag(slot) over (order by slot) <= 1 then 0 else 1 end as fresh from leaders)),
turns as (select rotation, min(leader) as leader, min(slot) as first_slot, max(slot) as last_slot, count(*) as slots from numbered group by rotation),
offs as (select unnest([-2, -1, 0, 1, 2]) as off)"""
PAIRS = f"""{HEADS}, {TURNS},
base as (select b.leader, o.off, sum(a.slots) / any_value((select sum(slots) from turns)) as freq from turns a, offs o join turns b on b.rotation = a.rotation + o.off group by 1, 2),
met as (select w.signer, r.leader, o.off, count(*) as n from sw w join numbered x on x.slot = w.front_slot cross join offs o join turns r on r.rotation = x.rotation + o.off group by 1, 2, 3),
near as (select signer, leader, sum(n) as near, arg_min(off, -n * 10 + off) as peak_offset, max(n) as peak_count, coalesce(sum(n) filter (off = 1), 0) as off_1 from met group by 1, 2),
pairs as (
  select * from (select n.*, t.total as signer_total, b.expected, n.near / t.total / b.expected as eta from near n join (select signer, count(*) as total from sw group by 1) t on t.signer = n.signer join (select leader, sum(freq) as expected from base group by 1) b on b.leader = n.leader) where eta >= 1.05 and near >= 3
)"""


def add(name: str, build: Callable[[Chain], DataFrame], steps: str | None = None, select: str | None = None, places: int = 6, recursive: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Chain(spark, sf_dir)), places)

    QUERIES[name] = run
    if select:
        ORACLE_SQL[name] = f"with {'recursive ' if recursive else ''}{chain.CHAIN_SQL}{', ' + steps if steps else ''} {select}"


def components_sql(edges: str) -> str:
    """(node, root) of the edges (a, b), by reaching every node from the least ones."""
    return f"edges as ({edges}), ways as (select a, b from edges union select b, a from edges), reach(node, root) as (select a, a from ways group by a having min(b) >= a union select w.b, r.root from reach r join ways w on w.a = r.node where w.b > r.root)"


r6 = lambda *columns: ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns)

# headers, scopes, shapes
add("chain_headers", lambda c: sandwiches.headers(c.legs).select("sid", "front_slot", "back_slot", "ts", "token_a", "token_b", "pool_dex", "front_count", "back_count", "victim_count", "adverse_count", "transfer_count", "signer_same", "owner_same", "multi_front", "multi_back", "has_transfer", "cross_block", "profit_a", "diff_a", "diff_b", "fee_sol", "signer", "motif_id"),
    HEADS, f"select sid, front_slot, back_slot, ts, token_a, token_b, pool_dex, front_count, back_count, victim_count, adverse_count, transfer_count, signer_same, owner_same, multi_front, multi_back, has_transfer, cross_block, {r6('profit_a', 'diff_a', 'diff_b', 'fee_sol')}, signer, sha256(front_sig || ':' || back_sig) as motif_id from sw")
add("scope_counts", lambda c: c.metrics().groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("has_transfer")).alias("with_transfer"), F.sum("victim_count").alias("victims")), METRICS, "select category, count(*) as n, count(*) filter (has_transfer) as with_transfer, cast(sum(victim_count) as bigint) as victims from m group by category")
add("variant_counts", lambda c: _variants(c), METRICS, "select v as variant, count(*) filter (case v when 'all' then true when 'multi_front' then multi_front and not multi_back when 'multi_back' then multi_back and not multi_front else multi_front and multi_back end) as n, count(*) filter (coalesce(cross_leader, false) and case v when 'all' then true when 'multi_front' then multi_front and not multi_back when 'multi_back' then multi_back and not multi_front else multi_front and multi_back end) as crossing from m, (select unnest(['all', 'multi_front', 'multi_back', 'both']) as v) group by v")


def _variants(c: Chain) -> DataFrame:
    m, out = c.metrics(), None
    for which in ("all", "multi_front", "multi_back", "both"):
        one = sandwiches.variant(m, which).agg(F.count("*").alias("n"), F.count_if(F.coalesce("cross_leader", F.lit(False))).alias("crossing")).select(F.lit(which).alias("variant"), "n", "crossing")
        out = one if out is None else out.unionByName(one)
    return out


_known = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("unknown")).alias(x)
add("victim_geometry", lambda c: sandwiches.geometry(c.legs, c.leaders).select("sid", "front_slot", "back_slot", _known("front_leader"), _known("back_leader"), "n_victims", "cross_block", _known("cross_leader"), "v_front_leader", "v_back_leader", _known("first_v_front_leader"), "v_same_block_as_front"), GEOMETRY, "select sid, front_slot, back_slot, coalesce(front_leader, 'unknown') as front_leader, coalesce(back_leader, 'unknown') as back_leader, n_victims, cross_block, coalesce(cross_leader::varchar, 'unknown') as cross_leader, v_front_leader, v_back_leader, coalesce(first_v_front_leader::varchar, 'unknown') as first_v_front_leader, v_same_block_as_front from geo")
add("shape_counts", lambda c: sandwiches.geometry_classes(sandwiches.geometry(c.legs, c.leaders)).groupBy("geom_class").agg(F.count("*").alias("n"), *[F.count_if(x).alias(x) for x in distributions.XL_SHAPES]), GEOMETRY, f"select geom_class, count(*) as n, {', '.join(f'count(*) filter ({x}) as {x}' for x in distributions.XL_SHAPES)} from shapes group by geom_class")
add("shape_invariant", lambda c: sandwiches.broken_geometry(sandwiches.geometry(c.legs, c.leaders)).agg(F.count("*").alias("broken")), GEOMETRY, "select count(*) filter (cross_leader and not cross_block) as broken from geo")
add("victim_consumption", lambda c: sandwiches.victim_consumption(c.legs), f"{HEADS}, {CONSUMED}", f"select sid, sig, slot, position, reason, {r6('sc')} from victims")
add("sandwich_consumption", lambda c: sandwiches.sandwich_consumption(sandwiches.headers(c.legs), sandwiches.victim_consumption(c.legs)), f"{HEADS}, {CONSUMED}", f"select sid, {r6('sc')}, sc_anomaly, sc_unprotected, sc_reason, sc_victim_n, sc_victim_anomaly_n, sc_victim_protected_n from sc")
add("ordering_gaps", lambda c: sandwiches.gaps(c.legs, c.counts), GAPS, "select sid, front_gap, back_gap from gap")
add("bundle_explode_join", lambda c: sandwiches.bundle_verdicts(c.legs, c.bundles), BUNDLED, "select sid, bundle_id from verdicts")
add("verified_bundle_semi", lambda c: sandwiches.verified_bundles(sandwiches.headers(c.legs), sandwiches.bundle_verdicts(c.legs, c.bundles)), f"{HEADS}, {BUNDLED}", "select w.sid from sw w join verdicts v on v.sid = w.sid where signer_same and profit_a > 0")
add("bundle_candidates", lambda c: sandwiches.bundle_candidates(c.legs), BUNDLED, "select sid from colocated")
add("net_profit", lambda c: sandwiches.net_usd(sandwiches.headers(c.legs), c.prices).select("sid", "token_a", "token_a_price", "usd_gross", "usd_fee", "usd_net"), METRICS, f"select sid, token_a, {r6('token_a_price', 'usd_gross', 'usd_fee', 'usd_net')} from m")
add("signature_marks", lambda c: c.legs.join(files.slot_signatures(c.bundles, c.legs.where("type = 'victim'")), ["slot", "sig"]).select("sid", "slot", "sig"), BUNDLED, "select distinct l.sid, l.slot, l.sig from legs l join (select slot, unnest(transactions) as sig from bundles where slot in (select slot from legs where type = 'victim')) b on b.slot = l.slot and b.sig = l.sig")
add("bundle_overlap", lambda c: c.bundles.select("bundle_id", "slot", F.explode("transactions").alias("sig")).join(c.legs.where("type = 'victim' and limit_type = 'input'").select("sig"), "sig", "left_semi").select("bundle_id", "slot").distinct(), None, "select distinct bundle_id, slot from bundles b where list_has_any(transactions, (select list(sig) from legs where type = 'victim' and limit_type = 'input'))")
add("leg_tips", lambda c: sandwiches.leg_tips(c.legs, c.bundles, c.bundles.where("slot % 3 <> 0").groupBy("bundle_id").agg(F.max(F.col("slot") % 100).cast("double").alias("tip"))), "h as (select unnest(transactions) as sig, bundle_id from bundles), tips as (select bundle_id, max(slot % 100)::double as tip from bundles where slot % 3 <> 0 group by 1), o as (select sig, min(bundle_id) as bundle_id from h group by sig)", "select l.sid, l.sig, case when not l.in_bundle then 0.0 else t.tip end as tip from legs l left join o on o.sig = l.sig left join tips t on t.bundle_id = o.bundle_id")


# reports
def _block(rows: DataFrame, *by) -> DataFrame:
    # a distinct count would sum by signer first, and sums at half a cent would round otherwise than those over the rows
    net, one = F.col("usd_net"), Window.partitionBy(*by, "signer").orderBy("sid")
    rows = rows.withColumn("fresh", F.col("signer").isNotNull() & (F.row_number().over(one) == 1))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("fresh").alias("front_signers"), F.sum("victim_count").alias("victims"), F.sum("usd_gross").alias("usd_gross"), F.sum("usd_fee").alias("usd_fee"), F.sum(net).alias("usd_net"), F.avg(net).alias("usd_avg"), F.count_if(net > 0).alias("profitable"), scalars.ratio(F.count_if(net > 0), F.count(net)).alias("win_rate"), scalars.ratio(F.count_if(net.isNotNull() & (F.col("profit_a") > 0)), F.count(net)).alias("win_rate_gross"), F.count(net).alias("priced"))


BLOCK = "count(*) as n, count(distinct signer) as front_signers, cast(sum(victim_count) as bigint) as victims, round(sum(usd_gross), 2) + 0.0 as usd_gross, round(sum(usd_fee), 2) as usd_fee, round(sum(usd_net), 2) + 0.0 as usd_net, round(avg(usd_net), 2) + 0.0 as usd_avg, count(*) filter (usd_net > 0) as profitable, round(count(*) filter (usd_net > 0) / nullif(count(usd_net), 0), 2) as win_rate, round(count(*) filter (usd_net is not null and profit_a > 0) / nullif(count(usd_net), 0), 2) as win_rate_gross, count(usd_net) as priced"
add("report_distance", lambda c: _block(c.metrics(), "distance"), METRICS, f"select distance, {BLOCK} from m group by distance", 2)
add("report_pattern", lambda c: _block(c.metrics(), "pattern"), METRICS, f"select pattern, {BLOCK} from m group by pattern", 2)
add("report_pattern_distance", lambda c: _block(c.metrics(), F.concat("pattern", F.lit("  |  "), "distance").alias("grp")), METRICS, f"select pattern || '  |  ' || distance as grp, {BLOCK} from m group by 1", 2)
add("report_bundle_epochs", lambda c: _block(c.metrics().where("jito_bundle"), F.floor(F.col("front_slot") / EPOCH).alias("epoch"), "signer"), METRICS, f"select front_slot // {EPOCH} as epoch, signer, {BLOCK} from m where jito_bundle group by 1, 2", 2)
add("report_flags", lambda c: c.metrics().agg(F.count("*").alias("total"), F.count_if(F.col("multi_front") | F.col("multi_back")).alias("multi_split"), F.count_if(~F.col("signer_same")).alias("diff_signer"), F.count_if(F.col("has_transfer")).alias("has_transfer"), F.count_if(F.col("victim_count") > 1).alias("multi_victim"), F.count_if(F.abs(F.col("diff_b")) < 1e-9).alias("perfect"), F.count_if(F.col("usd_net").isNull()).alias("unpriced"), F.count_if(F.col("category").isNull()).alias("without_scope")), METRICS, "select count(*) as total, count(*) filter (multi_front or multi_back) as multi_split, count(*) filter (not signer_same) as diff_signer, count(*) filter (has_transfer) as has_transfer, count(*) filter (victim_count > 1) as multi_victim, count(*) filter (abs(diff_b) < 1e-9) as perfect, count(*) filter (usd_net is null) as unpriced, count(*) filter (category is null) as without_scope from m")
add("slot_coverage", lambda c: files.coverage(c.counts, c.legs, c.bundles, EPOCH), None, f"select a.epoch, a.fetched, a.checked, coalesce(b.bundles, 0) as bundles, coalesce(l.legs, 0) as legs, coalesce(l.in_bundle, 0) as in_bundle from (select slot // {EPOCH} as epoch, count(distinct slot) filter (fetched) as fetched, count(distinct slot) filter (checked) as checked from slot_counts group by 1) a left join (select slot // {EPOCH} as epoch, count(*) as bundles from bundles group by 1) b on b.epoch = a.epoch left join (select slot // {EPOCH} as epoch, count(*) as legs, count(*) filter (in_bundle) as in_bundle from legs group by 1) l on l.epoch = a.epoch")
add("covered_epochs", lambda c: files.covered_epochs([c.leaders, c.counts.where("slot % 2 = 0")], 400, 0.005), None, "select slot // 400 as epoch, count(distinct slot) as slots from (select slot from leaders union all select slot from slot_counts where slot % 2 = 0) group by 1 having count(distinct slot) >= 2")
add("leader_concentration", lambda c: _concentration(c), HEADS, "select signer, cast(sum(n) as bigint) as n, count(*) as leaders, round(max(n) / sum(n), 6) + 0.0 as top_share from (select w.signer, l.leader, count(*) as n from sw w join leaders l on l.slot = w.front_slot group by 1, 2) group by signer having sum(n) >= 10")


def _concentration(c: Chain) -> DataFrame:
    met = c.acts().join(c.leaders, "slot").groupBy("signer", "leader").agg(F.count("*").alias("n"))
    return met.groupBy("signer").agg(F.sum("n").alias("n"), F.count("*").alias("leaders"), (F.max("n") / F.sum("n")).alias("top_share")).where("n >= 10")


# entities and classes
FEATURE_COLUMNS = ("signer", "sandwich_count", "first_slot", "last_slot", "win_rate", "win_rate_n", "fee_sol_total", "usd_net_total", "sol_count", "sol_win_rate", "sol_net_profit", "sol_profit_median", "sol_profit_top1_share", "sol_loss_magnitude_ratio", "front_gap_p50", "back_gap_p90", "front_gap_cv", "front_gap_le1_ratio", "fg100_ratio", "mean_sc", "sc_p90", "sc_scoreable_n", "sc_victim_weighted_mean", "sc_unprotected_n", "jito_count", "jito_colocated_count", "cross_block_count", "cross_leader_count", "token_b_nunique")
_real = [c for c in FEATURE_COLUMNS if c not in ("signer", "sandwich_count", "first_slot", "last_slot", "win_rate_n", "sol_count", "sc_scoreable_n", "sc_unprotected_n", "jito_count", "jito_colocated_count", "cross_block_count", "cross_leader_count", "token_b_nunique")]
add("signer_features", lambda c: c.features().select(*FEATURE_COLUMNS), FEATURES, "select " + ", ".join(f"round({c}, 6) + 0.0 as {c}" if c in _real else c for c in FEATURE_COLUMNS) + " from f")
ENTROPY = "select {key} as v, signer from m where {key} is not null"
for _value, _expression, _support in (("hour", "hour(make_timestamp(ts * 1000000))", 24), ("token_b", "token_b", None), ("pool_dex", "pool_dex", None), ("shape", "front_count || '/' || back_count || '/' || victim_count", None)):
    add(f"entropy_{_value}", partial(lambda c, value, support: entities.entropy(c.metrics().withColumns({"shape": F.concat_ws("/", "front_count", "back_count", "victim_count"), "hour": F.hour(F.timestamp_seconds("ts"))}), "signer", value, support), value=_value, support=_support), f"{METRICS}, e as (select signer, {_expression} as v, count(*) as n from m group by 1, 2), q as (select signer, n, n / sum(n) over (partition by signer) as p, count(*) over (partition by signer) as k from e)",
        f"select signer, round(least(1.0, greatest(0.0, {f'-sum(p * ln(p)) / ln({_support})' if _support else 'case when max(k) = 1 then 0.0 else -sum(p * ln(p)) / ln(max(k)) end'})), 6) + 0.0 as entropy, round(max(p), 6) as top_share, max(k) as kinds from q group by signer")
add("active_intervals", lambda c: entities.intervals(sandwiches.headers(c.legs)), f"{HEADS}, a as (select distinct signer, front_slot from sw), d as (select signer, front_slot, front_slot - lag(front_slot) over (partition by signer order by front_slot) as d from a)", f"select signer, {r6('avg_interval_slots', 'interval_cv', 'burstiness')}, active_slot_count, round(duty_cycle, 6) as duty_cycle from (select signer, avg(d) as avg_interval_slots, stddev_samp(d) / nullif(avg(d), 0) as interval_cv, (stddev_samp(d) - avg(d)) / nullif(stddev_samp(d) + avg(d), 0) as burstiness, count(*) as active_slot_count, case when max(front_slot) > min(front_slot) then count(*) / (max(front_slot) - min(front_slot) + 1) end as duty_cycle from d group by signer)")
add("anomaly_reason_top", lambda c: entities.top_reason(c.metrics()), METRICS, "select signer, arg_min(sc_reason, -n * 100 + place) as sc_reason_top from (select signer, sc_reason, count(*) as n, list_position(['ok', 'no_protection', 'empty_type', 'limit_nonpositive', 'actual_nonpositive', 'uncomputable', 'above_one', 'unclassified', 'no_victim'], sc_reason) as place from m where sc_anomaly group by 1, 2) group by signer")
add("signer_summary", lambda c: (lambda m: entities.summary(m, entities.features(m)).select("signer", "count_bucket", "usd_total_profit", "usd_positive_count", "usd_negative_count", "usd_priced_count", "usd_price_coverage", "sol_total_profit", "sol_sandwich_count"))(c.metrics()), METRICS, "select signer, case when count(*) <= 10 then '1-10' when count(*) <= 50 then '11-50' when count(*) <= 100 then '51-100' when count(*) <= 500 then '101-500' when count(*) <= 1000 then '501-1000' else '1001+' end as count_bucket, round(sum(usd_gross), 4) + 0.0 as usd_total_profit, count(*) filter (usd_gross > 0) as usd_positive_count, count(*) filter (usd_gross < 0) as usd_negative_count, count(usd_gross) as usd_priced_count, round(count(usd_gross) / count(*), 4) as usd_price_coverage, round(coalesce(sum(profit_a) filter (token_a = 'SOL'), 0), 4) + 0.0 as sol_total_profit, count(*) filter (token_a = 'SOL') as sol_sandwich_count from m group by signer", 4)
add("floor_survivors", lambda c: (lambda m: entities.profit_floor(m, entities.features(m), 150.0)[0].groupBy("signer").agg(F.count("*").alias("n")))(c.metrics()), FEATURES, "select signer, sandwich_count as n from f where win_rate_n > 0 and usd_net_total >= 150 or jito_count >= sandwich_count and (win_rate_n = 0 or usd_net_total > 0)")
add("attacker_tiers", lambda c: c.classified().select("signer", "in_pool", "is_jito", "is_signal", "is_oneshot", "tier", F.coalesce("bot_type", F.lit("-")).alias("bot_type")), CLASSIFIED, "select signer, in_pool, is_jito, is_signal, is_oneshot, tier, case tier when 'jito_only' then 'Jito Bot' when 'signal' then 'Signal Bot' when 'jito_and_signal' then 'Jito Bot + Signal Bot' when 'oneshot' then 'Oneshot Bot' when 'signal_and_oneshot' then 'Signal Bot + Oneshot Bot' else '-' end as bot_type from t")
add("tier_totals", lambda c: classes.tier_totals(c.classified()).drop("turn"), CLASSIFIED, "select n.tier, count(t.signer) as entities, cast(coalesce(sum(sandwich_count), 0) as bigint) as sandwiches, round(coalesce(sum(sol_net_profit), 0), 4) + 0.0 as sol_net, round(coalesce(sum(usd_net_total), 0), 4) + 0.0 as usd_net, round(count(t.signer) / (select count(*) from t), 4) as entity_share, round(coalesce(sum(sandwich_count), 0) / (select sum(sandwich_count) from t), 4) as sandwich_share from (select unnest(['jito_and_signal', 'jito_only', 'signal_and_oneshot', 'signal', 'oneshot', 'unclassified']) as tier) n left join t on t.tier = n.tier group by n.tier", 4)
add("bots_and_others", lambda c: classes.bots_and_others(c.classified()), CLASSIFIED, "select tier <> 'unclassified' as is_bot, count(*) as entities, cast(sum(sandwich_count) as bigint) as sandwiches, round(sum(usd_net_total), 6) + 0.0 as usd_net, round(sum(greatest(usd_net_total, 0)), 6) as usd_positive, round(sum(fee_sol_total), 6) as fee_sol from t group by 1", 6)
add("usd_split", lambda c: classes.usd_split(c.metrics()), METRICS, "select signer, round(coalesce(sum(usd_net), 0), 6) + 0.0 as usd_total_profit, round(avg(usd_net), 6) + 0.0 as usd_avg_profit, round(sum(fee_sol), 6) as fee_sol_paid, round(coalesce(sum(usd_net) filter (token_a = 'SOL'), 0), 6) + 0.0 as usd_profit_sol_part, round(coalesce(sum(usd_net) filter (token_a <> 'SOL'), 0), 6) + 0.0 as usd_profit_nonsol_part, round(count(usd_net) filter (token_a <> 'SOL') / nullif(count(*) filter (token_a <> 'SOL'), 0), 6) as usd_price_coverage from m group by signer", 6)
add("funnel_of_gates", lambda c: classes.gate_funnel(c.features(), **GATES), f"{FEATURES}, g as (select coalesce(usd_net_total >= 10, false) as u, coalesce(sandwich_count >= 3, false) as n, coalesce(sol_win_rate >= 0.5, false) as w, coalesce(mean_sc >= 0.3, false) as s, coalesce(front_gap_p50 <= 90, false) as p from f)", "select count(*) as all_entities, count(*) filter (u) as usd, count(*) filter (u and n) as usd_n, count(*) filter (u and n and w) as pool, count(*) filter (u and n and w and s and not p) as sc_only, count(*) filter (u and n and w and not s and p) as gap_only, count(*) filter (u and n and w and s and p) as both, count(*) filter (u and n and w and not s and not p) as neither from g")
SETTINGS = [(f"s{n}{i}{j}", n, w, s, 90.0 if n < 5 else 300.0) for n in (2, 5, 9) for i, w in enumerate((0.3, 0.6)) for j, s in enumerate((0.2, 0.5))]
add("gate_sensitivity", lambda c: classes.sensitivity(c.features(), SETTINGS).select("setting", "bots", "sandwiches", "usd_net"), f"{FEATURES}, g as (select * from (values {', '.join(f'{s!r}' for s in SETTINGS)}) s(setting, n_min, wr_min, sc_min, gap_max))", "select g.setting, count(f.signer) as bots, cast(coalesce(sum(f.sandwich_count), 0) as bigint) as sandwiches, round(coalesce(sum(f.usd_net_total), 0), 4) + 0.0 as usd_net from g left join f on f.usd_net_total >= 10 and f.sandwich_count >= g.n_min and f.sol_win_rate >= g.wr_min and f.mean_sc >= g.sc_min and f.front_gap_p50 <= g.gap_max group by g.setting", 4)
add("stage_sweeps", lambda c: classes.stage_tables(c.features(), [1, 5, 9]), f"{FEATURES}, s as (select '1 all' as stage, f.* from f), g as (select * from s union all select '2 usd', f.* from f where usd_net_total >= 10 union all select '3a sc', f.* from f where mean_sc >= 0.9 union all select '3b gap', f.* from f where front_gap_p50 <= 75 union all select '4 both', f.* from f where mean_sc >= 0.9 and front_gap_p50 <= 75)", "select stage, k, count(*) filter (sandwich_count <= k) as n_at_most, count(*) filter (sandwich_count >= k) as n_at_least, cast(coalesce(sum(sandwich_count) filter (sandwich_count <= k), 0) as bigint) as sandwiches_at_most, cast(coalesce(sum(sandwich_count) filter (sandwich_count >= k), 0) as bigint) as sandwiches_at_least, round(coalesce(sum(usd_net_total) filter (sandwich_count >= k), 0.0), 4) + 0.0 as usd_at_least from g, (select unnest([1, 5, 9]) as k) group by 1, 2", 4)
add("merged_list", lambda c: _merged(c), None, None, 4)


def _merged(c: Chain) -> DataFrame:
    m, tables = c.metrics(), {}
    for category in classes.CATEGORIES[:3]:
        tables[category] = classes.classify(entities.features(m.where(F.col("category") == category)), 2, 0.3, 0.2, 300.0, 0.0, True, 8, 0.0).where("tier <> 'unclassified'")
    return classes.merged(files.pooled(tables))


for _mode in entities.MODES:
    _keys = {"legacy": "select sid, unnest(signers) as key from legs where type in ('frontRun', 'backRun')", "feepayer": "select sid, signers[1] as key from legs where type in ('frontRun', 'backRun')"}.get(_mode, "select * from own union select * from pay where sid not in (select sid from own)")
    _own = "own as (select distinct sid, key from (select sid, unnest(owners_b) as key from legs where type = 'frontRun') join (select sid, unnest(owners_b) as key from legs where type = 'backRun') using (sid, key) where key not in ('o3', 'o100', 'o101')), pay as (select distinct sid, signers[1] as key from legs where type in ('frontRun', 'backRun')), "
    _steps = _own + f"raw as (select distinct * from ({_keys}))"
    if _mode == "owner+guard":
        _steps += ", hot as (select key from raw group by key having count(*) > 20), kept as (select * from raw where key not in (select key from hot)), anchored as (select * from kept union select * from pay where key not in (select key from hot) and sid not in (select sid from kept))"
    else:
        _steps += ", anchored as (select * from raw)"
    add(f"entities_{_mode.replace('+', '_')}", partial(lambda c, mode: entities.resolve(entities.anchors(entities.key_sets(c.legs), mode, c.spark.createDataFrame([("o3",), ("o100",), ("o101",)], "key string"), 20)), mode=_mode), f"{_steps}, {components_sql('select (select min(key) from anchored x where x.sid = a.sid) as a, key as b from anchored a')}", "select node as key, min(root) as entity from reach group by node", recursive=True)
add("entity_sizes", lambda c: (lambda a: entities.merge_diagnostics(entities.resolve(a), a))(entities.anchors(entities.key_sets(c.legs), "feepayer")))
add("key_degrees", lambda c: entities.key_degrees(entities.anchors(entities.key_sets(c.legs), "legacy"), 20), None, "select key, count(*) as degree from (select distinct sid, unnest(signers) as key from legs where type in ('frontRun', 'backRun')) group by key order by degree desc, key limit 20")

# programs
add("program_rows", lambda c: sandwiches.program_rows(c.legs).groupBy("program").agg(F.count("*").alias("n")), None, "select program, count(*) as n from (select distinct sid, unnest(programs) as program from legs where type in ('frontRun', 'backRun')) group by program")
add("entry_programs", lambda c: sandwiches.entry_programs(c.legs, ["p0", "p1", "p2", "p3"]), "u as (select sid, program, count(*) as n from (select sid, unnest(programs) as program from legs where type in ('frontRun', 'backRun')) where program not in ('p0', 'p1', 'p2', 'p3') group by 1, 2)", "select sid, program from (select *, row_number() over (partition by sid order by n, program) as k from u) where k = 1")
add("combined_programs", lambda c: distributions.combined_total(sandwiches.program_rows(c.legs), ["p1", "p2"], sandwiches.headers(c.legs), "profit_a"), HEADS, "select count(*) as n, round(sum(profit_a), 4) + 0.0 as total from sw where sid in (select sid from (select sid, unnest(programs) as p from legs where type in ('frontRun', 'backRun')) where p in ('p1', 'p2'))", 4)

# association
add("turn_baseline", lambda c: association.baseline(association.turns(c.leaders)), PAIRS, f"select leader, off, {r6('freq')} from base")
add("leader_shares", lambda c: association.leader_shares(association.turns(c.leaders)), TURNS, "select leader, cast(sum(slots) as bigint) as slots, round(sum(slots) / (select sum(slots) from turns), 6) as share from turns group by leader")
add("encounters", lambda c: association.encounters(c.acts(), c.leaders), PAIRS, "select signer, leader, off, n from met")
add("unmatched_acts", lambda c: association.missed(c.acts(), c.leaders), HEADS, "select signer, count(*) as total, count(*) filter (front_slot not in (select slot from leaders)) as missed from sw group by signer")
add("scored_pairs", lambda c: c.pairs().select("signer", "leader", "near", "peak_offset", "peak_count", "off_1", "signer_total", "expected", "eta"), PAIRS, f"select signer, leader, cast(near as bigint) as near, peak_offset, peak_count, cast(off_1 as bigint) as off_1, signer_total, {r6('expected', 'eta')} from pairs")
add("untrusted_pairs", lambda c: association.without_trusted(c.pairs(), association.turns(c.leaders), 5).select("signer", "leader"), PAIRS, "select signer, leader from pairs where leader not in (select leader from turns group by leader order by sum(slots) desc, leader limit 5)")
add("shared_leaders", lambda c: association.shared_leaders(c.pairs(), 2), PAIRS, "select a.signer as a, b.signer as b, count(*) as shared from pairs a join pairs b on a.leader = b.leader and a.signer < b.signer group by 1, 2 having count(*) >= 2")
add("signer_cohorts", lambda c: association.cohorts(c.pairs()), f"{PAIRS}, {components_sql('select min(signer) over (partition by leader) as a, signer as b from pairs')}, found as (select node, min(root) as root from reach group by node)", "select node as signer, root as cohort, members from (select node, root, count(*) over (partition by root) as members from found) where members >= 2", recursive=True)
add("cohort_core", lambda c: association.cohort_core(c.pairs(), 2, 1, 1), f"{PAIRS}, {components_sql('select a.signer as a, b.signer as b from pairs a join pairs b on a.leader = b.leader and a.signer < b.signer where a.off_1 >= 1 and b.off_1 >= 1 group by 1, 2 having count(*) >= 2')}, found as (select node, min(root) as root from reach group by node)", "select node as signer from found where root = (select root from found group by root order by count(*) desc, root limit 1)", recursive=True)
add("strongest_leaders", lambda c: association.strongest(association.encounters(c.acts(), c.leaders)), f"{PAIRS}, s as (select signer, leader, sum(n) as n from met group by 1, 2)", "select signer, leader, cast(n as bigint) as n, round(n / t, 6) as share from (select *, row_number() over (partition by signer order by n desc, leader) as k, sum(n) over (partition by signer) as t from s) where k = 1")
add("peak_offsets", lambda c: association.peak_counts(c.pairs()), PAIRS, "select o.off, count(p.signer) as pairs from offs o left join pairs p on p.peak_offset = o.off group by o.off")
add("control_row", lambda c: association.control(association.encounters(c.acts(), c.leaders), association.cohort_core(c.pairs(), 2, 1, 1)))
add("suppressed_boundaries", lambda c: (lambda g: association.boundary_suppression(sandwiches.headers(c.legs).drop("front_slot", "back_slot", "cross_block").join(g, "sid"), c.leaders))(sandwiches.geometry(c.legs, c.leaders)), f"{HEADS}, {GEOMETRY}, {TURNS}, e as (select w.signer, w.sid, coalesce(g.cross_leader, false) as x, g.back_slot - g.front_slot as span, n.rotation from sw w join geo g on g.sid = w.sid join numbered n on n.slot = g.front_slot where g.cross_block), p as (select e.signer, e.sid, any_value(e.x) as x, avg((s.slot + e.span > t.last_slot)::int) as p from e join turns t on t.rotation = e.rotation join numbered s on s.rotation = e.rotation group by 1, 2)", f"select signer, count(*) as n, count(*) filter (x) as observed, round(sum(p), 6) + 0.0 as expected from p group by signer")
add("as_of_turns", lambda c: ordered.as_of(c.counts.select("slot").distinct(), association.turns(c.leaders).select(F.col("first_slot").alias("slot"), "rotation"), "slot", "rotation"), TURNS, "select s.slot, t.rotation from (select distinct slot from slot_counts) s asof left join turns t on s.slot >= t.first_slot")


# distributions
def _profiles(c: Chain) -> DataFrame:
    m = c.metrics()
    return distributions.geometry_profile(m, distributions.all_front_baseline(m), association.boundary_suppression(m, c.leaders))


PROFILE = ", ".join(f"count(*) filter (geom_class = '{s}') as {s}_n, round(count(*) filter (geom_class = '{s}') / count(*), 4) as {s}_share, round(coalesce(sum(usd_net) filter (geom_class = '{s}'), 0), 4) + 0.0 as {s}_usd" for s in distributions.SHAPES) + ", " + ", ".join(f"count(*) filter ({s}) as {s}_n" for s in distributions.XL_SHAPES)
add("geometry_profile", lambda c: _profiles(c).select("signer", "sandwich_count", *[f"{s}_{x}" for s in distributions.SHAPES for x in ("n", "share", "usd")], *[f"{s}_n" for s in distributions.XL_SHAPES], "victim_in_front_block_n", "victim_in_front_block_share", "victims_per_xl_sandwich", "xl_all_front_expected"), f"{METRICS}, b as (select least(n_victims, 12) as nv, avg(xl_all_victims_front_leader::int) as p from m where geom_class = 'cross_leader' group by 1)", f"select signer, count(*) as sandwich_count, {PROFILE}, cast(sum(v_same_block_as_front) as bigint) as victim_in_front_block_n, round(sum(v_same_block_as_front) / nullif(sum(n_victims), 0), 4) as victim_in_front_block_share, round(avg(n_victims) filter (geom_class = 'cross_leader'), 4) as victims_per_xl_sandwich, round(avg(b.p) filter (geom_class = 'cross_leader'), 4) + 0.0 as xl_all_front_expected from m left join b on b.nv = least(m.n_victims, 12) group by signer", 4)
add("geometry_population", lambda c: distributions.population_geometry(_profiles(c)), METRICS, " union all ".join([f"select '{s}' as shape, count(*) as n, round(coalesce(sum(usd_net), 0), 3) + 0.0 as usd, round(coalesce(sum(usd_net), 0) / nullif(count(*), 0), 3) + 0.0 as per from m where geom_class = '{s}'" for s in distributions.SHAPES] + [f"select '{s}', count(*), round(coalesce(sum(usd_net), 0), 3) + 0.0, round(coalesce(sum(usd_net), 0) / nullif(count(*), 0), 3) + 0.0 from m where {s}" for s in distributions.XL_SHAPES]), 3)
add("geometry_economics", lambda c: distributions.geometry_table(c.metrics(), all_=F.lit(True), bundled=F.col("jito_bundle")), f"{METRICS}, g as (select 'all_' as population, geom_class, usd_net from m union all select 'bundled', geom_class, usd_net from m where jito_bundle)", "select population, geom_class, count(*) as n, round(count(*) / sum(count(*)) over (partition by population), 4) as share, round(sum(usd_net), 4) + 0.0 as usd, round(sum(usd_net) / nullif(sum(sum(usd_net)) over (partition by population), 0), 4) + 0.0 as usd_share from g group by 1, 2", 4)
add("all_front_baseline", lambda c: distributions.all_front_baseline(c.metrics()), METRICS, "select cast(least(n_victims, 12) as bigint) as nv, round(avg(xl_all_victims_front_leader::int), 6) + 0.0 as p from m where geom_class = 'cross_leader' group by 1")
add("win_rate_histogram", lambda c: distributions.histogram(c.features(), "win_rate", distributions.equal_edges(0, 1, 10)).select("bin", "n"), FEATURES, "select least(cast(floor(win_rate * 10 + 1e-12) as int), 9) as bin, count(*) as n from f where win_rate is not null group by 1")
add("weighted_histogram", lambda c: distributions.histogram(c.features(), "win_rate", [0.0, 0.25, 0.5, 1.0], "sandwich_count").select("bin", "n"), FEATURES, "select case when win_rate < 0.25 then 0 when win_rate < 0.5 then 1 else 2 end as bin, cast(sum(sandwich_count) as bigint) as n from f where win_rate is not null group by 1")
add("geometric_histogram", lambda c: distributions.histogram(c.features(), "usd_net_total", distributions.geometric_edges(1, 65536, 8)).select("bin", "n"), FEATURES, "select least(cast(floor(log2(usd_net_total) / 2) as int), 7) as bin, count(*) as n from f where usd_net_total between 1 and 65536 group by 1")
add("bin_means", lambda c: distributions.bin_means(c.features(), "win_rate", "usd_net_total", 0.05), FEATURES, "select cast(floor(win_rate / 0.05 + 1e-9) as bigint) as bin, count(*) as n, round(avg(usd_net_total), 4) + 0.0 as mean from f where win_rate is not null group by 1", 4)
DESCRIBED = ("sandwich_count", "front_gap_p50", "mean_sc", "usd_net_total")
add("describe_features", lambda c: distributions.describe(c.features(), DESCRIBED), FEATURES, " union all ".join(f"select '{x}' as name, count({x}) as n, {', '.join(f'round({e}, 4) + 0.0 as {a}' for e, a in ((f'avg({x})', 'mean'), (f'median({x})', 'median'), (f'stddev_samp({x})', 'sd'), (f'min({x})', 'lo'), (f'max({x})', 'hi'), *((f'quantile_cont({x}, {q})', f'p{round(100 * q)}') for q in (0.1, 0.25, 0.75, 0.9))))} from f" for x in DESCRIBED), 4)
add("count_gate", lambda c: distributions.kept_and_dropped(c.features(), F.col("sandwich_count") >= 5, ["sandwich_count", "usd_net_total"]), FEATURES, "select sandwich_count >= 5 as kept, count(*) as n, cast(sum(sandwich_count) as bigint) as sandwich_count, round(sum(usd_net_total), 4) + 0.0 as usd_net_total from f group by 1", 4)
add("gap_gate", lambda c: distributions.kept_and_dropped(c.features(), F.col("front_gap_p50") <= 75, ["sandwich_count"]), FEATURES, "select coalesce(front_gap_p50 <= 75, false) as kept, count(*) as n, cast(sum(sandwich_count) as bigint) as sandwich_count from f group by 1")
add("win_rate_trough", lambda c: distributions.mode_and_trough(c.features(), "win_rate", 0.1, 0.5), f"{FEATURES}, b as (select cast(floor(win_rate / 0.1 + 1e-9) as bigint) as bin, count(*) as n from f where win_rate is not null group by 1)", "select arg_min(bin, -n * 1000 + bin) as modal_bin, max(n) as modal_n, arg_min(bin, n * 1000 + bin) filter (bin >= 5) as trough_bin, min(n) filter (bin >= 5) as trough_n from b")
add("signal_quadrants", lambda c: distributions.quadrants(c.features(), F.col("mean_sc") >= 0.3, F.col("front_gap_p50") <= 90, "usd_net_total"), FEATURES, "select mean_sc >= 0.3 as x_high, front_gap_p50 <= 90 as y_high, count(*) as n, round(sum(usd_net_total), 4) + 0.0 as total, round(avg(usd_net_total), 4) + 0.0 as mean, round(quantile_cont(usd_net_total, 0.9), 4) + 0.0 as p90 from f where mean_sc is not null and front_gap_p50 is not null group by 1, 2", 4)
add("signal_plane", lambda c: distributions.plane_crop(c.features(), "front_gap_p50", "mean_sc", (0, 200), (0, 0.5)), FEATURES, "select count(*) as points, count(*) filter (front_gap_p50 is null or mean_sc is null) as unplaced, count(*) filter (front_gap_p50 is not null and mean_sc is not null and not (front_gap_p50 between 0 and 200 and mean_sc between 0 and 0.5)) as cropped from f")
add("win_rate_bands", lambda c: distributions.bands(c.features(), "win_rate", [0, 0.2, 0.4, 0.6, 0.8, 1.001], ["sandwich_count", "usd_net_total"]), f"{FEATURES}, e as (select i as band, [0, 0.2, 0.4, 0.6, 0.8][i + 1]::double as low, [0.2, 0.4, 0.6, 0.8, 1.001][i + 1]::double as high from range(5) r(i))", "select cast(e.band as int) as band, round(e.low, 4) + 0.0 as low, round(e.high, 4) as high, count(f.signer) as n, round(count(f.signer) / (select count(*) from f), 4) as share, cast(sum(f.sandwich_count) as bigint) as sandwich_count, round(sum(f.usd_net_total), 4) + 0.0 as usd_net_total from e left join f on f.win_rate >= e.low and f.win_rate < e.high group by 1, e.low, e.high", 4)
add("profit_range_bands", lambda c: distributions.bands(sandwiches.headers(c.legs), "profit_a", [-1e9, 0, 1, 10, 1e9], ["profit_a"]).select("band", "n", "profit_a"), HEADS, "select cast(i as int) as band, count(b) as n, round(sum(profit_a), 4) + 0.0 as profit_a from range(4) r(i) left join (select *, case when profit_a < 0 then 0 when profit_a < 1 then 1 when profit_a < 10 then 2 else 3 end as b from sw) on b = i group by 1", 4)
add("reason_shares", lambda c: distributions.shares(c.metrics(), "sc_reason"), METRICS, "select sc_reason, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from m group by 1")
add("gap_report", lambda c: distributions.describe(c.metrics().withColumn("front_le1", (F.col("front_gap") <= 1).cast("int")), ["front_gap", "back_gap", "sc", "front_le1"]).select("name", "n", "mean", "p10", "median", "p90", "hi"), f"{METRICS}, g as (select *, (front_gap <= 1)::int as front_le1 from m)", " union all ".join(f"select '{x}' as name, count({x}) as n, round(avg({x}), 4) + 0.0 as mean, round(quantile_cont({x}, 0.1), 4) + 0.0 as p10, round(median({x}), 4) + 0.0 as median, round(quantile_cont({x}, 0.9), 4) + 0.0 as p90, round(max({x}), 4) + 0.0 as hi from g" for x in ("front_gap", "back_gap", "sc", "front_le1")), 4)
add("bucket_boxes", lambda c: distributions.box_stats(c.features().withColumn("bucket", F.least(F.floor(F.col("sandwich_count") / 4), F.lit(3))), "bucket", "usd_net_total"), f"{FEATURES}, g as (select cast(least(sandwich_count // 4, 3) as bigint) as bucket, usd_net_total as x from f), q as (select bucket, quantile_cont(x, 0.25) as a, median(x) as b, quantile_cont(x, 0.75) as c from g group by 1)", "select g.bucket, round(any_value(a), 4) + 0.0 as p25, round(any_value(b), 4) + 0.0 as median, round(any_value(c), 4) + 0.0 as p75, count(*) as n, round(min(x) filter (x >= a - 1.5 * (c - a) and x <= c + 1.5 * (c - a)), 4) + 0.0 as low, round(max(x) filter (x >= a - 1.5 * (c - a) and x <= c + 1.5 * (c - a)), 4) + 0.0 as high from g join q on q.bucket = g.bucket group by g.bucket", 4)
add("sliding_bands", lambda c: distributions.sliding_quantiles(c.metrics().where("front_gap is not null").select(F.col("front_slot").cast("double").alias("front_slot"), "sid", "front_gap"), ["front_slot", "sid"], "front_gap", 20), f"{METRICS}, o as (select front_gap, row_number() over (order by front_slot, sid) - 1 as i, count(*) over () as n from m where front_gap is not null), z as (select greatest(max(n) // 20, 1) as size, greatest(greatest(max(n) // 20, 1) // 4, 1) as step, max(n) as n from o), w as (select unnest(range(0, (n - size) // step + 1)) as window, size, step from z)", "select cast(w.window as bigint) as window, cast(min(o.i) as bigint) as first, count(*) as n, round(quantile_cont(front_gap, 0.1), 4) + 0.0 as p10, round(quantile_cont(front_gap, 0.5), 4) + 0.0 as p50, round(quantile_cont(front_gap, 0.9), 4) + 0.0 as p90 from w join o on o.i >= w.window * w.step and o.i < w.window * w.step + w.size group by w.window", 4)
add("profit_ranks", lambda c: ordered.ranks(sandwiches.headers(c.legs).select("sid", "profit_a"), "profit_a", "sid").select("sid", "rank"), HEADS, "select sid, row_number() over (order by profit_a, sid) as rank from sw")
add("daily_shapes", lambda c: distributions.daily(c.metrics(), "ts", "geom_class", list(distributions.SHAPES), {"victims": "victim_count"}), METRICS, f"select cast(make_timestamp(ts * 1000000) as date) as day, {', '.join(f'''cast(coalesce(sum(victim_count) filter (geom_class = '{s}'), 0) as bigint) as victims_{s}''' for s in distributions.SHAPES)} from m group by 1")
add("daily_transactions", lambda c: distributions.daily_transactions(c.counts, sandwiches.headers(c.legs)), HEADS, "select cast(make_timestamp(s.ts * 1000000) as date) as day, cast(sum(v.valid_count) as bigint) as total from (select front_slot as slot, min(ts) as ts from sw group by 1) s join (select slot, max(valid_count) as valid_count from slot_counts group by 1) v on v.slot = s.slot group by 1")
add("cost_by_class", lambda c: distributions.cost_by_class(c.legs.join(sandwiches.geometry_classes(sandwiches.geometry(c.legs, c.leaders)).select("sid", "geom_class"), "sid"), F.col("geom_class"), "fee"), f"{GEOMETRY}, x as (select l.type, g.geom_class as class, count(l.fee) as n, median(l.fee) as median, avg(l.fee) as mean from legs l join shapes g on g.sid = l.sid group by 1, 2)", "select type, class, n, round(median, 4) as median, round(mean, 4) as mean, round(mean / nullif(max(mean) filter (class = 'single_slot') over (partition by type), 0), 4) as ratio from x", 4)
add("fee_fingerprint", lambda c: distributions.fee_fingerprint(c.legs, association.strongest(association.encounters(c.acts(), c.leaders))).select("signer", "legs", "fee_values", "usual_fee", "usual_share", "mean_fee"), "c as (select signers[1] as signer, fee, count(*) as n from legs where type in ('frontRun', 'backRun') group by 1, 2)", "select signer, cast(sum(n) as bigint) as legs, count(*) as fee_values, arg_min(fee, -n * 10000000 + fee) as usual_fee, round(max(n) / sum(n), 4) as usual_share, round(sum(n * fee) / sum(n), 4) as mean_fee from c group by signer", 4)
add("validator_lookup", lambda c: distributions.lookup(c.pairs(), "leader", {"near": "near"}, 10), PAIRS, "select leader, count(*) as n, cast(sum(near) as bigint) as near from pairs group by leader order by n desc, leader limit 10")

# ingest tables
add("slot_signatures", lambda c: files.slot_signatures(c.bundles, c.leaders.where("slot % 3 = 0")), None, "select distinct slot, unnest(transactions) as sig from bundles where slot in (select slot from leaders where slot % 3 = 0)")
add("owner_keys", lambda c: files.owner_keys(c.legs, c.spark.createDataFrame([("o999",)], "key string")), HEADS, "select 'o999' as key union select unnest(owners_b) from legs l where type in ('frontRun', 'backRun') and sid in (select sid from sw where not signer_same)")
add("fetch_status", lambda c: files.fetch_status(c.leaders.where("slot % 5 = 0"), c.bundles.where("slot % 10 = 0")), None, "select l.slot, count(b.slot) > 0 as fetched, count(b.transactions) as bundles, cast(coalesce(sum(len(b.transactions)), 0) as bigint) as transactions from (select slot from leaders where slot % 5 = 0) l left join (select * from bundles where slot % 10 = 0) b on b.slot = l.slot group by l.slot")
add("slots_to_check", lambda c: files.to_check(c.counts, c.bundles, 2000, 50), None, "select distinct slot from slot_counts where not checked and slot <= (select max(slot) from slot_counts) - 2000 and slot in (select slot from bundles) order by slot limit 50")
add("retired_epochs", lambda c: files.retired_epochs(c.counts, c.counts.agg((F.max("slot") - 2000).alias("frontier")), EPOCH), None, f"select distinct slot // {EPOCH} as epoch from slot_counts where (slot // {EPOCH} + 1) * {EPOCH} - 1 <= (select max(slot) - 2000 from slot_counts)")
add("latest_bundles", lambda c: files.latest_bundles(c.bundles, 100), None, "select bundle_id, max(slot) as slot from bundles group by 1 order by slot desc, bundle_id limit 100")
add("unfetched_slots", lambda c: files.missing_slots(c.spark, 1000, 3000, c.counts), None, "select i as slot from range(1000, 3001) r(i) where i not in (select slot from slot_counts)")
add("merged_leaders", lambda c: files.merged_leaders(c.leaders, c.counts.select("slot", F.concat(F.lit("R"), (F.col("slot") % 7).cast("string")).alias("leader"))), None, "select s.slot, coalesce(l.leader, 'R' || (s.slot % 7)) as leader from (select distinct slot from slot_counts) s left join leaders l on l.slot = s.slot")
add("feed_comparison", lambda c: (lambda h: files.feed_comparison(h.where("victim_count > 0"), h.where("front_slot % 3 <> 0")))(sandwiches.headers(c.legs)), HEADS, "select count(*) filter (victim_count > 0 and front_slot % 3 <> 0) as both, count(*) filter (victim_count > 0 and front_slot % 3 = 0) as only_ours, count(*) filter (victim_count = 0 and front_slot % 3 <> 0) as only_theirs from sw")
add("named_prefixes", lambda c: classes.resolve_prefixes(sandwiches.headers(c.legs), c.spark.createDataFrame([("a5",), ("a60",), ("a6",), ("b",)], "prefix string")), HEADS, "select p as prefix, min(signer) as signer from (select distinct signer from sw) s, (select unnest(['a5', 'a60', 'a6', 'b']) as p) where starts_with(signer, p) group by p having count(*) = 1")
add("selected_attackers", lambda c: classes.selected(c.features(), 20, c.spark.createDataFrame([("a60",)], "prefix string")), FEATURES, "select signer from (select signer from f order by usd_net_total desc, signer limit 20) union select signer from f where signer = 'a60'")


# instruction bytes
def _instructions(c: Chain) -> DataFrame:
    """An instruction a leg: every rule in turn, with limits from the fee and the slot."""
    table = [(i, p, tag if isinstance(tag, str) else "", 0 if isinstance(tag, str) else tag, place, at if at is not None else -1) for i, (venue, tag, _, place, at, _) in enumerate(slippage.RULES) for p in slippage.PROGRAMS[venue][:1]]
    rules = c.spark.createDataFrame(table, "i long, program string, method string, byte int, place int, mode_at int")
    little = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lpad(F.hex(F.call_function("shiftright", x, k * 8).bitwiseAND(F.lit(255))), 2, "0")), "")
    rows = c.legs.select("sig", "fee", "slot", "position", (F.col("position") % len(slippage.RULES)).alias("i")).join(F.broadcast(rules), "i")
    head = F.when(F.col("method") != "", _named_selector()).otherwise(F.lpad(F.hex(F.col("byte").cast("long")), 2, "0"))
    # both numbers of a call, then the byte that may tell its kind where the rule looks for it
    body = F.concat(head, little(F.col("slot")), little(F.col("fee")))
    padded = F.when(F.col("mode_at") >= 0, F.concat(F.rpad(body, 2 * 40, "0").substr(F.lit(1), 2 * F.col("mode_at")), F.lpad(F.hex(F.col("slot") % 3), 2, "0"), F.lit("0000"))).otherwise(body)
    return rows.select(F.col("sig").alias("tx"), "program", F.unhex(padded).alias("data"), "i")


def _named_selector():
    return F.upper(F.substring(F.sha2(F.concat(F.lit("global:"), F.col("method")).cast("binary"), 256), 1, 16))


_RULE_SQL = ", ".join(f"({i}, '{venue}', {place}, {1 if not isinstance(tag, str) else 8}, '{mode}')" for i, (venue, tag, _, place, _, mode) in enumerate(slippage.RULES))
add("decoded_limits", lambda c: slippage.decode(_instructions(c)).select("tx", "venue", "limit_type", F.col("limit_raw").cast("long").alias("limit_raw"), "no_protection"), f"rules(i, venue, place, head, mode) as (values {_RULE_SQL})", f"select l.sig as tx, r.venue, case r.mode when 'output if set' then case when l.slot % 3 <> 0 then 'output' else 'input' end when 'input if 2' then case when l.slot % 3 = 2 then 'input' else 'output' end else r.mode end as limit_type, case when r.place = r.head then l.slot else l.fee end as limit_raw, case r.mode when 'output if set' then l.slot % 3 <> 0 when 'input if 2' then l.slot % 3 <> 2 else r.mode = 'output' end and case when r.place = r.head then l.slot else l.fee end = 0 as no_protection from legs l join rules r on r.i = l.position % {len(slippage.RULES)}")


def _limits(c: Chain) -> DataFrame:
    calls = _instructions(c)
    twice = calls.unionByName(calls.where("i % 5 = 0"))
    victims = c.legs.where("type = 'victim'").select(F.col("sig").alias("tx"), "sid", "from_token", "to_token", (F.col("from_amount") / 1e6).alias("from_amount"), (F.col("to_amount") / 1e6).alias("to_amount"), (F.col("position") % 4 == 0).alias("inner_missing")).join(calls.select("tx", "program"), "tx")
    decimals = c.legs.select(F.col("sig").alias("tx"), F.col("to_token").alias("token"), F.lit(6).alias("decimals"))
    return slippage.victim_limits(victims, twice.where("i % 7 <> 0"), decimals)


add("victim_limits", lambda c: _limits(c).select("tx", "venue", "limit_type", "state", "consumption"))
add("limit_summary", lambda c: slippage.summary(_limits(c), "sid"))


def _base(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = fn, sql


_base("json_props", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top")), "select event_type, count(cast(props->>'k' as int)) as n, cast(sum(cast(props->>'k' as int)) as bigint) as total, max(cast(props->>'k' as int)) as top from events group by 1")
_base("u64_little_endian", lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scalars.u64_le(F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0"), F.lpad(F.hex(F.col("o_custkey") % 256), 2, "0"), F.lit("000000000080"))), 1).cast("string").alias("n")), "select o_orderkey, cast(cast(o_orderkey % 256 + o_custkey % 256 * 256 as hugeint) + 9223372036854775808 as varchar) as n from orders")
_base("half_up", lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").select(scalars.half_up(F.col("l_extendedprice") / 7, 3).alias("x")).groupBy().agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")), "select count(*) as n, round(sum(floor(l_extendedprice / 7 * 1000 + 0.5) / 1000), 2) as total from lineitem")
_base("normalised_labels", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select(scalars.normalised_label(F.concat(F.lit("  "), "p_type", F.lit(": #"), "p_brand", F.lit("! "))).alias("label")).groupBy("label").agg(F.count("*").alias("n")), "select trim(regexp_replace(lower(trim('  ' || p_type || ': #' || p_brand || '! ')), '[^a-z0-9]+', '_', 'g'), '_') as label, count(*) as n from part group by 1")
