"""Relational operators of the ledger engine, each a set of common table expressions and a final select.

The text is plain SQL that Spark and DuckDB read alike; only the ledger views underneath differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import ledger

# Shared steps -----------------------------------------------------------------------------------------------------
# Ordered passes go over chunks of 512 slots; totals, a row a chunk, carry over their edges.
TURNS = """
{p}produced as (select slot, min(leader) as leader, count(*) as tx_count, cast(floor(slot / 512.0e0) as bigint) as chunk from legs group by slot),
{p}edges as (select chunk, max_by(leader, slot) as leader, max(slot) as slot, sum(tx_count) as txs from {p}produced group by chunk),
{p}carried as (select chunk, lag(leader) over (order by chunk) as p_leader, lag(slot) over (order by chunk) as p_slot, coalesce(sum(txs) over (order by chunk rows between unbounded preceding and 1 preceding), 0) as before from {p}edges),
{p}beside as (
  select q.slot, q.leader, q.tx_count, q.chunk, c.before + coalesce(sum(q.tx_count) over (partition by q.chunk order by q.slot rows between unbounded preceding and 1 preceding), 0) as start,
    lag(q.slot) over (partition by q.chunk order by q.slot) as i_slot, lag(q.leader) over (partition by q.chunk order by q.slot) as i_leader, c.p_slot, c.p_leader
  from {p}produced q join {p}carried c on c.chunk = q.chunk
), {p}marked as (select slot, leader, tx_count, chunk, start, case when case when i_slot is null then p_leader else i_leader end = leader and slot - coalesce(i_slot, p_slot) <= {gap} then 0 else 1 end as fresh from {p}beside),
{p}runs as (select chunk, coalesce(sum(n) over (order by chunk rows between unbounded preceding and 1 preceding), 0) as before from (select chunk, sum(fresh) as n from {p}marked group by chunk) z),
{p}numbered as (select m.slot, m.leader, m.tx_count, m.chunk, m.start, cast(r.before + sum(m.fresh) over (partition by m.chunk order by m.slot rows unbounded preceding) as bigint) as rotation from {p}marked m join {p}runs r on r.chunk = m.chunk),
{p}rotations as (select rotation, min(leader) as leader, min(slot) as first_slot, max(slot) as last_slot, count(*) as slots, cast(sum(tx_count) as bigint) as txs from {p}numbered group by rotation)"""
ROTATIONS = TURNS.replace("{p}", "")
# A front and a back lie in one rotation or in two neighbours, of known leaders and at most four slots apart; a window
# of a pool holds the legs of two rotations, and all joins are on it.
PAIRS = TURNS.replace("{p}", "w_").replace("{gap}", "4") + """,
follows as (select b.rotation from w_rotations a join w_rotations b on b.rotation = a.rotation + 1 where b.first_slot <= a.last_slot + 4 and a.leader is not null and b.leader is not null),
stood as (select l.*, l.slot * 1048576 + l.pos as at, n.rotation from legs l join w_numbered n on n.slot = l.slot),
seen as (select q.*, q.rotation - d.back as win from stood q cross join (select 0 as back union all select 1) d left join follows f on f.rotation = q.rotation where d.back = 0 or f.rotation is not null),
pairs as (
  select a.pool, a.signer, a.rotation as win, a.slot as f_slot, a.pos as f_pos, b.slot as b_slot, b.pos as b_pos, a.leader as f_leader, b.leader as b_leader,
    a.amount as f_amount, b.amount as b_amount, a.token as token, a.fee + b.fee as fee, a.account as f_account, b.account as b_account,
    a.at as f_key, b.at as b_key, b.value - a.value as gain, a.value as f_value, b.value as b_value,
    abs(a.amount - b.amount) / greatest(a.amount, b.amount) as diff
  from stood a join seen b on a.pool = b.pool and a.signer = b.signer and b.win = a.rotation and b.at > a.at + 1
  where a.side = 'O' and b.side = 'F' and abs(a.amount - b.amount) / greatest(a.amount, b.amount) <= 0.1e0
), hit as (
  select p.pool, p.signer, p.f_key, p.b_key, v.at as v_key, v.side as v_side, v.limit_amount, v.actual_amount, v.token as v_token
  from pairs p join seen v on v.pool = p.pool and v.win = p.win and v.at > p.f_key and v.at < p.b_key and v.signer <> p.signer
), counted as (
  select f_key, b_key, count(*) filter (where v_side = 'O') as victims, count(*) filter (where v_side = 'F') as adverse from hit group by f_key, b_key
), motifs as (
  select p.*, c.victims, c.adverse, case when f_leader <> b_leader then 'cross_leader' when f_slot <> b_slot then 'same_leader_multi_slot' else 'single_slot' end as geometry
  from pairs p join counted c on p.f_key = c.f_key and p.b_key = c.b_key where c.victims > 0
)"""
CONSUMED = """
consumed as (
  select f_key, b_key, v_key, case
      when v_token = 'N' then 'empty_type' when actual_amount <= 0 and limit_amount > 0 then 'actual_nonpositive'
      when v_token = 'A' and limit_amount = 0 then 'no_protection' when limit_amount <= 0 then 'limit_nonpositive'
      when (case when v_token = 'A' then limit_amount / nullif(actual_amount, 0) else actual_amount / nullif(limit_amount, 0) end) > 1.000000001e0 then 'above_one' else 'ok' end as reason,
    case when v_token = 'A' then limit_amount / nullif(actual_amount, 0) when v_token = 'R' then actual_amount / nullif(limit_amount, 0) end as ratio
  from hit where v_side = 'O'
), scored as (select f_key, b_key, v_key, reason, case when reason = 'no_protection' then 0.0e0 when reason = 'ok' then least(ratio, 1.0e0) end as sc from consumed),
by_motif as (
  select f_key, b_key, count(*) as n, count(*) filter (where reason not in ('ok', 'no_protection')) as anomalies,
    count(*) filter (where sc >= 0.01e0) as protected, max(case when sc >= 0.01e0 then sc end) as top from scored group by f_key, b_key
), collapsed as (
  select f_key, b_key, case when anomalies > 0 then 'anomalous' when protected = 0 then 'unprotected' else 'scored' end as state,
    case when anomalies = 0 and protected > 0 then top end as sc from by_motif
)"""
NET = """
net as (
  select m.*, m.gain * p.usd - m.fee * 100.0e0 as net_usd from motifs m left join prices p on m.token = p.token
), features as (
  select signer, pool, count(*) as n, cast(sum(victims) as bigint) as victims, sum(net_usd) as net_usd, count(net_usd) as priced,
    avg(case when net_usd > 0 then 1.0e0 when net_usd is not null then 0.0e0 end) as win_rate,
    avg(case when b_slot - f_slot <= 2 then 1.0e0 else 0.0e0 end) as near_rate, avg(diff) as diff from net group by signer, pool
)"""

# accounts met by a leader more often than its share of all legs; cohorts join all accounts of one such leader
FLAGGED = """
share as (select leader, count(*) * 1.0e0 / sum(count(*)) over () as freq from legs group by leader),
own as (select account, leader, count(*) as n, sum(count(*)) over (partition by account) as total from legs group by account, leader),
flagged as (select o.account, o.leader, o.n, o.n * 1.0e0 / o.total / s.freq as eta from own o join share s on o.leader = s.leader where o.n >= 3 and o.n >= 2 * o.total * s.freq)"""
# two accounts that share three of their leaders share one that is among all but the two commonest of either
SHARED = """
often as (select leader, count(*) as n from flagged group by leader),
turned as (select f.account, f.leader, row_number() over (partition by f.account order by o.n, f.leader) as turn, count(*) over (partition by f.account) as held from flagged f join often o on o.leader = f.leader),
candidates as (select distinct x.account as a, y.account as b from turned x join turned y on x.leader = y.leader and x.account < y.account where x.turn <= x.held - 2 and y.turn <= y.held - 2)"""
ACTS = "acts as (select distinct cast(m.signer as varchar(20)) as entity, n.rotation from motifs m join numbered n on n.slot = m.f_slot)"


def steps(*parts: str, gap: int = 1) -> str:
    return ",".join(p.strip().replace("{gap}", str(gap)) for p in parts)


#: name: (common table expressions, select).
REPORTS: dict[str, tuple[str, str]] = {
    # windows and sequences
    "rotation_islands": (steps(ROTATIONS), "select rotation, leader, first_slot, last_slot, slots, txs from rotations"),
    "rotation_islands_tolerant": (steps(ROTATIONS, gap=4), "select rotation, leader, first_slot, last_slot, slots, txs from rotations"),
    "rotation_neighbours": (steps(ROTATIONS), "select a.rotation, a.leader, b.leader as next_leader from rotations a join rotations b on b.rotation = a.rotation + 1 where b.first_slot <= a.last_slot + 4"),
    "slot_coordinates": (steps(ROTATIONS), "select slot, tx_count, cast(start as bigint) as start from marked"),
    "front_back_gap": (steps(PAIRS, ROTATIONS), "select m.f_key, m.b_key, cast(b.start + m.b_pos - a.start - m.f_pos as bigint) as gap from motifs m join marked a on a.slot = m.f_slot join marked b on b.slot = m.b_slot"),
    "inter_arrival": ("active as (select distinct signer, slot from legs), gaps as (select signer, slot - lag(slot) over (partition by signer order by slot) as gap from active)", "select signer, count(gap) as n, round(avg(gap), 6) as mean_gap, round(stddev_samp(gap), 6) as sd_gap, round((stddev_samp(gap) - avg(gap)) / nullif(stddev_samp(gap) + avg(gap), 0), 6) as burstiness from gaps group by signer"),
    "cumulative_share_gini": (steps("""owners as (select account, sum(value) as v from legs group by account), bounds as (select min(v) as lo, max(v) as hi from owners),
        cut as (select account, v, coalesce(least(cast(floor((v - lo) / nullif(hi - lo, 0) * 256) as bigint), 255), 0) as bucket from owners cross join bounds),
        sizes as (select bucket, count(*) as n, sum(v) as total from cut group by bucket), earlier as (select bucket, coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0) as before from sizes),
        ranked as (select c.v, e.before + row_number() over (partition by c.bucket order by c.v, c.account) as r from cut c join earlier e on e.bucket = c.bucket), whole as (select sum(n) as n, sum(total) as total from sizes)"""), "select count(*) as accounts, round(2 * sum(r * v) / (max(w.n) * max(w.total)) - (max(w.n) + 1.0e0) / max(w.n), 6) as gini from ranked cross join whole w"),
    "rolling_crossover": (steps(ROTATIONS, """seq as (select l.slot, m.start + l.pos as idx, case when l.side = 'O' then 1.0e0 else 0.0e0 end as v from legs l join marked m on m.slot = l.slot),
        copies as (select s.slot, s.idx, s.v, cast(floor(s.idx / 4096.0e0) as bigint) + d.back as block from seq s cross join (select -1 as back union all select 0 union all select 1) d
          where s.idx >= (cast(floor(s.idx / 4096.0e0) as bigint) + d.back) * 4096 - 200 and s.idx < (cast(floor(s.idx / 4096.0e0) as bigint) + d.back) * 4096 + 4295),
        framed as (select slot, idx, block, avg(v) over (partition by block order by idx rows between 200 preceding and 199 following) as share, count(*) over (partition by block order by idx rows between 200 preceding and 199 following) as n from copies)"""), "select min(slot) filter (where n = 400 and share >= 0.5e0) as first_slot, count(*) filter (where n = 400) as full_frames from framed where idx >= block * 4096 and idx < block * 4096 + 4096"),
    "first_leg_per_signer": ("", "select signer, pool, min_by(account, slot * 1048576 + pos) as first_account, max_by(account, slot * 1048576 + pos) as last_account, min(slot) as first_slot, max(slot) as last_slot from legs group by signer, pool"),
    "share_within_day": ("d as (select slot, token, sum(value) as v from legs group by slot, token)", "select slot, token, round(v / sum(v) over (partition by slot), 6) as share from d"),
    "top_pool_per_signer": ("c as (select signer, pool, count(*) as n from legs group by signer, pool), r as (select *, row_number() over (partition by signer order by n desc, pool) as k from c)", "select signer, pool, n from r where k = 1"),
    "consecutive_positions": ("s as (select tx, slot, pos, lag(pos) over (partition by slot, pool order by pos) as before from legs)", "select slot, count(*) filter (where before + 1 = pos) as adjacent, count(*) as n from s group by slot"),
    # motifs
    "motif_candidates": (steps(PAIRS), "select pool, signer, f_slot, f_pos, b_slot, b_pos, round(diff, 6) as diff, victims, adverse, geometry from motifs"),
    "motif_geometry_counts": (steps(PAIRS), "select geometry, count(*) as n, cast(sum(victims) as bigint) as victims, round(avg(diff), 6) as diff from motifs group by geometry"),
    "victims_adverse_counts": (steps(PAIRS), "select pool, cast(sum(victims) as bigint) as victims, cast(sum(adverse) as bigint) as adverse from motifs group by pool"),
    "profit_normalised": (steps(PAIRS), "select f_key, b_key, round(f_amount * b_value / nullif(b_amount, 0) - f_value, 6) as profit_a, round(b_amount - f_amount, 6) as diff_a from motifs"),
    "landing_slot_heatmap": (steps(PAIRS), "select f_slot % 4 as front, b_slot % 4 as back, count(*) as n, round(100.0e0 * count(*) / sum(count(*)) over (), 6) as pct from motifs group by f_slot % 4, b_slot % 4"),
    "leg_fee_sum": (steps(PAIRS), "select f_key, b_key, round(fee, 6) as fee from motifs"),
    # slippage
    "victim_sc": (steps(PAIRS, CONSUMED), "select f_key, b_key, v_key, reason, round(sc, 6) as sc from scored"),
    "sandwich_sc": (steps(PAIRS, CONSUMED), "select f_key, b_key, state, round(sc, 6) as sc from collapsed"),
    "sc_rates": (steps(PAIRS, CONSUMED), "select state, count(*) as n, round(avg(sc), 6) as mean_sc, round(1.0e0 * count(*) / sum(count(*)) over (), 6) as rate from collapsed group by state"),
    # features, tiers, sensitivity
    "net_usd_null_price": (steps(PAIRS, NET), "select f_key, b_key, round(net_usd, 6) as net_usd from net"),
    "entity_features": (steps(PAIRS, NET), "select signer, pool, n, victims, priced, round(coalesce(net_usd, 0), 4) as net_usd, round(win_rate, 6) as win_rate, round(near_rate, 6) as near_rate, round(diff, 6) as diff from features"),
    "entity_quantiles": ("", "select signer, round(percentile_cont(0.1e0) within group (order by value), 4) as p10, round(percentile_cont(0.5e0) within group (order by value), 4) as p50, round(percentile_cont(0.9e0) within group (order by value), 4) as p90, round(stddev_samp(value), 4) as sd, count(distinct pool) as pools from legs group by signer"),
    "entity_entropy": ("c as (select signer, token, count(*) as n from legs group by signer, token), p as (select signer, n * 1.0e0 / sum(n) over (partition by signer) as p from c)", "select signer, round(case when count(*) = 1 then 0.0e0 else -sum(p * ln(p)) / ln(count(*)) end, 6) as entropy, count(*) as k from p group by signer"),
    "profit_floor": (steps(PAIRS, NET), "select signer, pool, round(net_usd, 4) as net_usd from features where net_usd >= 100 or n >= 5"),
    "tier_classification": (steps(PAIRS, NET), "select signer, pool, case when n >= 5 and win_rate >= 0.85e0 then 'steady' when n >= 3 and near_rate >= 0.5e0 then 'near' when n <= 2 and coalesce(net_usd, 0) >= 100 then 'oneshot' when priced = 0 then 'unpriced' else 'other' end as tier from features"),
    "gate_funnel": (steps(PAIRS, NET), "select count(*) as pools, count(*) filter (where n >= 2) as many, count(*) filter (where n >= 2 and win_rate >= 0.5e0) as winning, count(*) filter (where n >= 2 and win_rate >= 0.5e0 and near_rate >= 0.2e0) as near from features"),
    "sweep_table": (steps(PAIRS, NET, "grid as (select 1 as k union all select 2 union all select 3 union all select 5 union all select 8)"), "select k, count(*) filter (where n <= k) as at_most, count(*) filter (where n >= k) as at_least, round(coalesce(sum(net_usd) filter (where n >= k), 0), 3) as usd from features cross join grid group by k"),
    "bucket_table": (steps(PAIRS, NET, "labels_ as (select 1 as b union all select 2 union all select 3 union all select 4), bucketed as (select *, case when n = 1 then 1 when n <= 3 then 2 when n <= 9 then 3 else 4 end as b from features)"), "select l.b as bucket, count(f.n) as attackers, cast(coalesce(sum(f.n), 0) as bigint) as motifs, round(avg(f.net_usd), 4) as mean_usd from labels_ l left join bucketed f on l.b = f.b group by l.b"),
    "merged_attackers": (steps(PAIRS, NET, "r as (select *, row_number() over (partition by signer order by n desc, pool) as k from features)"), "select signer, cast(sum(n) as bigint) as n, max(case when k = 1 then pool end) as main_pool, round(max(case when k = 1 then win_rate end), 6) as main_win_rate, round(coalesce(sum(net_usd), 0), 3) as usd from r group by signer"),
    "weighted_sc": (steps(PAIRS, CONSUMED), "select m.pool, round(sum(c.sc * m.victims) / nullif(sum(case when c.sc is not null then m.victims end), 0), 6) as weighted_sc, count(c.sc) as scored from motifs m join collapsed c on m.f_key = c.f_key and m.b_key = c.b_key group by m.pool"),
    "standardised_share": (steps(PAIRS, "base as (select least(victims, 3) as nv, avg(case when adverse = 0 then 1.0e0 else 0.0e0 end) as p from motifs group by least(victims, 3))"), "select m.signer, round(avg(b.p), 6) as expected, round(avg(case when m.adverse = 0 then 1.0e0 else 0.0e0 end), 6) as observed from motifs m join base b on b.nv = least(m.victims, 3) group by m.signer"),
    # association
    "leader_load": ("c as (select signer, leader, count(*) as n from legs group by signer, leader)", "select signer, cast(sum(n) as bigint) as legs, round(max(n) * 1.0e0 / sum(n), 6) as top_share, count(*) as leaders from c group by signer having sum(n) >= 10"),
    "offset_baseline": (steps(ROTATIONS, "offsets as (select -2 as off union all select -1 union all select 0 union all select 1 union all select 2)"), "select o.off, b.leader, round(sum(a.slots) * 1.0e0 / max(t.total), 8) as freq from rotations a cross join offsets o join rotations b on b.rotation = a.rotation + o.off cross join (select sum(slots) as total from rotations) t group by o.off, b.leader"),
    "enrichment_pairs": (steps(PAIRS, ROTATIONS, """offsets as (select -2 as off union all select -1 union all select 0 union all select 1 union all select 2),
        base as (select b.leader, sum(a.slots) * 1.0e0 / max(t.total) as freq from rotations a cross join offsets o join rotations b on b.rotation = a.rotation + o.off cross join (select sum(slots) as total from rotations) t group by b.leader),
        acts as (select distinct signer, f_slot from motifs), near as (select x.signer, r2.leader, count(*) as n from acts x join numbered r1 on r1.slot = x.f_slot cross join offsets o join rotations r2 on r2.rotation = r1.rotation + o.off group by x.signer, r2.leader),
        totals as (select signer, count(*) as total from acts group by signer)"""), "select n.signer, n.leader, n.n, round(n.n * 1.0e0 / t.total / b.freq, 6) as eta from near n join totals t on n.signer = t.signer join base b on n.leader = b.leader where n.n >= 2"),
    "flagged_leaders": (steps(FLAGGED), "select account, leader, n, round(eta, 6) as eta from flagged"),
    "shared_leader_edges": (steps(FLAGGED, SHARED), "select c.a, c.b, count(*) as shared from candidates c join flagged x on x.account = c.a join flagged y on y.account = c.b and y.leader = x.leader group by c.a, c.b having count(*) >= 3"),
    "cohort_edges": (steps(FLAGGED, "least_account as (select leader, min(account) as a from flagged group by leader)"), "select distinct m.a, f.account as b from flagged f join least_account m on f.leader = m.leader where m.a < f.account"),
    "motif_account_edges": (steps(PAIRS), "select f_account as a, b_account as b, count(*) as n from motifs group by f_account, b_account"),
    "max_cooccurrence": (steps(PAIRS, ROTATIONS, ACTS, """offsets as (select -2 as off union all select -1 union all select 0 union all select 1 union all select 2), total as (select count(*) as n from rotations),
        met as (select a.entity, r.leader, o.off, count(*) as observed from acts a cross join offsets o cross join total t join rotations r on r.rotation = (a.rotation - 1 + o.off + t.n) % t.n + 1 group by a.entity, r.leader, o.off),
        ranked as (select *, row_number() over (partition by entity order by observed desc, off, leader) as k from met)"""), "select entity, leader, off, observed from ranked where k = 1"),
    # joins and sets
    "asof_rotation": (steps(ROTATIONS, """asked as (select distinct slot + 3 as slot from legs), both_ as (select slot, cast(null as bigint) as f, 1 as asks from asked union all select first_slot, first_slot, 0 from rotations),
        cut as (select slot, f, asks, cast(floor(slot / 512.0e0) as bigint) as part from both_), lasts as (select part, max(f) as f from cut group by part), befores as (select part, max(f) over (order by part rows between unbounded preceding and 1 preceding) as f from lasts),
        latest as (select c.slot, c.asks, coalesce(max(c.f) over (partition by c.part order by c.slot, c.asks rows unbounded preceding), b.f) as f from cut c join befores b on b.part = c.part)"""), "select e.slot, r.rotation from latest e join rotations r on r.first_slot = e.f where e.asks = 1"),
    "any_inner_join": ("one as (select distinct slot from legs where token = 'A')", "select l.slot, count(*) as n from legs l join one o on l.slot = o.slot group by l.slot"),
    "scalar_lag": ("", "select slot, count(*) as n from legs where slot <= (select max(slot) from legs) - 2000 group by slot"),
    "candidate_having": ("", "select tx, count(distinct slot) as slots, count(*) as n from legs group by tx having count(distinct slot) = 1 and sum(case when token = 'N' then 1 else 0 end) = 0"),
    "bundle_verdict": ("b as (select tx, pool % 3 as bundle, count(distinct token) as kinds from legs group by tx, pool % 3)", "select tx, min(bundle) filter (where kinds = 3) as bundle from b group by tx"),
    "dedup_total_order": ("r as (select signer, slot, account, amount, row_number() over (partition by signer, slot order by amount desc, account, tx, pos) as k from legs)", "select signer, slot, account, amount from r where k = 1"),
    "union_categories": ("", "select 'open' as category, count(*) as n from legs where side = 'O' union all select 'close', count(*) from legs where side = 'F' union all select 'unpriced', count(*) from legs l where not exists (select 1 from prices p where p.token = l.token)"),
    "missing_slots": ("wanted as (select distinct pool, slot + 1 as slot from legs), stored as (select distinct pool, slot from legs)", "select w.pool, w.slot from wanted w left join stored s on w.pool = s.pool and w.slot = s.slot where s.slot is null"),
    "epoch_coverage": ("e as (select cast(floor(slot / 432.0e0) as bigint) as epoch, slot from legs)", "select epoch, count(distinct slot) as slots, count(*) as legs, min(slot) as first_slot, max(slot) as last_slot from e group by epoch having count(distinct slot) >= 216"),
    "intersect_signers": ("", "select account from legs where side = 'O' and token = 'A' intersect select account from legs where side = 'F' and token = 'R'"),
    # aggregates and pivots
    "conditional_counts": ("", "select token, count(*) as n, count(*) filter (where side = 'O') as opened, round(sum(value) filter (where side = 'F'), 2) as closed_value, round(avg(amount) filter (where fee > 0.04e0), 6) as dear_amount from legs group by token"),
    "daily_pivot": ("", "select slot, round(sum(case when token = 'A' then value else 0 end), 2) as a, round(sum(case when token = 'R' then value else 0 end), 2) as r, round(sum(case when token = 'N' then value else 0 end), 2) as n from legs group by slot"),
    "profit_bands": ("", "select case when value < 1000 then 'low' when value < 20000 then 'mid' when value < 50000 then 'high' else 'top' end as band, count(*) as n, round(sum(value), 2) as value from legs group by case when value < 1000 then 'low' when value < 20000 then 'mid' when value < 50000 then 'high' else 'top' end"),
    "histogram_bins": ("m as (select min(value) as lo, max(value) as hi from legs), b as (select least(cast(floor((value - lo) / ((hi - lo) / 20)) as bigint), 19) as bin from legs cross join m)", "select bin, count(*) as n from b group by bin"),
    "mode_with_ties": ("c as (select signer, token, count(*) as n from legs group by signer, token), r as (select *, row_number() over (partition by signer order by n desc, token) as k from c)", "select signer, token, n from r where k = 1"),
    "grouping_report": ("", "select token, side, count(*) as n, grouping(token) as no_token, grouping(side) as no_side from legs group by grouping sets ((token, side), (token), ())"),
    "price_coverage": ("", "select l.side, round(count(p.usd) * 1.0e0 / count(*), 6) as coverage, round(sum(l.value * p.usd), 1) as usd from legs l left join prices p on l.token = p.token group by l.side"),
    "top_accounts": ("c as (select account, sum(amount) as v from legs group by account)", "select account, round(v, 4) as v from c order by v desc, account limit 20"),
    "descriptive_stats": ("", "select side, count(*) as n, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd, round(min(value), 4) as lo, round(max(value), 4) as hi, round(percentile_cont(0.25e0) within group (order by value), 4) as p25, round(percentile_cont(0.75e0) within group (order by value), 4) as p75 from legs group by side"),
    "watermarks": ("", "select coalesce(min(slot), 0) as first_slot, coalesce(max(slot), 0) as last_slot, count(distinct slot) as slots from legs"),
    "program_rank_assign": ("c as (select pool, row_number() over (order by count(*) desc, pool) as rank from legs group by pool)", "select l.tx, min_by(l.pool, c.rank) as pool from legs l join c on l.pool = c.pool group by l.tx"),
    "tip_three_state": ("t as (select distinct tx, fee from legs where token = 'A')", "select l.tx, l.pos, l.slot, case when l.token = 'N' then null when t.tx is null then 0.0e0 else l.fee end as tip from legs l left join t on l.tx = t.tx and l.fee = t.fee"),
    "customer_supplier_edges": ("", "select o.o_custkey as customer, l.pool as supplier, count(*) as n from legs l join orders o on l.tx = o.o_orderkey where o.o_orderstatus = 'F' group by o.o_custkey, l.pool having count(*) >= 2"),
    "burstiness": ("active as (select distinct signer, slot from legs), gaps as (select signer, slot - lag(slot) over (partition by signer order by slot) as gap from active), m as (select signer, count(gap) as n, avg(gap) as mu, stddev_samp(gap) as sd from gaps group by signer)", "select signer, n, round((sd - mu) / nullif(sd + mu, 0), 6) as burstiness, round(sd / nullif(mu, 0), 6) as cv from m"),
    "onset_waves": ("f as (select signer, pool, min(slot) as first_slot from legs group by signer, pool)", "select signer, pool, first_slot, cast(dense_rank() over (partition by signer order by first_slot) as bigint) as wave from f"),
    "sensitivity_grid": (steps(PAIRS, NET, "settings as (select 2 as n_min, 0.5e0 as wr_min union all select 2, 0.85e0 union all select 5, 0.5e0 union all select 5, 0.85e0)"), "select s.n_min, s.wr_min, count(*) filter (where f.n >= s.n_min and f.win_rate >= s.wr_min) as pools, cast(coalesce(sum(f.n) filter (where f.n >= s.n_min and f.win_rate >= s.wr_min), 0) as bigint) as motifs from settings s cross join features f group by s.n_min, s.wr_min"),
    "boundary_suppression": (steps(PAIRS, ROTATIONS, """placed as (select m.signer, m.f_key, m.b_key, m.geometry, m.b_slot - m.f_slot as span, n.rotation from motifs m join numbered n on n.slot = m.f_slot where m.b_slot > m.f_slot),
        chance as (select p.signer, p.f_key, p.b_key, max(case when p.geometry = 'cross_leader' then 1.0e0 else 0.0e0 end) as crossed, avg(case when c.slot + p.span > r.last_slot then 1.0e0 else 0.0e0 end) as expected
          from placed p join numbered c on c.rotation = p.rotation join rotations r on r.rotation = p.rotation group by p.signer, p.f_key, p.b_key)"""), "select signer, count(*) as n, round(sum(crossed), 6) as observed, round(sum(expected), 6) as expected from chance group by signer"),
}


def spark_query(name: str):
    ctes, select = REPORTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger.register(spark, sf_dir)
        return spark.sql(f"with {ctes} {select}" if ctes else select)

    return run


def duckdb_sql(name: str) -> str:
    ctes, select = REPORTS[name]
    views = ledger.LEGS_SQL.replace("{day}", ledger.DUCKDB_DAY)
    return f"with {views}{', ' + ctes if ctes else ''} {select}"
