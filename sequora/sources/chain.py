"""Ledger-shaped tables of sandwiches made from the order tables, for tests and for comparison with another engine.

Every order of three lines or more is a sandwich: its first lines are front-runs, its last ones back-runs, those between
victims, adverse legs and transfers.  All values are integer arithmetic on keys or copies of stored columns, so both
engines derive the same rows.  Operators take these tables as DataFrames; nothing is registered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 432_000
ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _name(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a leg: sid, type, slot, position, ts, sig, signers, programs, fee, tokens and amounts, limits, owners_b, in_bundle."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = Window.partitionBy("l_orderkey")
    rows = rows.select("*", F.row_number().over(by.orderBy(*ORDER)).alias("k"), F.count("*").over(by).alias("n")).where("n >= 3")
    ok, pk, sk, k, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "k", "n"))
    kind = (
        F.when((k == 1) | ((k == 2) & (n >= 6) & (ok % 3 == 0)), "frontRun")
        .when((k == n) | ((k == n - 1) & (n >= 7) & (ok % 2 == 0)), "backRun")
        .when(pk % 7 == 0, "adverse")
        .when(pk % 7 == 1, "transfer")
        .otherwise("victim")
    )
    rows = rows.withColumn("type", kind).withColumn("slot", (ok * 200 + F.floor((k - 1) * (ok % 4) / n)).cast("long"))
    t, same = F.col("type"), F.when(ok % 10 == 0, 1).otherwise(0)
    token_a = F.when(ok % 3 == 0, "SOL").when(ok % 3 == 1, "USDC").otherwise(_name("T", ok % 11))
    token_b = _name("M", ok % 17)
    buys = t.isin("frontRun", "victim", "transfer")
    attacker = _name("a", ok % 61)
    return rows.select(
        _name("s", ok).alias("sid"), t.alias("type"), "slot", (k * 60 + sk % 60).cast("long").alias("position"),
        (F.lit(1_700_000_000) + F.floor(F.col("slot") * 2 / 5)).cast("long").alias("ts"),
        F.concat(F.lit("g"), ok.cast("string"), F.lit("x"), k.cast("string")).alias("sig"),
        F.when(t == "frontRun", F.when(ok % 5 == 0, F.array(attacker, _name("x", sk % 7))).otherwise(F.array(attacker)))
        .when(t == "backRun", F.array(_name("a", (ok + same) % 61)))
        .when(t == "transfer", F.array(attacker))
        .otherwise(F.array(_name("v", pk % 500))).alias("signers"),
        F.array(_name("p", sk % 13), _name("p", pk % 13)).alias("programs"),
        (F.round(F.col("l_tax") * 1_000_000) + 5000).cast("long").alias("fee"),
        F.when(buys, token_a).otherwise(token_b).alias("from_token"), F.when(buys, token_b).otherwise(token_a).alias("to_token"),
        F.when(buys, F.col("l_quantity")).otherwise(F.col("l_quantity") * 20).alias("from_amount"),
        F.when(buys, F.col("l_quantity") * 20).otherwise(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("to_amount"),
        F.when(F.col("l_returnflag") == "A", "output").when(F.col("l_returnflag") == "R", "input").otherwise("").alias("limit_type"),
        F.col("l_discount").alias("limit_amount"), F.col("l_tax").alias("actual_amount"),
        F.when(ok % 4 == 0, F.array(_name("o", ok % 83), _name("o", sk % 29 + 100))).otherwise(F.array(_name("o", ok % 83))).alias("owners_b"),
        ((pk + ok) % 3 != 0).alias("in_bundle"), _name("dex", ok % 6).alias("pool_dex"),
    )


def leaders(legs: DataFrame) -> DataFrame:
    """(slot, leader) of the slots that legs lie in; some slots have none."""
    return legs.select("slot").distinct().where(F.floor(F.col("slot") / 4) % 29 != 0).select("slot", _name("L", (F.floor(F.col("slot") / 200) * 7 + F.floor(F.col("slot") / 2) % 2) % 25).alias("leader"))


def slot_counts(legs: DataFrame) -> DataFrame:
    """(slot, tx_count, valid_count, fetched, checked) a slot; some slots come twice, as appended tables hold them."""
    once = legs.select("slot").distinct()
    twice = once.select("slot", F.explode(F.when(F.col("slot") % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return twice.select("slot", (800 + F.col("slot") * 37 % 900 + F.col("again") * 5).cast("long").alias("tx_count"), (400 + F.col("slot") % 300).cast("long").alias("valid_count"), (F.col("slot") % 19 != 0).alias("fetched"), (F.col("slot") % 7 != 0).alias("checked"))


def bundles(legs: DataFrame) -> DataFrame:
    """(bundle_id, slot, transactions): the bundled legs of a sandwich, in one bundle or two."""
    number = F.substring("sid", 2, 20).cast("long")
    part = F.when(number % 6 == 0, F.lit(0)).otherwise(F.col("position") % 2)
    return legs.where("in_bundle").groupBy(F.concat(F.lit("b"), F.substring("sid", 2, 20), F.lit("x"), part.cast("string")).alias("bundle_id"), "slot").agg(F.sort_array(F.collect_list("sig")).alias("transactions"))  # a bundle's own few


def prices(spark: SparkSession) -> DataFrame:
    """USD prices by token; some tokens have none."""
    return spark.createDataFrame([("SOL", 150.0), ("USDC", 1.0), *((f"T{i}", 0.25 * (i + 1)) for i in range(5))], "token string, usd double")


#: The same tables for DuckDB.
CHAIN_SQL = """
c_rows as (
  select *, l_orderkey as ok, l_partkey as pk, l_suppkey as sk,
    row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as k,
    count(*) over (partition by l_orderkey) as n
  from lineitem
), c_typed as (
  select *, case when k = 1 or (k = 2 and n >= 6 and ok % 3 = 0) then 'frontRun' when k = n or (k = n - 1 and n >= 7 and ok % 2 = 0) then 'backRun'
      when pk % 7 = 0 then 'adverse' when pk % 7 = 1 then 'transfer' else 'victim' end as type,
    cast(ok * 200 + (k - 1) * (ok % 4) // n as bigint) as slot,
    case when ok % 3 = 0 then 'SOL' when ok % 3 = 1 then 'USDC' else 'T' || (ok % 11) end as token_a, 'M' || (ok % 17) as token_b
  from c_rows where n >= 3
), legs as (
  select 's' || ok as sid, type, slot, cast(k * 60 + sk % 60 as bigint) as position, cast(1700000000 + slot * 2 // 5 as bigint) as ts, 'g' || ok || 'x' || k as sig,
    case when type = 'frontRun' then case when ok % 5 = 0 then ['a' || (ok % 61), 'x' || (sk % 7)] else ['a' || (ok % 61)] end
      when type = 'backRun' then ['a' || ((ok + case when ok % 10 = 0 then 1 else 0 end) % 61)] when type = 'transfer' then ['a' || (ok % 61)] else ['v' || (pk % 500)] end as signers,
    ['p' || (sk % 13), 'p' || (pk % 13)] as programs, cast(round(l_tax * 1000000) + 5000 as bigint) as fee,
    case when type in ('frontRun', 'victim', 'transfer') then token_a else token_b end as from_token, case when type in ('frontRun', 'victim', 'transfer') then token_b else token_a end as to_token,
    case when type in ('frontRun', 'victim', 'transfer') then l_quantity else l_quantity * 20 end as from_amount,
    case when type in ('frontRun', 'victim', 'transfer') then l_quantity * 20 else l_quantity * (1 + l_tax) end as to_amount,
    case l_returnflag when 'A' then 'output' when 'R' then 'input' else '' end as limit_type, l_discount as limit_amount, l_tax as actual_amount,
    case when ok % 4 = 0 then ['o' || (ok % 83), 'o' || (sk % 29 + 100)] else ['o' || (ok % 83)] end as owners_b,
    (pk + ok) % 3 <> 0 as in_bundle, 'dex' || (ok % 6) as pool_dex
  from c_typed
), leaders as (
  select slot, 'L' || ((slot // 200 * 7 + slot // 2 % 2) % 25) as leader from (select distinct slot from legs) where slot // 4 % 29 <> 0
), slot_counts as (
  select slot, cast(800 + slot * 37 % 900 + again * 5 as bigint) as tx_count, cast(400 + slot % 300 as bigint) as valid_count, slot % 19 <> 0 as fetched, slot % 7 <> 0 as checked
  from (select distinct slot from legs) s, (values (0), (1)) d(again) where again = 0 or slot % 31 = 0
), bundles as (
  select 'b' || substr(sid, 2) || 'x' || (case when cast(substr(sid, 2) as bigint) % 6 = 0 then 0 else position % 2 end) as bundle_id, slot, list_sort(list(sig)) as transactions
  from legs where in_bundle group by 1, 2
), prices as (
  select 'SOL' as token, 150.0::double as usd union all select 'USDC', 1.0 union all select 'T' || i, 0.25 * (i + 1) from range(5) r(i)
)
"""
