"""Ledger-shaped views of the order tables: legs of transactions by slot and position, bundles, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A view of lineitem as legs; day is the dialect's day difference of l_shipdate from 1995-01-01.
LEGS_SQL = """
legs as (
  select cast({day} as bigint) as slot,
    cast(row_number() over (partition by l_shipdate order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as bigint) as pos,
    l_suppkey as pool, l_partkey % 8 as signer, l_linestatus as side, l_quantity as amount, l_orderkey as tx, l_partkey as account,
    l_tax as fee, l_returnflag as token, l_discount as limit_amount, l_tax as actual_amount, l_extendedprice as value,
    cast(floor(floor({day} / 4) * 7) as bigint) % 25 as leader
  from lineitem
), prices as (select 'A' as token, cast(2.0 as double) as usd union all select 'R', cast(0.5 as double))
"""
DUCKDB_DAY = "date_diff('day', timestamp '1995-01-01', l_shipdate)"


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a leg: slot, position in the slot, pool, signer, side and amounts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    day = F.datediff("l_shipdate", F.to_date(F.lit("1995-01-01"))).cast("long")
    position = F.row_number().over(Window.partitionBy("l_shipdate").orderBy(*order)) - 1
    return items.select(
        day.alias("slot"), position.cast("long").alias("pos"), F.col("l_suppkey").alias("pool"), (F.col("l_partkey") % 8).alias("signer"), F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("amount"), F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("account"),
        F.col("l_tax").alias("fee"), F.col("l_returnflag").alias("token"), F.col("l_discount").alias("limit_amount"), F.col("l_tax").alias("actual_amount"), F.col("l_extendedprice").alias("value"),
        (F.floor(day / 4) * 7 % 25).cast("long").alias("leader"),
    )


def prices(spark: SparkSession) -> DataFrame:
    """Prices by token; one token has none."""
    return spark.createDataFrame([("A", 2.0), ("R", 0.5)], "token string, usd double")


def register(spark: SparkSession, sf_dir: str, tables=("orders", "customer", "supplier", "nation", "events")) -> None:
    """Temporary views of the ledger and the stored tables, for SQL."""
    legs(spark, sf_dir).createOrReplaceTempView("legs")
    prices(spark).createOrReplaceTempView("prices")
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
