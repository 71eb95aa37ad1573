"""Tables by epoch: making and dropping them, overwriting epochs, newest rows, marks, outputs, resumed lists and releases.

Defined cases: a null epoch is a partition of its own, in a release the part without a number; of rows alike in key and
order one stays; an empty table writes no epoch; an epoch larger than a part's limit is a part of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overwrite_epochs(rows: DataFrame, path: str, epoch: str = "epoch") -> None:
    """Replace the epochs that the rows hold and leave all others; running it again changes nothing."""
    rows.repartition(epoch, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(epoch).parquet(path)


def drop_epochs(spark: SparkSession, path: str, epochs: list[int], epoch: str = "epoch") -> None:
    """Delete whole epochs, no row being read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for e in epochs:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{epoch}={int(e)}")
        at.getFileSystem(conf).delete(at, True)


def newest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key; tables are appended to and made single when read."""
    tied = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), tied))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def mark(rows: DataFrame, hits: DataFrame, key: list[str], flag: str) -> DataFrame:
    """The rows with a flag set where their key is among the hits; flags set before stay."""
    found = hits.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct().withColumn("_hit", F.lit(True))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    before = F.coalesce(F.col(flag), F.lit(False)) if flag in rows.columns else F.lit(False)
    return rows.join(found, on, "left").withColumn(flag, before | F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{k}" for k in key])


def pack_epochs(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Neighbouring epochs in parts of at most ``limit`` bytes, in order."""
    parts: list[list[int]] = []
    used = 0
    for epoch, size in sorted(sizes):
        if not parts or used + size > limit:
            parts.append([])
            used = 0
        parts[-1].append(epoch)
        used += size
    return parts


def _bytes_of(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def write_release(rows: DataFrame, path: str, limit: int, epoch: str = "epoch") -> list[list[int]]:
    """A release: one folder a part, rows of neighbouring epochs together and in order; returns the epochs by part.

    Epochs are written beside the release first, and packed by the bytes that they take there.
    """
    spark, staged = rows.sparkSession, f"{path}-epochs"
    drop_table(spark, staged)
    names = [r[0] for r in rows.where(F.col(epoch).isNotNull()).select(epoch).distinct().collect()]  # a row an epoch
    rows.withColumn("_epoch", F.col(epoch)).repartition("_epoch").write.mode("overwrite").option("compression", "zstd").partitionBy("_epoch").parquet(staged)
    parts = pack_epochs([(e, _bytes_of(spark, f"{staged}/_epoch={e}")) for e in names], limit)
    of = spark.createDataFrame([(e, i) for i, part in enumerate(parts) for e in part], "_e long, part int")
    stored = spark.read.schema(rows.schema).parquet(staged)
    placed = stored.join(F.broadcast(of), F.col(epoch) == F.col("_e"), "left").select(*rows.columns, "part")
    placed.repartitionByRange("part", epoch).sortWithinPartitions("part", epoch).write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
    drop_table(spark, staged)
    return parts


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table's files; none is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The tables of a chain's database and what they are partitioned by.
TABLES = {
    "slot_leaders": "slot bigint, leader string, epoch bigint",
    "slot_txs": "slot bigint, tx_count bigint, valid_count bigint, fetched boolean, checked boolean, epoch bigint",
    "slot_bundles": "slot bigint, fetched boolean, bundles bigint, transactions bigint, epoch bigint",
    "jito_bundles": "bundle_id string, slot bigint, transactions array<string>, tip double, epoch bigint",
    "sandwiches": "sid string, motif_id string, front_slot bigint, back_slot bigint, signer string, token_a string, token_b string, profit_a double, epoch bigint",
    "sandwich_txs": "sid string, type string, slot bigint, position bigint, sig string, signers array<string>, fee bigint, in_bundle boolean, epoch bigint",
}


def create_tables(spark: SparkSession, path: str, database: str = "default") -> list[str]:
    """Tables over folders of a path, those that exist left as they are."""
    for name, columns in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet partitioned by (epoch) location '{path}/{name}'")
    return list(TABLES)


def add_column(spark: SparkSession, table: str, name: str, kind: str) -> None:
    """A column that older rows hold null in; one that is there already is left."""
    if name not in spark.table(table).columns:
        spark.sql(f"alter table {table} add columns ({name} {kind})")


def drop_tables(spark: SparkSession, path: str, database: str = "default") -> None:
    """All tables and their files."""
    for name in TABLES:
        spark.sql(f"drop table if exists {database}.{name}")
        drop_table(spark, f"{path}/{name}")


def with_epoch(rows: DataFrame, slot: str, slots: int = 432_000) -> DataFrame:
    return rows.withColumn("epoch", F.floor(F.col(slot) / slots).cast("long"))


def append(rows: DataFrame, path: str, epoch: str = "epoch") -> None:
    """Rows added to their epochs."""
    rows.write.mode("append").option("compression", "zstd").partitionBy(epoch).parquet(path)


def mark_epochs(spark: SparkSession, path: str, hits: DataFrame, key: list[str], flag: str, epoch: str = "epoch") -> list[int]:
    """Set a flag where the key is among the hits, writing anew only the epochs that hits (with their epoch) name."""
    touched = sorted(r[0] for r in hits.select(epoch).where(F.col(epoch).isNotNull()).distinct().collect())  # a row an epoch
    if touched:
        rows = spark.read.parquet(path).where(F.col(epoch).isin(touched))
        staged = f"{path}-marked"
        mark(rows, hits.drop(epoch), key, flag).write.mode("overwrite").parquet(staged)  # the table can't be read while it is written
        overwrite_epochs(spark.read.parquet(staged), path, epoch)
        drop_table(spark, staged)
    return touched


def write_outputs(rows: DataFrame, path: str, csv: bool = True, json: bool = False) -> None:
    """A small result as Parquet and, arrays joined by commas, as one CSV file; JSON where it is asked for."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.parquet")
    flat = rows.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in rows.dtypes])
    if csv:
        flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    if json:
        rows.coalesce(1).write.mode("overwrite").json(f"{path}.json")


def release_sandwiches(metrics: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Sandwiches under the release's names, each once, in the order of slot and id."""
    state = F.when(F.col("sc_anomaly"), "anomalous").when(F.col("sc_unprotected"), "unprotected").otherwise("scored")
    label = F.col("category") if not labels else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("category")), F.col("category"))
    out = metrics.dropDuplicates(["sid"]).select(
        F.col("sid").alias("sandwich_id"), F.col("signer").alias("attacker"), F.col("front_slot").alias("slot"), F.timestamp_seconds("ts").alias("timestamp"), "token_a", "token_b", F.col("profit_a").alias("profit_token_a"), "fee_sol", F.col("usd_net").alias("usd_profit_net"), "is_profitable",
        "victim_count", "adverse_count", "front_count", "back_count", "cross_block", "cross_leader", (F.col("multi_front") | F.col("multi_back")).alias("multi_split"), "front_gap", "back_gap",
        F.col("sc").alias("slippage_consumption"), state.alias("slippage_state"), F.col("sc_reason").alias("slippage_reason"), "jito_bundle", "pool_dex", label.alias("category"),
    )
    return out.orderBy("slot", "sandwich_id")


def release_attackers(sandwiches: DataFrame, bots: DataFrame) -> DataFrame:
    """One row an attacker of a release's sandwiches: sums, label sets, and behaviour from the list of bots (signer, bot_type, category, ...)."""
    sums = sandwiches.groupBy("attacker").agg(
        F.count("*").alias("sandwich_count"), F.coalesce(F.sum("usd_profit_net"), F.lit(0.0)).alias("usd_profit_net"), F.sum("fee_sol").alias("fee_sol_total"), F.count_if(~F.col("cross_block")).alias("in_block_count"), F.count_if("cross_block").alias("cross_block_count"), F.count_if("cross_leader").alias("cross_leader_count"),
        F.count_if("multi_split").alias("multi_split_count"), F.count_if("jito_bundle").alias("jito_bundle_count"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    most = lambda c: F.max_by(c, F.struct("sandwich_count", "category")).alias(c)
    of = bots.groupBy(F.col("signer").alias("attacker")).agg(F.array_join(F.array_sort(F.collect_set("bot_type")), ",").alias("bot_type"), *[most(c) for c in ("win_rate", "sol_win_rate", "mean_sc", "front_gap_p50")])
    return sums.join(of, "attacker", "left").withColumn("usd_avg_profit", F.col("usd_profit_net") / F.col("sandwich_count"))


def release_legs(legs: DataFrame, ids: DataFrame) -> DataFrame:
    """The legs of a release's sandwiches (sandwich_id); limits are shown for victims only."""
    victim = F.col("type") == "victim"
    kept = legs.join(ids.select(F.col("sandwich_id").alias("sid")).distinct(), "sid", "left_semi")
    return kept.select(F.col("sid").alias("sandwich_id"), "type", "slot", "position", F.col("sig").alias("signature"), F.element_at("signers", 1).alias("tx_signer"), "from_token", "to_token", "from_amount", "to_amount", "fee", "in_bundle", "programs", F.when(victim, F.col("limit_type")).otherwise("").alias("slippage_limit_type"), F.when(victim, F.col("limit_amount")).alias("slippage_limit_amount"), F.when(victim, F.col("actual_amount")).alias("slippage_actual_amount"))


def csv_slice(legs: DataFrame, ids: DataFrame) -> DataFrame:
    """The own legs, fronts and backs, of the sandwiches chosen (sandwich_id)."""
    return legs.join(ids.select("sandwich_id").distinct(), "sandwich_id", "left_semi").where(F.col("type").isin("frontRun", "backRun"))
