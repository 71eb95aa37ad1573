"""Files of other programs: tables with the columns they must have, resumable fetch lists, prices, verdicts and feeds.

Nothing here calls a network service: what one has answered is read from files, and what to ask for next is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import rotations
from ..operators.sandwiches import stricter

PRICE_SCHEMA = "token string, sandwich_count double, usd_price double, symbol string, name string, decimals double"
VERDICT_SCHEMA = "sandwichId string, slot long, epoch int, bundle_id string"
FEED_SCHEMA = "slot long, front_sig string, back_sig string, front_signer string, back_signer string, victim_sig string"
EXPERT_SCHEMA = "signer string, selected boolean, verdict string, case_id string"
VALIDATOR_COLUMNS = ("identity", "vote_identity", "name", "activated_stake", "commission", "delinquent", "asn", "ip_city", "ip_country", "wiz_score")


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, if they have all these columns; an error names the missing ones."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows


def has_column(rows: DataFrame, name: str) -> bool:
    """Older tables lack some columns; what needs them asks first."""
    return name in rows.columns


def read_tagged(spark: SparkSession, folder: str, stem: str, tag: str, columns: list[str]) -> DataFrame:
    """The table of just this tag, with its columns checked."""
    return require(spark.read.parquet(f"{folder}/{stem}_{tag}.parquet"), columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files of a path or pattern, with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(token, usd) of tokens that have a price."""
    return read_csv(spark, path, PRICE_SCHEMA).where("usd_price is not null").groupBy("token").agg(F.max("usd_price").alias("usd"))


def merged_prices(known: DataFrame, fresh: DataFrame, counts: DataFrame, pinned: list[str]) -> DataFrame:
    """Known prices with fresh ones in their place, pinned tokens always there, and today's counts; nulls come last.

    A price that a failed call left null doesn't replace a known one.
    """
    every = known.select("token", "usd_price", F.lit(0).alias("age")).unionByName(fresh.where("usd_price is not null").select("token", "usd_price", F.lit(1).alias("age")))
    every = every.unionByName(known.sparkSession.createDataFrame([(t, None, -1) for t in pinned], "token string, usd_price double, age int"))
    last = every.groupBy("token").agg(F.max_by("usd_price", "age").alias("usd_price"))
    return last.join(counts.groupBy("token").agg(F.max("sandwich_count").alias("sandwich_count")), "token", "left").select("token", F.coalesce("sandwich_count", F.lit(0.0)).alias("sandwich_count"), "usd_price").orderBy(F.desc_nulls_last("usd_price"), F.desc("sandwich_count"), "token")


def bundle_verdicts(spark: SparkSession, pattern: str, first_epoch: int, last_epoch: int, excluded: tuple[int, ...] = (961,)) -> DataFrame:
    """Verdicts of all files, each sandwich once, of the epochs asked for but the excluded ones."""
    rows = read_csv(spark, pattern, VERDICT_SCHEMA).where(F.col("epoch").between(first_epoch, last_epoch) & ~F.col("epoch").isin(*excluded))
    return stricter(rows, ["sandwichId"], [F.col("epoch"), F.col("slot"), F.col("bundle_id")])


def feed(rows: DataFrame, first_epoch: int, last_epoch: int, epoch_slots: int = 432_000) -> DataFrame:
    """A third party's list of the epochs asked for: each (slot, front, back) once, and whether one signer made both."""
    chosen = rows.where((F.col("slot") >= first_epoch * epoch_slots) & (F.col("slot") < (last_epoch + 1) * epoch_slots))
    once = stricter(chosen, ["slot", "front_sig", "back_sig"], [F.col("victim_sig")])
    return once.withColumn("same_signer", F.col("front_signer") == F.col("back_signer"))


def feed_comparison(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: how many (front_sig, back_sig) both lists hold, and how many only either."""
    a, b = (x.select("front_sig", "back_sig").distinct() for x in (ours, theirs))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["front_sig", "back_sig"], "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_ours"), F.count_if(F.col("a").isNull()).alias("only_theirs"))


def validators(rows: DataFrame) -> DataFrame:
    """Metadata of validators, each identity once, with the known columns that there are."""
    kept = [c for c in VALIDATOR_COLUMNS if c in rows.columns]
    return stricter(rows.select(*kept), ["identity"], [F.xxhash64(*kept)])


def missing_slots(spark: SparkSession, first: int, last: int, stored: DataFrame) -> DataFrame:
    """(slot) from first to last, both included, that are not stored."""
    return spark.range(first, last + 1).select(F.col("id").alias("slot")).join(stored.select("slot").distinct(), "slot", "left_anti")


def fetch_status(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(slot, fetched, bundles, transactions) of slots asked for; answers: (slot, transactions) a bundle; none is a failure to be asked again.

    A slot without bundles answers with a row whose transactions are null.
    """
    got = answers.groupBy("slot").agg(F.count("transactions").alias("bundles"), F.coalesce(F.sum(F.size("transactions")), F.lit(0)).alias("transactions"))
    return asked.select("slot").distinct().join(got.withColumn("fetched", F.lit(True)), "slot", "left").select("slot", F.coalesce("fetched", F.lit(False)).alias("fetched"), F.coalesce("bundles", F.lit(0)).alias("bundles"), F.coalesce("transactions", F.lit(0)).alias("transactions"))


def to_check(slots: DataFrame, bundled: DataFrame, lag: int, limit: int) -> DataFrame:
    """The first slots not checked yet that lie ``lag`` behind the last and have their bundles: oldest first."""
    last = slots.agg((F.max("slot") - lag).alias("safe"))  # one row
    open_ = slots.where("not checked").select("slot").distinct().join(F.broadcast(last), F.col("slot") <= F.col("safe")).select("slot")
    return open_.join(bundled.select("slot").distinct(), "slot", "left_semi").orderBy("slot").limit(limit)


def frontier(fetched: DataFrame, first: int) -> DataFrame:
    """One row, ``frontier``: the last slot up to which all from ``first`` on are fetched, null if the first is not."""
    runs = rotations(fetched.where(F.col("slot") >= first).select("slot", F.lit("x").alias("leader")))
    return runs.groupBy("rotation").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).agg(F.max(F.when(F.col("a") == first, F.col("b"))).alias("frontier"))


def retired_epochs(checked: DataFrame, front: DataFrame, epoch_slots: int = 432_000) -> DataFrame:
    """Epochs that lie wholly behind the frontier: their bundles may be dropped."""
    return checked.select(F.floor(F.col("slot") / epoch_slots).alias("epoch")).distinct().join(F.broadcast(front), (F.col("epoch") + 1) * epoch_slots - 1 <= F.col("frontier")).select("epoch")


def merged_leaders(known: DataFrame, rewarded: DataFrame) -> DataFrame:
    """Leaders of the schedule, and of rewards where the schedule has none."""
    both = known.select("slot", "leader", F.lit(0).alias("turn")).unionByName(rewarded.select("slot", "leader", F.lit(1).alias("turn")))
    return both.where("leader is not null").groupBy("slot").agg(F.min_by("leader", F.struct("turn", "leader")).alias("leader"))


def slot_signatures(bundles: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, sig): bundled signatures of the slots asked for, each once."""
    return bundles.join(slots.select("slot").distinct(), "slot", "left_semi").select("slot", F.explode("transactions").alias("sig")).distinct()


def owner_keys(legs: DataFrame, known: DataFrame) -> DataFrame:
    """(key): owners of token B on either side of sandwiches of different signers, and those known before."""
    front = legs.where("type = 'frontRun'").groupBy("sid").agg(F.min_by("signers", F.struct("slot", "position")).alias("f"))
    back = legs.where("type = 'backRun'").groupBy("sid").agg(F.min_by("signers", F.struct("slot", "position")).alias("b"))
    different = front.join(back, "sid").where(~F.arrays_overlap("f", "b")).select("sid")
    own = legs.where(F.col("type").isin("frontRun", "backRun")).join(different, "sid", "left_semi").select(F.explode("owners_b").alias("key"))
    return own.unionByName(known.select("key")).where("key is not null").distinct()


def token_accounts(owners: DataFrame, token_programs: list[str]) -> DataFrame:
    """(key, is_token_account) from (key, owner), the program that owns the account; a key without an account is none."""
    return owners.dropDuplicates(["key"]).select("key", F.coalesce(F.col("owner").isin(token_programs), F.lit(False)).alias("is_token_account"))


def pooled(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several categories as one, with the category; columns that one lacks are null there."""
    out = None
    for category, rows in tables.items():
        named = rows.withColumn("category", F.lit(category))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table")
    return out


def latest_bundles(bundles: DataFrame, n: int) -> DataFrame:
    """The ids of the last bundles, newest first."""
    return bundles.groupBy("bundle_id").agg(F.max("slot").alias("slot")).orderBy(F.desc("slot"), "bundle_id").limit(n)


def remaining(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to ask for."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def coverage(slots: DataFrame, legs: DataFrame, bundles: DataFrame, epoch_slots: int) -> DataFrame:
    """(epoch, fetched, checked, bundles, legs, in_bundle): three facts by epoch, epochs of the slots."""
    epoch = F.floor(F.col("slot") / epoch_slots).alias("epoch")
    once = slots.groupBy("slot").agg(F.bool_or("fetched").alias("fetched"), F.bool_or("checked").alias("checked"))
    a = once.groupBy(epoch).agg(F.count_if("fetched").alias("fetched"), F.count_if("checked").alias("checked"))
    b = bundles.groupBy(epoch).agg(F.count("*").alias("bundles"))
    c = legs.groupBy(epoch).agg(F.count("*").alias("legs"), F.count_if("in_bundle").alias("in_bundle"))
    return a.join(b, "epoch", "left").join(c, "epoch", "left").fillna(0)


def covered_epochs(tables: list[DataFrame], epoch_slots: int, least: float = 0.5) -> DataFrame:
    """(epoch, slots): epochs of which all sources together keep at least a share of the slots."""
    out = None
    for rows in tables:
        one = rows.select("slot")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.floor(F.col("slot") / epoch_slots).alias("epoch")).agg(F.count_distinct("slot").alias("slots")).where(F.col("slots") >= least * epoch_slots)

