"""How often entities act near a leader's turns, against how often chance would have it.

A turn is a rotation: a run of slots of one leader.  Offsets reach two turns either way; a turn weighs as many slots as
it has.  Ties between offsets go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import graph, ordered

OFFSETS = (-2, -1, 0, 1, 2)
MIN_ETA, MIN_NEAR, MIN_SHARED, TRUSTED = 10.0, 5, 3, 15
CORE_SHARED, CORE_OFFSET, CORE_NEAR = 6, 1, 3


def turns(leaders: DataFrame) -> DataFrame:
    return ordered.rotation_extents(ordered.rotations(leaders))


def _offsets() -> Column:
    return F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("off")


def baseline(turns: DataFrame) -> DataFrame:
    """(leader, off, freq): the slot-weighted share of turns that have the leader at the offset."""
    total = turns.agg(F.sum("slots").alias("total"))  # one row
    each = turns.select("rotation", "slots", _offsets()).select((F.col("rotation") + F.col("off")).alias("r"), "off", "slots")
    met = each.join(turns.select(F.col("rotation").alias("r"), "leader"), "r").groupBy("leader", "off").agg(F.sum("slots").alias("w"))
    return met.join(F.broadcast(total)).select("leader", "off", (F.col("w") / F.col("total")).alias("freq"))


def leader_shares(turns: DataFrame) -> DataFrame:
    """(leader, slots, share) of all produced slots."""
    total = turns.agg(F.sum("slots").alias("total"))  # one row
    return turns.groupBy("leader").agg(F.sum("slots").alias("slots")).join(F.broadcast(total)).select("leader", "slots", (F.col("slots") / F.col("total")).alias("share"))


def encounters(acts: DataFrame, leaders: DataFrame) -> DataFrame:
    """(signer, leader, off, n) of acts (signer, slot), a row an act; acts in slots without a leader meet nobody."""
    numbered = ordered.rotations(leaders)
    names = numbered.select("rotation", "leader").distinct()
    placed = acts.join(numbered.select("slot", "rotation"), "slot").groupBy("signer", "rotation").agg(F.count("*").alias("n"))
    each = placed.select("signer", "n", "rotation", _offsets()).select("signer", "n", "off", (F.col("rotation") + F.col("off")).alias("rotation"))
    return each.join(names, "rotation").groupBy("signer", "leader", "off").agg(F.sum("n").alias("n"))


def missed(acts: DataFrame, leaders: DataFrame) -> DataFrame:
    """(signer, total, missed): acts, and those of them in slots without a leader."""
    met = acts.join(leaders.select("slot", F.lit(1).alias("known")).distinct(), "slot", "left")
    return met.groupBy("signer").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("missed"))


def scored(acts: DataFrame, leaders: DataFrame, min_eta: float = MIN_ETA, min_near: int = MIN_NEAR) -> DataFrame:
    """Pairs of entity and leader met at least ``min_near`` times and ``min_eta`` times as often as chance has it."""
    base = baseline(turns(leaders)).groupBy("leader").agg(F.sum("freq").alias("expected"))
    met = encounters(acts, leaders)
    totals = acts.groupBy("signer").agg(F.count("*").alias("signer_total"))  # acts that meet nobody count as well
    pairs = met.groupBy("signer", "leader").agg(F.sum("n").alias("near"), F.max_by("off", F.struct("n", -F.col("off"))).alias("peak_offset"), F.max("n").alias("peak_count"), *[F.sum(F.when(F.col("off") == o, F.col("n")).otherwise(0)).alias(f"off_{o}".replace("-", "m")) for o in OFFSETS])
    out = pairs.join(totals, "signer").join(base, "leader")
    share = F.col("near") / F.col("signer_total")
    out = out.select("*", share.alias("near_share"), ratio(share, F.col("expected")).alias("eta"))
    return out.where((F.col("eta") >= min_eta) & (F.col("near") >= min_near))


def without_trusted(pairs: DataFrame, turns: DataFrame, top: int = TRUSTED) -> DataFrame:
    """The pairs but for those with the leaders of the most slots."""
    best = leader_shares(turns).orderBy(F.desc("slots"), "leader").limit(top).select("leader")
    return pairs.join(best, "leader", "left_anti")


def shared_leaders(pairs: DataFrame, least: int = MIN_SHARED) -> DataFrame:
    """(a, b, shared): entities flagged with at least ``least`` leaders in common.

    Two that share k of their leaders share one of either's rarest n - k + 1, so only these are joined for candidates.
    """
    flags = pairs.select("signer", "leader").distinct()
    often = flags.groupBy("leader").agg(F.count("*").alias("often"))
    per = Window.partitionBy("signer")
    placed = flags.join(often, "leader").select("signer", "leader", F.row_number().over(per.orderBy("often", "leader")).alias("turn"), F.count("*").over(per).alias("n"))
    rare = placed.where(F.col("turn") <= F.col("n") - least + 1).select("signer", "leader")
    a, b = rare.select(F.col("signer").alias("a"), "leader"), rare.select(F.col("signer").alias("b"), "leader")
    candidates = a.join(b, "leader").where("a < b").select("a", "b").distinct()
    both = candidates.join(flags.select(F.col("signer").alias("a"), "leader"), "a").join(flags.select(F.col("signer").alias("b"), "leader"), ["b", "leader"])
    return both.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def cohorts(pairs: DataFrame) -> DataFrame:
    """(signer, cohort, members): entities joined by a leader flagged for both, in groups of two or more.

    Entities that share several leaders share one, so the edges of single leaders join these too.
    """
    edges = graph.star_edges(pairs, "leader", "signer")
    found = graph.components(edges).select(F.col("node").alias("signer"), F.col("root").alias("cohort"))
    sizes = found.groupBy("cohort").agg(F.count("*").alias("members")).where("members >= 2")
    return found.join(sizes, "cohort").select("signer", "cohort", "members")


def cohort_core(pairs: DataFrame, least: int = CORE_SHARED, offset: int = CORE_OFFSET, near: int = CORE_NEAR) -> DataFrame:
    """(signer): the largest group joined by ``least`` leaders met at one offset at least ``near`` times; ties: the least name."""
    column = f"off_{offset}".replace("-", "m")
    some = pairs.where(F.col(column) >= near)
    found = graph.components(shared_leaders(some, least).select("a", "b"))
    best = found.groupBy("root").agg(F.count("*").alias("n")).agg(F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("best"))  # one row
    return found.join(F.broadcast(best), F.col("root") == F.col("best")).select(F.col("node").alias("signer"))


def cohort_leaders(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(leader, members, n, rank): a cohort's leaders by how many of it they are flagged for."""
    own = pairs.join(members, "signer", "left_semi").groupBy("leader").agg(F.count_distinct("signer").alias("members"), F.sum("near").alias("n"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("members"), F.desc("n"), "leader")))  # a row a leader


def control(met: DataFrame, members: DataFrame) -> DataFrame:
    """(leader, off, n) of all entities that are no members, pooled."""
    return met.join(members, "signer", "left_anti").groupBy("leader", "off").agg(F.sum("n").alias("n"))


def strongest(met: DataFrame) -> DataFrame:
    """(signer, leader, n, share): the leader that an entity meets most."""
    sums = met.groupBy("signer", "leader").agg(F.sum("n").alias("n"))
    return sums.groupBy("signer").agg(F.min_by("leader", F.struct(-F.col("n"), F.col("leader"))).alias("leader"), F.max("n").alias("n"), F.sum("n").alias("t")).select("signer", "leader", "n", (F.col("n") / F.col("t")).alias("share"))


def peak_counts(pairs: DataFrame) -> DataFrame:
    """(off, pairs) for every offset, also those that no pair peaks at."""
    every = pairs.sparkSession.createDataFrame([(o,) for o in OFFSETS], "off int")
    return every.join(pairs.groupBy(F.col("peak_offset").alias("off")).agg(F.count("*").alias("pairs")), "off", "left").fillna(0, ["pairs"])


def boundary_suppression(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """(signer, n, observed, expected): sandwiches over several slots that end with another leader, and how many would by chance.

    Chance is the front-run at any produced slot of its own turn with the same span; for a turn without gaps that is
    min(span, k) / k, else the share of its slots.
    """
    numbered = ordered.rotations(leaders)
    ends = ordered.rotation_extents(numbered).select("rotation", "last_slot", "slots", "contiguous")
    placed = rows.where("cross_block and front_slot is not null and back_slot is not null").select("signer", "sid", "cross_leader", (F.col("back_slot") - F.col("front_slot")).alias("span"), F.col("front_slot").alias("slot"))
    placed = placed.join(numbered.select("slot", "rotation"), "slot").join(ends, "rotation")
    closed = placed.where("contiguous").select("signer", "cross_leader", (F.least("span", "slots") / F.col("slots")).alias("p"))
    gapped = placed.where("not contiguous").select("signer", "sid", "cross_leader", "span", "last_slot", "rotation").join(numbered.select(F.col("slot").alias("c"), "rotation"), "rotation")
    gapped = gapped.groupBy("signer", "sid", "cross_leader").agg(F.avg((F.col("c") + F.col("span") > F.col("last_slot")).cast("int")).alias("p")).select("signer", "cross_leader", "p")
    return closed.unionByName(gapped).groupBy("signer").agg(F.count("*").alias("n"), F.count_if("cross_leader").alias("observed"), F.sum("p").alias("expected"))


#: Triples of a sorted array of leaders, each sorted.
_TRIPLES = "flatten(transform(sequence(0, size(leaders) - 3), i -> flatten(transform(sequence(i + 1, size(leaders) - 2), j -> transform(sequence(j + 1, size(leaders) - 1), k -> array(leaders[i], leaders[j], leaders[k]))))))"
#: Accounts of one set of leaders are joined in blocks of about this many; up to ``NEAR`` accounts are broadcast.
BLOCK = 500
NEAR = 1_000_000


def shared_leader_edges(flagged: DataFrame) -> DataFrame:
    """(a, b, shared): accounts a < b that are flagged (account, leader) for three leaders or more in common.

    Only sets of leaders are compared: two share three if they hold the same triple, and are met at the least such one, so
    no pair has to be made distinct.  Their accounts are then paired in passing; no pair of accounts is ever shuffled.
    """
    spark = flagged.sparkSession
    graph.use_checkpoints(spark)
    known = flagged.where("account is not null and leader is not null").groupBy("account").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    sets = known.where("size(leaders) >= 3").checkpoint()
    classes = sets.groupBy("leaders").agg(F.count("*").alias("n"))
    triples = classes.select("leaders", F.explode(F.expr(_TRIPLES)).alias("triple"))
    both = F.array_intersect("l1", "l2")
    pairs = (
        triples.select("triple", F.col("leaders").alias("l1")).join(triples.select("triple", F.col("leaders").alias("l2")), "triple")
        .where((F.col("l1") <= F.col("l2")) & (F.slice(both, 1, 3) == F.col("triple"))).select("l1", "l2", F.size(both).cast("long").alias("shared"))
        .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    )
    blocks = sets.join(classes, "leaders").groupBy("leaders", F.pmod(F.xxhash64("account"), F.ceil(F.col("n") / BLOCK)).alias("block")).agg(F.collect_list("account").alias("accounts"))
    one, two = (blocks.select(F.col("leaders").alias(f"l{i}"), F.col("block").alias(f"b{i}"), F.col("accounts").alias(f"a{i}")) for i in (1, 2))
    if sets.count() <= NEAR:
        one, two = F.broadcast(one), F.broadcast(two)
    same = F.col("l1") == F.col("l2")
    met = pairs.join(one, "l1").join(two, "l2").where(~same | (F.col("b1") <= F.col("b2"))).withColumn("within", same & (F.col("b1") == F.col("b2")))
    each = met.select("shared", "within", "a2", F.explode("a1").alias("u")).select("shared", "within", "u", F.explode("a2").alias("v"))
    return each.where(~F.col("within") | (F.col("u") < F.col("v"))).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "shared")
