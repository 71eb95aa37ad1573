"""Greedy claiming of round trips in windows of two neighbouring rotations.

A front group, a victim and a back group of one signer in one pool make a motif; a leg serves as front or back once.
Claims reach over pools and tiers, so a window is matched as a whole: round trips that stay with one leader come first,
those over two leaders take what is left.  A window holds the legs of two rotations, a number that block sizes bound;
a motif belongs to the window whose left rotation holds its first front.

A right neighbour is the next rotation if it begins at most ``GAP`` slots after the left one and both leaders are known.

Defined cases: legs with a null in a needed column but the leader match nothing; a slot of unknown leader is a rotation
of its own and has no neighbour; an empty table gives no row; a window without a right neighbour is matched alone; legs
that repeat are legs of their own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Positions between neighbouring legs of one group.
CHAIN = 500
#: Slots between neighbouring rotations, and within one.
GAP = 4
#: Largest relative difference between what goes in and what comes out.
TOLERANCE = 0.1
DUST = 1e-6
NEEDED = ("slot", "pos", "pool", "signer", "side", "amount", "leader")
FOUND = "pool long, signer long, side string, f_slot long, f_pos long, b_slot long, b_pos long, fronts int, backs int, victims int, adverse int, front_amount double, back_amount double, cross_leader boolean"


def chain(at: np.ndarray, free: np.ndarray, first: int) -> list[int]:
    """Members of the group that starts at ``first``: free legs, each near the one before."""
    group = [first]
    for i in range(first + 1, len(at)):
        if at[i] - at[group[-1]] > CHAIN:
            break
        if free[at[i]]:
            group.append(i)
    return group


class Lane:
    """One signer's possible fronts and backs in a pool, with the other signers' legs of both sides around them."""

    def __init__(self, pool, signer, side, fronts, backs, others_same, others_reverse, amount, leader):
        self.key = (pool, side, signer)
        self.fronts, self.backs, self.same, self.reverse = fronts, backs, others_same, others_reverse
        self.amount, self.leader = amount, leader

    @staticmethod
    def between(places: np.ndarray, low: int, high: int) -> int:
        return int(np.searchsorted(places, high, "left") - np.searchsorted(places, low, "right"))

    def accepts(self, front: np.ndarray, back: np.ndarray):
        went, came = float(self.amount[front].sum()), float(self.amount[back].sum())
        largest = max(went, came)
        if largest < DUST or round(went, 3) < round(came, 3) or abs(went - came) / largest > TOLERANCE:
            return None
        victims = self.between(self.same, front[-1], back[0])
        if not victims:
            return None
        crossed = self.leader[front[0]] != self.leader[back[-1]]
        return victims, self.between(self.reverse, front[-1], back[0]), went, came, bool(crossed)

    def match(self, seed: int, free: np.ndarray, cross: bool):
        """The smallest front group from a seed, with the earliest and smallest back group that it makes a motif with."""
        group = self.fronts[chain(self.fronts, free, seed)]
        for k in range(1, len(group) + 1):
            front = group[:k]
            for start in range(int(np.searchsorted(self.backs, front[-1] + 1, "right")), len(self.backs)):
                if not free[self.backs[start]]:
                    continue
                back = self.backs[chain(self.backs, free, start)]
                for n in range(1, len(back) + 1):
                    got = self.accepts(front, back[:n])
                    if got and (cross or not got[4]):
                        return front, back[:n], got
        return None


def match_window(legs: pd.DataFrame) -> pd.DataFrame:
    """All motifs of one window; legs carry the window and whether their rotation is its left one."""
    legs = legs.sort_values(["slot", "pos", "pool", "side", "signer", "amount"], kind="stable").reset_index(drop=True)
    slot, pos, amount, leader, left = (legs[c].to_numpy() for c in ("slot", "pos", "amount", "leader", "left"))
    by_pool: dict = defaultdict(lambda: defaultdict(list))
    for at, (pool, side, signer) in enumerate(zip(legs["pool"], legs["side"], legs["signer"], strict=True)):
        by_pool[pool][side].append((at, signer))
    # all seeds of a pool's direction in the order of the ledger, each in its signer's lane
    turns = []
    for pool in sorted(by_pool):
        sides = by_pool[pool]
        for side in sorted(sides):
            for reverse in sorted(set(sides) - {side}):
                lanes = {}
                for seed, signer in sides[side]:
                    if signer not in lanes:
                        own = lambda s, mine, signer=signer: np.array([a for a, g in sides[s] if (g == signer) == mine], np.int64)  # noqa: B023, E731
                        lanes[signer] = Lane(pool, signer, side, own(side, True), own(reverse, True), own(side, False), own(reverse, False), amount, leader)
                    lane = lanes[signer]
                    if len(lane.backs) and len(lane.same):
                        turns.append((lane, int(np.searchsorted(lane.fronts, seed))))
    free, rows = np.ones(len(legs), bool), []
    for cross in (False, True):
        for lane, seed in turns:
            if not free[lane.fronts[seed]]:
                continue
            found = lane.match(seed, free, cross)
            if found is None:
                continue
            front, back, (victims, adverse, went, came, crossed) = found
            free[front] = free[back] = False
            if left[front[0]]:
                pool, side, signer = lane.key
                a, b = front[0], back[-1]
                rows.append((pool, signer, side, slot[a], pos[a], slot[b], pos[b], len(front), len(back), victims, adverse, went, came, crossed))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def place(legs: DataFrame, gap: int = GAP) -> DataFrame:
    """The legs that can match, with the rotation of their slot and whether it joins the one before."""
    whole = legs.select(*NEEDED).dropna(subset=[c for c in NEEDED if c != "leader"])
    typed = whole.select(*[F.col(c).cast("string" if c == "side" else "double" if c == "amount" else "long").alias(c) for c in NEEDED])
    numbered = ordered.rotations(typed.select("slot", "leader"), gap)
    extents = ordered.rotation_extents(numbered)
    before = extents.select((F.col("rotation") + 1).alias("r"), F.col("leader").alias("l"), "last_slot")
    near = (F.col("first_slot") <= F.col("last_slot") + GAP) & F.col("leader").isNotNull() & F.col("l").isNotNull()
    joined = extents.drop("last_slot").join(before, F.col("rotation") == F.col("r")).where(near).select("rotation", F.lit(True).alias("joins"))
    placed = typed.drop("leader").join(numbered, "slot").join(joined, "rotation", "left")
    return placed.select(*NEEDED, "rotation", F.coalesce("joins", F.lit(False)).alias("joins"))


def match_windows(placed: DataFrame, last: int | None = None) -> DataFrame:
    """The motifs of all windows, or of those whose left rotation is at most ``last``."""
    turns = F.when(F.col("joins"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = placed.select("*", F.explode(turns).alias("back")).select("*", (F.col("rotation") - F.col("back")).alias("window"), (F.col("back") == 0).alias("left"))
    chosen = both if last is None else both.where(F.col("window") <= int(last))
    # an unknown leader has a window to itself, so any number will do for it
    return chosen.withColumn("leader", F.coalesce("leader", F.lit(-1))).drop("rotation", "back", "joins").groupBy("window").applyInPandas(match_window, FOUND)


def claimed_motifs(legs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row a claimed motif of the ledger's legs."""
    return match_windows(place(legs, gap))
