"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit in one of their 32-bit halves.  So
each half is indexed as it is and with each of its bits made a wildcard; an equality join on these signatures meets
every linked pair, and the whole fingerprints verify it.  A wildcard signature only pairs fingerprints that differ in
the wildcard bit, as equal halves meet in the plain one.

Equal fingerprints are one node from the start, so copies are never paired.  A signature shared by more than
``BUCKET`` nodes is not expanded into pairs: its nodes are linked exactly through the points one flipped bit away from
them.  Nodes meet in such a point only within distance two of each other, and every pair that near meets in one, so
each point (of 65 nodes at most) gives a star.

Sets of similarity 0.8 differ in more bits than that, so ``wide_links`` takes fingerprints of ``LANES`` words, cut into
segments of ``SEGMENT`` bits.  Two texts are met if in one segment they differ in at most one bit, by the same variants,
and linked if ``COMPARED`` words differ in ``FAR`` bits at most; what is linked there is still to be compared exactly.
Bits of two sets of similarity 0.8 and of one size differ with probability arccos(8/9)/pi = 0.152, so they differ in at
most one of 16 with 0.28 and are missed by all 32 segments with 3e-5; ``FAR`` is five standard deviations off.

Defined cases: a null or empty text has fingerprint zero; null doc_ids have a fingerprint and never are a component's
id unless all of its ids are null; repeated rows are rows of their own; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BUCKET = 8
HALF = 32
#: Nodes whose signatures one task makes.
NODES = 20_000
#: A fingerprint is hot if it has more than this part of all rows.
HOT = 1000
#: Shared signatures, of 16 bytes, that may be broadcast; more are joined by a shuffle.
BROADCAST = 4_000_000

#: 64-bit words of a wide fingerprint, the bits of a segment, and the words that are compared whole.
LANES, SEGMENT, COMPARED = 8, 16, 4
#: The most differing bits of linked fingerprints, in the first word and in all words compared.
FAR_FIRST, FAR = 24, 68
#: Sizes of linked sets differ by this factor at most: the smaller has 4 for 5 of the larger.
SIZES = (4, 5)
#: Fingerprints that one group of ``wide_links`` holds, about; pairs expanded at once; pairs a row above which a signature is searched.
GROUP, PAIRS, CROWD = 50_000, 1 << 18, 64
_LANES = np.random.default_rng(43).integers(0, 1 << 64, LANES, np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 250):  # sums of bytes stay below 256
        ones += np.unpackbits(hashes[at : at + 250].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, *kept: Column) -> DataFrame:
    """The columns kept, and fp, the fingerprint of text as a signed long."""

    def rows(batches):
        for batch in common.in_slices(batches):
            found = np.array([fingerprint(t) for t in batch.column("fp_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "fp"])

    common.ship(docs.sparkSession)
    chosen = docs.select(*kept, F.col("text").cast("string").alias("fp_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[:-1])
    return chosen.mapInArrow(rows, f"{schema}, fp long")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finish, of words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``LANES`` words: a bit is set if it is set in over half of the hashes, which are mixed anew for each word."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 250):  # sums of bytes stay below 256
        lanes = mixed(hashes[at : at + 250, None] ^ _LANES)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _within(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the compared words differ in few bits; a and b are places that broadcast."""
    near = np.bitwise_count(prints[0][a] ^ prints[0][b]) <= FAR_FIRST
    found = np.nonzero(near)
    a, b = (np.broadcast_to(x, near.shape)[found] for x in (a, b))
    near[found] = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in prints) <= FAR
    return near


def _sizes_fit(sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (SIZES[1] * sizes[a] >= SIZES[0] * sizes[b]) & (SIZES[1] * sizes[b] >= SIZES[0] * sizes[a])


def _searched(members: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among all members, by search: copies that are near each other are met once."""
    out, rest = [], members
    while len(rest) > 1:
        queue, rest = rest[:1], rest[1:]
        while len(queue) and len(rest):
            some = max(1, PAIRS // len(rest))
            now, queue = queue[:some], queue[some:]
            met = np.zeros(len(rest), np.int64) - 1
            for at in range(0, len(rest), PAIRS):
                own = rest[at : at + PAIRS]
                near = _sizes_fit(sizes, now[:, None], own[None]) & _within(prints, now[:, None], own[None])
                met[at : at + PAIRS] = np.where(near.any(axis=0), near.argmax(axis=0), -1)
            reached = met >= 0
            out.append((now[met[reached]], rest[reached]))
            queue, rest = np.concatenate([queue, rest[reached]]), rest[~reached]
    return out


def met_in_segment(values: np.ndarray, sizes: np.ndarray, prints: np.ndarray, plain: bool, wild: range) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) of rows whose values are equal (if plain), or equal but for one bit of wild.

    values: below 2 ** 16; prints: (words, rows).  All links within a crowded signature are replaced by a spanning forest.
    """
    order = np.lexsort((sizes, values))
    sizes_, prints_, keys = sizes[order], prints[:, order], (values[order].astype(np.int64) << 40) | sizes[order]
    low, high = -(-SIZES[0] * sizes_ // SIZES[1]), np.minimum(SIZES[1] * sizes_ // SIZES[0], (1 << 40) - 1)
    base, out = keys - sizes_, [(np.zeros(0, np.int64),) * 2]

    def pair(left: np.ndarray, begin: np.ndarray, end: np.ndarray, right: np.ndarray, signature: np.ndarray) -> None:
        """Pairs of left[i] with right[begin[i] : end[i]]; signature: equal for those of one, ascending."""
        n = np.maximum(end - begin, 0)
        first = np.flatnonzero(np.diff(signature, prepend=-1)) if len(signature) else np.zeros(0, np.int64)
        if len(first):
            total = np.add.reduceat(n, first)
            counts = np.diff(np.append(first, len(left)))
            for k in np.flatnonzero(total > CROWD * (counts + 1)):
                rows = slice(first[k], first[k] + counts[k])
                met = right[begin[rows].min() : end[rows].max()]
                out.extend(_searched(np.unique(np.concatenate([left[rows], met])), sizes_, prints_))
                n[rows] = 0
        total = common.starts_of(n)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
            own = n[at:stop]
            a = np.repeat(left[at:stop], own)
            b = right[np.arange(len(a)) + np.repeat(begin[at:stop] - (total[at:stop] - total[at]), own)]
            near = _within(prints_, a, b)
            out.append((a[near], b[near]))
            at = stop

    every = np.arange(len(keys))
    if plain:
        pair(every, every + 1, np.searchsorted(keys, base + high, side="right"), every, base)
    for p in wild:
        bit = np.int64(1) << (40 + p)
        zeros, ones = np.flatnonzero(keys & bit == 0), np.flatnonzero(keys & bit)
        without = keys[ones] - bit  # the variant without this bit; both sides stay in order
        begin, end = np.searchsorted(without, base[zeros] + low[zeros]), np.searchsorted(without, base[zeros] + high[zeros], side="right")
        pair(zeros, begin, end, ones, base[zeros])
    u, v = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[u], order[v]


def stars(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) among n places as a star for each component: its places but the smallest, and that one."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while len(u) and (root[root] != root).any():
            root = root[root]
    places = np.flatnonzero(root != np.arange(n))
    return places, root[places]


def wide_links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that join all nodes (fp, size, prints: wide fingerprints) that are met in a segment and linked.

    A difference of one bit is in one half of a segment, so a group has the rows with equal halves, and for its variants
    the bits of the other half: the variants themselves are never written.
    """
    parts = min(1 << SEGMENT // 2, max(1, -(-nodes.count() // GROUP)))
    per_word = 64 // SEGMENT
    each = nodes.select("fp", "size", "prints", F.explode(F.sequence(F.lit(0), F.lit(LANES * per_word - 1))).alias("seg"))
    value = F.call_function("shiftright", F.get("prints", F.floor(F.col("seg") / per_word).cast("int")), F.col("seg") % per_word * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))
    words = [F.get("prints", F.lit(k)).alias(f"p{k}") for k in range(COMPARED)]
    sides = each.select("fp", "size", "seg", value.alias("value"), *words, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.when(F.col("side") == 0, F.shiftright("value", SEGMENT // 2)).otherwise(F.col("value").bitwiseAND(F.lit((1 << SEGMENT // 2) - 1)))
    group = (F.col("seg") * 2 + F.col("side")) * parts + F.pmod(half, F.lit(parts)).cast("int")
    both = F.call_function("shiftleft", F.col("size").cast("long"), F.lit(SEGMENT)).bitwiseOR(F.col("value"))
    rows = sides.select(group.alias("g"), "fp", both.alias("both"), *[f"p{k}" for k in range(COMPARED)])

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("fp")  # so that groups choose the same stars
        both, fp = table.column("both").to_numpy(), table.column("fp").to_numpy()
        prints = np.stack([table.column(f"p{k}").to_numpy().view(np.uint64) for k in range(COMPARED)])
        side = int(table.column("g")[0].as_py()) // parts % 2
        u, v = met_in_segment(both & ((1 << SEGMENT) - 1), both >> SEGMENT, prints, not side, range(SEGMENT // 2 * side, SEGMENT // 2 * (side + 1)))
        u, v = stars(len(fp), u, v)  # copies near each other are never written as pairs
        return pa.table({"u": pa.array(fp[u], pa.int64()), "v": pa.array(fp[v], pa.int64())})

    common.ship(nodes.sparkSession)
    return rows.groupBy("g").applyInArrow(search, "u long, v long")


def signatures(nodes: DataFrame) -> DataFrame:
    """(sig, side, fp): both halves, plain (side null) and with each bit a wildcard (side: that bit)."""
    half = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)))
    each = nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("fp", "seg", half.alias("half"))
    variants = F.transform(F.sequence(F.lit(0), F.lit(HALF)), lambda p: F.struct(p.alias("p"), F.when(p < HALF, F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("half"), p))).alias("side")))
    wide = each.select("fp", "seg", "half", F.explode(variants).alias("x"))
    masked = F.col("half") - F.coalesce(F.call_function("shiftleft", F.col("x.side"), F.col("x.p")), F.lit(0))
    tag = F.call_function("shiftleft", (F.col("seg") * 64 + F.col("x.p")).cast("long"), F.lit(HALF))
    return wide.select((tag + masked).alias("sig"), F.col("x.side").alias("side"), "fp")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join all nodes whose fingerprints differ in at most two bits."""
    if radius != 2:
        raise ValueError("two halves and one wildcard fit a radius of two")
    nodes, path = common.materialise(nodes, "nodes")
    signed = signatures(nodes.repartition(max(1, -(-nodes.count() // NODES)), "fp"))
    # one sum carries two counts: all nodes of a signature, and above bit 32 those with the wildcard bit set
    both = F.sum(F.lit(1).cast("bigint") + F.when(F.col("side") == 1, F.lit(1 << HALF)).otherwise(F.lit(0)))
    n, ones = F.col("c").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftright("c", HALF)
    plain = F.shiftright("sig", HALF).bitwiseAND(F.lit(63)) == HALF
    shared = signed.groupBy("sig").agg(both.alias("c")).where((n > 1) & (plain | ((ones > 0) & (ones < n)))).select(F.col("sig").alias("s"), n.alias("n"))
    shared, _ = common.materialise(shared, "shared")
    if shared.count() <= BROADCAST:
        shared = F.broadcast(shared)
    met, _ = common.materialise(signed.join(shared, F.col("sig") == F.col("s")).select("sig", "side", "fp", "n"), "met")
    few = met.where(F.col("n") <= BUCKET)
    a, b = few.select("sig", F.col("side").alias("sa"), F.col("fp").alias("u")), few.select(F.col("sig").alias("sb_sig"), F.col("side").alias("sb"), F.col("fp").alias("v"))
    near = (F.col("u") > F.col("v")) & (F.col("sa").isNull() | (F.col("sa") != F.col("sb"))) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    pairs = a.join(b, (F.col("sig") == F.col("sb_sig")) & near).select("u", "v")
    many = met.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << p) - (1 << 64 if p == 63 else 0)).cast("long") for p in range(64)])
    points = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("us")).where(F.size("us") > 1)  # 65 at most
    stars = stars.select(F.explode("us").alias("u"), "v").where("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(table: DataFrame) -> DataFrame:
    """(fp, root): for each fingerprint of a materialised table with a column fp, its component's smallest one."""
    nodes = table.select("fp").distinct()
    found = components(links(nodes))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    marked, _ = common.materialise(with_fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")), "fingerprints")
    roots, _ = common.materialise(near_duplicates(marked), "roots")
    total = marked.count()
    first, _ = common.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    least = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = common.materialise(roots.join(least, "root").join(first.select("fp", "n"), "fp").select(F.col("fp").alias("f"), "component_id", (F.col("n") * HOT > total).alias("hot")), "named")
    # fingerprints of more than a thousandth of all rows, of which there are fewer than a thousand, go to every task
    hot = F.broadcast(named.where("hot").select("f", "component_id"))
    on = marked["fp"] == F.col("f")
    few = marked.join(F.broadcast(named.where("hot").select("f")), on, "left_anti").join(named.where("not hot").select("f", "component_id"), on)
    met = marked.join(hot, on).unionByName(few)
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
