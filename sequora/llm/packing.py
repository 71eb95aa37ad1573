"""Best-fit packing: token pieces into as few sequences as possible, by dominance reduction and then best fit.

Pieces differ only by length, so the instance is a histogram of at most ``capacity`` lengths, whatever the corpus.  The
driver packs that histogram in bulk: Martello and Toth's dominance criterion fixes sets of one or two pieces that some
optimal packing holds, as long as it applies; best-fit decreasing packs what is left.  The result is a list of patterns
with multiplicities; every piece then finds its place from its rank among the pieces of its length, which is the
number of such pieces in earlier tasks plus its number in its own.

Defined cases: a null or empty text is the end id alone; repeated rows and null doc_ids are packed like any others; an
empty table gives no row; a document of exactly the capacity is one piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import worker_tokenizer

CAPACITY = 1024
#: Bytes of text that are encoded at once; smaller slices take less memory and more time.
SLICE = 3 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_table(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, at_once: int = SLICE) -> DataFrame:
    """All pieces, with the task that cut them and their rank among its pieces of that length."""

    common.ship(docs.sparkSession)
    def cut(batches):
        tokenizer = worker_tokenizer(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in common.in_slices(batches, limit=at_once):
            ids, counts = tokenizer.encode(batch.column("text"), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(common.starts_of(pieces)[:-1], pieces)
            head = counts - (pieces - 1) * capacity
            length = np.where(piece == 0, head[owner], capacity)
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
            at = common.starts_of(length)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered, side="left")
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part), pa.int32()), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + ", part int, rank long")


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fix sets that dominate all others with the same largest piece: (patterns with multiplicity, what is left).

    With a piece s and r the room beside it, at least one optimal packing holds: s alone, if nothing fits beside it;
    s with a piece of r exactly; s with k, the largest that fits, if no two others fit together, or if no three fit
    and no two that do exceed k.  Taking pieces away never makes such a condition false, so pairs are fixed in bulk.
    """
    left, fixed = counts.copy(), []

    def take(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for size in pattern:
            left[size] -= times

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while left[s]:
                room = capacity - s
                left[s] -= 1
                beside = np.flatnonzero(left[: room + 1])
                some = np.repeat(beside[:3], np.minimum(left[beside[:3]], 3))[:3]
                k = int(beside[-1]) if len(beside) else 0
                single = len(some) < 2 or int(some[0] + some[1]) > room
                if k and k < room and not single and (len(some) < 3 or int(some.sum()) > room):
                    single = best_pair(left, beside, room) <= k
                left[s] += 1
                if not k:
                    take((s,), int(left[s]))
                elif k == room or single:
                    take((s, k) if s >= k else (k, s), int(min(left[s], left[k]) if s != k else left[s] // 2))
                else:
                    break
                changed = True
    return fixed, left


def best_pair(left: np.ndarray, sizes: np.ndarray, room: int) -> int:
    """The largest sum, of at most ``room``, of two pieces."""
    partner = np.searchsorted(sizes, room - sizes, side="right") - 1
    alone = (partner >= 0) & (sizes[partner] == sizes) & (left[sizes] < 2)
    partner = np.where(alone, partner - 1, partner)
    good = partner >= 0
    return int((sizes[good] + sizes[partner[good]]).max(initial=0))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram; bins alike are filled together."""
    open_bins: dict[int, list[list]] = {}
    filled = []

    def put(pattern: tuple[int, ...], room: int, times: int) -> None:
        if room == 0:
            filled.append((pattern, times))
        else:
            open_bins.setdefault(room, []).append([pattern, times])

    for s in range(capacity, 0, -1):
        todo = int(counts[s])
        while todo:
            room = min((r for r in open_bins if r >= s), default=0)
            pattern, bins = open_bins[room][-1] if room else ((), todo)
            room = room or capacity
            fit = min(room // s, todo)
            times = min(bins, todo // fit)
            if pattern:
                group = open_bins[room]
                group[-1][1] -= times
                if not group[-1][1]:
                    group.pop()
                if not group:
                    del open_bins[room]
            put((*pattern, *[s] * fit), room - fit * s, times)
            todo -= fit * times
    return filled + [(p, n) for group in open_bins.values() for p, n in group]


def plan(counts: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, pieces a bin, first bin, first offset), by rank."""
    fixed, left = reduce_instance(counts, capacity)
    out: dict[int, list] = {}
    taken, bin_ = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in fixed + best_fit(left, capacity):
        at = 0
        for size in dict.fromkeys(pattern):
            each = pattern.count(size)
            out.setdefault(size, []).append((taken[size], each, bin_, at))
            taken[size] += each * times
            at += each * size
        bin_ += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, at_once: int = SLICE) -> DataFrame:
    """One row a piece with its sequence_id and offset; at_once: bytes of text that are encoded at once."""
    spark = docs.sparkSession
    pieces, _ = common.materialise(piece_table(docs, vocabulary, end_id, capacity, at_once), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[sizes.column("length").to_numpy()] = sizes.column("n").to_numpy()
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = per_task.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("earlier"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("earlier").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[group[0]])
                rows = places.value[size]
                row = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
                inside = rank[group] - row[:, 0]
                sequence[group] = row[:, 2] + inside // row[:, 1]
                offset[group] = row[:, 3] + inside % row[:, 1] * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(earlier, (pieces["part"] == earlier["p"]) & (pieces["length"] == earlier["l"])).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "earlier")
    return joined.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op6(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), 2)
