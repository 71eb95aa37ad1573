"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact weighted-shingle check.

Words are cut at white space, lower-cased and stripped of all but letters and digits.  A window has as many words as
the item (or all words of a shorter text); its shingles are runs of five words, or the whole of a shorter item.  The
k-th occurrence of a shingle in a window is a feature of its own, so the weighted Jaccard similarity of shingle counts
is the plain one of features, and repeated words don't make a fingerprint lean on one shingle.

Every window of every text gets a 64-bit SimHash for each length that items have, as a difference of running sums.
Those in which a shingle repeats, which running sums don't serve, are all verified.  Fingerprints are cut into four blocks of 16 bits; an item is entered in each block's table under every value
within ``RADIUS // 4`` bits, so the tables miss no fingerprint within ``RADIUS`` bits.  Windows so met that hold enough
known shingles are compared by Hamming distance, and what stays is verified by exact shingle counts and stays from
``SIMILARITY`` on.

A window of the item's size at a similarity of 0.8 shares 8 of 9 features, so a bit differs with probability
arccos(8/9) / pi = 0.152; more than ``RADIUS`` of 64 differ with probability 1.1e-5, and less at a higher similarity.

Items come to the executors in blocks of at most ``BLOCK_WORDS`` words and ``BLOCK_LENGTHS`` lengths, each block a pass
over the documents.

Defined cases: null and empty texts and items match nothing, nor do items without letters or digits; repeated
documents and items each have rows; with ties in similarity the first window is named; empty tables give no row.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCK_WORDS = 2_000_000
BLOCK_LENGTHS = 256
#: Bytes of text that a worker slides over at a time, so that its sums stay near the processor.
SLICE = 1 << 20
#: Short words of other than ASCII letters and digits that a worker remembers the hashes of.
WORDS = 300_000
#: Windows whose fingerprints are made at once.
RUN = 32768
_NOISE = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def clean(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else _NOISE.sub("", low)


_hashes: dict[str, int] = {}


def hash_words(words: pa.Array) -> np.ndarray:
    """A hash of each cleaned word, zero for words without letters and digits.

    Plain ASCII words only need their case lowered; of the others a worker remembers ``WORDS``.
    """
    from xxhash import xxh64_intdigest

    if len(_hashes) > WORDS:
        _hashes.clear()
    plain = pc.ascii_is_alnum(words).to_numpy(zero_copy_only=False).astype(bool)
    out = np.fromiter(map(xxh64_intdigest, pc.ascii_lower(words).to_numpy(zero_copy_only=False)), np.uint64, len(words))
    out[out == 0] = 1
    rest = np.flatnonzero(~plain)
    others = words.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
    found = list(map(_hashes.get, others))
    for at, h in enumerate(found):
        if h is None:
            w = others[at]
            h = (xxh64_intdigest(c) or 1) if (c := clean(w)) else 0
            if len(w) <= 32:
                _hashes[w] = h
            found[at] = h
    out[rest] = np.array(found, np.uint64)
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + words[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def feature_hashes(shingles: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """The hash of each shingle's k-th occurrence; of the first it is the shingle's own."""
    mixed = (shingles ^ (occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _BASE
    return np.where(occurrence == 1, shingles, mixed ^ (mixed >> np.uint64(32)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each hash."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _running(bits: np.ndarray, kind) -> np.ndarray:
    """Sums of the rows before each row, and of all; in bytes they go by eights, 32 rows at a time, as no sum passes 255 there."""
    n = len(bits)
    out = np.empty((n + 1, 64), kind)
    out[0] = 0
    whole = n // 32 * 32 if kind is np.uint8 else 0
    if whole:
        inner = np.cumsum(bits[:whole].view(np.uint64).reshape(-1, 32, 8), axis=1).view(np.uint8).reshape(-1, 32, 64)
        before = np.zeros((len(inner), 1, 64), np.uint8)
        np.cumsum(inner[:-1, -1], axis=0, dtype=np.uint8, out=before[1:, 0])
        np.add(inner, before, out=out[1 : whole + 1].reshape(-1, 32, 64))
    if whole < n:
        rest = np.cumsum(bits[whole:], axis=0, dtype=kind)
        np.add(rest, out[whole], out=out[whole + 1 :])
    return out


def _packed(positive: np.ndarray) -> np.ndarray:
    return np.packbits(positive, bitorder="little").view("<u8")


def _kind(n: int):
    """Running counts wrap around in it without harm: their differences are at most n."""
    return np.uint8 if n <= 255 else np.uint16 if n <= 65535 else np.uint32


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """For each shingle how often it has come so far, itself included."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    out = np.empty(len(shingles), np.int64)
    out[order] = np.arange(len(shingles)) - np.searchsorted(ordered, ordered, side="left") + 1
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a window by itself."""
    ones = _bits(feature_hashes(shingles, occurrences(shingles))).sum(axis=0, dtype=np.int64)
    return int(_packed(2 * ones > len(shingles))[0])


_buffers: dict[str, np.ndarray] = {}


def _buffer(name: str, size: int, kind, width: int = 0) -> np.ndarray:
    """An array that a worker uses again and again: fresh pages cost more than the arithmetic done in them."""
    shape = (max(size, RUN), width) if width else (max(size, RUN),)
    have = _buffers.get(name)
    if have is None or len(have) < size or have.dtype != kind:
        have = _buffers[name] = np.empty(shape, kind)
    return have[:size]


class Windows:
    """The flat shingles of many texts, with the sums that fingerprints of windows without repeats are cut from."""

    def __init__(self, words: np.ndarray, width: int, longest: int):
        """longest: the most shingles of a window."""
        self.shingles = shingle_hashes(words, width)
        self.sums = _running(_bits(self.shingles), _kind(longest))
        # of each shingle the next equal one, by sorting hash and place together; hashes are cut short, so that a few
        # windows more than needed count as repeating, which costs a look at them and nothing else
        size = len(self.shingles)
        bits = np.uint64(max(1, size.bit_length()))
        both = np.sort((self.shingles >> bits << bits) | np.arange(size, dtype=np.uint64))
        places = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        again = np.flatnonzero(both[1:] >> bits == both[:-1] >> bits)
        following = np.full(size, 2 * size, np.int64)
        following[places[again]] = places[again + 1]
        #: The fewest shingles from here on among which two are equal.
        self.repeat = np.minimum(np.minimum.accumulate(following[::-1])[::-1] - np.arange(size) + 1, 1 << 30).astype(np.int32)

    def prints(self, n: int, begin: int, end: int) -> np.ndarray:
        """A fingerprint for each place of a stretch of at most ``RUN``, right where its n shingles differ from each other."""
        differences, positive = _buffer("differences", end - begin, self.sums.dtype, 64), _buffer("positive", end - begin, bool, 64)
        np.subtract(self.sums[begin + n : end + n], self.sums[begin:end], out=differences)
        if n <= 127 and differences.dtype == np.uint8:
            differences = differences.view(np.int8)  # compares faster
        return _packed(np.greater(differences, n // 2, out=positive))


class Items:
    """A block of benchmark items, by words and shingle width."""

    def __init__(self, rows: list[tuple[int, str]]):
        apart = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
        values = np.arange(1 << 16, dtype=np.uint16)
        self.groups: dict[int, dict] = {}
        known: dict[int, list] = {}
        for item_id, text in rows:
            hashes = hash_words(pa.array(text.split(), pa.string()))
            hashes = hashes[hashes > 0]
            if not len(hashes):
                continue
            width = min(WIDTH, len(hashes))
            shingles = shingle_hashes(hashes, width)
            group = self.groups.setdefault(len(hashes), {"width": width, "n": len(shingles), "ids": [], "counts": [], "prints": [], "tables": np.zeros((4, 1 << 16), bool)})
            own = fingerprint(shingles)
            group["ids"].append(item_id)
            group["counts"].append(Counter(shingles.tolist()))
            group["prints"].append(own)
            for block in range(4):
                group["tables"][block] |= apart[values ^ np.uint16(own >> (16 * block) & 0xFFFF)] <= RADIUS // 4
            known.setdefault(width, []).append(shingles)
        self.known = {}
        for width, found in known.items():
            screen = np.zeros(1 << 22, bool)
            screen[np.concatenate(found) & np.uint64((1 << 22) - 1)] = True
            self.known[width] = screen

    @staticmethod
    def tabled(group: dict, prints: np.ndarray) -> np.ndarray:
        """Whether each fingerprint is met in a table; the answer is overwritten by the next."""
        blocks, k = prints.view("<u2").reshape(-1, 4), len(prints)
        met, also, places = _buffer("met", k, bool), _buffer("also", k, bool), _buffer("places", k, np.intp)
        for block in range(4):
            np.copyto(places, blocks[:, block])
            np.take(group["tables"][block], places, out=also if block else met, mode="wrap")  # the fastest; all are within
            if block:
                met |= also
        return met

    @staticmethod
    def near(group: dict, prints: np.ndarray):
        """For each item whether each fingerprint is within the radius."""
        for own in group["prints"]:
            yield np.bitwise_count(prints ^ np.uint64(own)) <= RADIUS

    def search(self, texts: pa.Array):
        """(text's index, its best windows) for each text that has one: (item_id, similarity, distance, first word, words)."""
        index, words, counts = common.split_words(texts.fill_null(""))
        hashes = hash_words(words)[index]
        owner = np.repeat(np.arange(len(counts)), counts)
        full = hashes > 0
        hashes, owner = hashes[full], owner[full]
        sizes = np.bincount(owner, minlength=len(counts))
        first = common.starts_of(sizes)
        left = first[1:][owner] - np.arange(len(owner))  # words from here to the text's end
        best: dict[int, dict[tuple[int, int], tuple]] = {}

        for width, screen in self.known.items():
            if len(hashes) < width:
                continue
            lengths = sorted(k for k, g in self.groups.items() if g["width"] == width)
            windows = Windows(hashes, width, lengths[-1] - width + 1)
            shingles = windows.shingles
            met = common.starts_of(screen[shingles & np.uint64((1 << 22) - 1)].astype(np.int64)).astype(np.uint32)

            def verify(at: np.ndarray, n: np.ndarray, group: dict, length: int, i: int) -> None:
                for a, size in zip(at.tolist(), n.tolist(), strict=True):
                    item = group["counts"][i]
                    own = Counter(shingles[a : a + size].tolist())
                    shared = sum(min(c, item[s]) for s, c in own.items() if s in item)
                    similarity = shared / (size + group["n"] - shared)
                    found = best.setdefault(int(owner[a]), {})
                    if similarity >= SIMILARITY and similarity > found.get((length, i), (0, 0.0))[1]:
                        distance = (fingerprint(shingles[a : a + size]) ^ group["prints"][i]).bit_count()
                        found[length, i] = (group["ids"][i], similarity, distance, int(a - first[owner[a]]), size + width - 1)

            shorter = np.flatnonzero((sizes < lengths[-1]) & (sizes >= width))
            whole = np.array([fingerprint(shingles[first[t] : first[t] + sizes[t] - width + 1]) for t in shorter], np.uint64)
            enough = {length: int(np.ceil(2 * SIMILARITY * self.groups[length]["n"] / (1 + SIMILARITY) - 1e-6)) for length in lengths}
            for begin in range(0, len(shingles), RUN):
                for length in lengths:
                    group = self.groups[length]
                    n = group["n"]
                    end = min(begin + RUN, len(shingles) - n + 1)
                    if end <= begin:
                        continue
                    # of n shingles, so many must be known to some item if the similarity is to be reached
                    promising = met[begin + n : end + n] - met[begin:end] >= enough[length]
                    odd = windows.repeat[begin:end] <= n
                    prints = windows.prints(n, begin, end)
                    met_too = self.tabled(group, prints)
                    met_too |= odd
                    met_too &= promising
                    chosen = np.flatnonzero(met_too)
                    if not len(chosen):
                        continue
                    sure = odd[chosen]
                    for i, close in enumerate(self.near(group, prints[chosen])):
                        at = chosen[close | sure] + begin
                        if len(at):
                            at = at[left[at] >= length]
                            verify(at, np.full(len(at), n), group, length, i)
            for length in lengths:
                group = self.groups[length]
                n = group["n"]
                some = np.flatnonzero((sizes[shorter] < length) & ((sizes[shorter] - width + 1) * 5 >= 4 * n))
                some = some[self.tabled(group, whole[some])]
                for i, close in enumerate(self.near(group, whole[some])) if len(some) else ():
                    chosen = shorter[some[close]]
                    verify(first[chosen], sizes[chosen] - width + 1, group, length, i)
        for text in sorted(t for t, found in best.items() if found):
            yield text, list(best[text].values())


_last: list = [None, None]


def _forget() -> None:
    _last[:] = None, None
    _hashes.clear()
    _buffers.clear()


def items_of(shared) -> "Items":
    """The items of a broadcast block, made once a worker; of other blocks none is kept."""
    common.hold("decontaminate", _forget)
    if _last[0] is not shared.value:
        _last[:] = shared.value, Items(shared.value)
    return _last[1]


def item_blocks(benchmark: DataFrame):
    """The items, a bounded block at a time, those of a length together."""
    block, words, lengths = [], 0, set()
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = F.size(F.split("text", r"\s+"))
    for row in chosen.orderBy(size, "item_id", "text").toLocalIterator():
        own = len(row[1].split())
        if block and (words > BLOCK_WORDS or len(lengths | {own}) > BLOCK_LENGTHS):
            yield block
            block, words, lengths = [], 0, set()
        block.append((row[0], row[1]))
        words += own
        lengths.add(own)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds."""
    schema = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"
    spark, found = docs.sparkSession, None
    common.ship(spark)
    for rows in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(rows)

        def search(batches, shared=shared):
            items = items_of(shared)
            for batch in common.in_slices(batches, limit=SLICE):
                got = [(i, *window) for i, windows in items.search(batch.column("text")) for window in windows]
                columns = list(zip(*got, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], [c.split()[0] for c in schema.split(", ")])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    common.ship(spark)
    text = common.free_name(docs.columns, "leak_text")
    out = docs.select("*", F.col("text").cast("string").alias(text))
    for rows in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(rows)

        def clean_rows(batches, shared=shared):
            items = items_of(shared)
            for batch in common.in_slices(batches, limit=SLICE):
                bad = [i for i, _ in items.search(batch.columns[-1])]
                keep = np.ones(batch.num_rows, bool)
                keep[bad] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean_rows, out.schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

