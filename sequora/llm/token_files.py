"""Token-id files: canonical length-limited Huffman coding from global counts, decoded by table in independent blocks.

Steps: texts become ids once (written to the shared folder); global counts, at most one row a vocabulary entry, give
code lengths by package-merge; each document becomes a byte-aligned bit stream whose blocks of ``BLOCK`` ids have
bit-offset checkpoints; streams are dealt to shards by ranges of doc_id, of the row within it, that hold about as many
ids each, and joined into containers in ascending order.  A container is one row of a table: Spark's writers are all that reaches every store.

Container bytes, little-endian: magic ``SQT1``; uint32 documents, uint32 block size; uint64 tokens; then for each
document int64 doc_id, uint8 flag (1: the id is null), uint32 tokens, uint32 stream bytes; then uint32 bit offsets of
all blocks within their document's stream; then the streams, bits most significant first.

Defined cases: a null or empty text holds the end id alone; rows with a null doc_id come first; rows that share a
doc_id keep their own streams, in the order of the table's parts; an empty table gives no container.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import worker_tokenizer

#: Parts that a worker remembers: encoding is most of the work here.
PARTS = 600_000
BLOCK = 512
MAX_BITS = 18
CONTAINER_TOKENS = 1 << 20
#: Ids of a shard, about; beyond ``SHARDS`` shards they grow instead.
SHARD_TOKENS = 1 << 22
SHARDS = 10_000
#: Rows sampled a shard to find where it ends.
SAMPLED = 64
FIRST = -(1 << 63)
MAGIC = b"SQT1"
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u4"), ("bytes", "<u4")])


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (0: the symbol doesn't occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    is_symbol, level = [], weights
    for bit in range(limit):
        is_symbol.append(np.ones(len(level), bool) if bit == 0 else own)  # noqa: F821
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        order = np.argsort(merged, kind="stable")
        level, own = merged[order], order < len(weights)  # noqa: F841
    taken, found = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for own in reversed(is_symbol):
        symbols = int(own[:taken].sum())
        found[:symbols] += 1
        taken = 2 * (taken - symbols)
    lengths[used] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of every symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[lengths[order] > 0]:
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """For each window of ``bits`` bits: symbol << 5 | length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, bits - lengths[order].astype(np.int64))
    table = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32), spans)
    return np.concatenate([table, np.zeros((1 << bits) - len(table), np.uint32)])


def encode_streams(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """The bit stream of each document, and the bit offsets of its blocks."""
    if not len(ids):
        return [b""] * len(counts), [np.zeros(0, np.uint32)] * len(counts)
    each = lengths[ids].astype(np.int64)
    ends = common.starts_of(each)
    first = common.starts_of(counts)
    stream_bytes = (ends[first[1:]] - ends[first[:-1]] + 7) // 8
    base = common.starts_of(stream_bytes)
    at = ends[:-1] + np.repeat(base[:-1] * 8 - ends[first[:-1]], counts)
    word, shift = at >> 5, at & 31
    value = codes[ids].astype(np.uint64) << (64 - shift - each).astype(np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    joined = np.bitwise_or.reduceat(value, starts)
    words = np.zeros(int(base[-1] // 4 + 3), np.uint32)
    words[word[starts]] = (joined >> np.uint64(32)).astype(np.uint32)
    words[word[starts] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = words.astype(">u4").tobytes()
    streams = [data[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
    marks = [(at[a:b:BLOCK] - o * 8).astype(np.uint32) for a, b, o in zip(first[:-1], first[1:], base[:-1], strict=True)]
    return streams, marks


def pack_container(docs: np.ndarray, marks: list[bytes], streams: list[bytes]) -> bytes:
    head = MAGIC + struct.pack("<IIQ", len(docs), BLOCK, int(docs["tokens"].sum()))
    return b"".join([head, docs.tobytes(), *marks, *streams])


def decode_container(data: bytes, table: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(documents, flat ids): all blocks are decoded side by side, each from its own checkpoint."""
    if data[:4] != MAGIC:
        raise ValueError("not a token container")
    n, block, total = struct.unpack_from("<IIQ", data, 4)
    docs = np.frombuffer(data, _DOC, n, 20)
    blocks = -(-docs["tokens"].astype(np.int64) // block)
    at = 20 + n * _DOC.itemsize
    offsets = np.frombuffer(data, "<u4", int(blocks.sum()), at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=at + 4 * len(offsets))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    base = common.starts_of(docs["bytes"].astype(np.int64))[:-1]
    position = offsets + np.repeat(base * 8, blocks)
    number = np.arange(len(offsets)) - np.repeat(common.starts_of(blocks)[:-1], blocks)
    left = np.minimum(block, np.repeat(docs["tokens"].astype(np.int64), blocks) - number * block)
    goal = common.starts_of(left)[:-1]
    order = np.argsort(-left, kind="stable")
    position, goal, left = position[order], goal[order], left[order]
    out = np.zeros(int(total), np.uint32)
    alive = len(left) - np.searchsorted(left[::-1], np.arange(block), side="right")
    for step in range(block):
        k = int(alive[step])
        if not k:
            break
        p = position[:k]
        found = table[(window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - bits)]
        out[goal[:k] + step] = found >> np.uint32(5)
        p += (found & np.uint32(31)).astype(np.int64)
    return docs, out


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, row (a number of its own), n_tokens and ids (unsigned, little-endian, 16 bits where the vocabulary allows, else 32)."""

    common.ship(docs.sparkSession)
    def encode(batches):
        tokenizer = worker_tokenizer(vocabulary, PARTS)
        kind = np.dtype("<u2" if max(tokenizer.size, end_id + 1) <= 1 << 16 else "<u4")
        row = TaskContext.get().partitionId() << 40
        for batch in common.in_slices(batches):
            ids, counts = tokenizer.encode(batch.column("text"), end_id)
            ids = ids.astype(kind)
            offsets = (common.starts_of(counts) * kind.itemsize).astype(np.int32)
            numbers = pa.array(np.arange(row, row + len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), numbers, pa.array(counts), pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])], ["doc_id", "row", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, row long, n_tokens long, ids binary")


def _ids_of(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u2" if len(raw) == 2 * counts.sum() else "<u4")


def global_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; each task sends at most one row an id."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ids_of(batch.column("ids"), batch.column("n_tokens").to_numpy()), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = tokens.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def shard_edges(tokens: DataFrame, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The (doc_id, row) after which each shard but the last ends, from a sample in which ids are equally likely."""
    if shards < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = F.col("n_tokens") * (SAMPLED * shards / total)
    chance = F.shiftrightunsigned(F.xxhash64("row"), 1) / float(1 << 63)
    # at most about SAMPLED rows a shard; a null id comes before all others
    rows = tokens.where(chance < share).select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), "row").toArrow()
    ids, numbers = rows.column("doc_id").to_numpy(), rows.column("row").to_numpy()
    order = np.lexsort((numbers, ids))
    at = order[(np.arange(1, shards) * len(order)) // shards] if len(order) else order
    return ids[at], numbers[at]


def shard_of(ids: np.ndarray, numbers: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many edges lie before each (doc_id, row)."""
    low = np.searchsorted(edges[0], ids, side="left")
    high = np.searchsorted(edges[0], ids, side="right")
    for i in np.flatnonzero(high > low):  # edges within one doc_id
        low[i] += np.searchsorted(edges[1][low[i] : high[i]], numbers[i], side="left")
    return low


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> np.ndarray:
    """Write all documents' ids to ``path`` in ascending doc_id order; returns the code lengths that readers need."""
    spark = docs.sparkSession
    tokens, scratch = common.materialise(token_table(docs, vocabulary, end_id), "ids")
    size = max(worker_tokenizer(vocabulary).size, end_id + 1)
    counts = global_counts(tokens, size)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    total = int(counts.sum())
    shards = min(SHARDS, max(1, -(-total // SHARD_TOKENS)))
    edges = shard_edges(tokens, total, shards)

    def encode(batches):
        for batch in common.in_slices(batches, 2000, 1 << 20):
            n = batch.column("n_tokens").to_numpy()
            streams, marks = encode_streams(_ids_of(batch.column("ids"), n), n, lengths, codes)
            shard = shard_of(batch.column("doc_id").fill_null(FIRST).to_numpy(), batch.column("row").to_numpy(), edges)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("doc_id"), batch.column("row"), batch.column("n_tokens"), pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(streams, pa.binary())], ["shard", "doc_id", "row", "n_tokens", "marks", "stream"])

    def join(batches):
        shard, start, rows, size_now = None, 0, [], 0

        def flush():
            nonlocal rows, size_now, start
            docs_ = np.array([(r[0] or 0, r[0] is None, r[1], len(r[3])) for r in rows], _DOC)
            data = pack_container(docs_, [r[2] for r in rows], [r[3] for r in rows])
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([start]), pa.array([size_now]), pa.array([data], pa.binary())], ["shard", "start", "n_tokens", "data"])
            start, rows, size_now = start + size_now, [], 0
            return out

        for batch in common.in_slices(batches, 2000):
            columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "marks", "stream")]
            for s, *row in zip(*columns, strict=True):
                if rows and (s != shard or size_now >= CONTAINER_TOKENS):
                    yield flush()
                if s != shard:
                    shard, start = s, 0
                rows.append(row)
                size_now += row[1]
        if rows:
            yield flush()

    coded = tokens.mapInArrow(encode, "shard int, doc_id long, row long, n_tokens long, marks binary, stream binary")
    ordered = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "row")
    ordered.drop("row").mapInArrow(join, "shard int, start long, n_tokens long, data binary").write.option("compression", "none").parquet(path)
    common.drop_path(spark, scratch)
    return lengths


def read_token_files(spark: SparkSession, path: str, lengths: np.ndarray) -> DataFrame:
    """Decode every container: doc_id, start, n_tokens, ids_crc32, n_blocks."""
    table = spark.sparkContext.broadcast(decode_table(lengths))

    def decode(batches):
        for batch in batches:
            for shard_start, start, data in zip(batch.column("shard_start").to_pylist(), batch.column("start").to_pylist(), batch.column("data"), strict=True):
                docs, ids = decode_container(data.as_py(), table.value)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = common.starts_of(docs["tokens"].astype(np.int64))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"] == 1), pa.array(first[:-1] + start + shard_start), pa.array(docs["tokens"].astype(np.int64)), pa.array(crc, pa.int64()), pa.array(-(-docs["tokens"].astype(np.int64) // BLOCK))], ["doc_id", "start", "n_tokens", "ids_crc32", "n_blocks"])

    files = spark.read.schema("shard int, start long, n_tokens long, data binary").parquet(path)
    # a row a shard, of which there are at most SHARDS: small enough for one task's window and for a broadcast
    before = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    return files.join(F.broadcast(before), files["shard"] == before["s"]).select("shard_start", "start", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, n_blocks long")


def op1(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    lengths = write_token_files(common.table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"), 1, path)
    return read_token_files(spark, path, lengths)
