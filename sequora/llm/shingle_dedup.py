"""Operator 10 for shingle sets: near-duplicates by the Jaccard similarity of distinct five-word shingles, 0.8 or more.

SimHash nominates: wide fingerprints of the shingle sets are met by deletion-variant signatures of their segments, as
``simhash_dedup.wide_links`` has it, where a pair of 0.8 is missed with 3e-5.  Equal shingle sets are one node from the
start, and sets of fewer than ``FEWEST`` shingles are similar to equal ones alone.  Nodes that are linked, directly or
through others, make a cluster, and similar sets are found in clusters exactly.

A cluster is dealt into blocks of about ``TOKENS`` shingles, and each pair of blocks is a group of its own, so memory
stays bounded; a group returns the links of a spanning forest, never all pairs.

Defined cases: a text of fewer words has one shingle; null and empty texts have none and are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash_dedup import mixed, wide_fingerprint, wide_links

WIDTH = 5
SIMILAR = (4, 5)  # a fraction, so that the comparison is exact
#: Different sets are similar only if they have five shingles together and share four.
FEWEST = 4
TOKENS = 200_000
#: Clusters of more shingles than ``SMALL`` are dealt into up to ``SPLIT`` blocks at any rate, so that they don't fill one task.
SMALL, SPLIT = 50_000, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    from xxhash import xxh64_intdigest

    codes, words, counts = common.split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.array([xxh64_intdigest(w, 42) for w in words.to_pylist()], np.uint64)[codes]
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + hashes[k : len(hashes) - width + 1 + k] if len(rolled) else rolled
    rolled = mixed(rolled)
    for at, n in zip(common.starts_of(counts), counts):
        if n >= width:
            yield np.unique(rolled[at : at + n - width + 1])
        else:
            own = np.zeros(min(n, 1), np.uint64)
            for h in hashes[at : at + n]:
                own = own * _STEP + h
            yield mixed(own + np.uint64(n))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(common.starts_of(np.array([len(a) for a in arrays], np.int64)), pa.int32()), pa.array(flat))


def _digest(tokens: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(tokens.tobytes(), 42) if len(tokens) else 0


def with_sets(docs: DataFrame, *kept: Column, tokens: bool = False) -> DataFrame:
    """The columns kept, fp (equal for equal sets), size, and sets: the wide fingerprint, or the hashes themselves."""

    def rows(batches):
        common.hold()
        for batch in common.in_slices(batches):
            found = list(shingle_sets(batch.column("fp_text")))
            prints = np.array([_digest(t) for t in found], np.uint64).view(np.int64)
            sizes = np.array([len(t) for t in found], np.int64)
            lists = _lists(found if tokens else [wide_fingerprint(t) for t in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints), pa.array(sizes), lists], [*batch.schema.names[:-1], "fp", "size", "sets"])

    common.ship(docs.sparkSession)
    chosen = docs.select(*kept, F.col("text").cast("string").alias("fp_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[:-1])
    return chosen.mapInArrow(rows, f"{schema}{', ' if schema else ''}fp long, size long, sets array<long>")


def similar(prints: np.ndarray, offsets: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of similar sets.

    Sets at 0.8 share one of the rarest shingles of either: of n shingles, any n - ceil(0.8 n) + 1.  So each set enters
    its rarest ones into an index; a search from a set meets those not reached yet through it and compares them whole.
    """
    sizes, n = np.diff(offsets), len(prints)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    token = token[np.lexsort((token, owner))]  # each set's rarest first
    rare = sizes - -(-SIMILAR[0] * sizes // SIMILAR[1]) + 1
    chosen = np.arange(len(token)) - offsets[:-1][owner] < rare[owner]
    keys, nodes = token[chosen], owner[chosen]
    order = np.argsort(keys, kind="stable")
    nodes = nodes[order]
    begin = np.searchsorted(keys[order], np.arange(len(often) + 1))
    fresh, mark, links = np.ones(n, bool), np.zeros(len(often), np.int64), []
    for seed in range(n):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            mine = token[offsets[i] : offsets[i + 1]]
            lists = [nodes[begin[t] : begin[t + 1]] for t in mine[: rare[i]].tolist()]
            met = np.concatenate(lists) if lists else nodes[:0]
            met = np.unique(met[fresh[met]])
            met = met[(SIMILAR[1] * sizes[met] >= SIMILAR[0] * sizes[i]) & (SIMILAR[0] * sizes[met] <= SIMILAR[1] * sizes[i])]
            if not len(met):
                continue
            mark[mine] = 1
            ends = np.cumsum(sizes[met])
            at = np.arange(ends[-1]) + np.repeat(offsets[met] - ends + sizes[met], sizes[met])
            both = np.add.reduceat(mark[token[at]], ends - sizes[met])
            mark[mine] = 0
            near = met[SIMILAR[1] * both >= SIMILAR[0] * (sizes[i] + sizes[met] - both)]
            fresh[near] = False
            queue += near.tolist()
            links += [(int(prints[i]), int(prints[j])) for j in near]
    return links


def _compare(table: pa.Table) -> pa.Table:
    sets = table.column("sets").combine_chunks()
    offsets = sets.offsets.to_numpy().astype(np.int64)
    flat = sets.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    links = similar(table.column("fp").to_numpy(), offsets - offsets[0], flat)
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def near_duplicates(docs: DataFrame, marked: DataFrame, id_: Column, row: Column) -> DataFrame:
    """(fp, root): for each set of a materialised table (id, row, fp, size, sets), its component's smallest fp.

    docs: the texts again, of which one a set is read for the sets in clusters; id_ and row name its rows.
    """
    # one row a set: the row that names it, and its fingerprint
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "size")
    nodes, _ = common.materialise(marked.groupBy("fp").agg(F.min(order).alias("x"), F.first("sets").alias("sets")), "nodes")
    links = wide_links(nodes.where(F.col("x.size") >= FEWEST).select("fp", "x.size", F.col("sets").alias("prints")))
    clusters, _ = common.materialise(components(links), "clusters")
    members, _ = common.materialise(nodes.join(clusters, F.col("fp") == F.col("node")).select("x.*", "root", F.col("fp").alias("node")), "members")
    total = F.sum("size")
    parts = F.greatest(F.ceil(total / TOKENS), F.least(F.lit(SPLIT), F.ceil(total / SMALL)))
    blocks = members.groupBy("root").agg(parts.cast("int").alias("blocks")).withColumnRenamed("root", "r")
    placed = members.join(blocks, F.col("root") == F.col("r")).select("id", F.col("row").alias("m_row"), "root", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    placed = common.bounded(placed, "placed")  # broadcast where it can be, so that no text is shuffled
    read = docs.select(id_.alias("d_id"), row.alias("d_row"), "text").join(placed, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_row") == F.col("m_row")))
    found, _ = common.materialise(with_sets(read, F.col("root"), F.col("blocks"), F.col("block"), tokens=True), "sets")
    found = found.dropDuplicates(["root", "fp"]) if found.groupBy("fp").count().where("count > 1").limit(1).count() else found
    # a pair of blocks is searched as a whole, so a block alone is a group only where it is the cluster
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("block")))
    each = found.select("root", "fp", "block", "sets", F.explode(others).alias("other"))
    groups = each.groupBy("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    roots = components(groups.applyInArrow(_compare, "u long, v long"))
    return nodes.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last; then by the row's hash), all its columns kept."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    id_ = F.col("doc_id").cast("long")
    marked, _ = common.materialise(with_sets(docs, id_.alias("id"), row_hash.alias("row")), "shingles")
    roots = near_duplicates(docs, marked, id_, row_hash).select(F.col("fp").alias("f"), "root")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # copies are one row each before they meet their component
    first = marked.groupBy("fp").agg(F.min(order).alias("first"))
    best = first.join(roots, F.col("fp") == F.col("f")).groupBy("root").agg(F.min("first").alias("best"))
    c_id, c_row = common.free_name(docs.columns, "chosen_id"), common.free_name(docs.columns, "chosen_row")
    chosen, _ = common.materialise(best.select(F.col("best.id").alias(c_id), F.col("best.row").alias(c_row)), "chosen")
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(c_id)) & (row_hash == F.col(c_row)), "left_semi")
    again = marked.groupBy("id", "row").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates() if again else kept
