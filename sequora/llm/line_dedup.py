"""Line dedup by distinct-site spread: lines that many sites share stay in one document only.

A line counts without spaces, tabs and returns at its ends, if it has a word.  Sites are the documents' sources.  A line
of ``MIN_SITES`` sites is boilerplate, one of fewer than ``FEW_WORDS`` words, which may be ordinary prose, from
``SHORT_SITES`` on: it is taken out of every document but the one with the smallest doc_id.

A HyperLogLog sketch of each line's sites is kept as rows of its non-empty registers, so it is built and merged by plain
aggregation: max(rank) by (line, register).  A line has no fewer sites than full registers, so enough of these, or an
estimate of over twice the threshold, decide; of the others those estimated at a quarter of it or more have their sites
counted exactly.  A line of enough sites is estimated at less with a probability under 1e-9.

Decisions of up to ``SHARED`` lines are broadcast, after their count is known, and applied to whole texts; more are
joined to the lines instead, with the same result.

Defined cases: a null text stays null and has no line; a null source is one site of its own; a null doc_id is the
largest; documents with the smallest doc_id all keep the line if they repeat; lines are cut at \\n only; an empty table
gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native import let

MIN_SITES = 5
FEW_WORDS = 3
SHORT_SITES = 10
#: Registers of a sketch are 2 to this power.
PRECISION = 8
SHARED = 500_000
#: Lines to be counted that are broadcast at most, of 32 bytes.
NEAR = 100_000
LAST = (1 << 63) - 1


_MANY = r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}" % (FEW_WORDS - 1)


def lines_of(docs: DataFrame, *kept: str) -> DataFrame:
    """Lines that count, by two hashes and whether they are short, with the columns kept of their documents."""
    cut = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    full = F.filter(cut, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(*kept, F.explode(full).alias("line")).select(F.xxhash64("line").alias("h1"), F.crc32("line").alias("h2"), (~F.col("line").rlike(_MANY)).alias("short"), *kept)


def site_hash():
    return F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\x00null")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> DataFrame:
    """(h1, h2, first): the lines of enough sites, and the smallest doc_id that holds each."""
    m = 1 << PRECISION
    register = F.shiftrightunsigned(F.col("site"), 64 - PRECISION)
    bits = F.length(F.bin(F.shiftrightunsigned(F.shiftleft(F.col("site"), PRECISION), PRECISION)))
    rank = F.when(F.shiftleft(F.col("site"), PRECISION) == 0, 64 - PRECISION + 1).otherwise(64 - PRECISION - bits + 1)
    sites = docs.select("doc_id", "text", site_hash().alias("site")).withColumns({"register": register.cast("int"), "rank": rank, "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))})
    rows = lines_of(sites.select("text", "register", "rank", "id"), "register", "rank", "id")
    registers = rows.groupBy("h1", "h2", "short", "register").agg(F.max("rank").alias("rank"), F.min("id").alias("first"))
    sketch = registers.groupBy("h1", "h2", "short").agg(F.count("*").alias("full"), F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))).alias("z"), F.min("first").alias("first"))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("z") + (m - F.col("full")))
    estimate = F.when((raw <= 2.5 * m) & (F.col("full") < m), m * F.log(m / (m - F.col("full").cast("double")).cast("double"))).otherwise(raw)
    need = F.when(F.col("short"), short_sites).otherwise(min_sites).cast("long")
    likely, _ = common.materialise(sketch.select("h1", "h2", "first", "full", need.alias("need"), estimate.alias("sites")).where((F.col("sites") >= F.col("need") / 4) | (F.col("full") >= F.col("need"))), "lines")
    sure = (F.col("full") >= F.col("need")) | (F.col("sites") > 2 * F.col("need"))
    every = lines_of(docs.select("text", site_hash().alias("site")), "site")
    a = likely.where(~sure).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "first", "need")
    if a.count() <= NEAR:
        a = F.broadcast(a)
    else:  # a line on many pages is one row a site before it meets the others
        every = every.select("h1", "h2", "site").distinct()
    near = every.join(a, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))).select("h1", "h2", "first", "need", "site").distinct()
    exact = near.groupBy("h1", "h2", "first", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("need"))
    return likely.where(sure).select("h1", "h2", "first").unionByName(exact.select("h1", "h2", "first"))


def _cleaner(known: dict[int, tuple[int, int]]):
    from xxhash import xxh64_intdigest

    def clean(text: str | None, doc_id: int | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        lines, kept = text.split("\n"), []
        me = LAST if doc_id is None else doc_id
        for line in lines:
            own = line.strip(" \t\r").encode()
            h1 = xxh64_intdigest(own, 42)
            if h1 in known and known[h1][0] == zlib.crc32(own) and known[h1][1] != me:
                continue
            kept.append(line)
        return (text if len(kept) == len(lines) else "\n".join(kept)), len(lines), len(lines) - len(kept)

    return clean


NAMES = ("ld_text", "ld_lines", "ld_removed")


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, shared: int = SHARED, names=NAMES) -> DataFrame:
    """The documents without boilerplate lines: all columns but text as they were, then those of the names: text, lines, lines removed."""
    spark = docs.sparkSession
    found, _ = common.materialise(boilerplate(docs, min_sites, short_sites), "boilerplate")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    if found.count() > shared:
        return _clean_by_join(docs, found, others, names)
    rows = found.toArrow()
    hashes = [rows.column(c).to_numpy() for c in ("h1", "h2", "first")]
    known = spark.sparkContext.broadcast([hashes[0].view(np.uint64), *hashes[1:]])

    def rows_of(batches):
        common.hold()
        clean = _cleaner({int(a): (int(b), int(c)) for a, b, c in zip(*known.value, strict=True)})
        for batch in common.in_slices(batches):
            texts, ids = batch.columns[-2:]
            out = [clean(t, i) for t, i in zip(texts.to_pylist(), ids.to_pylist(), strict=True)]
            text, lines, removed = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(text, texts.type), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*batch.schema.names[:-2], *names])

    chosen = docs.select(*others, F.col("text").cast("string").alias(names[0]), F.col("doc_id").cast("long").alias(names[1]))
    schema = "".join(f"`{c}` {t}, " for c, t in chosen.dtypes[:-2])
    return chosen.mapInArrow(rows_of, f"{schema}`{names[0]}` string, `{names[1]}` long, `{names[2]}` long")


def _clean_by_join(docs: DataFrame, found: DataFrame, others: list, names) -> DataFrame:
    cut = F.split(F.col("text").cast("string"), "\n", -1)
    me = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    key = docs.select(me.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.posexplode(cut).alias("at", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r"))
    places = key.select("id", "th", "at", F.xxhash64(trimmed).alias("l1"), F.crc32(trimmed).alias("l2")).where(trimmed.rlike(r"[^\x20\x09-\x0D]"))
    hit = places.join(found, (F.col("l1") == F.col("h1")) & (F.col("l2") == F.col("h2")) & (F.col("id") != F.col("first")))
    i, th, gone = (common.free_name(docs.columns, c) for c in ("hit_id", "hit_text", "hit_lines"))
    per_text = hit.groupBy(F.col("id").alias(i), F.col("th").alias(th)).agg(F.collect_set("at").alias(gone))  # a text's own lines
    rows = docs.join(per_text, (me == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th)), "left")
    kept = let(F.struct(cut.alias("cut"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone")), lambda x: F.array_join(F.filter(x["cut"], lambda _, i: ~F.array_contains(x["gone"], i)), "\n"))
    return rows.select(*others, F.when(F.col("text").isNotNull(), kept).alias(names[0]), F.when(F.col("text").isNotNull(), F.size(cut)).otherwise(0).cast("long").alias(names[1]), F.when(F.col(gone).isNotNull(), F.size(gone)).otherwise(0).cast("long").alias(names[2]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.col("ld_text").alias("text"))


OP8_SQL = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null
), counted as (
  select *, trim(line, ' ' || chr(9) || chr(13)) as own, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as counts,
    regexp_matches(line, '[^\\x20\\x09-\\x0D]+([\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+){{{FEW_WORDS - 1}}}') as many
  from lines
), boilerplate as (
  select own, min(coalesce(doc_id, {LAST})) as first from counted where counts
  group by own having count(distinct coalesce(source, chr(1) || 'null')) >= max(case when many then {MIN_SITES} else {SHORT_SITES} end)
), kept as (
  select c.doc_id, c.pos, c.line, (c.counts and b.own is not null and b.first <> coalesce(c.doc_id, {LAST})) as gone
  from counted c left join boilerplate b on c.own = b.own
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
from kept group by doc_id
union all select doc_id, 0, 0, null from documents where text is null
"""
