"""PII: pattern entities, and information-theoretic sanitisation of the terms that give them away.

Protected entities are the distinct values that the patterns find.  A term is a run of letters and digits outside all
entities, lower-cased where that keeps the text's length.  With N distinct texts, c(x) of them that hold x, and c(t, e) those
that hold both, a term reveals of an entity the pointwise mutual information log2(N c(t, e) / (c(t) c(e))), of at most
the entity's own information log2(N / c(e)).  Terms that ``SUPPORT`` texts or more hold together with the entity are
disclosing if that share reaches ``GENERALISE``: every place of theirs, in whichever text, gets a general mark, and from
``REMOVE`` on nothing is left of it.  Exact copies count once, near copies do not.  All counts are over whole texts of
all documents; entities of a single text have no evidence beyond it, and are left to the patterns.

Defined cases: a null or empty text has no span; rows alike in doc_id and text are rows of their own with equal spans;
an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native import let, match_spans, printed

# The kinds in order, and their patterns with possessive loops and run starts so that long runs cost
# linear time; they find the same matches.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
TERM = r"[\p{L}\p{N}]+"
MARK = "[TERM]"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + doubled

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def entity_spans(text: Column) -> Column:
    """All base spans as (ord, start, stop, kind, value), sorted."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n_digits = lambda s: F.length(digits(s))
    found = (
        match_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(match_spans(text, IP), lambda s: s["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
        F.filter(match_spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda s: n_digits(s).between(16, 19) & F.when(n_digits(s).between(16, 19), let(digits(s), luhn)).otherwise(False)),
        F.filter(match_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: n_digits(s).between(8, 15)),
    )
    return F.sort_array(F.concat(*[_labelled(f, i, k) for i, (k, f) in enumerate(zip(KINDS, found, strict=True))]))


def _labelled(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("ord"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def masked(text: Column, base: Column) -> Column:
    """The text with blanks where spans are, every other character in its place."""
    by_place = F.sort_array(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))

    def blank(acc: Column, b: Column) -> Column:
        begin = F.greatest(acc["at"], b["start"])
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        blanks = F.repeat(F.lit(" "), F.greatest(b["stop"] - begin, F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], gap, blanks).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(by_place, start, blank, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(base) > 0, done).otherwise(text)


def folded(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.when(F.length(low) == F.length(text), low).otherwise(text))


def hashed(docs: DataFrame) -> DataFrame:
    """text_hash and text of every row, null counting as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), entity_spans(text).alias("base"))


def terms_of(text: Column) -> Column:
    """The distinct terms outside a text's entities.  Texts are read again for them: their terms are larger than they are."""
    # texts without a sign that entities need are not looked through for them
    plain = ~F.contains(text, F.lit("@")) & ~F.contains(text, F.lit("+")) & ~text.rlike(r"[0-9](?:[\x20.-]?[0-9]){3}")
    outside = F.when(plain, text).otherwise(let(F.struct(entity_spans(text).alias("base"), text.alias("text")), lambda x: masked(x["text"], x["base"])))
    return F.array_distinct(F.regexp_extract_all(let(outside, folded), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, term_hash, entity, c_te, c_t, c_e, ratio) of all pairs that reach the threshold."""
    n_texts = found.select(F.count_distinct("text_hash").alias("n"))  # one row
    own = F.array_distinct(F.transform("base", lambda b: F.concat(b["kind"], F.lit(":"), F.lower(b["value"]))))
    held = found.where(F.size("base") > 0).select("text_hash", F.explode(own).alias("entity")).distinct()
    c_e = held.groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("c_e")).where(F.col("c_e") >= SUPPORT)
    c_e, _ = common.materialise(c_e, "held")
    # only entities of several texts can have terms; a text's own are gathered beside its terms
    sets = held.join(c_e, F.col("entity") == F.col("e")).groupBy(F.col("text_hash").alias("h")).agg(F.collect_set("entity").alias("entities"))
    texts = hashed(docs).join(common.bounded(sets, "sets", 100_000), F.col("text_hash") == F.col("h")).dropDuplicates(["text_hash"])
    both = texts.select("entities", F.explode(terms_of(F.col("text"))).alias("term")).select("term", F.explode("entities").alias("entity"))
    joint = both.groupBy("entity", "term").agg(F.count("*").alias("c_te")).where(F.col("c_te") >= SUPPORT)
    # a term's texts: its rows, less those by which each copied text is more than one
    copied = common.bounded(found.groupBy(F.col("text_hash").alias("h")).agg((1 - F.count("*")).alias("less")).where("less < 0"), "copied")
    again = hashed(docs).join(copied, F.col("text_hash") == F.col("h")).groupBy("text_hash", "less").agg(F.first("text").alias("text"))
    rows = hashed(docs).select(F.explode(terms_of(F.col("text"))).alias("t"), F.lit(1).cast("long").alias("w"))
    rows = rows.unionByName(again.select(F.explode(terms_of(F.col("text"))).alias("t"), F.col("less").alias("w")))
    # terms go as hashes: 16 bytes a row
    c_t = rows.select(F.xxhash64("t").alias("th"), "w").groupBy("th").agg(F.sum("w").alias("c_t")).where(F.col("c_t") >= SUPPORT)
    met = joint.withColumn("term_hash", F.xxhash64("term")).join(c_e, F.col("entity") == F.col("e")).join(c_t, F.col("term_hash") == F.col("th")).join(F.broadcast(n_texts))
    pmi = F.log2(F.col("n") * F.col("c_te") / (F.col("c_t") * F.col("c_e")))
    most = F.log2(F.col("n") / F.col("c_e"))
    ratio = F.when(most > 0, pmi / F.when(most > 0, most)).otherwise(F.lit(0.0))
    return met.select("term", "term_hash", "entity", "c_te", "c_t", "c_e", ratio.alias("ratio")).where(F.col("ratio") >= GENERALISE)


def places(text: Column, terms: Column) -> Column:
    """Where the terms, structs with a share, stand as whole runs: (start, stop, ratio)."""
    def of(t: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), t["term"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.transform(match_spans(text, pattern), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), t["ratio"].alias("ratio")))

    return F.sort_array(F.flatten(F.transform(terms, of)))


def spans_of(docs: DataFrame) -> DataFrame:
    """A row for each row of the documents: doc_id, text_hash, base, and marks: (start, stop, kind), by place."""
    found, _ = common.materialise(entities(docs), "entities")
    best = common.bounded(disclosing(docs, found).groupBy("term_hash").agg(F.max("ratio").alias("ratio")), "terms")
    each = hashed(docs).select("text_hash", F.explode(terms_of(F.col("text"))).alias("term")).withColumn("th", F.xxhash64("term"))
    hits = each.join(best, F.col("th") == F.col("term_hash")).select("text_hash", "term", "ratio").distinct()
    own = common.bounded(hits.groupBy(F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("term", "ratio")).alias("own")), "hits", 100_000)  # a text's own terms
    texts = hashed(docs).join(own, F.col("text_hash") == F.col("h")).dropDuplicates(["text_hash"])
    placed = texts.select(F.col("text_hash").alias("p_hash"), places(F.col("text"), F.col("own")).alias("placed"))
    rows = found.select("doc_id", "text_hash", "base").join(placed, F.col("text_hash") == F.col("p_hash"), "left")
    free = F.filter("placed", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    kind = lambda t: F.when(t["ratio"] >= REMOVE, "remove").otherwise("generalise")
    marks = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), kind(t).alias("kind")))
    return rows.select("doc_id", "text_hash", "base", F.coalesce(marks, F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")).alias("marks"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and sanitised text: entities become their kind in brackets, disclosing terms a general mark or nothing."""
    changed = spans_of(docs).where((F.size("base") > 0) | (F.size("marks") > 0)).select("text_hash", "base", "marks").dropDuplicates(["text_hash"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).join(changed, F.col("h") == F.col("text_hash"), "left")
    put_in = lambda start, stop, mark: F.struct(start.alias("start"), stop.alias("stop"), mark.alias("mark"))
    spans = F.sort_array(F.concat(
        F.transform("base", lambda b: put_in(b["start"], b["stop"], F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")))),
        F.transform("marks", lambda t: put_in(t["start"], t["stop"], F.when(t["kind"] == "remove", "").otherwise(MARK))),
    ))

    def put(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]  # of overlapping spans the first is replaced, with the rest of the others
        gap = F.when(fresh, F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))).otherwise("")
        return F.struct(F.greatest(acc["at"], m["stop"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, m["mark"]).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return met.select("doc_id", F.coalesce(done, "text").alias("text"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(common.table(spark, sf_dir, "documents"))
    base = printed("base")
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.array_join(F.filter(F.array(base, printed("marks")), lambda s: s != ""), ",")
    actions = [F.size(_of_kind(F.col("marks"), k)).cast("long").alias(f"n_{k}") for k in ("generalise", "remove")]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"), *actions)
