"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a longest run of 20 or more characters that keys are written with.  Its class (hex, letters and digits,
or base64) sets the threshold.  A window of ``WINDOW`` characters slides over it; the counts of its characters, and
with them the sum of c log2 c, change by the one character that comes and the one that goes.  The stretch from the
first to the last window whose entropy reaches the threshold is a span of kind ``entropy``, unless the allow list
knows the candidate.

Defined cases: a null or empty text has no span and base_sha256 is that of the empty string; rows repeat as they come.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native import let, match_spans, printed, tagged

# The patterns of the base kinds.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character, of at most log2(20) = 4.32.
THRESHOLDS = {"hex": 2.8, "alnum": 3.6, "base64": 3.8}
#: Words only, paths of words, one repeated unit, UUIDs, counting or alphabetical runs, and placeholders.
ALLOWED = r"^[A-Za-z_=-]+$|^[0-9_=-]+$|^(?:[A-Za-z]+[/_-])+[A-Za-z]*$|^(.{1,8}?)\1+.{0,7}$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:0123456789|123456789|abcdefghij|example|placeholder|your[_-]?(?:key|token|secret)|changeme|dummy)"


def entropy_stretch(value: Column) -> Column:
    """(first, last): the stretch of a candidate whose windows reach the threshold of its class; null if none does."""
    f = F.array(*[F.lit(float(c * log2(c)) if c else 0.0) for c in range(WINDOW + 2)])
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    chars = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1)

    def slide(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came, went = F.get(x["chars"], i), F.get(x["chars"], i - WINDOW)  # none goes before the window is full
            n_came, n_went = F.get(acc["counts"], came), F.get(acc["counts"], went)
            n_went = n_went + (came == went).cast("int")
            total = acc["total"] + F.get(x["f"], n_came + 1) - F.get(x["f"], n_came) + F.coalesce(F.get(x["f"], n_went - 1) - F.get(x["f"], n_went), F.lit(0.0))
            counts = F.transform(acc["counts"], lambda c, k: c + (k == came).cast("int") - F.coalesce((k == went).cast("int"), F.lit(0)))
            full = (i >= WINDOW - 1) & (F.lit(log2(WINDOW)) - total / WINDOW >= x["least"])
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(full & acc["first"].isNull(), i - WINDOW + 1).otherwise(acc["first"]).alias("first"), F.when(full, i + 1).otherwise(acc["last"]).alias("last"))

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["chars"]) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(F.struct(chars.alias("chars"), f.alias("f"), least.alias("least")), slide)


def entropy_spans(text: Column) -> Column:
    candidates = F.filter(match_spans(text, CANDIDATE), lambda c: ~c["value"].rlike(ALLOWED))
    found = F.transform(candidates, lambda c: let(entropy_stretch(c["value"]), lambda s: F.struct((c["start"] + s["first"]).cast("bigint").alias("start"), (c["start"] + s["last"]).cast("bigint").alias("stop"), c["value"].alias("value"))))
    return F.filter(found, lambda s: s["start"].isNotNull())


def secret_spans(text: Column) -> Column:
    """A struct of the span arrays of all kinds."""
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6)
    return F.struct(
        assign.alias("assign"),
        match_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        match_spans(text, HEX).alias("hex"),
        entropy_spans(text).alias("entropy"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: its spans by kind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), secret_spans(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("found"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    kinds = ("assign", "access", "hex", "entropy")
    rows = found.select("doc_id", *[tagged(F.col(f"found.{k}"), k, i).alias(k) for i, k in enumerate(kinds)])
    base = printed(F.sort_array(F.concat("assign", "access", "hex")))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(base, 256).alias("base_sha256"), printed(F.sort_array(F.concat(*kinds))).alias("spans"))
