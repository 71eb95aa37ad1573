"""Text helpers built from SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"
#: White space of all contracts here.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str | Column, rough: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: start, stop (code points, exclusive) and value.

    The pieces between matches give the positions.  rough: a cheaper condition that holds wherever a match is.
    """
    sought = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, sought, -1).alias("gaps"), F.regexp_extract_all(text, sought, F.lit(0)).alias("found"))

    def place(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["gaps"], i))
            stop = start + F.length(F.get(x["found"], i))
            return F.struct(stop.cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), F.get(x["found"], i).alias("value")))).alias("out"))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), start, step, lambda acc: acc["out"])

    none = F.array().cast(SPAN)
    placed = let(both, lambda x: F.when(F.size(x["found"]) > 0, place(x)).otherwise(none))
    return F.when(F.rlike(text, sought) if rough is None else rough, placed).otherwise(none)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, ord, stop, kind), for sorting and printing."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def printed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
