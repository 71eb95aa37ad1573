"""Quality rules: fixed base rules, and adaptive fences from mergeable quantile sketches per language and source.

Measures of every text: mean word length, symbols a word, share of repeated lines, share of words in repeated windows.
A KLL sketch of each measure is built for every (lang, source) by partial aggregation; the sketches of a language's
sources merge into one for the language.  Sketches take the texts that pass the base rules.  A fence lies beyond the
sketch's 90th percentile by ``REACH`` times the way from the median to it, and by the measure's slack, which keeps
measures that are nearly always equal from dropping every text that differs; so up to a tenth of a group may be junk.  A group of n texts with words takes n / (n + ``WEIGHT``) of its own fence and the rest of its
language's, so small groups lean on their language and none switches at a size.  The mean word length has a fence on
either side.

Defined cases: a null or empty text has no words and fails the base; a null lang or source is a group of its own; rows
repeat as they come; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native import let, words

WINDOW = 5
TAIL = 0.9
REACH = 3.0
WEIGHT = 100
#: Items that a sketch keeps, about; a rank is off by some 0.4 % of its texts, and by nothing in groups of fewer.
SKETCH = 800
#: The slack of each measure; whether the measure has a lower fence.
MEASURES = {"mean_chars": (0.5, True), "symbol_share": (0.05, False), "dup_line_share": (0.25, False), "repeat_share": (0.18, False)}


def repeated_words(found: Column) -> Column:
    """Words in windows of five that the text holds twice or more."""
    grams = F.transform(F.sequence(F.lit(1), F.size(found) - WINDOW + 1), lambda i: F.xxhash64(F.slice(found, i, WINDOW)))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda o: F.filter(F.transform(o, lambda x, k: F.when((x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda at, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - at), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(F.size(found) > WINDOW, some).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """Counts of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        of_words.alias("w"),
        lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("symbols"),
    )
    long = lambda c: F.col(c).cast("long")
    return read.select("doc_id", "lang", "source", long("w.n").alias("n_words"), long("chars").alias("word_chars"), long("symbols").alias("n_symbols"), long("l.dup").alias("n_dup_lines"), long("w.repeated").alias("n_repeat_words"), long("l.n").alias("n_lines"))


def with_shares(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return rows.withColumns({"mean_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def fences(rows: DataFrame) -> DataFrame:
    """A low and a high fence of each measure for every (lang, source); null where no text has words."""
    sketches = rows.groupBy("lang", "source").agg(F.count("mean_chars").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in MEASURES])
    merged = sketches.groupBy("lang").agg(*[F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(f"lang_{m}") for m in MEASURES]).withColumnRenamed("lang", "l")
    both = sketches.join(merged, F.col("lang").eqNullSafe(F.col("l")))
    own = F.col("n") / (F.col("n") + WEIGHT)

    def quantile(sketch: str, q: float) -> Column:  # a sketch of nothing has none
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(F.when(F.kll_sketch_get_n_double(sketch) > 0, F.col(sketch)), F.lit(q)))

    def fence(sketch: str, tail: float, slack: float) -> Column:
        far, middle = quantile(sketch, tail), quantile(sketch, 0.5)
        return far + REACH * (far - middle) + slack

    out = []
    for m, (slack, low) in MEASURES.items():
        for name, tail, give in (("high", TAIL, slack), ("low", 1 - TAIL, -slack)):
            mixed = F.coalesce(own * fence(m, tail, give), F.lit(0.0)) + (1 - own) * fence(f"lang_{m}", tail, give)
            out.append((mixed if low or name == "high" else F.lit(None).cast("double")).alias(f"{m}_{name}"))
    return both.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *out)


def judge(docs: DataFrame) -> DataFrame:
    """Every document's counts, base_failed and kept."""
    rows, _ = common.materialise(measures(docs), "measures")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = with_shares(rows)
    # the fences, a row a group, are small for most inputs; AQE broadcasts them by their size or splits hot groups
    met = rows.join(fences(rows.where(~failed)), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    beyond = [F.coalesce((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low")), F.col(m) > F.col(f"{m}_high"), F.lit(False)) for m in MEASURES]
    kept = ~failed
    for b in beyond:
        kept = kept & ~b
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "lang", "source", *MEASURES)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
