"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees are trained from labelled URLs: those that a rule fits, its verdict as label (1: block).  Statistics of host
suffixes are counts over all pages: how many there are, and the share of blocked ones among the labelled; a labelled
page is dealt by its hash to one of ``FOLDS`` folds and its features leave its own fold out, so that no label reaches
its own features.  Only the fit of the trees takes a bounded sample, the ``SAMPLE`` labelled rows with the smallest hash
of url and page_id.  Features are cut into at most ``BINS`` bins at quantiles of the sample; each level of a tree is one
aggregate of gradients by (leaf, feature, bin), of fixed size, from which the driver takes the best splits.  The model is
then a SQL expression.  ``held_out`` gives its log loss on labelled pages that neither fit nor statistics have seen.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged by the trees like others; if
the sample has one label only, or none, the trees say that label, or allow; rows repeat as they come.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The most labelled rows that training takes.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, L2 = 16, 8, 3, 0.5, 1.0
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, a host and a path counting together; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url."""
    n = F.length(url)
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    digits = n - F.length(F.translate(url, "0123456789", ""))
    chars = F.array_distinct(F.split(url, ""))
    c_log_c = F.aggregate(F.transform(chars, lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double")), F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(F.when(c > 0, c))).otherwise(0.0))
    entropy = F.when(n > 0, F.log2(F.when(n > 0, n.cast("double"))) - c_log_c / n).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": n,
        "depth": count(path, "/"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(1 + count(query, "&")),
        "host_length": F.length(host),
        "labels": count(host, ".") + 1,
        "path_length": F.length(path),
        "hyphens": count(url, "-"),
        "first_segment": F.length(F.regexp_extract(path, r"^/?([^/]*)", 1)),
        "secure": url.startswith("https").cast("int"),
        "last_is_digit": path.rlike("[0-9]/?$").cast("int"),
    }


def prepared(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    suffix = F.element_at(F.split("host", r"\."), -1)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), suffix.alias("suffix"))
    return rows.select("*", *[c.cast("double").alias(f"x_{k}") for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])


def expression(tree, default: float = 0.0) -> Column:
    """A tree as a CASE expression: a leaf's value, or (feature, cut, left, right)."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= cut, expression(left)).otherwise(expression(right))


def train(sample: DataFrame, names: list[str]) -> tuple[float, list]:
    """(bias, trees) of log-odds for label 1; sample: the features and a column label."""
    bias, trees = 0.0, []
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or ones in (0, n):
        return (35.0 if n and ones == n else -35.0), []
    bias = log(ones / (n - ones))
    quantiles = sample.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], F.lit(10_000)).alias(c) for c in names]).first()
    cuts = {c: sorted(set(quantiles[c])) for c in names}
    bins = F.array(*[reduce(lambda a, b: a + b, [(F.col(c) > x).cast("int") for x in cuts[c]], F.lit(0)) for c in names])
    binned = sample.withColumn("bins", bins)
    for _ in range(TREES):
        score = reduce(lambda a, t: a + expression(t), trees, F.lit(bias))
        p = 1 / (1 + F.exp(-score))
        graded = binned.select("bins", *names, (p - F.col("label")).alias("g"), (p * (1 - p)).alias("h"))
        splits: dict[int, tuple] = {}  # by leaf: the root is 1, the children of k are 2k and 2k + 1
        value: dict[int, float] = {}

        def leaf_of(splits: dict, k: int = 1) -> Column:
            if k not in splits:
                return F.lit(k)
            c, cut = splits[k]
            return F.when(F.col(c) <= cut, leaf_of(splits, 2 * k)).otherwise(leaf_of(splits, 2 * k + 1))

        for depth in range(DEPTH + 1):
            # the last level is not split: its leaves' sums are all it needs
            bin_of = F.posexplode("bins").alias("feature", "bin") if depth < DEPTH else F.posexplode(F.array(F.lit(0))).alias("feature", "bin")
            each = graded.select(leaf_of(splits).alias("leaf"), "g", "h", bin_of)
            cells = each.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # at most leaves x features x bins
            table: dict[int, dict[int, dict[int, tuple]]] = {}
            for r in cells:
                table.setdefault(r["leaf"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
            for leaf, by_feature in table.items():
                g, h = (sum(x[i] for x in by_feature[0].values()) for i in (0, 1))
                value[leaf] = -RATE * g / (h + L2)
                best = (1e-6, 0, 0.0)
                for f, by_bin in sorted(by_feature.items()) if depth < DEPTH else ():
                    gl = hl = 0.0
                    for b, cut in enumerate(cuts[names[f]]):
                        gb, hb = by_bin.get(b, (0.0, 0.0))
                        gl, hl = gl + gb, hl + hb
                        gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                        best = max(best, (round(gain, 9), -f, cut))
                if depth < DEPTH and best[0] > 1e-6 and leaf >= 1 << depth:
                    splits[leaf] = (names[-best[1]], best[2])

        def build(k: int = 1):
            if k not in splits:
                return value.get(k, 0.0)
            return (*splits[k], build(2 * k), build(2 * k + 1))

        trees.append(build())
    return bias, trees


def suffix_statistics(rows: DataFrame, learned: Column) -> DataFrame:
    """Features of every (suffix, fold): counts of all rows, and of the labelled ones that may be learned from.

    Fold -1 holds all; each other one leaves its own rows out.
    """
    label = F.when(learned, (F.col("ruled") == "block").cast("long"))
    each = rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count(label).alias("known"), F.coalesce(F.sum(label), F.lit(0)).alias("ones"))
    each, _ = common.materialise(each, "suffixes")
    total = each.groupBy(F.col("suffix").alias("s")).agg(F.sum("n").alias("t_n"), F.sum("known").alias("t_known"), F.sum("ones").alias("t_ones"))
    rate = lambda ones, known: (ones + 1) / (known + 2)
    count = F.log2(F.col("t_n") + 1.0).alias("x_suffix_count")
    own = each.where("fold >= 0").join(total, F.col("suffix").eqNullSafe(F.col("s"))).select("s", F.col("fold").alias("f"), rate(F.col("t_ones") - F.col("ones"), F.col("t_known") - F.col("known")).alias("x_suffix_block"), count)
    return total.select("s", F.lit(-1).alias("f"), rate(F.col("t_ones"), F.col("t_known")).alias("x_suffix_block"), count).unionByName(own)


def with_folds(pages: DataFrame) -> DataFrame:
    """The prepared pages with their fold: -1 where no rule gives a label."""
    rows = prepared(pages)
    return rows.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64(F.lit("fold"), "url", "page_id"), F.lit(FOLDS))).otherwise(-1).cast("int"))


def fit(rows: DataFrame, learned: Column, sample: int) -> tuple[Column, DataFrame]:
    """(the log-odds of block, rows with the suffix features); only rows that are labelled and learned are trained on."""
    spark = rows.sparkSession
    stats = suffix_statistics(rows, learned)
    # a suffix may hold a third of all rows; the statistics, a row a suffix and fold, are broadcast by AQE where small
    full = rows.join(stats, F.col("suffix").eqNullSafe(F.col("s")) & (F.col("fold") == F.col("f"))).drop("s", "f")
    names = [c for c in full.columns if c.startswith("x_")]
    known = rows.where(learned).count()
    # a hash keeps about twice the sample before the exact cut, so that no task sends all its rows
    place = F.xxhash64("url", "page_id")
    bound = 2 * sample / max(known, 1)
    most = (1 << 63) - 1 if bound >= 1 else int(-(1 << 63) + bound * (1 << 64))
    chosen = full.where(learned & (place <= most)).orderBy(place, "url", "page_id").limit(sample).select(*names, (F.col("ruled") == "block").cast("int").alias("label"))
    features, at = common.materialise(chosen.coalesce(4), "features")
    bias, trees = train(features, names)
    common.drop_path(spark, at)
    return reduce(lambda a, t: a + expression(t), trees, F.lit(bias)), full


def judge(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every page's host, path, rule and verdict, and the trees' probability of block."""
    score, full = fit(with_folds(pages), F.col("ruled").isNotNull(), sample)
    out = full.withColumn("p_block", 1 / (1 + F.exp(-score)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def held_out(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row: the labelled pages of the first fold, their log loss, that of the other folds' share of blocks, and accuracy."""
    rows = with_folds(pages)
    score, full = fit(rows, F.col("fold") > 0, sample)
    label = (F.col("ruled") == "block").cast("double")
    share = rows.where("fold > 0").agg(F.avg(label).alias("share"))  # one row
    judged = full.where("fold = 0").select(label.alias("y"), (1 / (1 + F.exp(-score))).alias("p")).join(F.broadcast(share))
    loss = lambda p: -F.avg(F.col("y") * F.ln(F.greatest(p, F.lit(1e-12))) + (1 - F.col("y")) * F.ln(F.greatest(1 - p, F.lit(1e-12))))
    return judged.agg(F.count("*").alias("n"), loss(F.col("p")).alias("log_loss"), loss(F.col("share")).alias("base_loss"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
