"""Distributions as tables: histograms, quantiles, bands, sweeps and profiles; what is drawn elsewhere is counted here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

SHAPES = ("single_slot", "same_leader_multi_slot", "cross_leader")
XL_SHAPES = ("xl_all_victims_front_leader", "xl_first_victim_front_leader", "xl_no_victim_front_leader", "xl_single_victim_same_leader", "xl_single_victim_diff_leader")
CLIP = 12


def equal_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def geometric_edges(low: float, high: float, bins: int) -> list[float]:
    return [low * (high / low) ** (i / bins) for i in range(bins + 1)]


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The number of the bin, from 0: closed below, and the last one above too; null outside."""
    inside = (x >= edges[0]) & (x <= edges[-1])
    found = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:-1]]), lambda e: e <= x)) if len(edges) > 2 else F.lit(0)
    return F.when(inside, found)


def histogram(rows: DataFrame, x: str, edges: Sequence[float], weight: str | None = None, *by: str) -> DataFrame:
    """(by, bin, low, high, n) of all bins that hold something; n sums the weights, else counts."""
    cells = F.array(*[F.lit(float(e)) for e in edges])
    cut = rows.withColumn("bin", bin_of(F.col(x), edges)).where("bin is not null")
    n = F.sum(weight) if weight else F.count("*")
    return cut.groupBy(*by, "bin").agg(n.alias("n")).select(*by, "bin", F.get(cells, "bin").alias("low"), F.get(cells, F.col("bin") + 1).alias("high"), "n")


def bin_means(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(bin, n, mean): the mean of y by bins of x."""
    return rows.where(F.col(x).isNotNull()).groupBy(F.floor(F.col(x) / width + 1e-9).alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: n, mean, median, sd, lo, hi, p10, p25, p75, p90 of what is not null."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.name", "x.v")
    return each.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.percentile("v", q).alias(f"p{round(100 * q)}") for q in (0.1, 0.25, 0.75, 0.9)])


def kept_and_dropped(rows: DataFrame, test: Column, sums: Sequence[str]) -> DataFrame:
    """(kept, n, sums): both sides of a gate; a null fails it."""
    return rows.groupBy(F.coalesce(test, F.lit(False)).alias("kept")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def mode_and_trough(rows: DataFrame, x: str, width: float, above: float) -> DataFrame:
    """One row: the bin that holds most, and of those from ``above`` on the one that holds least; ties: the lower."""
    bins = rows.where(F.col(x).isNotNull()).groupBy(F.floor(F.col(x) / width + 1e-9).alias("bin")).agg(F.count("*").alias("n"))
    high = F.col("bin") * width >= above - 1e-9
    return bins.agg(F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("modal_bin"), F.max("n").alias("modal_n"), F.min_by("bin", F.when(high, F.struct("n", "bin"))).alias("trough_bin"), F.min(F.when(high, F.col("n"))).alias("trough_n"))


def quadrants(rows: DataFrame, x: Column, y: Column, value: str) -> DataFrame:
    """(x_high, y_high, n, total, mean, p90): a value by two tests; rows with a null in either are left out."""
    return rows.select(x.alias("x_high"), y.alias("y_high"), value).where("x_high is not null and y_high is not null").groupBy("x_high", "y_high").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.percentile(value, 0.9).alias("p90"))


def plane_crop(rows: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple) -> DataFrame:
    """One row: points, those without a place, and those beyond the frame."""
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return rows.agg(F.count("*").alias("points"), F.count_if(~placed).alias("unplaced"), F.count_if(placed & ~inside).alias("cropped"))


def bands(rows: DataFrame, x: str, edges: Sequence[float], sums: Sequence[str]) -> DataFrame:
    """(band, n, share, sums): half-open bands, empty ones too; sums of nothing are null."""
    table = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "band int, low double, high double")
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:-1]]), lambda e: e <= F.col(x)))
    cut = rows.where((F.col(x) >= edges[0]) & (F.col(x) < edges[-1])).groupBy(band.alias("b")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    total = rows.agg(F.count("*").alias("all"))  # one row
    met = table.join(cut, F.col("band") == F.col("b"), "left").join(F.broadcast(total))
    return met.select("band", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("n", F.lit(0)), F.col("all")).alias("share"), *sums)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of every value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("all"))  # one row
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("all")).alias("share"))


def box_stats(rows: DataFrame, by: str, x: str) -> DataFrame:
    """(by, n, p25, median, p75, low, high): quartiles, and the ends within 1.5 times their distance."""
    quartiles = rows.where(F.col(x).isNotNull()).groupBy(by).agg(F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.75).alias("p75"))
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    met = rows.where(F.col(x).isNotNull()).select(F.col(by).alias("_b"), F.col(x).alias("_x")).join(quartiles, F.col("_b") == F.col(by))
    inside = (F.col("_x") >= F.col("p25") - reach) & (F.col("_x") <= F.col("p75") + reach)
    return met.groupBy(by, "p25", "median", "p75").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("_x"))).alias("low"), F.max(F.when(inside, F.col("_x"))).alias("high"))


def sliding_quantiles(rows: DataFrame, order: list[str], x: str, parts: int = 60, overlap: int = 4, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(window, first, n, quantiles): bands over windows of a ``parts``-th of the rows in order, stepping by a fraction of it."""
    from .ordered import ranks

    total = rows.agg(F.count("*").alias("_all"))  # one row
    placed = ranks(rows, order[0], order[1]).join(F.broadcast(total))
    size = F.greatest(F.floor(F.col("_all") / parts), F.lit(1))
    step = F.greatest(F.floor(size / overlap), F.lit(1))
    at = F.col("rank") - 1
    # a row lies in the windows that begin at most a window's length before it
    first = F.greatest(F.ceil((at - size + 1) / step), F.lit(0))
    last = F.least(F.floor(at / step), F.floor((F.col("_all") - size) / step))
    each = placed.where(first <= last).select(x, at.alias("_at"), F.explode(F.sequence(first, last)).alias("window"))
    return each.groupBy("window").agg(F.min("_at").alias("first"), F.count("*").alias("n"), *[F.percentile(x, q).alias(f"p{round(100 * q)}") for q in quantiles])


def geometry_table(rows: DataFrame, usd: str = "usd_net", **populations: Column) -> DataFrame:
    """(population, geom_class, n, share, usd, usd_share): economics of the shapes for each population."""
    named = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in populations.items()]), lambda p: p.isNotNull())
    each = rows.select(F.explode(named).alias("population"), "geom_class", usd).groupBy("population", "geom_class").agg(F.count("*").alias("n"), F.sum(usd).alias("usd"))
    whole = Window.partitionBy("population")  # three rows
    return each.select("population", "geom_class", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), "usd", ratio(F.col("usd"), F.sum("usd").over(whole)).alias("usd_share"))


def all_front_baseline(rows: DataFrame) -> DataFrame:
    """(nv, p): how often all victims are under the front's leader, by their number up to ``CLIP``."""
    nv = F.least(F.coalesce("n_victims", F.lit(0)), F.lit(CLIP))
    return rows.where("geom_class = 'cross_leader'").groupBy(nv.alias("nv")).agg(F.avg(F.col("xl_all_victims_front_leader").cast("int")).alias("p"))


def geometry_profile(rows: DataFrame, base: DataFrame, suppression: DataFrame, usd: str = "usd_net") -> DataFrame:
    """One row a signer: counts, shares and USD of the shapes, victims in the front's block, and what chance would have."""
    xl = F.col("geom_class") == "cross_leader"
    columns = [F.count("*").alias("sandwich_count")]
    for shape in SHAPES:
        own = F.col("geom_class") == shape
        columns += [F.count_if(own).alias(f"{shape}_n"), (F.count_if(own) / F.count("*")).alias(f"{shape}_share"), F.coalesce(F.sum(F.when(own, F.col(usd))), F.lit(0.0)).alias(f"{shape}_usd"), F.avg(F.when(own, F.col(usd))).alias(f"{shape}_usd_avg")]
    for shape in XL_SHAPES:
        own = F.col(shape)
        columns += [F.count_if(own).alias(f"{shape}_n"), ratio(F.count_if(own), F.count_if(xl)).alias(f"{shape}_share_of_xl"), F.coalesce(F.sum(F.when(own, F.col(usd))), F.lit(0.0)).alias(f"{shape}_usd"), F.avg(F.when(own, F.col(usd))).alias(f"{shape}_usd_avg")]
    columns += [F.coalesce(F.sum("v_same_block_as_front"), F.lit(0)).alias("victim_in_front_block_n"), ratio(F.sum("v_same_block_as_front"), F.sum("n_victims")).alias("victim_in_front_block_share"), F.avg(F.when(xl, F.col("n_victims"))).alias("victims_per_xl_sandwich"), F.avg("p").alias("xl_all_front_expected")]
    nv = F.when(xl, F.least(F.coalesce("n_victims", F.lit(0)), F.lit(CLIP)))
    met = rows.withColumn("_nv", nv).join(F.broadcast(base), F.col("_nv") == F.col("nv"), "left")  # at most CLIP + 1 rows
    out = met.groupBy("signer").agg(*columns).join(suppression.select("signer", F.col("n").alias("xb_sandwiches"), F.col("observed").alias("xl_observed"), F.col("expected").alias("xl_expected_if_arbitrary")), "signer", "left")
    return out.select("*", ratio(F.col("xl_all_victims_front_leader_share_of_xl"), F.col("xl_all_front_expected")).alias("xl_all_front_vs_expected"), ratio(F.col("xl_observed"), F.col("xl_expected_if_arbitrary")).alias("boundary_suppression"))


def population_geometry(profiles: DataFrame) -> DataFrame:
    """(shape, n, usd, per): totals of all profiles by shape."""
    each = F.array(*[F.struct(F.lit(s).alias("shape"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_usd").alias("usd")) for s in (*SHAPES, *XL_SHAPES)])
    return profiles.select(F.explode(each).alias("x")).groupBy("x.shape").agg(F.sum("x.n").alias("n"), F.sum("x.usd").alias("usd")).withColumn("per", ratio(F.col("usd"), F.col("n")))


def cost_by_class(legs: DataFrame, block_class: Column, cost: str) -> DataFrame:
    """(type, class, n, median, mean, ratio) of a cost by leg type; ratio: the mean to the single-slot class's mean."""
    sums = legs.groupBy("type", block_class.alias("class")).agg(F.count(cost).alias("n"), F.percentile(cost, 0.5).alias("median"), F.avg(cost).alias("mean"))
    base = F.max(F.when(F.col("class") == "single_slot", F.col("mean"))).over(Window.partitionBy("type"))  # three rows
    return sums.withColumn("ratio", ratio(F.col("mean"), base))


def fee_fingerprint(legs: DataFrame, strongest: DataFrame) -> DataFrame:
    """One row a signer: fees of the own legs, how many values they take, the commonest one's share, and the leader met most."""
    own = legs.where(F.col("type").isin("frontRun", "backRun")).select(F.element_at("signers", 1).alias("signer"), "fee")
    counts = own.groupBy("signer", "fee").agg(F.count("*").alias("n"))
    sums = counts.groupBy("signer").agg(F.sum("n").alias("legs"), F.count("*").alias("fee_values"), F.min_by("fee", F.struct(-F.col("n"), F.col("fee"))).alias("usual_fee"), (F.max("n") / F.sum("n")).alias("usual_share"), (F.sum(F.col("n") * F.col("fee")) / F.sum("n")).alias("mean_fee"))
    return sums.join(strongest.select("signer", F.col("leader").alias("top_leader"), F.col("share").alias("top_leader_share")), "signer", "left")


def daily(rows: DataFrame, ts: str, by: str, values: Sequence, sums: Mapping[str, str]) -> DataFrame:
    """(day, and for each value and sum a column): a pivot by day."""
    day = F.to_date(F.timestamp_seconds(ts))
    return rows.groupBy(day.alias("day")).agg(*[F.coalesce(F.sum(F.when(F.col(by) == v, F.col(c))), F.lit(0)).alias(f"{name}_{v}") for v in values for name, c in sums.items()])


def daily_transactions(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """(day, total): valid transactions of the slots that hold a sandwich, by the day of the slot's first one."""
    first = rows.groupBy(F.col("front_slot").alias("slot")).agg(F.min("ts").alias("ts"))
    once = counts.groupBy("slot").agg(F.max("valid_count").alias("valid_count"))
    return first.join(once, "slot").groupBy(F.to_date(F.timestamp_seconds("ts")).alias("day")).agg(F.sum("valid_count").alias("total"))


def lookup(rows: DataFrame, key: str, sums: Mapping[str, str], top: int, names: DataFrame | None = None) -> DataFrame:
    """The keys of the most rows with their sums, and a name where there is one; names that come twice count once."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias(a) for a, c in sums.items()]).orderBy(F.desc("n"), key).limit(top)
    return out if names is None else out.join(names.dropDuplicates([key]), key, "left")


def combined_total(program_rows: DataFrame, programs: Sequence[str], rows: DataFrame, value: str) -> DataFrame:
    """One row: sandwiches of any of the programs, each once, and the sum of a value over them."""
    some = program_rows.where(F.col("program").isin(list(programs))).select("sid").distinct()
    return rows.join(some, "sid", "left_semi").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
