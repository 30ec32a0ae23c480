"""Measurement analytics: percentiles, histograms, windows, rates, stop windows, streaks, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.shared import checkpointed

#: Bits of a sub-bucket at three significant figures.
HDR_BITS = 11
LOG_BUCKETS = 112


def round_robin(rows: DataFrame, by: str, order: list[str], quota: int) -> DataFrame:
    """Up to quota rows, one of each stratum in turn. No more than quota rows of a stratum leave a task."""
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("turn") <= quota)
    return ranked.orderBy("turn", by).limit(quota).drop("turn")


def numbered(rows: DataFrame, order: str, slices: int = 64) -> DataFrame:
    """rows with `nth`, their place by a column (from 1; ties in any order). Rows are sorted in slices of the order, split at sampled values, and numbered from the sizes of the slices before: no task sees all rows."""
    split = rows.repartitionByRange(slices, order).sortWithinPartitions(order).withColumn("_slice", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(split)
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = sizes.select("_slice", "_first", F.coalesce(F.sum("n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # A row's id counts up from its slice's first: the sort came before.
    return placed.join(F.broadcast(before), "_slice").withColumn("nth", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_slice", "_id", "_first", "_before")


def floor_rank(rows: DataFrame, by: list[str], value: str, percents=(50, 95, 99)) -> DataFrame:
    """Percentiles as the sorted element at (n - 1) * p / 100, rounded down; with count and max.

    Equal values are counted first, so that a group's running counts are over its distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    at = lambda p: F.floor((F.col("total") - 1) * p / 100)
    return upto.groupBy(*by).agg(F.sum("n").alias("samples"), *[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in percents], F.max(value).alias("max"))


def hdr_top(value: Column) -> Column:
    """The highest value of the histogram bucket of a value."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - HDR_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift) + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def hdr_histogram(rows: DataFrame, by: list[str], value: str, highest: int) -> DataFrame:
    """(by, top, n, total, observed, over): bucket counts, which add up over parts; values above highest count as over, in the highest bucket."""
    capped = F.least(F.greatest(F.col(value), F.lit(1)), F.lit(highest)).cast("long")
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, hdr_top(capped).alias("top")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("observed"), F.count_if(F.col(value) > highest).alias("over"))


def hdr_summary(histogram: DataFrame, by: list[str], quantiles=((50, 0.5), (95, 0.95), (99, 0.99), (999, 0.999))) -> DataFrame:
    """mean, quantiles (the bucket top at rank max(1, ceil(q n))), max, max_observed, over_range and samples of merged histograms."""
    merged = histogram.groupBy(*by, "top").agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("observed", F.max), ("over", F.sum))])
    order = W.partitionBy(*by).orderBy("top").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = merged.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    return upto.groupBy(*by).agg(
        F.sum("n").alias("samples"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        *[F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)), F.col("top"))).alias(f"p{p}") for p, q in quantiles],
        F.max("top").alias("max"),
        F.max("observed").alias("max_observed"),
        F.sum("over").alias("over_range"),
    )


def log_bucket(micros: Column) -> Column:
    """Which of the buckets [2^(i/4), 2^((i+1)/4)) holds a time."""
    return F.least(F.lit(LOG_BUCKETS - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(micros.cast("double"), F.lit(1.0))) * 4))).cast("int")


def log_percentile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, value): 2^((i + 0.5) / 4) of the first bucket (by, bucket, n) whose running count reaches q of all."""
    order = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = buckets.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    return upto.filter(F.col("upto") >= F.col("all") * q).groupBy(*by).agg(F.pow(F.lit(2.0), (F.min("bucket") + 0.5) / 4).alias("value"))


def histogram_delta(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts that came between two cumulative readings: what isn't in before counts from 0, and what fell is dropped."""
    earlier = before.withColumnRenamed("n", "was")
    return after.join(earlier, [*by, "bucket"], "left").withColumn("n", F.col("n") - F.coalesce("was", F.lit(0))).filter("n > 0").select(*by, "bucket", "n")


def counter_rate(samples: DataFrame, by: str, at: str, counter: str, same: list[str]) -> DataFrame:
    """samples with `rate` a second from the sample before; null at the first, where a column of same changed, where the counter fell, or where no time passed."""
    order = W.partitionBy(by).orderBy(at)
    before = lambda c: F.lag(c).over(order)
    whole = (F.col(counter) >= before(counter)) & (F.col(at) > before(at))
    for c in same:
        whole = whole & F.col(c).eqNullSafe(before(c))
    return samples.withColumn("rate", F.when(whole, (F.col(counter) - before(counter)) * 1000.0 / (F.col(at) - before(at))))


def as_of(rows: DataFrame, samples: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """rows with `value` of the last sample of their key at or before their time, else of its first."""
    marked = rows.withColumn("_is", F.lit(1)).unionByName(samples.select(by, at, value).withColumn("_is", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy(by).orderBy(at, "_is")
    past = F.last(F.when(F.col("_is") == 0, F.col(value)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.first(F.when(F.col("_is") == 0, F.col(value)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return marked.withColumn(value, F.coalesce(past, first)).filter("_is = 1").drop("_is")


def streaks(probes: DataFrame, by: str, order: list[str], failed: str) -> DataFrame:
    """(by, longest): the longest run of failed probes of each key."""
    w = W.partitionBy(by).orderBy(*order)
    runs = probes.withColumn("run", F.row_number().over(w) - F.row_number().over(W.partitionBy(by, failed).orderBy(*order)))
    each = runs.groupBy(by, "run").agg(F.count_if(F.col(failed)).alias("n"))
    return each.groupBy(by).agg(F.max("n").alias("longest"))


def stop_window(samples: DataFrame, by: str, at: str, busy: str, done: str, seen: str) -> DataFrame:
    """(by, first_busy, last_busy, first_ok): from cumulative counters sampled over time, the first sample being the baseline. busy counts rejections, done successful writes, and seen is the number of rejections known to the last successful write when it started. The window closes at the first sample, from the last one in which busy grew, with a write that knew of all rejections; a later rejection opens it again."""
    order = W.partitionBy(by).orderBy(at)
    marked = samples.withColumn("grew", F.coalesce(F.col(busy) > F.lag(busy).over(order), F.lit(False))).withColumn("at_first", F.first(done).over(order))
    marked = marked.withColumn("last", F.max(F.when(F.col("grew"), F.col(at))).over(W.partitionBy(by)))
    closes = (F.col(at) >= F.col("last")) & (F.col(done) > F.col("at_first")) & (F.col(seen) >= F.col(busy))
    return marked.groupBy(by).agg(F.min(F.when(F.col("grew"), F.col(at))).alias("first_busy"), F.max("last").alias("last_busy"), F.min(F.when(closes, F.col(at))).alias("first_ok"))


def islands(intervals: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, start, end): overlapping or touching intervals merged."""
    order = W.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy(by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def with_gaps(series: DataFrame, by: str, at: str, value: str, phase: str, window: float) -> DataFrame:
    """The series with a null value half-way into each gap: where the phase changed, or more than 1.5 windows passed."""
    order = W.partitionBy(by).orderBy(at)
    gap = (F.col(phase) != F.lag(phase).over(order)) | (F.col(at) - F.lag(at).over(order) > 1.5 * window)
    own = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    hole = F.struct(F.floor((F.col(at) + F.lag(at).over(order)) / 2).alias("at"), F.lit(None).cast("double").alias("value"))
    return series.withColumn("_x", F.when(F.coalesce(gap, F.lit(False)), F.array(hole, own)).otherwise(F.array(own))).select(by, F.explode("_x").alias("_x")).select(by, "_x.at", "_x.value")


def least_squares(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, points, slope, intercept, r): groups of two points or more; 0 where a variance is."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(F.regr_count(y, x).alias("points"), zero(F.regr_slope(y, x)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), zero(F.expr(f"try_divide(covar_pop({y}, {x}), stddev_pop({y}) * stddev_pop({x}))")).alias("r")).filter("points >= 2")


def paired(rows: DataFrame, case: str, rep: str, system: str, value: str, a: str, b: str) -> DataFrame:
    """(case, pairs, geomean_delta, median_a, median_b): the paired geometric mean of b over a, less 1."""
    from annulus.operators.stages import medians

    one = lambda s, name: rows.filter(F.col(system) == s).select(case, rep, F.col(value).alias(name))
    both = one(a, "a").join(one(b, "b"), [case, rep])
    rolled = both.groupBy(case).agg(F.count("*").alias("pairs"), (F.exp(F.avg(F.ln(F.col("b") / F.col("a")))) - 1).alias("geomean_delta"))
    return rolled.join(medians(both, [case], ["a", "b"]), case).select(case, "pairs", "geomean_delta", F.col("a").alias("median_a"), F.col("b").alias("median_b"))
