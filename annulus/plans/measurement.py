"""Queries on measurements: latencies, windows, rates, balance, recovery, repetitions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.functions import scalars
from annulus.operators import metrics
from annulus.sources import datasets as data

HIGHEST = 3_000_000


def latency_floor_pct(spark, sf_dir):
    return metrics.floor_rank(data.ledger(spark, sf_dir), ["op", "stage"], "latency_us")


def hdr_summary(spark, sf_dir):
    # By day first, as a run's windows are, then merged.
    daily = metrics.hdr_histogram(data.ledger(spark, sf_dir), ["op", "day"], "latency_us", HIGHEST)
    found = metrics.hdr_summary(daily, ["op"])
    return found.withColumn("mean", F.round("mean", 6))


def log2q_histogram(spark, sf_dir):
    return data.ledger(spark, sf_dir).groupBy("op", metrics.log_bucket(F.col("quantity") * 100 + 7).alias("bucket")).agg(F.count("*").alias("n"))


def log2q_percentile(spark, sf_dir):
    return metrics.log_percentile(log2q_histogram(spark, sf_dir), ["op"], 0.95).select("op", F.round("value", 6).alias("p95"))


def histogram_delta(spark, sf_dir):
    rows = data.ledger(spark, sf_dir).withColumn("bucket", metrics.log_bucket(F.col("quantity") * 100 + 7))
    count = lambda r: r.groupBy("op", "bucket").agg(F.count("*").alias("n"))
    return metrics.histogram_delta(count(rows.filter("line <= 2")), count(rows.filter("id % 3 = 0")), ["op"])


def _samples(spark, sf_dir):
    """Hourly samples of each user's cumulative events and errors."""
    events = data.mutations(spark, sf_dir)
    order = W.partitionBy("user_id").orderBy("at_ms", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.select("user_id", "seq", "at_ms", F.count_if(F.col("op") == "delete").over(order).alias("busy"), F.count_if(F.col("op") == "put").over(order).alias("done"), "epoch", (F.col("seq") % 997).alias("counter"))


def counter_rate(spark, sf_dir):
    rated = metrics.counter_rate(_samples(spark, sf_dir), "user_id", "at_ms", "counter", ["epoch"])
    return rated.select("user_id", "seq", F.round("rate", 6).alias("rate"))


def stop_window(spark, sf_dir):
    samples = _samples(spark, sf_dir).withColumn("seen", F.col("busy") - F.when(F.col("seq") % 3 == 0, 1).otherwise(0))
    return metrics.stop_window(samples, "user_id", "at_ms", "busy", "done", "seen")


def max_fail_streak(spark, sf_dir):
    probes = data.mutations(spark, sf_dir).withColumn("failed", F.col("op") == "get")
    return metrics.streaks(probes, "user_id", ["at_ms", "seq"], "failed")


def cpu_asof(spark, sf_dir):
    rows = data.mutations(spark, sf_dir).filter("op = 'put'").select("user_id", "seq", "at_ms")
    samples = data.mutations(spark, sf_dir).filter("op = 'get'").select("user_id", "at_ms", F.col("seq").alias("sample"))
    return metrics.as_of(rows, samples, "user_id", "at_ms", "sample").select("user_id", "seq", "sample")


def warmup_islands(spark, sf_dir):
    spans = data.mutations(spark, sf_dir).filter("op = 'put'").select("user_id", F.col("at_ms").alias("a"), (F.col("at_ms") + F.col("seq") % 11 * 7_200_000).alias("b"))
    return metrics.islands(spans, "user_id", "a", "b")


def series_gaps(spark, sf_dir):
    series = data.mutations(spark, sf_dir).select("user_id", "at_ms", F.col("seq").cast("double").alias("v"), "epoch")
    return metrics.with_gaps(series, "user_id", "at_ms", "v", "epoch", 40_000_000.0)


def post_kill_progress(spark, sf_dir):
    """Per op, from day 15 on: failures, first and last failure, first success."""
    rows = data.mutations(spark, sf_dir).withColumn("failed", F.col("seq") % 4 == 0).filter("at_ms >= 1705276800000")
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.min(F.when(F.col("failed"), F.col("at_ms"))).alias("first_failure"), F.max(F.when(F.col("failed"), F.col("at_ms"))).alias("last_failure"), F.min(F.when(~F.col("failed"), F.col("at_ms"))).alias("first_success"))


def error_zero_fill(spark, sf_dir):
    reasons = spark.sql("SELECT * FROM VALUES ('error'), ('timeout'), ('click'), ('busy'), ('unavailable') AS t(reason)")
    counts = data.mutations(spark, sf_dir).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))
    return reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def phase_kind_buckets(spark, sf_dir):
    """Requests by the phase in which they started, and kind."""
    phase = F.when(F.col("at_ms") < 1704844800000, "pre").when(F.col("at_ms") < 1705708800000, "copy").otherwise("post")
    return data.mutations(spark, sf_dir).groupBy(phase.alias("phase"), F.col("op").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("seq") % 1000).alias("total"))


def rtt_fit(spark, sf_dir):
    items = data.read(spark, sf_dir, "lineitem")
    fit = metrics.least_squares(items, ["l_returnflag", "l_linenumber"], "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", "l_linenumber", "points", *[F.round(c, 4).alias(c) for c in ("slope", "intercept")], F.round("r", 6).alias("r"))


def repair_groups(spark, sf_dir):
    """Groups in which every task is complete or due, and some pending, those of the fewest attempts first, then the larger."""
    tasks = data.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("waiting").alias("state"), (F.col("o_orderkey") % 7).alias("attempts"))
    due = (F.col("state") == "complete") | ((F.col("state") == "pending") & (F.col("attempts") < 6))
    groups = tasks.groupBy("node").agg(F.bool_and(due).alias("ready"), F.bool_or(F.col("state") == "pending").alias("some"), F.max("attempts").alias("attempts"), F.count("*").alias("size"))
    return groups.filter("ready and some").select("node", "attempts", "size", scalars.retry_seconds(F.col("attempts")).alias("backoff")).orderBy("attempts", F.desc("size"), "node")


def natural_order(spark, sf_dir):
    """The place of every stage, by natural order."""
    stages = data.read(spark, sf_dir, "customer").select(F.concat(F.lit("rate_"), F.col("c_custkey").cast("string")).alias("stage"))
    return metrics.numbered(stages.withColumn("key", scalars.natural_order(F.col("stage"))), "key").select("stage", "nth")


def load_balance(spark, sf_dir):
    """Requests of each node between two counters, with those that miss one or fell set apart."""
    rows = data.ledger(spark, sf_dir)
    count = lambda where, name: rows.filter(where).groupBy("node").agg(F.count("*").alias(name))
    both = count("line <= 2", "before").join(count("line <= 4", "after"), "node", "full")
    return both.select("node", F.when(F.col("before").isNull() | F.col("after").isNull(), "missing").when(F.col("after") < F.col("before"), "fell").otherwise("ok").alias("state"), (F.col("after") - F.col("before")).alias("handled"))


def verify_dataset(spark, sf_dir):
    from annulus.operators.verify import mismatches

    o = data.read(spark, sf_dir, "orders")
    expected = o.filter("o_orderkey % 10 <> 3").select("o_orderkey", F.col("o_custkey").alias("v"))
    observed = o.filter("o_orderkey % 10 <> 4").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 100 == 5, 1).otherwise(0)).alias("v"))
    return mismatches(expected, observed, "o_orderkey", "v")


def oracle_sql():
    from annulus.plans.keyspace import _BASE

    m = f"WITH {_BASE.split('w AS (')[0].rstrip().rstrip(',')}"
    led = "l AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'get' WHEN 'N' THEN 'put' ELSE 'delete' END AS op, l_linestatus AS stage, round(l_extendedprice * 100)::BIGINT AS us, l_quantity AS q, l_suppkey AS node FROM lineitem)"
    bucket = "least(111, greatest(0, floor(log2(greatest(q * 100 + 7, 1)) * 4)))::INT"
    nth = lambda p: f"list_sort(list(us))[((count(*) - 1) * {p}) // 100 + 1] AS p{p}"
    sh = "greatest(0, length(bin(v)) - 11)"
    smp = m + ", x AS (SELECT user_id, seq, at_ms, count(*) FILTER (op = 'delete') OVER o AS busy, count(*) FILTER (op = 'put') OVER o AS done, epoch, seq % 997 AS counter FROM m WINDOW o AS (PARTITION BY user_id ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING))"
    return {
        "latency_floor_pct": f"WITH {led} SELECT op, stage, count(*) AS samples, {nth(50)}, {nth(95)}, {nth(99)}, max(us) AS max FROM l GROUP BY 1, 2",
        "hdr_summary": f"WITH {led}, v AS (SELECT *, least(greatest(us, 1), {HIGHEST}) AS v FROM l), b AS (SELECT *, ((v >> {sh}) << {sh}) + (1::BIGINT << {sh}) - 1 AS top FROM v), s AS (SELECT op, list_sort(list(top)) AS t, count(*) AS n, sum(us) AS total, max(us) AS o, count(*) FILTER (us > {HIGHEST}) AS over_range FROM b GROUP BY 1) SELECT op, n AS samples, round(total / n, 6) AS mean, t[greatest(1, ceil(n * 0.5))::BIGINT] AS p50, t[greatest(1, ceil(n * 0.95))::BIGINT] AS p95, t[greatest(1, ceil(n * 0.99))::BIGINT] AS p99, t[greatest(1, ceil(n * 0.999))::BIGINT] AS p999, list_max(t) AS max, o AS max_observed, over_range FROM s",
        "log2q_histogram": f"WITH {led} SELECT op, {bucket} AS bucket, count(*) AS n FROM l GROUP BY 1, 2",
        "log2q_percentile": f"WITH {led}, h AS (SELECT op, {bucket} AS bucket, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM h) SELECT op, round(pow(2.0, (min(bucket) + 0.5) / 4), 6) AS p95 FROM c WHERE upto >= total * 0.95 GROUP BY 1",
        "histogram_delta": f"WITH {led}, r AS (SELECT *, {bucket} AS bucket FROM l), a AS (SELECT op, bucket, count(*) AS n FROM r WHERE id % 3 = 0 GROUP BY 1, 2), b AS (SELECT op, bucket, count(*) AS n FROM r WHERE line <= 2 GROUP BY 1, 2) SELECT a.op, a.bucket, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (op, bucket) WHERE a.n - coalesce(b.n, 0) > 0",
        "counter_rate": smp + " SELECT user_id, seq, round(CASE WHEN counter >= lag(counter) OVER o AND at_ms > lag(at_ms) OVER o AND epoch = lag(epoch) OVER o THEN (counter - lag(counter) OVER o) * 1000.0::DOUBLE / (at_ms - lag(at_ms) OVER o) END, 6) AS rate FROM x WINDOW o AS (PARTITION BY user_id ORDER BY at_ms)",
        "stop_window": smp + ", y AS (SELECT *, busy - (seq % 3 = 0)::INT AS seen, coalesce(busy > lag(busy) OVER o, false) AS grew, first_value(done) OVER o AS d0 FROM x WINDOW o AS (PARTITION BY user_id ORDER BY at_ms)), z AS (SELECT *, max(at_ms) FILTER (grew) OVER (PARTITION BY user_id) AS last FROM y) SELECT user_id, min(at_ms) FILTER (grew) AS first_busy, max(last) AS last_busy, min(at_ms) FILTER (at_ms >= last AND done > d0 AND seen >= busy) AS first_ok FROM z GROUP BY 1",
        "max_fail_streak": m + ", r AS (SELECT user_id, op = 'get' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, seq) - row_number() OVER (PARTITION BY user_id, op = 'get' ORDER BY at_ms, seq) AS run FROM m) SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) FILTER (failed) AS n FROM r GROUP BY 1, 2) GROUP BY 1",
        "cpu_asof": m + ", g AS (SELECT user_id, at_ms, seq AS sample FROM m WHERE op = 'get'), f AS (SELECT user_id, min_by(sample, at_ms) AS first FROM g GROUP BY 1) SELECT p.user_id, p.seq, coalesce(g.sample, f.first) AS sample FROM (SELECT * FROM m WHERE op = 'put') p ASOF LEFT JOIN g ON p.user_id = g.user_id AND p.at_ms >= g.at_ms LEFT JOIN f ON f.user_id = p.user_id",
        "warmup_islands": m + ", i AS (SELECT user_id, at_ms AS a, at_ms + seq % 11 * 7200000 AS b FROM m WHERE op = 'put'), k AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM i), j AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM k) SELECT user_id, min(a) AS start, max(b) AS \"end\" FROM j GROUP BY user_id, island",
        "series_gaps": m + ", g AS (SELECT user_id, at_ms AS \"at\", seq::DOUBLE AS value, coalesce(epoch <> lag(epoch) OVER o OR at_ms - lag(at_ms) OVER o > 60000000, false) AS gap, lag(at_ms) OVER o AS b FROM m WINDOW o AS (PARTITION BY user_id ORDER BY at_ms)) SELECT user_id, \"at\", value FROM g UNION ALL SELECT user_id, (\"at\" + b) // 2, NULL FROM g WHERE gap",
        "post_kill_progress": m + " SELECT op, count(*) AS n, count(*) FILTER (seq % 4 = 0) AS failures, min(at_ms) FILTER (seq % 4 = 0) AS first_failure, max(at_ms) FILTER (seq % 4 = 0) AS last_failure, min(at_ms) FILTER (seq % 4 <> 0) AS first_success FROM m WHERE at_ms >= 1705276800000 GROUP BY 1",
        "error_zero_fill": "SELECT reason, count(event_id) AS n FROM (VALUES ('error'), ('timeout'), ('click'), ('busy'), ('unavailable')) t(reason) LEFT JOIN events ON event_type = reason GROUP BY 1",
        "phase_kind_buckets": m + " SELECT CASE WHEN at_ms < 1704844800000 THEN 'pre' WHEN at_ms < 1705708800000 THEN 'copy' ELSE 'post' END AS phase, op AS kind, count(*) AS n, sum(seq % 1000)::BIGINT AS total FROM m GROUP BY 1, 2",
        "rtt_fit": "SELECT l_returnflag, l_linenumber, count(*) AS points, round(coalesce(regr_slope(l_extendedprice, l_quantity), 0), 4) AS slope, round(coalesce(regr_intercept(l_extendedprice, l_quantity), avg(l_extendedprice)), 4) AS intercept, round(coalesce(corr(l_extendedprice, l_quantity), 0), 6) AS r FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2",
        "repair_groups": "SELECT o_custkey AS node, max(o_orderkey % 7) AS attempts, count(*) AS size, least(pow(2, least(max(o_orderkey % 7), 6)), 60)::BIGINT AS backoff FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 7 < 6)) AND bool_or(o_orderstatus = 'O')",
        "natural_order": "SELECT 'rate_' || c_custkey AS stage, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer",
        "load_balance": f"WITH {led} SELECT node, CASE WHEN b = 0 OR a = 0 THEN 'missing' WHEN a < b THEN 'fell' ELSE 'ok' END AS state, CASE WHEN b > 0 AND a > 0 THEN a - b END AS handled FROM (SELECT node, count(*) FILTER (line <= 2) AS b, count(*) FILTER (line <= 4) AS a FROM l GROUP BY 1) WHERE a > 0 OR b > 0",
        "verify_dataset": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey END AS expected, CASE WHEN o_orderkey % 10 <> 4 THEN o_custkey + (o_orderkey % 100 = 5)::INT END AS observed FROM orders WHERE o_orderkey % 10 IN (3, 4) OR o_orderkey % 100 = 5",
    }


def queries():
    names = oracle_sql()
    return {name: globals()[name] for name in names}
