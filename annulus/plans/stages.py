"""Queries on load tests: stages, windows, phases, failures, recoveries, profiles, repetitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from annulus.operators import metrics, stages
from annulus.plans.keyspace import _BASE
from annulus.sources import datasets as data
from annulus.sources import requests as load

RATE = 75.0
KILL, PUBLISHED, VICTIM_EPOCH = 1_704_844_800_000, 1_705_708_800_000, 2
PHASES = ((0, "pre"), (6_000, "copying"), (11_000, "replaying"), (15_500, "published"), (21_000, "post"))
ROLES = {"worker": "^user:[0-4]", "replicator": "^user:[5-7]"}
BUCKETS = {"network": "click", "storage": "signup|purchase"}


def _rounded(df, *columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


def stage_measurement(spark, sf_dir):
    return _rounded(stages.measured(load.requests(spark, sf_dir), ["stage"], "t", RATE, "retries"), "achieved_rate")


def metrics_windows(spark, sf_dir):
    """Second by second: issued, late, behind, rates, successes and errors."""
    return _rounded(stages.windows(load.requests(spark, sf_dir), ["stage"], "t", 1000, RATE), "achieved_rate", "success_rate")


def scaling_windows(spark, sf_dir):
    """The same in windows of 2.5 seconds, for all stages together."""
    return _rounded(stages.windows(load.requests(spark, sf_dir).withColumn("run", F.lit("r")), ["run"], "t", 2500, 5 * RATE), "achieved_rate", "success_rate")


def error_reasons(spark, sf_dir):
    """Failures by reason and what is known of the mutation."""
    q = load.requests(spark, sf_dir).filter("kind IS NOT NULL")
    return q.groupBy("op", "reason", stages.outcome(F.col("kind"), F.col("said")).alias("outcome")).agg(F.count("*").alias("n"))


def latency_reasons(spark, sf_dir):
    """Failures of each stage by the six reasons, zeros included."""
    q = load.requests(spark, sf_dir).withColumn("reason", stages.latency_reason(F.col("op"), F.col("kind"), F.col("code"))).filter("reason IS NOT NULL")
    return stages.zero_filled(q.groupBy("stage", "reason").agg(F.count("*").alias("n")), stages.LATENCY_REASONS, ["stage"])


def _phased(spark, sf_dir):
    changes = spark.createDataFrame(list(PHASES), "at long, phase string")
    return stages.in_phase(load.requests(spark, sf_dir), changes, "t")


def phase_errors(spark, sf_dir):
    """Requests by the phase in which they started, kind and reason."""
    return _phased(spark, sf_dir).groupBy("phase", F.col("op").alias("kind"), F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def phase_histograms(spark, sf_dir):
    """Counts and latencies (here: a request's number, mixed) by phase and kind, in three-figure buckets."""
    rows = _phased(spark, sf_dir).withColumn("us", F.col("seq") * 7919 % 100_000 + 1)
    found = metrics.hdr_summary(metrics.hdr_histogram(rows, ["phase", "op"], "us", 60_000), ["phase", "op"])
    return found.select("phase", F.col("op").alias("kind"), "samples", "p50", "p99", "max", "over_range")


def failure_window(spark, sf_dir):
    """What reduced replication let through: mutations between the kill and the fail-over, in the victim's epoch."""
    q = load.requests(spark, sf_dir).filter(stages.in_failure_window(F.col("at_ms"), F.col("epoch"), F.col("op"), KILL, PUBLISHED, VICTIM_EPOCH))
    return stages.reduced_rf(q.withColumn("version_epoch", F.col("epoch")).withColumn("victim_epoch", F.lit(VICTIM_EPOCH)))


def _rounds(spark, sf_dir):
    """A round for each customer nation."""
    c = data.read(spark, sf_dir, "customer")
    n = F.count("*")
    return c.groupBy(F.col("c_nationkey").alias("round")).agg(
        (F.sum("c_custkey") % 97 / 10.0).alias("read_recovery"),
        F.when(F.sum("c_custkey") % 5 != 0, F.sum("c_custkey") % 89 / 10.0).alias("write_recovery"),
        n.alias("asked"),
        F.count_if(F.col("c_acctbal") > -900).alias("alive"),
        F.count_if(F.col("c_acctbal") < 0).alias("failed_probes"),
        (F.sum("c_custkey") % 3).alias("s3"),
        (F.sum("c_custkey") % 4).alias("s4"),
        (F.sum("c_custkey") % 7).alias("s7"),
    )


def availability_rollup(spark, sf_dir):
    return stages.availability(_rounds(spark, sf_dir))


def acknowledged_survival(spark, sf_dir):
    o = data.read(spark, sf_dir, "orders")
    seen = o.filter("o_orderkey % 11 <> 5").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 101 == 3, 1).otherwise(0)).alias("v"))
    return stages.survival(o.select("o_orderkey", F.col("o_custkey").alias("v")), seen, "o_orderkey", "v")


def round_verdict(spark, sf_dir):
    """The rules that each round breaks."""
    c = lambda expr: F.expr(expr)
    rounds = _rounds(spark, sf_dir).select(
        "round", c("IF(s7 = 0, 1, 0)").alias("impossible"), c("IF(s7 = 1, 0, asked)").alias("requests"), c("s4").alias("reads_after_kill"), c("s3").alias("writes_after_kill"), c("true").alias("offers_get"), c("s7 <> 2").alias("offers_put"),
        c("IF(s4 >= 2, 'follower', 'owner')").alias("scenario"), c("IF(s3 = 2, 'first_successor', 'owner_only')").alias("policy"), c("s7").alias("reduced_puts"), c("IF(s7 = 3, 4, 0)").alias("admission_rejections"), c("s7 <> 4").alias("owner_unchanged"),
        c("s3").alias("rollbacks"), c("IF(s7 = 5, 1, 0)").alias("forbidden_rollbacks"), c("IF(s7 = 6, 2, 0)").alias("undecidable"),
    )
    return stages.round_failures(rounds)


def run_status(spark, sf_dir):
    o = data.read(spark, sf_dir, "orders")
    status = stages.run_status(F.when(F.col("o_orderkey") % 9 == 0, "bad"), F.col("o_orderstatus") == "F")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def rep_medians(spark, sf_dir):
    """Median, least and most over repetitions, and how many were saturated."""
    orders, by = data.read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]
    whole = orders.groupBy(*by).agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_totalprice") > 300_000).alias("saturated"))
    return _rounded(whole.join(stages.medians(orders, by, ["o_totalprice"]).withColumnRenamed("o_totalprice", "median"), by), "median")


def successful_medians(spark, sf_dir):
    """Medians over successful repetitions, the most drops over all."""
    items = data.read(spark, sf_dir, "lineitem").withColumn("success", F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).withColumn("drops", F.col("l_orderkey") % 13)
    return _rounded(stages.sweep(items, ["l_linenumber", "l_linestatus"], "success", ["l_quantity", "l_extendedprice"], "drops"), "l_quantity", "l_extendedprice")


def rtt_crossover(spark, sf_dir):
    """Where a fitted line reaches the local ceiling of a concurrency, with the verdict against the largest x seen."""
    items = data.read(spark, sf_dir, "lineitem").withColumn("p50", F.col("l_quantity") / 1000.0).withColumn("y", F.col("l_extendedprice") / 1e6)
    fit = metrics.least_squares(items, ["l_returnflag"], "l_quantity", "y")
    local = stages.medians(items, ["l_returnflag"], ["p50"]).join(items.groupBy("l_returnflag").agg(F.max("l_quantity").alias("most")), "l_returnflag")
    top = stages.ceiling(F.lit(16.0), F.col("p50"))
    at = stages.crossover(F.lit(16.0), F.col("slope"), top)
    verdict = F.when(at.isNull(), "no rise").when(at <= F.col("most"), "reached").otherwise("not reached")
    return _rounded(fit.join(local, "l_returnflag").select("l_returnflag", top.alias("ceiling"), at.alias("crossover"), verdict.alias("verdict")), "ceiling", "crossover")


def ratio_pivot(spark, sf_dir):
    """The ratio of two systems' medians, for each case."""
    m = stages.medians(data.read(spark, sf_dir, "orders").filter("o_orderstatus IN ('F', 'O')"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])
    wide = m.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.first("o_totalprice"))
    return wide.select("o_orderpriority", F.round(F.col("F") / F.col("O"), 6).alias("ratio"))


def wait_share(spark, sf_dir):
    """Medians of lock waits and holds for each concurrency, and the waits' share."""
    items = data.read(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_discount") * 100).alias("wait"), (F.col("l_tax") * 100).alias("hold"))
    m = stages.medians(items, ["l_linenumber"], ["wait", "hold"])
    both = F.col("wait") + F.col("hold")
    return _rounded(m.select("l_linenumber", "wait", "hold", F.when(both > 0, F.col("wait") / both).otherwise(0.0).alias("share")), "wait", "hold", "share")


def lock_timing(spark, sf_dir):
    q = load.requests(spark, sf_dir).select("stage", F.col("t").alias("asked"), (F.col("t") + F.col("seq") % 7).alias("got"), (F.col("t") + F.col("seq") % 7 + F.col("seq") % 4).alias("released"))
    return _rounded(stages.lock_timing(q, "stage"), "wait_share")


def _samples(spark, sf_dir):
    return load.requests(spark, sf_dir).select(F.col("key").alias("thread"), F.array(F.element_at(F.split("op", ""), 1), F.concat("op", F.lit("_"), F.when(F.col("seq") % 3 == 0, "click").when(F.col("seq") % 3 == 1, "purchase").otherwise("view"))).alias("frames"), (F.col("seq") % 5 + 1).alias("weight"))


def cpu_profile(spark, sf_dir):
    """Weight by role of the thread and bucket of the stack; threads that wait (leaf d) apart."""
    return _rounded(stages.profile(_samples(spark, sf_dir), ROLES, BUCKETS, "^d$"), "share")


def frame_share(spark, sf_dir):
    return _rounded(stages.frame_share(_samples(spark, sf_dir), "purchase"), "share")


def cpu_percent(spark, sf_dir):
    """Processor use between samples of a worker's counter; it falls where a process is new."""
    q = load.requests(spark, sf_dir).groupBy("worker", "t").agg(F.max("seq").alias("seq"))
    return _rounded(stages.cpu_percent(q.withColumn("cpu", F.col("seq") % 1999 / 1000.0), "worker", "t", "cpu"), "percent").select("worker", "t", "percent")


def phase_cores(spark, sf_dir):
    """Cores that each worker used in each phase."""
    q = load.requests(spark, sf_dir)
    samples = q.groupBy("worker", F.col("t").alias("at")).agg((F.max("seq") * 3.0).alias("user"), (F.max("seq") * 1.0).alias("sys"))
    ends = [*[p[0] for p in PHASES[1:]], 26_000]
    phases = spark.createDataFrame([(w, p, a, b) for w in range(8) for (a, p), b in zip(PHASES, ends, strict=True)], "worker long, phase string, start long, end long")
    return _rounded(stages.phase_cores(phases, samples, "worker"), "cores", "user", "sys", "sys_share")


def phase_aggregate(spark, sf_dir):
    """All clients of a stage: rate over the common window, worst percentile, how far apart they finish."""
    q = load.requests(spark, sf_dir)
    parts = metrics.floor_rank(q.withColumn("us", F.col("seq") % 997), ["stage", "worker"], "us").select("stage", "worker", "p99")
    spans = q.groupBy("stage", "worker").agg(F.count("*").alias("requests"), F.min("t").alias("start"), F.max("t").alias("end"))
    return _rounded(stages.phase_aggregate(spans.join(parts, ["stage", "worker"]), ["stage"]), "rate", "finish_spread")


def paired_geomean(spark, sf_dir):
    """Paired systems: the geometric mean of ratios, with medians of either."""
    orders = data.read(spark, sf_dir, "orders").filter("o_totalprice > 0")
    one = orders.groupBy(F.col("o_orderpriority").alias("case"), F.month("o_orderdate").alias("rep"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("system")).agg(F.avg("o_totalprice").alias("v"))
    return _rounded(metrics.paired(one, "case", "rep", "system", "v", "a", "b"), "geomean_delta", "median_a", "median_b")


def paired_interval(spark, sf_dir):
    """The bootstrap interval of the paired ratio of each case, from 500 resamples."""
    orders = data.read(spark, sf_dir, "orders").filter("o_totalprice > 0")
    mean = lambda odd: F.avg(F.when(F.col("o_orderkey") % 2 == odd, F.col("o_totalprice")))
    pairs = orders.groupBy(F.col("o_orderpriority").alias("case"), F.month("o_orderdate").alias("rep")).agg(mean(0).alias("a"), mean(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return _rounded(stages.bootstrap(pairs.withColumn("d", F.ln(F.col("b") / F.col("a"))), "case", "d", 500), "low", "high")


def latency_curve(spark, sf_dir):
    """Points by achieved rate; those without a latency stay as gaps."""
    o = data.read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(F.col("o_totalprice") / 40_000).alias("step")).agg(F.count("*").alias("achieved"), F.max("o_orderkey").alias("last"))
    points = o.select("o_orderpriority", (F.col("achieved") * 1000 + F.col("step")).alias("achieved"), F.when(F.col("last") % 4 != 0, F.col("last")).alias("latency"))
    return stages.curve(points, ["o_orderpriority"], "achieved", "latency")


def example_caps(spark, sf_dir):
    """The first ten failed requests of each reason."""
    return stages.samples_of(load.requests(spark, sf_dir).filter("reason IS NOT NULL"), ["reason"], ["seq"], 10).select("reason", "seq")


def first_rows(spark, sf_dir):
    """The first order of each customer."""
    return stages.samples_of(data.read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 1).select("o_custkey", "o_orderkey")


def owner_sample(spark, sf_dir):
    """The first 128 keys, by number, of one owner."""
    from annulus.operators import ring

    placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, 10, 32))
    mine = placed.filter("owner = 'NATION_3'").withColumn("nr", F.substring_index("key", ":", -1).cast("long"))
    return mine.orderBy("nr").limit(128).select("key")


def replay_cursor(spark, sf_dir):
    """Events that a replay has shown at a moment and line, by kind."""
    m = data.mutations(spark, sf_dir).select("op", F.col("at_ms").alias("unix_ms"), F.col("seq").alias("line"))
    return stages.up_to_cursor(m, KILL, 0).groupBy("op").agg(F.count("*").alias("n"), F.max("unix_ms").alias("last"))


def replay_millis(spark, sf_dir):
    """Replay time summed over the ranges of each migration."""
    o = data.read(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("change")).agg(F.sum(F.col("o_orderkey") % 1000).alias("replay_ms"), F.max(F.col("o_orderkey") % 1000).alias("slowest"), F.count("*").alias("ranges"))


def oracle_sql():
    m = f"WITH {_BASE.split('w AS (')[0].rstrip().rstrip(',')}"
    q = f"{m}, {load.SQL}"
    phase = "CASE " + " ".join(f"WHEN t >= {at} THEN '{name}'" for at, name in reversed(PHASES)) + f" ELSE '{PHASES[0][1]}' END"
    window = lambda ms, rate, by: f"SELECT {by}, t // {ms} * {ms} AS start, count(*) FILTER (NOT late) AS issued, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND reason IS NULL) AS successes, count(*) FILTER (NOT late AND reason IS NOT NULL) AS errors, greatest(floor({ms / 1000}::DOUBLE * {rate})::BIGINT - count(*), 0) AS behind, round(count(*) FILTER (NOT late) / {ms / 1000}::DOUBLE, 6) AS achieved_rate, CASE WHEN count(*) FILTER (NOT late) > 0 THEN round(count(*) FILTER (NOT late AND reason IS NULL) * 1000.0::DOUBLE / {ms}, 6) END AS success_rate FROM q GROUP BY ALL"
    rounds = "r AS (SELECT c_nationkey AS round, sum(c_custkey)::BIGINT AS s, count(*) AS asked, count(*) FILTER (c_acctbal > -900) AS alive, count(*) FILTER (c_acctbal < 0) AS failed_probes FROM customer GROUP BY 1)"
    rules = [
        ("impossible value", "s % 7 = 0"), ("no requests", "s % 7 = 1"), ("no get after the kill", "s % 4 = 0"), ("no put after the kill", "s % 7 <> 2 AND s % 3 = 0"),
        ("no put at reduced replication", "s % 4 >= 2 AND s % 3 <> 2 AND s % 7 <> 2 AND s % 7 = 0"), ("admission rejections at reduced replication", "s % 4 >= 2 AND s % 3 <> 2 AND s % 7 = 3"), ("owner changed", "s % 7 = 4"),
        ("forbidden rollback", "CASE WHEN s % 4 >= 2 OR s % 3 = 2 THEN s % 3 > 0 ELSE s % 7 = 5 END"), ("undecidable reads", "s % 7 = 6"),
    ]
    sh = "greatest(0, length(bin(v)) - 11)"
    prof = f"p AS (SELECT CASE WHEN regexp_matches(key, '{ROLES['worker']}') THEN 'worker' WHEN regexp_matches(key, '{ROLES['replicator']}') THEN 'replicator' ELSE 'other' END AS role, CASE WHEN op = 'delete' THEN 'parked' WHEN seq % 3 = 0 THEN 'network' WHEN seq % 3 = 1 THEN 'storage' ELSE 'other' END AS bucket, sum(seq % 5 + 1)::BIGINT AS weight FROM q GROUP BY ALL)"
    ends = [*[p[0] for p in PHASES[1:]], 26_000]
    cores = ", ".join(f"({a}, '{p}', {b})" for (a, p), b in zip(PHASES, ends, strict=True))
    at = lambda edge: f"ps JOIN (SELECT worker AS w0, min(ms) AS least, arg_min(s, ms) AS first FROM smp GROUP BY 1) f ON f.w0 = ps.worker ASOF LEFT JOIN smp ON smp.worker = ps.worker AND ps.{edge} >= smp.ms"
    pairs = "pr AS (SELECT o_orderpriority AS \"case\", month(o_orderdate) AS rep, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL)"
    from annulus.plans import placement

    return {
        "stage_measurement": f"{q}, s AS (SELECT stage, t // 1000 AS x, count(*) AS n FROM q GROUP BY 1, 2), z AS (SELECT stage, bool_or(n < {RATE}::INT) AS saturated FROM s GROUP BY 1) SELECT stage, count(*) FILTER (NOT late) AS issued, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND reason IS NULL) AS completed, count(*) FILTER (NOT late AND reason IS NOT NULL) AS failed, (max(t) - min(t)) / 1000.0::DOUBLE AS seconds, round(count(*) FILTER (NOT late AND reason IS NULL) / greatest((max(t) - min(t)) / 1000.0::DOUBLE, 2.220446049250313e-16), 6) AS achieved_rate, any_value(saturated) AS saturated, max(retries) - min(retries) AS retries, true AS accounted FROM q JOIN z USING (stage) GROUP BY stage",
        "metrics_windows": f"{q} {window(1000, RATE, 'stage')}",
        "scaling_windows": f"{q} {window(2500, 5 * RATE, chr(39) + 'r' + chr(39) + ' AS run')}",
        "error_reasons": f"{q} SELECT op, reason, CASE kind WHEN 'missing_version' THEN 'may_have_applied' WHEN 'topology' THEN 'known_not_applied' ELSE said END AS outcome, count(*) AS n FROM q WHERE kind IS NOT NULL GROUP BY ALL",
        "latency_reasons": f"{q}, l AS (SELECT stage, CASE WHEN kind = 'missing_version' AND op = 'delete' THEN NULL WHEN kind = 'operation' AND code = 'NotFound' AND op = 'get' THEN 'not_found' WHEN kind = 'topology_refresh' THEN 'topology' WHEN kind = 'missing_version' THEN 'protocol' ELSE kind END AS reason FROM q) SELECT s.stage, r AS reason, count(l.reason) AS n FROM (SELECT DISTINCT stage FROM l WHERE reason IS NOT NULL) s CROSS JOIN (SELECT unnest({list(stages.LATENCY_REASONS)}) AS r) LEFT JOIN l ON l.stage = s.stage AND l.reason = r GROUP BY ALL",
        "phase_errors": f"{q} SELECT {phase} AS phase, op AS kind, coalesce(reason, 'ok') AS reason, count(*) AS n FROM q GROUP BY ALL",
        "phase_histograms": f"{q}, b AS (SELECT {phase} AS phase, op AS kind, seq * 7919 % 100000 + 1 AS us, least(us, 60000) AS v FROM q), t AS (SELECT *, ((v >> {sh}) << {sh}) + (1::BIGINT << {sh}) - 1 AS top FROM b), g AS (SELECT phase, kind, list_sort(list(top)) AS x, count(*) AS n, count(*) FILTER (us > 60000) AS over_range FROM t GROUP BY 1, 2) SELECT phase, kind, n AS samples, x[greatest(1, ceil(n * 0.5))::BIGINT] AS p50, x[greatest(1, ceil(n * 0.99))::BIGINT] AS p99, x[n] AS max, over_range FROM g",
        "failure_window": f"{q} SELECT count(*) FILTER (reason IS NULL AND op = 'put') AS puts, count(*) FILTER (reason IS NULL AND op = 'delete') AS deletes, count(*) FILTER (reason IN ('temporarily_unavailable', 'replica_not_ready')) AS admission_rejections, count(*) FILTER (reason = 'resource_exhausted') AS capacity_errors FROM q WHERE at_ms > {KILL} AND at_ms < {PUBLISHED} AND epoch = {VICTIM_EPOCH} AND op <> 'get'",
        "availability_rollup": f"WITH {rounds} SELECT count(*) AS rounds, max(s % 97 / 10.0::DOUBLE) AS max_read_recovery, max(CASE WHEN s % 5 <> 0 THEN s % 89 / 10.0::DOUBLE END) AS max_write_recovery, count(*) FILTER (s % 5 = 0) AS writes_not_recovered, sum(asked - alive)::BIGINT AS keys_lost, sum(failed_probes)::BIGINT AS failed_probes FROM r",
        "acknowledged_survival": "SELECT count(*) AS asked, count(*) FILTER (o_orderkey % 11 <> 5 AND o_orderkey % 101 <> 3) AS alive, count(*) FILTER (o_orderkey % 11 = 5 OR o_orderkey % 101 = 3) AS lost FROM orders",
        "round_verdict": f"WITH {rounds} " + " UNION ALL ".join(f"SELECT round, '{rule}' AS rule FROM r WHERE {holds}" for rule, holds in rules),
        "run_status": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'success' ELSE 'incomplete' END AS status, count(*) AS n FROM orders GROUP BY 1",
        "rep_medians": "SELECT o_orderpriority, o_orderstatus, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) FILTER (o_totalprice > 300000) AS saturated FROM orders GROUP BY 1, 2",
        "successful_medians": "SELECT l_linenumber, l_linestatus, count(*) AS runs, max(l_orderkey % 13) AS drops, round(median(l_quantity) FILTER (l_returnflag <> 'R'), 6) AS l_quantity, round(median(l_extendedprice) FILTER (l_returnflag <> 'R'), 6) AS l_extendedprice FROM lineitem GROUP BY 1, 2",
        "rtt_crossover": "SELECT l_returnflag, round(c, 6) AS ceiling, round(x, 6) AS crossover, CASE WHEN x IS NULL THEN 'no rise' WHEN x <= most THEN 'reached' ELSE 'not reached' END AS verdict FROM (SELECT *, CASE WHEN slope > 0 AND c > 0 THEN 16.0::DOUBLE / (slope * c) END AS x FROM (SELECT l_returnflag, regr_slope(l_extendedprice / 1e6, l_quantity) AS slope, 16.0::DOUBLE / median(l_quantity / 1000.0::DOUBLE) AS c, max(l_quantity) AS most FROM lineitem GROUP BY 1))",
        "ratio_pivot": "SELECT o_orderpriority, round(median(o_totalprice) FILTER (o_orderstatus = 'F') / median(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS ratio FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
        "wait_share": "SELECT l_linenumber, round(w, 6) AS wait, round(h, 6) AS hold, round(CASE WHEN w + h > 0 THEN w / (w + h) ELSE 0 END, 6) AS share FROM (SELECT l_linenumber, median(l_discount * 100) AS w, median(l_tax * 100) AS h FROM lineitem GROUP BY 1)",
        "lock_timing": f"{q} SELECT stage, count(*) AS acquisitions, sum(seq % 7)::BIGINT AS wait, max(seq % 7) AS max_wait, sum(seq % 4)::BIGINT AS hold, max(seq % 4) AS max_hold, round(sum(seq % 7) / (sum(seq % 7) + sum(seq % 4)), 6) AS wait_share FROM q GROUP BY 1",
        "cpu_profile": f"{q}, {prof} SELECT role, bucket, weight, CASE WHEN bucket <> 'parked' THEN round(weight / sum(weight) FILTER (bucket <> 'parked') OVER (PARTITION BY role), 6) END AS share FROM p",
        "frame_share": f"{q} SELECT sum(seq % 5 + 1)::BIGINT AS weight, sum(CASE WHEN seq % 3 = 1 THEN seq % 5 + 1 ELSE 0 END)::BIGINT AS within, round(sum(CASE WHEN seq % 3 = 1 THEN seq % 5 + 1 ELSE 0 END) / sum(seq % 5 + 1), 6) AS share FROM q",
        "cpu_percent": f"{q}, c AS (SELECT worker, t, max(seq) % 1999 / 1000.0::DOUBLE AS cpu FROM q GROUP BY 1, 2), d AS (SELECT worker, t, t - lag(t) OVER w AS dt, cpu - lag(cpu) OVER w AS dc FROM c WINDOW w AS (PARTITION BY worker ORDER BY t)) SELECT worker, t, CASE WHEN dt > 0 AND dc >= 0 THEN round(dc * 1000.0::DOUBLE / dt * 100.0::DOUBLE, 6) END AS percent FROM d",
        "phase_cores": f"{q}, smp AS (SELECT worker, t AS ms, max(seq)::DOUBLE AS s FROM q GROUP BY 1, 2), ps AS (SELECT DISTINCT worker, a, p, b FROM (SELECT unnest(range(8)) AS worker) CROSS JOIN (VALUES {cores}) v(a, p, b)), x AS (SELECT ps.worker, p, coalesce(s, first) AS s0 FROM {at('a')}), y AS (SELECT ps.worker, p, (b - a) / 1000.0::DOUBLE AS sec, coalesce(s, first) AS s1 FROM {at('b')}) SELECT worker, p AS phase, round((s1 - s0) * 4 / sec, 6) AS cores, round((s1 - s0) * 3 / sec, 6) AS user, round((s1 - s0) / sec, 6) AS sys, CASE WHEN s1 > s0 THEN 0.25 ELSE 0.0 END::DOUBLE AS sys_share FROM x JOIN y USING (worker, p)",
        "phase_aggregate": f"{q}, c AS (SELECT stage, worker, count(*) AS n, min(t) AS a, max(t) AS b, list_sort(list(seq % 997))[((count(*) - 1) * 99) // 100 + 1] AS p99 FROM q GROUP BY 1, 2) SELECT stage, sum(n)::BIGINT AS requests, CASE WHEN max(b) > min(a) THEN round(sum(n) * 1000.0::DOUBLE / (max(b) - min(a)), 6) END AS rate, max(p99) AS worst_p99, CASE WHEN min(b - a) > 0 THEN round(max(b - a) / min(b - a), 6) END AS finish_spread FROM c GROUP BY 1",
        "paired_geomean": "WITH o AS (SELECT o_orderpriority AS \"case\", month(o_orderdate) AS rep, o_orderkey % 2 AS s, avg(o_totalprice) AS v FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2, 3) SELECT a.\"case\", count(*) AS pairs, round(exp(avg(ln(b.v / a.v))) - 1, 6) AS geomean_delta, round(median(a.v), 6) AS median_a, round(median(b.v), 6) AS median_b FROM o a JOIN o b ON a.\"case\" = b.\"case\" AND a.rep = b.rep AND a.s = 0 AND b.s = 1 GROUP BY 1",
        "paired_interval": f"WITH {pairs}, ds AS (SELECT \"case\", list(ln(b / a) ORDER BY ln(b / a)) AS d FROM pr GROUP BY 1), rs AS (SELECT \"case\", d, unnest(range(500)) AS r FROM ds), me AS (SELECT \"case\", list_avg(list_transform(range(len(d)), lambda i: d[('0x' || substr(md5('b:' || \"case\" || ':' || r || ':' || i), 1, 15))::BIGINT % len(d) + 1])) AS m FROM rs), k AS (SELECT *, row_number() OVER (PARTITION BY \"case\" ORDER BY m) AS k FROM me) SELECT \"case\", round(exp(max(m) FILTER (k = 12)) - 1, 6) AS low, round(exp(max(m) FILTER (k = 488)) - 1, 6) AS high FROM k GROUP BY 1",
        "latency_curve": "SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY achieved) AS nth, achieved, CASE WHEN last % 4 <> 0 THEN last END AS latency FROM (SELECT o_orderpriority, count(*) * 1000 + floor(o_totalprice / 40000)::BIGINT AS achieved, max(o_orderkey) AS last FROM orders GROUP BY o_orderpriority, floor(o_totalprice / 40000)::BIGINT)",
        "example_caps": f"{q} SELECT reason, seq FROM q WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY seq) <= 10",
        "first_rows": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
        "owner_sample": placement._with(placement._ring_sql("t", 10, 32), placement._keys_sql(), placement._place_sql("t"), select="SELECT key FROM t_placed WHERE owner = 'NATION_3' ORDER BY split_part(key, ':', 2)::BIGINT LIMIT 128"),
        "replay_cursor": f"{m} SELECT op, count(*) AS n, max(at_ms) AS last FROM m WHERE (at_ms, seq) <= ({KILL}, 0) GROUP BY 1",
        "replay_millis": "SELECT o_custkey % 50 AS change, sum(o_orderkey % 1000)::BIGINT AS replay_ms, max(o_orderkey % 1000) AS slowest, count(*) AS ranges FROM orders GROUP BY 1",
    }


def queries():
    return {name: globals()[name] for name in oracle_sql()}
