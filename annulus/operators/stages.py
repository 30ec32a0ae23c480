"""What a load test measured: requests by stage, phase, window and reason; recoveries; profiles; repetitions; comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The codes of failed operations, and the reasons that they are reported as.
CODES = {
    "NotFound": "not_found",
    "Moved": "moved",
    "RangeBusy": "range_busy",
    "Unavailable": "unavailable",
    "DeadlineExceeded": "deadline",
    "TooLarge": "too_large",
    "ResourceExhausted": "resource_exhausted",
    "InvalidArgument": "invalid_argument",
    "MutationIdConflict": "mutation_id_conflict",
    "TemporarilyUnavailable": "temporarily_unavailable",
    "OutcomeUnknown": "outcome_unknown",
    "ReplicaNotReady": "replica_not_ready",
    "LeaseExpired": "lease_expired",
    "Unspecified": "operation",
}
# The reasons of other failures of a client.
KINDS = {"deadline": "deadline", "topology": "topology", "topology_refresh": "topology_refresh", "rpc": "rpc", "missing_version": "protocol"}
# The reasons that a latency run counts, none left out.
LATENCY_REASONS = ("deadline", "not_found", "operation", "protocol", "rpc", "topology")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def reason(kind: Column, code: Column) -> Column:
    """The reason of a failure (kind `operation` with a code, or another kind); null for a success (no kind)."""
    return F.when(kind == "operation", F.coalesce(_lookup(CODES, code), F.lit("operation"))).otherwise(_lookup(KINDS, kind))


def latency_reason(op: Column, kind: Column, code: Column) -> Column:
    """The reason that a latency run counts: a delete of what is gone is no failure; a missing key is one of its own for reads only."""
    failed = F.when((kind == "operation") & (code == "NotFound") & (op == "get"), "not_found").when(kind == "topology_refresh", "topology").otherwise(_lookup({"operation": "operation"} | KINDS, kind))
    return F.when((kind == "missing_version") & (op == "delete"), None).otherwise(failed)


def outcome(kind: Column, said: Column) -> Column:
    """Whether a failed mutation may have been applied: as the failure says; without a version it may, without a topology it can't."""
    return F.when(kind == "missing_version", "may_have_applied").when(kind == "topology", "known_not_applied").otherwise(F.when(kind.isNotNull(), said))


def throughput(operations: Column, seconds: Column) -> Column:
    return operations / F.greatest(seconds, F.lit(2.220446049250313e-16))


def zero_filled(counts: DataFrame, reasons, by: list[str]) -> DataFrame:
    """(by, reason, n): every group with every reason, 0 for those that it lacks; other reasons stay."""
    all_of = counts.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, reasons))).alias("reason")).withColumn("n", F.lit(0).cast("long"))
    return counts.select(*by, "reason", "n").unionByName(all_of).groupBy(*by, "reason").agg(F.sum("n").alias("n"))


def measured(requests: DataFrame, by: list[str], at: str, rate: float, retries: str) -> DataFrame:
    """(by, issued, late, completed, failed, seconds, achieved_rate, saturated, retries, accounted) of stages of requests (at, in ms; reason; late; a counter of retries): a late request was dropped and isn't issued. Saturated: issued less than the rate asks for in a whole second. Accounted: what was issued has come back."""
    issued, ok = F.count_if(~F.col("late")), F.count_if(~F.col("late") & F.col("reason").isNull())
    failed = F.count_if(~F.col("late") & F.col("reason").isNotNull())
    seconds = (F.max(at) - F.min(at)) / 1000.0
    second = requests.groupBy(*by, F.floor(F.col(at) / 1000).alias("_second")).agg(issued.alias("n"), F.count_if("late").alias("l"))
    full = second.groupBy(*by).agg(F.count_if(behind(F.lit(1.0), F.lit(rate), F.col("n"), F.col("l")) > 0).alias("saturated_seconds"))
    rolled = requests.groupBy(*by).agg(issued.alias("issued"), F.count_if("late").alias("late"), ok.alias("completed"), failed.alias("failed"), seconds.alias("seconds"), (F.max(retries) - F.min(retries)).alias("retries"))
    accounted = F.col("completed") + F.col("failed") == F.col("issued")
    return rolled.join(full, by).select(*by, "issued", "late", "completed", "failed", "seconds", throughput(F.col("completed"), F.col("seconds")).alias("achieved_rate"), (F.col("saturated_seconds") > 0).alias("saturated"), "retries", accounted.alias("accounted"))


def behind(seconds: Column, rate: Column, issued: Column, late: Column) -> Column:
    """How many requests a window of the sender lacks: dropped ones were sent for."""
    return F.greatest(F.floor(seconds * rate) - issued - late, F.lit(0))


def windows(requests: DataFrame, by: list[str], at: str, millis: int, rate: float) -> DataFrame:
    """(by, start, issued, late, behind, achieved_rate, successes, errors, success_rate): tumbling windows of requests. Rates are a second; null where there is nothing to divide by or nothing came back."""
    start = F.floor(F.col(at) / millis) * millis
    grouped = requests.groupBy(*by, start.alias("start")).agg(
        F.count_if(~F.col("late")).alias("issued"), F.count_if("late").alias("late"), F.count_if(~F.col("late") & F.col("reason").isNull()).alias("successes"), F.count_if(~F.col("late") & F.col("reason").isNotNull()).alias("errors")
    )
    seconds = F.lit(millis / 1000.0)
    return grouped.select("*", behind(seconds, F.lit(rate), F.col("issued"), F.col("late")).alias("behind"), (F.col("issued") / seconds).alias("achieved_rate"), F.when(F.col("successes") + F.col("errors") > 0, F.col("successes") * 1000.0 / millis).alias("success_rate"))


def cpu_percent(samples: DataFrame, by: str, at: str, seconds: str) -> DataFrame:
    """samples with `percent`: processor time between two samples over the time between them; null at the first, where no time passed, or where the counter fell."""
    order = W.partitionBy(by).orderBy(at)
    passed, used = F.col(at) - F.lag(at).over(order), F.col(seconds) - F.lag(seconds).over(order)
    return samples.withColumn("percent", F.when((passed > 0) & (used >= 0), used * 1000.0 / passed * 100.0))


def in_phase(requests: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """requests with `phase`: that of the last change (at, phase) at or before their start, else of the first. There are few changes, so they travel as one array."""
    line = changes.agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("at"), "phase"))).alias("_line"))
    past = F.filter("_line", lambda c: c["at"] <= F.col(at))
    return requests.join(F.broadcast(line)).withColumn("phase", F.coalesce(F.get(past, F.size(past) - 1)["phase"], F.get("_line", F.lit(0))["phase"])).drop("_line")


def in_failure_window(at: Column, start_epoch: Column, op: Column, kill: int, published: int, victim_epoch: int) -> Column:
    """Mutations that began after the kill and before the fail-over was published, in the victim's epoch."""
    return (at > kill) & (at < published) & (start_epoch == victim_epoch) & (op != "get")


def reduced_rf(requests: DataFrame) -> DataFrame:
    """(puts, deletes, admission_rejections, capacity_errors) of requests in a failure window (op, reason, epoch of the version, victim_epoch)."""
    done = F.col("reason").isNull() & (F.col("version_epoch") == F.col("victim_epoch"))
    return requests.agg(F.count_if(done & (F.col("op") == "put")).alias("puts"), F.count_if(done & (F.col("op") == "delete")).alias("deletes"), F.count_if(F.col("reason").isin("temporarily_unavailable", "replica_not_ready")).alias("admission_rejections"), F.count_if(F.col("reason") == "resource_exhausted").alias("capacity_errors"))


def availability(rounds: DataFrame) -> DataFrame:
    """The rollup of rounds (recovery in seconds for reads and, null if it failed, writes; keys asked for and alive; probes that failed): the slowest recoveries, what was lost."""
    return rounds.agg(
        F.count("*").alias("rounds"),
        F.max("read_recovery").alias("max_read_recovery"),
        F.max("write_recovery").alias("max_write_recovery"),
        F.count_if(F.col("write_recovery").isNull()).alias("writes_not_recovered"),
        F.sum(F.col("asked") - F.col("alive")).alias("keys_lost"),
        F.sum("failed_probes").alias("failed_probes"),
    )


def survival(asked: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """(asked, alive, lost) of acknowledged keys: alive are those that are observed with the acknowledged value."""
    both = asked.select(key, F.col(value).alias("_a")).join(observed.select(key, F.col(value).alias("_b")), key, "left")
    return both.agg(F.count("*").alias("asked"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("alive"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("lost"))


def run_status(error: Column, finished: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(finished, "success").otherwise("incomplete")


def round_failures(rounds: DataFrame) -> DataFrame:
    """(round, rule) for each rule that a round breaks: (round, impossible, requests, reads_after_kill, writes_after_kill, offers_get, offers_put, scenario, policy, reduced_puts, admission_rejections, owner_unchanged, rollbacks, forbidden_rollbacks, undecidable)."""
    follower = F.col("scenario") == "follower"
    lax = follower & (F.col("policy") == "owner_only")
    forbidden = F.when(follower | (F.col("policy") != "owner_only"), F.col("rollbacks")).otherwise(F.col("forbidden_rollbacks"))
    rules = {
        "impossible value": F.col("impossible") > 0,
        "no requests": F.col("requests") == 0,
        "no get after the kill": F.col("offers_get") & (F.col("reads_after_kill") == 0),
        "no put after the kill": F.col("offers_put") & (F.col("writes_after_kill") == 0),
        "no put at reduced replication": lax & F.col("offers_put") & (F.col("reduced_puts") == 0),
        "admission rejections at reduced replication": lax & (F.col("admission_rejections") > 0),
        "owner changed": ~F.col("owner_unchanged"),
        "forbidden rollback": forbidden > 0,
        "undecidable reads": F.col("undecidable") > 0,
    }
    broken = F.array_compact(F.array(*[F.when(holds, F.lit(rule)) for rule, holds in rules.items()]))
    return rounds.select("round", F.explode(broken).alias("rule"))


def medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, the exact median of each value). Equal values are counted first and the counts summed in order, so that no task holds a group; nulls don't count."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_x")).select(*by, "_x.*").filter("_v IS NOT NULL")
    counts = long.groupBy(*by, "_name", "_v").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*by, "_name").orderBy("_v")
    upto = counts.withColumn("_upto", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_all", F.sum("_n").over(W.partitionBy(*by, "_name")))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col("_v")))
    middle = upto.groupBy(*by, "_name").agg(((at(F.ceil(F.col("_all") / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("_median"))
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == v, F.col("_median"))).alias(v) for v in values])


def sweep(rows: DataFrame, by: list[str], success: str, values: list[str], worst: str) -> DataFrame:
    """(by, runs, medians over successful repetitions, the maximum of `worst` over all): null medians where none succeeded."""
    whole = rows.groupBy(*by).agg(F.count("*").alias("runs"), F.max(worst).alias(worst))
    return whole.join(medians(rows.filter(F.col(success) == 1), by, values), by, "left")


def ceiling(concurrency: Column, p50_seconds: Column) -> Column:
    """The throughput that closed-loop clients can reach."""
    return F.when(p50_seconds > 0, concurrency / p50_seconds)


def crossover(concurrency: Column, slope: Column, local_ceiling: Column) -> Column:
    """The round trip at which a fitted line falls to a ceiling; null without a rise."""
    return F.when((slope > 0) & (local_ceiling > 0), concurrency / (slope * local_ceiling))


def profile(samples: DataFrame, roles: dict[str, str], buckets: dict[str, str], parked: str, weight: str = "weight") -> DataFrame:
    """(role, bucket, weight, share): samples (thread, frames from the leaf, weight) by the first rule whose pattern is in the thread's name, and the first whose pattern is in some frame; threads that wait (pattern parked in the leaf) are a bucket of their own and have no share."""
    first = lambda column, rules, rest: F.coalesce(*[F.when(column(pattern), F.lit(name)) for name, pattern in rules.items()], F.lit(rest))
    role = first(lambda p: F.col("thread").rlike(p), roles, "other")
    in_frame = lambda p: F.exists("frames", lambda f: f.rlike(p))
    bucket = F.when(F.get("frames", F.lit(0)).rlike(parked), "parked").otherwise(first(in_frame, buckets, "other"))
    summed = samples.groupBy(role.alias("role"), bucket.alias("bucket")).agg(F.sum(weight).alias("weight"))
    busy = F.sum(F.when(F.col("bucket") != "parked", F.col("weight"))).over(W.partitionBy("role"))
    return summed.withColumn("share", F.when(F.col("bucket") != "parked", F.col("weight") / busy))


def frame_share(samples: DataFrame, pattern: str, weight: str = "weight") -> DataFrame:
    """(weight, within, share): how much of all samples has a frame of a pattern."""
    within = F.sum(F.when(F.exists("frames", lambda f: f.rlike(pattern)), F.col(weight)).otherwise(0))
    return samples.agg(F.sum(weight).alias("weight"), within.alias("within"), F.when(F.sum(weight) > 0, within / F.sum(weight)).otherwise(0.0).alias("share"))


def lock_timing(spans: DataFrame, by: str) -> DataFrame:
    """(by, acquisitions, total and longest wait and hold, wait_share) of spans (asked, got, released)."""
    wait, hold = F.col("got") - F.col("asked"), F.col("released") - F.col("got")
    share = F.when(F.sum(wait) + F.sum(hold) > 0, F.sum(wait) / (F.sum(wait) + F.sum(hold))).otherwise(0.0)
    return spans.groupBy(by).agg(F.count("*").alias("acquisitions"), F.sum(wait).alias("wait"), F.max(wait).alias("max_wait"), F.sum(hold).alias("hold"), F.max(hold).alias("max_hold"), share.alias("wait_share"))


def phase_cores(phases: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """(by, phase, cores, user, sys, sys_share) from cumulative processor times (at, user, sys) at the ends of each phase (phase, start, end, in ms): as of the last sample at or before each, else the first."""
    from annulus.operators.metrics import as_of

    ends = phases.select(by, "phase", "start", "end", F.explode(F.array(F.struct(F.lit(0).alias("last"), F.col("start").alias("at")), F.struct(F.lit(1).alias("last"), F.col("end").alias("at")))).alias("x")).select(by, "phase", "start", "end", "x.*")
    known = as_of(ends, samples.select(by, "at", F.struct("user", "sys").alias("cpu")), by, "at", "cpu")
    pick = lambda last, field: F.max(F.when(F.col("last") == last, F.col("cpu")[field]))
    used = lambda field: pick(1, field) - pick(0, field)
    seconds = (F.max("end") - F.max("start")) / 1000.0
    rolled = known.groupBy(by, "phase").agg(seconds.alias("seconds"), used("user").alias("u"), used("sys").alias("s"))
    per = lambda c: F.when(F.col("seconds") > 0, c / F.col("seconds"))
    both = F.col("u") + F.col("s")
    return rolled.select(by, "phase", per(both).alias("cores"), per(F.col("u")).alias("user"), per(F.col("s")).alias("sys"), F.when(both > 0, F.col("s") / both).otherwise(0.0).alias("sys_share"))


def phase_aggregate(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, requests a second, worst percentile, finish spread) over the clients of a phase (requests, p99, start, end): all requests over the window from first start to last end; the spread is the slowest client's time over the fastest's."""
    took = F.col("end") - F.col("start")
    window = F.max("end") - F.min("start")
    return parts.groupBy(*by).agg(F.sum("requests").alias("requests"), F.when(window > 0, F.sum("requests") * 1000.0 / window).alias("rate"), F.max("p99").alias("worst_p99"), F.when(F.min(took) > 0, F.max(took) / F.min(took)).alias("finish_spread"))


def bootstrap(pairs: DataFrame, case: str, delta: str, resamples: int, seed: str = "b") -> DataFrame:
    """(case, low, high): the 95 % interval of a case's mean log ratio, back as a delta, over resamples of its pairs with replacement. Which pairs a resample takes is a hash of seed, case, resample and draw, so it is the same on every run. A case has few pairs (repetitions), which travel as one array; resamples are rows."""
    from annulus.functions.tokens import portable_token

    cases = pairs.groupBy(case).agg(F.array_sort(F.collect_list(delta)).alias("_d"))
    each = cases.select(case, "_d", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    draw = lambda i: F.get("_d", F.pmod(portable_token(F.concat_ws(":", F.lit(seed), F.col(case), F.col("_r").cast("string"), i.cast("string"))), F.size("_d")).cast("int"))
    mean = F.aggregate(F.sequence(F.lit(0), F.size("_d") - 1), F.lit(0.0), lambda a, i: a + draw(i)) / F.size("_d")
    ranked = each.select(case, mean.alias("_m")).withColumn("_k", F.row_number().over(W.partitionBy(case).orderBy("_m")))
    low, high = max(1, math.floor(resamples * 0.025)), math.ceil(resamples * 0.975)
    at = lambda k: F.exp(F.max(F.when(F.col("_k") == k, F.col("_m")))) - 1
    return ranked.groupBy(case).agg(at(low).alias("low"), at(high).alias("high"))


def curve(points: DataFrame, by: list[str], achieved: str, latency: str) -> DataFrame:
    """(by, nth, achieved, latency): the points of a latency curve by achieved rate; a missing latency stays, as a gap."""
    order = W.partitionBy(*by).orderBy(achieved)
    return points.select(*by, F.row_number().over(order).alias("nth"), achieved, latency)


def samples_of(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group, at most so many; no more than these leave a task."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def up_to_cursor(events: DataFrame, at: int, line: int) -> DataFrame:
    """Events that a replay has shown when it stands at (at, line)."""
    return events.filter(F.struct("unix_ms", "line") <= F.struct(F.lit(at).cast("long").alias("unix_ms"), F.lit(line).cast("long").alias("line")))


def flat_stage(runs: DataFrame) -> DataFrame:
    """One flat row for each stage of runs (run, stages: arrays of structs with maps of counts by operation, errors by reason, and latency structs by operation): the maps' entries become columns ops_*, err_* and <op>_p50, <op>_p99."""
    stage = runs.select("run", F.posexplode("stages").alias("nth", "s"))
    one = lambda c, kind: F.coalesce(F.col(f"s.{kind}")[c], F.lit(0).cast("long"))
    ops = [one(op, "ops").alias(f"ops_{op}") for op in ("get", "put", "delete")]
    errors = [one(r, "errors").alias(f"err_{r}") for r in LATENCY_REASONS]
    latencies = [F.col("s.latency_us")[op][p].alias(f"{op}_{p}") for op in ("get", "put", "delete") for p in ("p50", "p99")]
    return stage.select("run", "nth", F.col("s.target_rate").alias("target_rate"), *ops, *errors, *latencies)


def merged_stats(workers: DataFrame, counts: str, samples: str, most: int) -> DataFrame:
    """(counts, samples): workers' maps of counts, summed by key, and the first samples of all, at most so many."""
    summed = workers.select(F.explode(counts).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))
    shown = workers.select(F.explode(samples).alias("s")).orderBy("s").limit(most).agg(F.array_sort(F.collect_list("s")).alias("samples"))
    return summed.join(shown)


def comparable(runs: DataFrame, left_out=("output_dir",)) -> DataFrame:
    """(field, values, same): the fields of runs' settings (run, config: JSON), with how many different values they have, key order aside; a missing field is a value of its own."""
    from annulus.functions.choices import canonical

    fields = runs.select("run", F.explode(F.variant_get(F.parse_json("config"), "$", "map<string,variant>")).alias("field", "v")).filter(~F.col("field").isin(*left_out))
    all_runs = runs.select("run").distinct()
    each = all_runs.join(F.broadcast(fields.select("field").distinct())).join(fields.select("run", "field", canonical(F.to_json("v")).alias("value")), ["run", "field"], "left")
    return each.groupBy("field").agg(F.count_distinct(F.coalesce("value", F.lit("missing"))).alias("values")).withColumn("same", F.col("values") == 1)


def pressure(nodes: DataFrame, cpu: DataFrame, rpc: DataFrame, by: list[str]) -> DataFrame:
    """(by, nodes, writes, peak, wait_s, hold_s, cores, calls): samples of nodes' pressure (by, node, writes, peak, wait_ns, hold_ns) rolled up, beside processor use (by, cores) and calls (by, calls), null where these lack."""
    rolled = nodes.groupBy(*by).agg(F.count("*").alias("nodes"), F.sum("writes").alias("writes"), F.max("peak").alias("peak"), (F.sum("wait_ns") / 1e9).alias("wait_s"), (F.sum("hold_ns") / 1e9).alias("hold_s"))
    one = lambda rows, c: rows.groupBy(*by).agg(F.sum(c).alias(c))
    return rolled.join(one(cpu, "cores"), by, "left").join(one(rpc, "calls"), by, "left")
