"""The state of a replicated cluster as tables: leases, failures, admissions, repairs, what may be written, and what is wrong.

Ranges are (start, end, owner, followers). Tables about a follower of a range have start, end, owner and node_id; they are as many as ranges times followers, which a ring bounds, and are joined by these four columns. Keys, the large side, meet ranges in ring.ring_join only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.operators import ring

TASK = ["start", "end", "owner", "node_id"]
OWNER_ONLY, FIRST_SUCCESSOR, ALL_REPLICAS = "owner_only", "first_successor", "all_replicas"


@dataclass(frozen=True)
class Guard:
    """What a range needs before writes are let in."""

    minimum_admitted_copies: int = 1
    minimum_healthy_followers: int = 0
    max_replica_lag_millis: int = 1_000


def live_leases(grants: DataFrame, instances: DataFrame, fenced: DataFrame, epoch: int, now: int) -> DataFrame:
    """(node_id): nodes whose lease (node_id, epoch, instance, expires_at) is of the epoch, not over, of the process that is registered (node_id, instance), and not fenced."""
    fresh = grants.filter((F.col("epoch") == epoch) & (F.col("expires_at") > now))
    return fresh.join(instances, ["node_id", "instance"], "left_semi").join(fenced, "node_id", "left_anti").select("node_id").distinct()


def known_nodes(*tables: DataFrame) -> DataFrame:
    """(node_id): every node that one of the tables names."""
    out = tables[0].select("node_id")
    for t in tables[1:]:
        out = out.union(t.select("node_id"))
    return out.distinct()


def failures_confirmed(targets: DataFrame, live: DataFrame, reports: DataFrame, now: int, lease_millis: int, freshness_millis: int) -> DataFrame:
    """(node_id, leased, reporters, confirmed) of each target: confirmed at once without a lease; else by two other nodes with a lease whose reports (target, reporter, first_seen, last_seen) have lasted a lease and are fresh."""
    counted = reports.filter((F.col("reporter") != F.col("target")) & (F.col("first_seen") + lease_millis <= now) & (F.col("last_seen") + freshness_millis >= now))
    seen = counted.join(live.withColumnRenamed("node_id", "reporter"), "reporter", "left_semi").groupBy(F.col("target").alias("node_id")).agg(F.count_distinct("reporter").alias("reporters"))
    both = targets.select("node_id").distinct().join(live.withColumn("leased", F.lit(True)), "node_id", "left").join(seen, "node_id", "left")
    leased, reporters = F.coalesce("leased", F.lit(False)), F.coalesce("reporters", F.lit(0))
    return both.select("node_id", leased.alias("leased"), reporters.alias("reporters"), (~leased | (reporters >= 2)).alias("confirmed"))


def tasks(ranges: DataFrame) -> DataFrame:
    """(start, end, owner, node_id, pos): a row for each follower that a range should have."""
    return ranges.select("start", "end", "owner", F.posexplode("followers").alias("pos", "node_id"))


def valid_admissions(admissions: DataFrame, instances: DataFrame, fenced: DataFrame) -> DataFrame:
    """Admissions of processes that are still the registered ones, on nodes that aren't fenced."""
    return admissions.join(instances, ["node_id", "instance"], "left_semi").join(fenced, "node_id", "left_anti")


def follower_status(ranges: DataFrame, live: DataFrame, instances: DataFrame, fenced: DataFrame, admissions: DataFrame, repairs: DataFrame, progress: DataFrame, guard: Guard) -> DataFrame:
    """(start, end, owner, node_id, pos, admitted, leased, lag_known, lag_millis, stream_head, stream_cursor, repair_state, healthy): each follower, with what is known of it. progress is (owner, node_id, head, cursor, lag_millis) of pairs that answer; a cursor falls back to the admission's."""
    admitted = valid_admissions(admissions, instances, fenced).select(*TASK, F.lit(True).alias("is_admitted"), F.col("cursor").alias("its_cursor"))
    flow = progress.select("owner", "node_id", "head", F.col("cursor").alias("now_cursor"), "lag_millis")
    joined = (
        tasks(ranges)
        .join(admitted, TASK, "left")
        .join(repairs.select(*TASK, "phase"), TASK, "left")
        .join(flow, ["owner", "node_id"], "left")
        .join(live.withColumn("is_leased", F.lit(True)), "node_id", "left")
    )
    known, is_admitted, leased = F.col("lag_millis").isNotNull(), F.coalesce("is_admitted", F.lit(False)), F.coalesce("is_leased", F.lit(False))
    return joined.select(
        *TASK,
        "pos",
        is_admitted.alias("admitted"),
        leased.alias("leased"),
        known.alias("lag_known"),
        F.coalesce("lag_millis", F.lit(0)).alias("lag_millis"),
        F.coalesce("head", F.lit(0)).alias("stream_head"),
        F.coalesce("now_cursor", "its_cursor", F.lit(0)).alias("stream_cursor"),
        F.coalesce("phase", F.lit("")).alias("repair_state"),
        (is_admitted & leased & known & (F.coalesce("lag_millis", F.lit(0)) <= guard.max_replica_lag_millis)).alias("healthy"),
    )


def is_required(policy: str, pos: Column) -> Column:
    """Whether a policy waits for the follower at a place."""
    return {OWNER_ONLY: F.lit(False), FIRST_SUCCESSOR: pos == 0, ALL_REPLICAS: F.lit(True)}[policy]


def overlapping(ranges: DataFrame, others: DataFrame, bits: int = 60) -> DataFrame:
    """(start, end): the ranges that overlap one of others: one holds the other's end."""
    ends = ranges.select(F.col("start").alias("own_start"), F.col("end").alias("own_end"), F.col("end").alias("token"))
    within = ring.ring_join(ends, others.select("start", "end"), bits).select(F.col("own_start").alias("start"), F.col("own_end").alias("end"))
    around = ring.ring_join(others.select(F.col("end").alias("token")), ranges.select("start", "end"), bits).select("start", "end")
    return within.union(around).distinct()


def replica_status(ranges: DataFrame, followers: DataFrame, live: DataFrame, instances: DataFrame, fenced: DataFrame, policy: str, desired_rf: int, guard: Guard, pending: str = "", cut_over: DataFrame | None = None) -> DataFrame:
    """(start, end, owner, desired_rf, current_rf, live_rf, admitted, healthy, owner_leased, writable, write_block_reason, under_replicated, repairing) of each range.

    The first rule that holds blocks writes: an activation is pending (why); a cut-over may fence the range (one of cut_over overlaps it); the owner has no lease; the placement lacks what the policy needs; too few copies are admitted or healthy; a required follower isn't healthy.
    """
    rolled = followers.groupBy("start", "end").agg(
        F.count("*").alias("followers"),
        F.count_if("admitted").alias("admitted"),
        F.count_if("healthy").alias("healthy"),
        F.count_if(F.col("admitted") & F.col("leased")).alias("alive"),
        F.bool_or(~F.col("admitted") | (F.col("repair_state") != "Complete")).alias("repairing"),
        F.min_by("node_id", F.when(is_required(policy, F.col("pos")) & ~F.col("healthy"), F.col("pos"))).alias("missing"),
    )
    mark = lambda rows, name: rows.select(F.col("node_id").alias("owner"), F.lit(True).alias(name))
    registered = instances.join(fenced, "node_id", "left_anti")
    fence = overlapping(ranges, cut_over).withColumn("fence", F.lit(True)) if cut_over is not None else ranges.select("start", "end", F.lit(False).alias("fence"))
    each = (
        ranges.select("start", "end", "owner")
        .join(rolled, ["start", "end"], "left")
        .join(mark(live, "is_leased"), "owner", "left")
        .join(mark(registered, "is_registered"), "owner", "left")
        .join(fence, ["start", "end"], "left")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        (F.lit(bool(pending)), F.lit(pending)),
        (no("fence"), F.lit("topology cutover write fence may be active")),
        (~no("is_leased"), F.lit("owner lease unavailable")),
        (F.lit(policy == FIRST_SUCCESSOR) & (n("followers") == 0), F.lit("first successor is not in desired placement")),
        (F.lit(policy == ALL_REPLICAS) & (n("followers") + 1 < desired_rf), F.lit("complete desired replication factor is unavailable")),
        ((n("admitted") + 1 < guard.minimum_admitted_copies) | (n("healthy") < guard.minimum_healthy_followers), F.lit("minimum admitted-copy or healthy-follower guard is not satisfied")),
        (F.col("missing").isNotNull(), F.concat(F.lit("required follower "), "missing", F.lit(" is not healthy and admitted"))),
    ]
    reason = F.coalesce(*[F.when(holds, why) for holds, why in rules], F.lit(""))
    live_rf = n("alive") + no("is_leased").cast("int")
    return each.select(
        "start",
        "end",
        "owner",
        F.lit(desired_rf).alias("desired_rf"),
        (n("admitted") + no("is_registered").cast("int")).alias("current_rf"),
        live_rf.alias("live_rf"),
        n("admitted").alias("admitted"),
        n("healthy").alias("healthy"),
        no("is_leased").alias("owner_leased"),
        (reason == "").alias("writable"),
        reason.alias("write_block_reason"),
        (live_rf < desired_rf).alias("under_replicated"),
        no("repairing").alias("repairing"),
    )


def policy_ready(target: DataFrame, followers: DataFrame, policy: str, desired_rf: int, guard: Guard) -> DataFrame:
    """(start, end, owner, ready) of each range of a target topology: its status is there, every admitted stream is caught up, and the guard and the required followers hold. A policy may change if all are ready."""
    known = F.col("lag_known") & (F.col("stream_cursor") == F.col("stream_head"))
    good = F.col("admitted") & known & (F.col("lag_millis") <= guard.max_replica_lag_millis)
    status = followers.groupBy("start", "end", "owner").agg(
        F.count_if("admitted").alias("admitted"),
        F.count_if(good).alias("healthy"),
        F.bool_and(~F.col("admitted") | known).alias("caught_up"),
        F.array_agg(F.when(good, F.col("node_id"))).alias("good"),
    )
    needed = {OWNER_ONLY: F.array().cast("array<string>"), FIRST_SUCCESSOR: F.slice("followers", 1, 1), ALL_REPLICAS: F.col("followers")}[policy]
    placed = F.lit(policy != ALL_REPLICAS) | (F.size("followers") + 1 >= desired_rf)
    ready = F.col("caught_up") & (F.col("admitted") + 1 >= guard.minimum_admitted_copies) & (F.col("healthy") >= guard.minimum_healthy_followers) & placed & (F.size(F.array_except(needed, F.col("good"))) == 0)
    return target.join(status, ["start", "end", "owner"], "left").select("start", "end", "owner", F.coalesce(ready, F.lit(False)).alias("ready"))


def required_followers(keys: DataFrame, ranges: DataFrame, followers: DataFrame, policy: str, desired_rf: int, guard: Guard, bits: int = 60) -> DataFrame:
    """keys with `required` (the followers that a write waits for, in order) and `error` (null, or why the write is refused)."""
    good = F.col("admitted") & F.col("lag_known") & (F.col("lag_millis") <= guard.max_replica_lag_millis)
    rolled = followers.groupBy("start", "end").agg(F.count_if("admitted").alias("_admitted"), F.count_if(good).alias("_healthy"), F.min_by("node_id", F.when(is_required(policy, F.col("pos")) & ~good, F.col("pos"))).alias("_missing"))
    per_range = ranges.join(rolled, ["start", "end"], "left")
    size, n = F.size("followers"), lambda c: F.coalesce(c, F.lit(0))
    no_guard = policy == OWNER_ONLY and guard.minimum_admitted_copies <= 1 and guard.minimum_healthy_followers == 0
    wanted = {OWNER_ONLY: F.array().cast("array<string>"), FIRST_SUCCESSOR: F.slice("followers", 1, 1), ALL_REPLICAS: F.col("followers")}[policy]
    error = F.coalesce(
        F.when(F.lit(policy == FIRST_SUCCESSOR) & (size < 1), "first successor is not in the desired placement"),
        F.when(F.lit(policy == ALL_REPLICAS) & (size + 1 < desired_rf), "complete desired replication factor is unavailable"),
        F.when(F.lit(not no_guard) & ((n("_admitted") + 1 < guard.minimum_admitted_copies) | (n("_healthy") < guard.minimum_healthy_followers)), "minimum admitted-copy or healthy-follower guard is not satisfied"),
        F.when(F.col("_missing").isNotNull(), F.concat(F.lit("required follower "), "_missing", F.lit(" is not healthy and admitted"))),
    )
    ruled = per_range.select("start", "end", error.alias("error"), wanted.alias("wanted"))
    return ring.ring_join(keys, ruled, bits).select(*keys.columns, F.when(F.col("error").isNull(), F.col("wanted")).alias("required"), "error")


def reconciled(ranges: DataFrame, instances: DataFrame, admissions: DataFrame, repairs: DataFrame, epoch: int) -> DataFrame:
    """(start, end, owner, node_id, phase, action): the repairs of a topology after a change. Those of the epoch that are still wanted stay; complete ones whose admission (of the epoch, by the registered process) is gone start again; what is wanted and has none is added; others are dropped."""
    holds = admissions.filter(F.col("epoch") == epoch).join(instances, ["node_id", "instance"], "left_semi").select(*TASK).distinct().withColumn("holds", F.lit(True))
    wanted = tasks(ranges).select(*TASK, F.lit(True).alias("wanted"))
    now = repairs.select(*TASK, F.col("epoch").alias("its_epoch"), F.col("phase").alias("was"))
    kept = F.col("wanted") & (F.col("its_epoch") == epoch)
    reset = (F.col("was") == "Complete") & F.col("holds").isNull()
    action = F.when(F.col("wanted").isNull(), "drop").when(F.coalesce(~kept, F.lit(True)), "add").when(reset, "reset").otherwise("keep")
    both = wanted.join(now, TASK, "full").join(holds, TASK, "left").withColumn("action", action)
    return both.select(*TASK, F.when(F.col("action") == "keep", F.col("was")).when(F.col("action") != "drop", F.lit("Pending")).alias("phase"), "action")


def missing_streams(old: DataFrame, target: DataFrame, admissions: DataFrame, needed: int, bits: int = 60) -> DataFrame:
    """(source, destination): pairs of nodes that a merge needs a stream between: a part's owner, and the new owner or one of its first `needed` followers that is another node and isn't admitted to the part."""
    parts = ring.constituents(old, target.select("start", "end", "owner"), bits)
    follow = F.slice("followers", 1, needed) if needed else F.array().cast("array<string>")
    takers = target.select("start", "end", F.explode(F.concat(F.array("owner"), follow)).alias("node_id"))
    pairs = parts.join(takers, ["start", "end"]).filter(F.col("node_id") != F.col("old_owner"))
    there = admissions.select(F.col("start").alias("old_start"), F.col("end").alias("old_end"), F.col("owner").alias("old_owner"), "node_id").distinct()
    return pairs.join(there, ["old_start", "old_end", "old_owner", "node_id"], "left_anti").select(F.col("old_owner").alias("source"), F.col("node_id").alias("destination")).distinct()


def state_violations(ranges: DataFrame, instances: DataFrame, fenced: DataFrame, admissions: DataFrame, repairs: DataFrame, epoch: int) -> DataFrame:
    """(rule, start, end, owner, node_id) of everything that a state must not hold; empty if it is consistent."""
    wanted = tasks(ranges).select(*TASK).withColumn("wanted", F.lit(True))
    own = admissions.join(wanted, TASK, "left").withColumn("copies", F.count("*").over(W.partitionBy(*TASK)))
    held = own.filter("copies >= 1").select(*TASK).distinct().withColumn("held", F.lit(True))
    fix = repairs.join(wanted, TASK, "left").join(held, TASK, "left").withColumn("copies", F.count("*").over(W.partitionBy(*TASK)))
    none = lambda rows: rows.select(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("owner"), "node_id")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = {
        "empty process identity": none(instances.filter(empty("node_id") | empty("instance"))),
        "empty fenced identity": none(fenced.filter(empty("node_id"))),
        "admission of another epoch": own.filter(F.col("epoch") != epoch),
        "admission without a process": own.filter(empty("instance")),
        "admission without a digest": own.filter(empty("digest")),
        "admission of no desired replica": own.filter(F.col("wanted").isNull()),
        "duplicate admission": own.filter("copies > 1"),
        "repair of another epoch": fix.filter(F.col("epoch") != epoch),
        "repair of no desired replica": fix.filter(F.col("wanted").isNull()),
        "duplicate repair": fix.filter("copies > 1"),
        "complete repair without admission": fix.filter((F.col("phase") == "Complete") & F.col("held").isNull()),
    }
    out = None
    for name, rows in rules.items():
        one = rows.select(F.lit(name).alias("rule"), *TASK)
        out = one if out is None else out.unionByName(one)
    return out


def status_of_keys(keys: DataFrame, status: DataFrame, bits: int = 60) -> DataFrame:
    """The distinct status rows of the ranges that hold the keys."""
    held = ring.ring_join(keys.select("token"), status.select("start", "end"), bits).select("start", "end").distinct()
    return status.join(held, ["start", "end"], "left_semi")


def cohort_stats(status: DataFrame) -> DataFrame:
    """(least_live_rf, under_replicated, not_writable) of a cohort's ranges; null for no range."""
    return status.agg(F.min("live_rf").alias("least_live_rf"), F.count_if("under_replicated").alias("under_replicated"), F.count_if(~F.col("writable")).alias("not_writable"))


def block_reasons(status: DataFrame) -> DataFrame:
    """(reason, ranges): how many ranges each reason blocks; one without a name counts as unnamed."""
    return status.filter(~F.col("writable")).groupBy(F.when(F.col("write_block_reason") == "", "unnamed").otherwise(F.col("write_block_reason")).alias("reason")).agg(F.count("*").alias("ranges"))


def victim(members: DataFrame, killed: DataFrame, placed: DataFrame, start: int, minimum: int, role: str = "owner") -> DataFrame:
    """(node_id, keys): the first live member, from a place on the sorted list round to it again, that owns (or, as role `follower`, follows) at least so many keys (key, owner, followers)."""
    order = W.orderBy("node_id")
    alive = members.join(killed, "node_id", "left_anti").withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    holder = F.col("owner") if role == "owner" else F.explode("followers")
    held = placed.select(holder.alias("node_id")).groupBy("node_id").agg(F.count("*").alias("keys"))
    turn = F.pmod(F.col("i") - F.lit(start), F.col("n"))
    return alive.join(held, "node_id").filter(F.col("keys") >= minimum).withColumn("turn", turn).orderBy("turn").limit(1).select("node_id", "keys")


def ring_differences(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """The rows by which a recorded ring differs from the one computed anew, with the side that has them; empty if it is canonical."""
    one = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return one(computed, recorded, "computed").unionByName(one(recorded, computed, "recorded"))


def topology_view(ranges: DataFrame, epoch: int) -> DataFrame:
    """(epoch, owner, ranges, followers): what a reader of the topology is told of each owner."""
    return ranges.groupBy("owner").agg(F.count("*").alias("ranges"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("followers")))), "|").alias("followers")).select(F.lit(epoch).alias("epoch"), "owner", "ranges", "followers")


def change_state(base_epoch: Column, target_epoch: Column, committed_epoch: Column, phase: Column) -> Column:
    """Whether an active change descends from the committed topology: by one epoch before it is published; after that, it is the committed one."""
    published = phase.isin("Published", "CleaningUp", "Complete")
    return F.when(published, (target_epoch == committed_epoch) & (base_epoch + 1 == committed_epoch)).otherwise((base_epoch == committed_epoch) & (target_epoch == committed_epoch + 1))
