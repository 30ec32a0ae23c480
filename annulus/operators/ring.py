"""Placement on a consistent-hash ring: owners, replicas, ranges, and what moves when members change.

A ring is a small table (token, node_id), bounded by members times virtual nodes (at most about a million), so windows over a whole ring run in one task and rings are broadcast. Keys are the large side; they are joined to ranges by an equi-join on high bits of the token, never by a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most ring positions; what is broadcast is a few times as many rows.
MOST_TOKENS = 1 << 20
#: Pieces of ranges (about 100 bytes each) that are broadcast at most.
BROADCAST_PARTS = 1 << 20


def build_ring(members: DataFrame, vnodes: int, token) -> DataFrame:
    """(token, node_id, vnode) for each member and virtual node; token(node_id, vnode) makes the token column."""
    each = members.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
    return each.select(token(F.col("node_id"), F.col("vnode")).alias("token"), "node_id", "vnode")


def replica_walk(ring: DataFrame, replicas: int, members: int) -> DataFrame:
    """ring with `pos` and `replicas`: the first distinct nodes clockwise from each position, itself first, at most `replicas` and as many as there are."""
    order = W.orderBy("token", "node_id")
    placed = ring.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy()))
    twice = placed.withColumn("lap", F.lit(0)).unionByName(placed.withColumn("lap", F.lit(1)))
    want, size = min(replicas, members), 64 * max(1, replicas)
    while True:
        ahead = W.orderBy("lap", "pos").rowsBetween(W.currentRow, min(MOST_TOKENS, size))
        walked = twice.withColumn("near", F.slice(F.array_distinct(F.collect_list("node_id").over(ahead)), 1, replicas))
        # Nearly always a few dozen positions hold enough nodes; only where they don't, more are looked at.
        if size >= MOST_TOKENS or walked.filter((F.col("lap") == 0) & (F.size("near") < want) & (F.col("n") > size)).isEmpty():
            break
        size *= 8
    return walked.filter("lap = 0").select("token", "node_id", "pos", F.col("near").alias("replicas"))


def derived_ranges(ring: DataFrame, replicas: int, members: int) -> DataFrame:
    """(start, end, owner, followers): one range (start, end] for each distinct token, the first wrapping from the last. A lone token is the whole ring (start = end)."""
    walk = replica_walk(ring, replicas, members)
    first = walk.withColumn("nth", F.row_number().over(W.partitionBy("token").orderBy("node_id"))).filter("nth = 1")
    order = W.orderBy("token")
    last = F.max("token").over(W.partitionBy())
    return first.select(F.coalesce(F.lag("token").over(order), last).alias("start"), F.col("token").alias("end"), F.col("node_id").alias("owner"), F.slice("replicas", 2, max(replicas - 1, 1)).alias("followers") if replicas > 1 else F.array().cast("array<string>").alias("followers"))


def contains(token: Column, start: Column, end: Column) -> Column:
    """Whether a token is in (start, end], which wraps where start > end and is the whole ring where they are equal."""
    return F.when(start == end, True).when(start < end, (token > start) & (token <= end)).otherwise((token > start) | (token <= end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return contains(a_end, b_start, b_end) | contains(b_end, a_start, a_end)


def unwrap(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """ranges with `lo` and `hi`, both inclusive: one interval, or two where the range wraps."""
    both = F.array(F.struct(F.lit(low).cast("long").alias("lo"), F.col("end").alias("hi")), F.struct((F.col("start") + 1).alias("lo"), F.lit(high).cast("long").alias("hi")))
    whole = F.array(F.struct(F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi")))
    one = F.array(F.struct((F.col("start") + 1).alias("lo"), F.col("end").alias("hi")))
    parts = F.when(F.col("start") == F.col("end"), whole).when(F.col("start") < F.col("end"), one).otherwise(F.when(F.col("start") == high, F.slice(both, 1, 1)).otherwise(both))
    return ranges.withColumn("part", F.explode(parts)).select(*ranges.columns, "part.lo", "part.hi")


def ring_join(keys: DataFrame, ranges: DataFrame, bits: int = 60, low: int = 0, buckets: int = 12, token: str = "token", how: str = "inner") -> DataFrame:
    """keys with the columns of the range that holds their token. Ranges are cut at the borders of 2^buckets equal parts of the token space (`bits` wide, from `low`), and joined by part. Up to BROADCAST_PARTS pieces, counted first, are broadcast; beyond, keys are dealt by part."""
    high = low + (1 << bits) - 1
    shift = bits - buckets
    parts = unwrap(ranges, low, high).withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    at = keys.withColumn("bucket", F.shiftright(F.col(token), shift))
    near = F.broadcast(parts) if parts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS else parts
    return at.join(near, (at["bucket"] == parts["bucket"]) & at[token].between(parts["lo"], parts["hi"]), how).drop(parts["bucket"]).drop("bucket", "lo", "hi")


def owned_keys(placed: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, owned_keys) for every member, zero where it owns none."""
    counts = placed.groupBy(F.col("owner").alias("node_id")).agg(F.count("*").alias("owned_keys"))
    return members.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("owned_keys", F.lit(0)).alias("owned_keys"))


def balance(counts: DataFrame, value: str = "owned_keys", by: tuple[str, ...] = ()) -> DataFrame:
    """Spread of counts over nodes: max/min (infinite if the least is 0 and the most isn't, 1 if all are 0), (max - min)/mean, max/mean, max/mean - 1 and the population's coefficient of variation (0 where the mean is)."""
    mean, least, most = F.avg(value), F.min(value), F.max(value)
    guarded = lambda x: F.when(mean > 0, x).otherwise(0.0)
    return counts.groupBy(*by).agg(
        F.count("*").alias("nodes"),
        F.sum(value).alias("total"),
        F.when(most == 0, 1.0).when(least == 0, float("inf")).otherwise(most / least).alias("max_over_min"),
        guarded((most - least) / mean).alias("spread"),
        guarded(most / mean).alias("max_over_mean"),
        guarded(most / mean - 1).alias("excess"),
        guarded(F.stddev_pop(value) / mean).alias("cv"),
    )


def segments(base: DataFrame, target: DataFrame, bits: int = 60) -> DataFrame:
    """(start, end, owner_before, replicas_before, owner_after, replicas_after) between neighbouring boundaries of two sets of ranges."""
    ends = base.select("end").union(target.select("end")).distinct()
    order = W.orderBy("end")
    cut = ends.select(F.coalesce(F.lag("end").over(order), F.max("end").over(W.partitionBy())).alias("start"), "end")
    of = lambda ranges, when: ranges.select("start", "end", F.col("owner").alias(f"owner_{when}"), F.concat(F.array("owner"), "followers").alias(f"replicas_{when}"))
    keyed = cut.select(F.col("start").alias("from"), F.col("end").alias("to"), F.col("end").alias("token"))
    before = ring_join(keyed, of(base, "before"), bits).select("from", "to", "token", "owner_before", "replicas_before")
    both = ring_join(before, of(target, "after"), bits)
    return both.select(F.col("from").alias("start"), F.col("to").alias("end"), "owner_before", "replicas_before", "owner_after", "replicas_after")


def topology_delta(base: DataFrame, target: DataFrame, bits: int = 60) -> DataFrame:
    """(start, end, source, destination): the ranges that change owner."""
    return segments(base, target, bits).filter("owner_before <> owner_after").select("start", "end", F.col("owner_before").alias("source"), F.col("owner_after").alias("destination"))


def obligations(base: DataFrame, target: DataFrame, bits: int = 60) -> DataFrame:
    """(start, end, owner, follower): followers that a range has in target and that held no replica of it in base."""
    new = F.explode(F.array_except(F.slice("replicas_after", 2, 1 << 20), F.col("replicas_before")))
    return segments(base, target, bits).select("start", "end", F.col("owner_after").alias("owner"), new.alias("follower"))


def stratum(owner_before: Column, replicas_before: Column, owner_after: Column, replicas_after: Column, removed: Column, added: Column) -> Column:
    """A key's stratum in a change, the first that holds."""
    return (
        F.when(F.arrays_overlap(replicas_before, removed), "removed_source")
        .when(F.arrays_overlap(replicas_after, added), "new_target")
        .when(owner_before != owner_after, "owner_changed")
        .when(F.sort_array(replicas_before) != F.sort_array(replicas_after), "replicas_changed")
        .otherwise("unchanged")
    )


def constituents(old: DataFrame, target: DataFrame, bits: int = 60) -> DataFrame:
    """(start, end, old_start, old_end, old_owner): old ranges whose end lies in a target range."""
    keyed = old.select(F.col("start").alias("old_start"), F.col("end").alias("old_end"), F.col("owner").alias("old_owner"), F.col("followers").alias("old_followers"), F.col("end").alias("token"))
    return ring_join(keyed, target.select("start", "end", "owner"), bits).select("start", "end", "owner", "old_start", "old_end", "old_owner", "old_followers")


def coverage_violations(old: DataFrame, target: DataFrame, admitted: DataFrame, bits: int = 60) -> DataFrame:
    """Parts of target ranges that can't be merged at once: the new owner neither owns the old part, nor is its first follower and admitted (start, end, node_id)."""
    parts = constituents(old, target, bits)
    ok = admitted.select(F.col("start").alias("old_start"), F.col("end").alias("old_end"), F.col("node_id").alias("owner"), F.lit(True).alias("is_admitted"))
    checked = parts.join(ok, ["old_start", "old_end", "owner"], "left")
    fine = (F.col("owner") == F.col("old_owner")) | ((F.col("owner") == F.get("old_followers", F.lit(0))) & F.col("is_admitted").isNotNull())
    return checked.filter(~F.coalesce(fine, F.lit(False))).select("start", "end", "owner", "old_start", "old_end", "old_owner")


def arc_share(ranges: DataFrame, bits: int = 60) -> DataFrame:
    """(owner, tokens, arc, share): how much of the ring each owner has."""
    size = 1 << bits
    gap = F.pmod(F.col("end") - F.col("start"), F.lit(size))
    arc = F.when(F.col("start") == F.col("end"), F.lit(size)).otherwise(gap).cast("decimal(20,0)")
    return ranges.groupBy("owner").agg(F.count("*").alias("tokens"), F.sum(arc).cast("decimal(20,0)").alias("arc")).withColumn("share", F.col("arc").cast("double") / float(size))


def probe_targets(members: DataFrame, offsets=(-2, -1, 1, 2)) -> DataFrame:
    """(node_id, target): the distinct neighbours of each member on the sorted list, itself left out."""
    order = W.orderBy("node_id")
    placed = members.select("node_id", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    asks = placed.select("node_id", "i", "n", F.explode(F.array(*map(F.lit, offsets))).alias("off")).select("node_id", F.pmod(F.col("i") + F.col("off"), F.col("n")).alias("at"))
    return asks.join(placed.select(F.col("node_id").alias("target"), F.col("i").alias("at")), "at").filter("node_id <> target").select("node_id", "target").distinct()
