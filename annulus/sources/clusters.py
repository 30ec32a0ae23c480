"""The test tables as the state of a cluster: nations are nodes, and a hash of a name decides what a process, a stream or a task is up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions.tokens import portable_token
from annulus.operators import cluster
from annulus.shared import checkpointed
from annulus.sources import datasets as data

EPOCH, NOW = 5, 1_000_000
MEMBERS, GROWN, VNODES, RF = 10, 11, 8, 3
LEASE, FRESHNESS = 3_000, 2_000
GUARD = cluster.Guard(minimum_admitted_copies=2, minimum_healthy_followers=1, max_replica_lag_millis=700)


def _draw(what: str, *names: Column) -> Column:
    return portable_token(F.concat_ws(":", F.lit(what), *[n.cast("string") for n in names]))


def _nodes(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return data.read(spark, sf_dir, "nation").filter(F.col("n_nationkey") < n).select(F.col("n_name").alias("node_id"), F.col("n_nationkey").alias("nr"))


def ranges(spark: SparkSession, sf_dir: str, n: int = MEMBERS) -> DataFrame:
    """The ranges of the first n nations, kept in the shared folder: much is made from these few rows."""
    return checkpointed(data.ranges_of(spark, sf_dir, n, VNODES, RF))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, 12).filter("nr <> 8").select("node_id", F.concat(F.lit("p"), "nr").alias("instance"))


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, 12).filter("nr = 5").select("node_id")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lease is of an old epoch, one of an old process, one is over."""
    return _nodes(spark, sf_dir, 12).select(
        "node_id",
        F.when(F.col("nr") == 6, EPOCH - 1).otherwise(EPOCH).alias("epoch"),
        F.when(F.col("nr") == 3, "old").otherwise(F.concat(F.lit("p"), "nr")).alias("instance"),
        (F.lit(NOW) + F.when(F.col("nr") == 0, -1).otherwise(F.col("nr") * 100 + 1)).alias("expires_at"),
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.live_leases(grants(spark, sf_dir), instances(spark, sf_dir), fenced(spark, sf_dir), EPOCH, NOW)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of users, told by one node of another: target, reporter, and when they were first and last seen."""
    e = data.mutations(spark, sf_dir).filter("op = 'delete'").select((F.col("user_id") % 12).alias("t"), (F.col("seq") % 12).alias("r"), (F.lit(NOW) - 1 - F.col("seq") % 9_000).alias("at"))
    told = e.groupBy("t", "r").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    named = lambda c, name: _nodes(spark, sf_dir, 12).select(F.col("nr").alias(c), F.col("node_id").alias(name))
    return told.join(named("t", "target"), "t").join(named("r", "reporter"), "r").select("target", "reporter", "first_seen", "last_seen")


def admissions(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Most followers are admitted; some by a process that is gone, some in another epoch, some without a digest, some twice."""
    own = own if own is not None else ranges(spark, sf_dir)
    each = cluster.tasks(own).join(_nodes(spark, sf_dir, MEMBERS), "node_id").withColumn("h", _draw("a", F.col("end"), F.col("node_id"))).filter("h % 6 <> 0")
    made = each.select(
        *cluster.TASK,
        F.when(F.col("h") % 41 == 1, EPOCH - 1).otherwise(EPOCH).alias("epoch"),
        F.when(F.col("h") % 7 == 1, "gone").otherwise(F.concat(F.lit("p"), "nr")).alias("instance"),
        F.when(F.col("h") % 43 == 2, "").otherwise("d").alias("digest"),
        (F.col("h") % 1000).alias("cursor"),
    )
    return made.unionByName(made.filter(_draw("a2", F.col("end"), F.col("node_id")) % 60 == 0))


def repairs(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Most followers have a repair, and some nodes that follow no more."""
    own = own if own is not None else ranges(spark, sf_dir)
    each = cluster.tasks(own).withColumn("h", _draw("r", F.col("end"), F.col("node_id"))).filter("h % 8 <> 0")
    phase = F.when(F.col("h") % 8 < 5, "Complete").when(F.col("h") % 8 < 7, "Pending").otherwise("Copying")
    made = each.select(*cluster.TASK, F.when(F.col("h") % 47 == 3, EPOCH - 1).otherwise(EPOCH).alias("epoch"), phase.alias("phase"))
    stray = own.filter(_draw("s", F.col("end")) % 10 == 0).select("start", "end", "owner", F.col("owner").alias("node_id"), F.lit(EPOCH).alias("epoch"), F.lit("Pending").alias("phase"))
    return made.unionByName(stray)


def progress(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Streams that answer, some behind."""
    pairs = cluster.tasks(own if own is not None else ranges(spark, sf_dir)).select("owner", "node_id").distinct().withColumn("h", _draw("p", F.col("owner"), F.col("node_id"))).filter("h % 11 <> 0")
    return pairs.select("owner", "node_id", F.lit(1000).cast("long").alias("head"), (F.lit(1000) - F.when(F.col("h") % 9 == 0, 5).otherwise(0)).cast("long").alias("cursor"), (F.col("h") % 800).alias("lag_millis"))


def followers(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    own = own if own is not None else ranges(spark, sf_dir)
    found = cluster.follower_status(own, live(spark, sf_dir), instances(spark, sf_dir), fenced(spark, sf_dir), admissions(spark, sf_dir, own).distinct(), repairs(spark, sf_dir, own), progress(spark, sf_dir, own), GUARD)
    return checkpointed(found)
