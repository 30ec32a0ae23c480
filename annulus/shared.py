"""The folder that driver and executors share, and frames whose lineage is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; in local mode a new one where none is named."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="annulus-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes of edges (u, v). Each node takes the least root among its neighbours', and roots are followed, until nothing changes; a step is two joins on checkpointed rows."""
    both = checkpointed(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    state = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")))
    while True:
        near = both.join(state.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        nearer = state.join(near, "node").select("node", F.least("root", "near").alias("root"))
        up = state.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = checkpointed(nearer.join(up, "root").select("node", F.least("root", "up").alias("root")))
        if after.join(state.withColumnRenamed("root", "was"), "node").filter("root <> was").isEmpty():
            return after
        state = after
