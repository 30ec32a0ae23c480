"""The test tables as what a load test leaves: requests with failures, processor samples, profiles, rounds, repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.operators import stages
from annulus.sources import datasets as data

CODES = tuple(stages.CODES)
KINDS = ("operation", *stages.KINDS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: their start in shrunken time (t, 26 seconds for a month), stage, worker, and what became of them."""
    m = data.mutations(spark, sf_dir)
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    kind = pick(KINDS, F.col("seq") % 13)  # beyond the six, null: a success
    return m.select(
        "seq",
        "key",
        "op",
        "user_id",
        "epoch",
        "at_ms",
        F.floor((F.col("at_ms") - 1_704_067_200_000) / 100_000).alias("t"),
        (F.col("user_id") % 5).alias("stage"),
        (F.col("user_id") % 8).alias("worker"),
        (F.col("seq") % 23 == 0).alias("late"),
        kind.alias("kind"),
        F.when(kind == "operation", pick(CODES, F.floor(F.col("seq") / 13) % len(CODES))).alias("code"),
        F.when(F.col("seq") % 2 == 0, "known_not_applied").otherwise("may_have_applied").alias("said"),
        F.floor(F.col("seq") / 5).alias("retries"),
    ).withColumn("reason", stages.reason(F.col("kind"), F.col("code")))


#: requests, in DuckDB: `q`, after the CTE `m` of the mutations.
SQL = f"""q AS (
  SELECT *, CASE kind WHEN 'operation' THEN coalesce(map({list(stages.CODES)}, {list(stages.CODES.values())})[code], 'operation') ELSE map({list(stages.KINDS)}, {list(stages.KINDS.values())})[kind] END AS reason
  FROM (
    SELECT *, CASE WHEN kind = 'operation' THEN {list(CODES)}[seq // 13 % {len(CODES)} + 1] END AS code FROM (
      SELECT seq, key, op, user_id, epoch, at_ms, (at_ms - 1704067200000) // 100000 AS t, user_id % 5 AS stage, user_id % 8 AS worker, seq % 23 = 0 AS late,
             {list(KINDS)}[seq % 13 + 1] AS kind, CASE WHEN seq % 2 = 0 THEN 'known_not_applied' ELSE 'may_have_applied' END AS said, seq // 5 AS retries
      FROM m)))"""
