"""Views of the test tables as members, keys, mutations and request ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions.tokens import portable_token
from annulus.operators import ring


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str, n: int = 25) -> DataFrame:
    """The first n nations, as members."""
    return read(spark, sf_dir, "nation").filter(F.col("n_nationkey") < n).select(F.col("n_name").alias("node_id"))


def token_of(node_id, vnode):
    return portable_token(F.concat(node_id, F.lit("#"), vnode.cast("string")))


def ring_of(spark: SparkSession, sf_dir: str, n: int, vnodes: int) -> DataFrame:
    return ring.build_ring(members(spark, sf_dir, n), vnodes, token_of)


def ranges_of(spark: SparkSession, sf_dir: str, n: int, vnodes: int, replicas: int = 3) -> DataFrame:
    return ring.derived_ranges(ring_of(spark, sf_dir, n, vnodes), replicas, n)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, token) of every order."""
    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select(key.alias("key"), portable_token(key).alias("token"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a mutation log: key user, op put, delete or get, a version (epoch, seq), and a deadline for sign-ups (an hour after)."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type").isin("signup", "purchase"), "put").otherwise("get").alias("op"),
        (F.lit(1) + F.floor(day / 10)).cast("long").alias("epoch"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("value"),
        at.alias("at_ms"),
        F.when(F.col("event_type") == "signup", at + 3_600_000).alias("expires_at_ms"),
        F.col("event_type"),
        F.col("user_id"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a request ledger: op, stage, latency_us, day."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "A", "get").when(F.col("l_returnflag") == "N", "put").otherwise("delete").alias("op"),
        F.col("l_linestatus").alias("stage"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("latency_us"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_suppkey").alias("node"),
    )
