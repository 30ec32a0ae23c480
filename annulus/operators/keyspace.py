"""Reads of a keyspace: pages, cursors, counts, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a key costs in a page besides its bytes.
OVERHEAD = 64


def page(records: DataFrame, start: int, max_keys: int, max_bytes: int, max_examined: int = 10_000) -> DataFrame:
    """Live keys in token order from start. The page ends between tokens, before the one that would exceed a limit; the first token is always taken.

    Only as many rows as can be in a page come to the window: the limit is pushed into the sort.
    """
    first = records.filter(F.col("token") >= start).orderBy("token", "key").limit(max_examined + 1)
    order = W.orderBy("token")
    cost = F.octet_length("key") + OVERHEAD
    by_token = first.groupBy("token").agg(F.count("*").alias("n"), F.count_if("live").alias("keys"), F.sum(F.when(F.col("live"), cost).otherwise(0)).alias("bytes"))
    upto = lambda c: F.sum(c).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = (upto("keys") <= max_keys) & (upto("bytes") <= max_bytes) & (upto("n") <= max_examined)
    taken = by_token.withColumn("nth", F.row_number().over(order)).withColumn("fits", fits).filter("fits or nth = 1").select("token")
    return first.filter("live").join(F.broadcast(taken), "token").select("key", "token")


def count_page(records: DataFrame, start: int, max_keys: int, max_bytes: int, max_examined: int = 10_000) -> DataFrame:
    """(keys, next) of a page without its keys: how many it has, and the token that the next one starts at (null: the end)."""
    held = page(records, start, max_keys, max_bytes, max_examined).agg(F.count("*").alias("keys"), F.max("token").alias("last"))
    first = records.filter(F.col("token") >= start).orderBy("token", "key").limit(max_examined + 1)
    after = first.filter("live").join(F.broadcast(held), F.col("token") > F.col("last")).agg(F.min("token").alias("next"))
    return held.select("keys").join(after)


def scan(records: DataFrame, cursor: int, count: int, keep: Column) -> DataFrame:
    """(key, token, next): the kept ones of the next `count` live keys, kept or not, from a cursor, rounded up to whole tokens; next is the cursor after them, 0 when done."""
    live = records.filter(F.col("live") & (F.col("token") >= cursor))
    ahead = live.orderBy("token", "key").limit(count)
    last = ahead.agg(F.max("token").alias("last"))
    after = live.join(F.broadcast(last), F.col("token") > F.col("last")).agg(F.coalesce(F.min("token"), F.lit(0)).alias("next"))
    seen = live.join(F.broadcast(last), F.col("token") <= F.col("last")).drop("last")
    return seen.filter(keep).join(F.broadcast(after)).select("key", "token", "next")


def at_or_after(records: DataFrame, token: int) -> DataFrame:
    """The first live key at or after a token, wrapping: a random key, when the token is."""
    turn = F.when(F.col("token") >= token, 0).otherwise(1)
    return records.filter("live").select("key", "token", turn.alias("turn")).orderBy("turn", "token", "key").limit(1).drop("turn")


def within_budget(records: DataFrame, budget: int) -> DataFrame:
    """(keys, bytes, too_large) of a walk over all live keys."""
    size = F.coalesce(F.sum(F.octet_length("key") + OVERHEAD), F.lit(0))
    return records.filter("live").agg(F.count("*").alias("keys"), size.alias("bytes"), (size > budget).alias("too_large"))


def lookup(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, key, value): values in the order asked, null where there is no live record."""
    return asked.join(records.filter("live").select("key", "value"), "key", "left").select("pos", "key", "value")


def stretch_end(ranges: DataFrame, node: str, start: int) -> DataFrame:
    """(next): where the run of a node's ranges that holds a token ends: the first token after it that another node owns, the token itself if another owns it, null if the run reaches the end of the ring."""
    ahead = ranges.filter(F.col("end") >= start).select("start", "end", "owner")
    # Past the last boundary the ring goes on with the owner of the first.
    rest = ranges.agg(F.max("end").alias("start"), F.min_by("owner", "end").alias("owner")).select("start", F.lit((1 << 63) - 1).alias("end"), "owner")
    other = ahead.unionByName(rest).filter(F.col("owner") != node)
    # A wrapping range begins past its end.
    begins = F.when(F.col("start") > F.col("end"), F.lit(0)).otherwise(F.col("start") + 1)
    return other.agg(F.min(F.greatest(begins, F.lit(start))).alias("next"))


def stretch(records: DataFrame, ranges: DataFrame, node: str, start: int) -> DataFrame:
    """All records from a token to the first range of another node, live or not: a filter, with no limit and no order."""
    end = stretch_end(ranges, node, start).first()["next"]
    ahead = records.filter(F.col("token") >= start)
    return ahead if end is None else ahead.filter(F.col("token") < end)


def one_stretch(records: DataFrame, ranges: DataFrame, node: str, start: int, max_keys: int, max_bytes: int) -> DataFrame:
    """A page of the live keys from a token on that stops at the first range of another node."""
    return page(stretch(records, ranges, node, start), start, max_keys, max_bytes)


def only_strings(records: DataFrame, kind: str) -> DataFrame:
    """The TYPE filter: every value is a string, so `string` selects all and any other type none."""
    return records if kind.lower() == "string" else records.filter(F.lit(False))


def byte_page(rows: DataFrame, order: list[str], size: Column, budget: int, most: int = 10_000) -> DataFrame:
    """The first rows in order whose sizes fit a budget together; the first is always taken. The limit is pushed into the sort, so that a page's rows come to the window only."""
    first = rows.withColumn("_size", size).orderBy(*order).limit(most)
    upto = F.sum("_size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return first.withColumn("_upto", upto).withColumn("_nth", F.row_number().over(W.orderBy(*order))).filter((F.col("_upto") <= budget) | (F.col("_nth") == 1)).drop("_size", "_upto", "_nth")
