"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.llm.common import checkpointed

SHARDS = 24
#: Ranges for each shard at least, and rows that a range should hold at most; at most so many ranges, which bounds the splitters that are broadcast (40 bytes each).
RANGES_A_SHARD, ROWS_A_RANGE, MOST_RANGES = 32, 500_000, 1 << 17
#: Keys drawn for each range.
SAMPLES_A_RANGE = 24
LOW = -(1 << 63)
#: Hashes of text and id, and the row's place in the input.
KEYS = ("k1", "k2", "k3")
#: High bits of the key by which a row finds the ranges that may hold it.
BITS = 12


def splitters(slim: DataFrame, ranges: int, total: int) -> DataFrame:
    """(rid, lo, hi, lo_cut, hi_cut): ranges [lo, hi) of the composite key (k1, k2, k3) with about equal bytes, from a size-weighted sample of ranges * SAMPLES_A_RANGE keys on average.

    k1 stands for a text, k2 for an id, k3 for a row. A boundary lies between texts, unless several neighbouring quantiles fall in one text: that range is overfull, and is subdivided by k2 and k3 (cut).
    """
    draws = float(ranges * SAMPLES_A_RANGE)
    chance = F.lit(draws / max(total, 1)) * F.col("size")
    luck = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *KEYS), 11).cast("double") / float(1 << 53)
    drawn = slim.filter(luck < chance).select(*KEYS, F.greatest(chance, F.lit(1.0)).alias("worth"))
    order = W.orderBy(*KEYS)
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.sum("worth").over(W.partitionBy()) / float(ranges)
    cuts = (
        drawn.withColumn("nth", F.floor(F.sum("worth").over(running) / step))
        .withColumn("was", F.coalesce(F.lag("nth").over(order), F.lit(0)))
        .filter("nth > was")
        .withColumn("cut", F.coalesce(F.lag("k1").over(order) == F.col("k1"), F.lit(False)) | F.coalesce(F.lead("k1").over(order) == F.col("k1"), F.lit(False)))
        .select("k1", *[F.when(F.col("cut"), F.col(k)).otherwise(F.lit(LOW)).alias(k) for k in KEYS[1:]], "cut")
        .unionByName(drawn.sparkSession.range(1).select(*[F.lit(LOW).alias(k) for k in KEYS], F.lit(False).alias("cut")))
        .groupBy(*KEYS)
        .agg(F.max("cut").alias("cut"))
    )
    return cuts.select(
        (F.row_number().over(order) - 1).alias("rid"),
        F.struct(*KEYS).alias("lo"),
        F.lead(F.struct(*KEYS)).over(order).alias("hi"),
        F.col("cut").alias("lo_cut"),
        F.coalesce(F.lead("cut").over(order), F.lit(False)).alias("hi_cut"),
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row: law `bytes`, so the shards' sizes are near equal.

    Rows are put in order by a hash of the text, then one of the id, then their place in the input, which only tells rows of one id and text apart; a sample weighted by size gives boundaries for many more ranges than shards, overfull ones subdivided; exact bytes of the ranges, and running sums within each, place every row on the line of all bytes, which is cut in equal parts. Equal texts stay in one shard where they are smaller than a range or two (some 1/32 of a shard); larger groups are cut row by row. slot counts up from 0 within a shard, in the same order.
    size is the text's bytes plus 8; a null text has no bytes, and the checksum and group of an empty one. Null ids are ordinary ids. Repeated rows are placed one by one; equal ones may swap slots. An empty table gives an empty one. A row's size can't be cut: a text larger than a shard makes its shard larger. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = checkpointed(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("row"), F.col("doc_id")).alias("k2"), F.monotonically_increasing_id().alias("k3"))
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(shards * RANGES_A_SHARD, rows // ROWS_A_RANGE))
    split = checkpointed(splitters(slim, ranges, total))
    prefix = lambda k: F.shiftright(k, 64 - BITS)
    at = split.withColumn("prefix", F.explode(F.sequence(prefix(F.col("lo.k1")), F.coalesce(prefix(F.col("hi.k1")), F.lit((1 << (BITS - 1)) - 1).cast("long")))))
    key = F.struct(*KEYS)
    located = (
        slim.withColumn("prefix", prefix(F.col("k1")))
        .join(F.broadcast(at), "prefix")
        .filter((key >= F.col("lo")) & (F.col("hi").isNull() | (key < F.col("hi"))))
        .select("doc_id", "size", "text_crc32", *KEYS, "rid", ((F.col("lo_cut") & (F.col("k1") == F.col("lo.k1"))) | (F.col("hi_cut") & (F.col("k1") == F.col("hi.k1")))).alias("cut"))
    )
    all_before = W.orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    offsets = located.groupBy("rid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select("rid", F.coalesce(F.sum("bytes").over(all_before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("rows_before"))
    order = W.partitionBy("rid").orderBy("k1", "k2", "doc_id", "k3")
    group = W.partitionBy("rid", "k1")
    placed = checkpointed(
        located.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("nth", F.row_number().over(order) - 1)
        .withColumn("group_end", F.max("end").over(group))
        .withColumn("group_start", F.min(F.col("end") - F.col("size")).over(group))
        .join(F.broadcast(offsets), "rid")
        .withColumn("middle", F.col("bytes_before") + F.when(F.coalesce(F.col("cut"), F.lit(False)), F.col("end") - F.col("size") / 2).otherwise((F.col("group_start") + F.col("group_end")) / 2))
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(float(max(total, 1))))).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).alias("nth"))
    )
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
