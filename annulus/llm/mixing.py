"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.llm.common import checkpointed, n_words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: How often a source can be read at most.
EPOCHS = 3
SEED = "mix-1"


def place(doc_id: Column, seed: str) -> Column:
    """A document's place in its source's random order: 60 bits, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with weight and target. All targets add up to the sum of all sizes, as far as epochs allow.

    A source is clamped when its share of what is left, by weight among those not clamped, is above epochs times its size. Sources are tried in order of the level at which they fill, so that one pass over running sums finds the fixpoint. There is a row for each source only.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy(F.col("fills").asc(), F.col("nth").asc())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("nth", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1).cast("long"))
        .withColumn("fills", F.col("source_size") * F.lit(float(epochs)) / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(W.partitionBy()) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("fills") > F.col("rest").cast("double") / F.col("rest_weight"))
    )
    first = W.partitionBy()
    level = F.min(F.when(F.col("open"), F.struct("fills", "nth", "rest", "rest_weight"))).over(first)
    return (
        ranked.withColumn("level", level)
        .withColumn("clamped", F.col("level").isNull() | (F.struct("fills", "nth") < F.struct("level.fills", "level.nth")))
        .select("source", "source_size", "weight", F.when(F.col("clamped"), F.lit(float(epochs)) * F.col("source_size")).otherwise(F.col("weight") * F.col("level.rest").cast("double") / F.col("level.rest_weight")).alias("target"))
    )


#: Up to so many sources, their rows (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """All rows and columns of docs as a struct `row`, and how much of each the mix takes: size, source_size, target, taken.

    A source whose target is r times its size is read floor(r) times whole; for what is left, its documents are taken once more in a seeded order until the words are reached, the last one as far as is needed. So a source's taken words equal its target to a word, and no document exceeds epochs times its size.
    The order's running sums are taken over hash buckets, about as many as the square root of the number of rows, and over rows only in the one bucket of a source where its words run out. What decides on a document is then one row for its source.
    Null source: a source of its own, last in order. Null, empty or blank text: size 0, taken 0. Null ids share one place. Repeated rows (same id and size) share evenly, rounded down, where the words run out among them. Empty table: empty result. Other columns are carried in `row`, whatever their names.
    """
    slim = checkpointed(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("h")))
    counted = checkpointed(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    rows, n_sources = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = max(4, (rows.bit_length() + 1) // 2)
    bucket = F.shiftright("h", 60 - bits)
    targets = (
        water_fill(counted.select("source", "source_size"), weights, epochs)
        .withColumn("reps", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("more", F.round("target").cast("long") - F.col("reps") * F.col("source_size"))
        .withColumnRenamed("source", "its")
    )
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    reached = (F.col("before") < F.col("more")) & (F.col("before") + F.col("words") >= F.col("more"))
    its = F.col("its").eqNullSafe(F.col("source"))
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df
    edge_buckets = sums.join(small(targets.select("its", "more")), its).filter(reached).select("its", "more", F.col("bucket").alias("edge"), F.col("before").alias("edge_before"))
    order = W.partitionBy("source").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    edges = (
        slim.withColumn("bucket", bucket)
        .join(small(edge_buckets), its & (F.col("bucket") == F.col("edge")))
        .groupBy("source", "h", "id", "size", "more", "edge_before")
        .agg(F.count("*").alias("n"))
        .withColumn("words", F.col("size") * F.col("n"))
        .withColumn("before", F.col("edge_before") + F.sum("words").over(order) - F.col("words"))
        .filter(reached)
        .select(F.col("source").alias("at"), F.struct("h", "id", "size").alias("edge"), F.floor((F.col("more") - F.col("before")) / F.col("n")).alias("part"))
    )
    decided = checkpointed(targets.join(edges, F.col("its").eqNullSafe(F.col("at")), "left").select("its", "source_size", "target", "reps", "edge", "part"))
    here = docs.select(F.struct("*").alias("row")).withColumn("size", n_words(F.col("row.text"))).withColumn("here", F.struct(place(F.col("row.doc_id"), seed).alias("h"), F.col("row.doc_id").alias("id"), F.col("size").alias("size")))
    extra = F.when(F.col("here") < F.col("edge"), F.col("size")).when(F.col("here") == F.col("edge"), F.col("part")).otherwise(0)
    return here.join(small(decided), F.col("row.source").eqNullSafe(F.col("its"))).select("row", "size", "source_size", "target", (F.col("reps") * F.col("size") + extra).cast("long").alias("taken"))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself, with the columns of the documents: a whole copy for each whole repetition, and the leading words of one that is taken in part. Rows of which nothing is taken go."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.col("taken") - whole * F.col("size")
    copies = mixed.withColumn("copy", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))))
    cut = F.array_join(F.slice(F.split(F.col("row.text"), r"(?<=[^ \t-\r])(?=[ \t-\r])"), 1, F.greatest(F.col("copy"), F.lit(1)).cast("int")), "")
    return copies.withColumn("row", F.col("row").withField("text", F.when(F.col("copy") < 0, F.col("row.text")).otherwise(cut))).select("row.*")
