"""A versioned mutation log: last writer wins, deadlines, retries, change feeds, digests."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def live(deleted: Column, expires_at: Column, now: Column) -> Column:
    """Neither deleted nor expired; a record is expired at its deadline."""
    return ~deleted & (expires_at.isNull() | (now < expires_at))


def latest(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The row of each key with the greatest version, compared field by field; of equal versions, one of them.

    An aggregate, so that each task sends one row of a key and a hot key is no burden.
    """
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_best"))
    return best.select(key, "_best.*")


def replay(snapshot: DataFrame, journal: DataFrame, key: str, version: list[str], after: int) -> DataFrame:
    """A snapshot with the journal's entries past a watermark, the greatest version of each key."""
    return latest(snapshot.unionByName(journal.filter(F.col("watermark") > after).drop("watermark")), key, version)


def replay_checked(snapshot: DataFrame, journal: DataFrame, key: str, version: list[str], after: int) -> DataFrame:
    """replay of a journal whose watermarks must follow on `after` without a gap; an error where they don't."""
    late = journal.filter(F.col("watermark") > after).agg(F.count_distinct("watermark").alias("n"), F.max("watermark").alias("last")).first()
    if late["n"] and late["last"] - after != late["n"]:
        raise ValueError(f"the journal lacks {late['last'] - after - late['n']} entries past {after}")
    return replay(snapshot, journal, key, version, after)


def replication_lag(progress: DataFrame, by: list[str], now: int) -> DataFrame:
    """(by, lag_ms) of streams (head, acked, oldest_unacked_ms): 0 where all is answered, else since the oldest entry without an answer; null (unknown) where there is no such entry or a side is silent."""
    lag = F.when(F.col("acked") >= F.col("head"), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(now) - F.col("oldest_unacked_ms"), F.lit(0)))
    return progress.select(*by, F.when(F.col("head").isNotNull() & F.col("acked").isNotNull(), lag).alias("lag_ms"))


def receipts_kept(receipts: DataFrame, now: int, retention_ms: int, overhead: int = 96) -> DataFrame:
    """Receipts (at_ms, mutation_id, key) within their retention, with their cost in bytes."""
    return receipts.filter(F.col("at_ms") + retention_ms > now).withColumn("cost", (F.octet_length("mutation_id") + F.octet_length("key") + overhead).cast("long"))


def admitted(receipts: DataFrame, now: int, retention_ms: int, capacity: int, asked: int) -> DataFrame:
    """(bytes, fits, retry_ms): what kept receipts (see receipts_kept) cost, whether `asked` more bytes fit a capacity, and else the time to the first receipt's end, at least 1 ms."""
    used = F.coalesce(F.sum("cost"), F.lit(0))
    wait = F.greatest(F.lit(1), F.min("at_ms") + retention_ms - now)
    return receipts.agg(used.alias("bytes"), (used + asked <= capacity).alias("fits"), F.when(used + asked > capacity, wait).alias("retry_ms"))


#: Sequence numbers of a stream that are put in order together.
BLOCK = 1 << 16


def gaps(entries: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, seq, before): entries whose predecessor isn't the sequence number before; a repeat is no gap. Numbers are put in order in blocks, and a block's first is compared with the last of the block before, so that a long stream isn't one task's."""
    block = F.floor(F.col(seq) / BLOCK)
    each = entries.select(by, seq, block.alias("_block")).distinct()
    order = W.partitionBy(by).orderBy("_block")
    ends = each.groupBy(by, "_block").agg(F.max(seq).alias("_last")).withColumn("_before", F.lag("_last").over(order)).drop("_last")
    inside = each.withColumn("_lag", F.lag(seq).over(W.partitionBy(by, "_block").orderBy(seq)))
    first = F.col("_lag").isNull()
    placed = inside.join(ends, [by, "_block"]).withColumn("before", F.when(first, F.col("_before")).otherwise(F.col("_lag")))
    return placed.filter(F.col("before").isNotNull() & (F.col(seq) != F.col("before") + 1)).select(by, seq, "before")


def retries(requests: DataFrame, request: str, fingerprint: str, order: list[str]) -> DataFrame:
    """(request, attempts, answer, conflict): retries get the first attempt's answer; another fingerprint under one id is a conflict."""
    first = F.min_by(fingerprint, F.struct(*order))
    return requests.groupBy(request).agg(F.count("*").alias("attempts"), first.alias("answer"), (F.min(fingerprint) != F.max(fingerprint)).alias("conflict"))


def fingerprint(*columns: Column) -> Column:
    """A digest of columns, each with its length, null apart from empty."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def range_digest(records: DataFrame, by: str, record: Column) -> DataFrame:
    """(by, records, digest): a digest of a range's records that doesn't depend on their order, so that it is a partial aggregate: the exclusive or of two 60-bit hashes each, and their number."""
    half = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), record)), 1, 15), 16, 10).cast("long")
    return records.groupBy(by).agg(F.count("*").alias("records"), F.concat_ws(":", F.bit_xor(half("a")).cast("string"), F.bit_xor(half("b")).cast("string")).alias("digest"))


def sweep(records: DataFrame, now: int, most: int, migrating: DataFrame | None = None, bits: int = 60) -> DataFrame:
    """Due records, the earliest deadlines first, at most so many; those in ranges that migrate (start, end) wait."""
    due = records.filter(F.col("expires_at_ms") <= now)
    if migrating is not None:
        from annulus.operators.ring import ring_join

        held = ring_join(due.select("key", "token"), migrating.select("start", "end"), bits).select("key").distinct()
        due = due.join(held, "key", "left_anti")
    return due.orderBy("expires_at_ms", "key").limit(most)


def next_deadline(given: Column, current: Column, is_live: Column) -> Column:
    """A write's deadline: unset keeps that of a live record, 0 clears, else it is set."""
    return F.when(given.isNull(), F.when(is_live, current)).when(given == 0, None).otherwise(given)


def conditional(requests: DataFrame) -> DataFrame:
    """(key, seq, outcome, version): the writes of each key in the order of seq, each under its condition; version is the key's after it.

    requests: key, seq, now_ms, op (put, delete, or expire, which sets the deadline and keeps the value), deadline_ms (null: a put keeps a live one's, an expire clears it; 0 clears), condition (null, absent, version), expected. Conditions look at the live record: an expired or deleted one is absent. A write that fails (condition_failed, or key_missing for an expire) writes nothing. The task holds one key's version and deadline and a batch of rows.
    """

    def run(batches):
        current, version, deadline, alive = object(), None, None, False
        for batch in batches:
            out = ([], [])
            for key, seq, now, op, until, condition, expected in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "now_ms", "op", "deadline_ms", "condition", "expected")), strict=True):
                if key != current:
                    current, version, deadline, alive = key, None, None, False
                if alive and deadline is not None and now >= deadline:
                    alive = False
                fits = condition is None or (not alive if condition == "absent" else alive and version == expected)
                if not fits:
                    outcome = "condition_failed"
                elif op == "expire" and not alive:
                    outcome = "key_missing"
                else:
                    outcome, version = "applied", seq
                    kept = deadline if alive and op == "put" else None
                    deadline = (until or None) if until is not None else kept
                    alive = op != "delete"
                out[0].append(outcome)
                out[1].append(version)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["key", "seq", "outcome", "version"])

    rows = requests.select("key", "seq", "now_ms", "op", "deadline_ms", "condition", "expected").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(run, f"key {requests.schema['key'].dataType.simpleString()}, seq long, outcome string, version long")


def ordered_digest(records: DataFrame, by: str, token: str, order: list[str], record: Column, bits: int = 60, chunks: int = 10) -> DataFrame:
    """(by, records, digest): a digest over a range's records in order, from digests of chunks (by the 2^chunks first parts of the token) that are digested in order; so a task holds one chunk of a range."""
    part = F.shiftright(token, bits - chunks)
    rows = records.select(by, part.alias("_part"), F.struct(*order, F.sha2(record, 256).alias("d")).alias("r"))
    one = rows.groupBy(by, "_part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["d"]), ""), 256).alias("d"))
    return one.groupBy(by).agg(F.sum("n").alias("records"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "d"))), lambda r: r["d"]), ""), 256).alias("digest"))


def entry_errors(entries: DataFrame, ranges: DataFrame, node: str, epoch: int, max_key: int = 1 << 10, max_value: int = 1 << 20, bits: int = 60) -> DataFrame:
    """entries (stream_seq, mutation_id, key, value, deleted, epoch, owner, version_epoch, version_owner, token) with `error`: the first rule by which a follower refuses one, null if it may apply it. The order of a stream is checked apart, entry by entry."""
    from annulus.operators.ring import ring_join

    placed = ring_join(entries, ranges.select("start", "end", F.col("owner").alias("_owner"), "followers"), bits).drop("start", "end")
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    rules = [
        (F.col("stream_seq") == 0, "sequence must be greater than zero"),
        ((size("mutation_id") == 0) | (size("mutation_id") > 128), "mutation id size"),
        ((size("key") == 0) | (size("key") > max_key), "key size"),
        (size("value") > max_value, "value size"),
        (F.col("deleted") & (size("value") > 0), "deleted entry with a value"),
        (F.col("version_epoch").isNull(), "no version"),
        ((F.col("version_epoch") != F.col("epoch")) | (F.col("version_owner") != F.col("owner")), "version of another stream"),
        (F.col("epoch") != epoch, "another epoch"),
        (F.col("owner") != F.col("_owner"), "not the current owner"),
        (~F.array_contains("followers", node), "not a follower"),
    ]
    return placed.withColumn("error", F.coalesce(*[F.when(holds, F.lit(why)) for holds, why in rules])).drop("_owner", "followers")
