"""Structured Streaming versions of windows, deduplication, ordered application, and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def tumbling(stream: DataFrame, at: str, length: str, late: str, by: list[str], *aggregates) -> DataFrame:
    """Aggregates, with the window's `start`, over tumbling windows of event time (a timestamp with zone); rows later than `late` are dropped."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, length).alias("_w"), *by).agg(*aggregates)
    return grouped.withColumn("start", F.col("_w.start")).drop("_w")


def deduplicated(stream: DataFrame, at: str, retention: str, keys: list[str]) -> DataFrame:
    """The first of each mutation id within its retention."""
    return stream.withWatermark(at, retention).dropDuplicatesWithinWatermark(keys)


def retried(stream: DataFrame, key: str, fingerprint: str, at: str, retention: str) -> DataFrame:
    """(key, fingerprint, verdict) of each request: first, retry (the same fingerprint under a mutation id within its retention) or conflict (another). The state of an id is its first fingerprint, kept until the watermark passes its retention."""
    length = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {retention}) AS ms").first()["ms"])

    def run(its, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        mark, last, out = state.get[0] if state.exists else None, 0, []
        for batch in batches:
            for own, when in batch.sort_values(at)[[fingerprint, at]].itertuples(index=False, name=None):
                out.append((its[0], own, "first" if mark is None else "retry" if own == mark else "conflict"))
                mark, last = mark or own, max(last, int(pd.Timestamp(when).timestamp() * 1000))
        state.update((mark,))
        state.setTimeoutTimestamp(max(last + length, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, fingerprint, "verdict"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, retention).select(key, fingerprint, at)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {fingerprint} string, verdict string", "mark string", "append", GroupStateTimeout.EventTimeTimeout)


def ordered_apply(stream: DataFrame, by: str, seq: str, fingerprint: str, owner_seq: str | None = None, kind: str | None = None, kept: int = 1024) -> DataFrame:
    """(by, seq, verdict) for each entry of a stream in sequence: applied; duplicate (an entry that was applied, by its fingerprint, or that a checkpoint covers); conflict (another entry under a sequence number that is still kept); gap; stale (its owner's sequence, if given, didn't advance).

    kind, if given, tells entries from checkpoints (`checkpoint`), which jump forward (verdict checkpoint) and never back (verdict rewind). The state of a stream is its last sequence number, its checkpoint, the owner's last sequence, and the fingerprints of the last `kept` entries.
    """
    import json

    def run(key, batches, state):
        import pandas as pd

        last, jumped, owner, marks = state.get if state.exists else (0, 0, -1, "{}")
        marks, out = json.loads(marks), []
        for batch in batches:
            for row in batch.sort_values(seq, kind="stable").itertuples(index=False):
                number, own = int(getattr(row, seq)), getattr(row, fingerprint)
                advanced = int(getattr(row, owner_seq)) if owner_seq else owner + 1
                if kind and getattr(row, kind) == "checkpoint":
                    verdict = "rewind" if number < last else "checkpoint"
                    if verdict == "checkpoint":
                        last = jumped = number
                elif number <= last:
                    was = marks.get(str(number))
                    verdict = "duplicate" if was == own or (was is None and number <= jumped) else "conflict"
                elif number != last + 1:
                    verdict = "gap"
                elif advanced <= owner:
                    verdict = "stale"
                else:
                    last, owner, verdict = number, advanced, "applied"
                    marks[str(number)] = own
                    marks.pop(str(number - kept), None)
                out.append((key[0], number, verdict))
        state.update((last, jumped, owner, json.dumps(marks)))
        yield pd.DataFrame(out, columns=[by, seq, "verdict"])

    its = stream.schema[by].dataType.simpleString()
    columns = [by, seq, fingerprint, *[c for c in (owner_seq, kind) if c]]
    return stream.select(*columns).groupBy(by).applyInPandasWithState(run, f"{by} {its}, {seq} long, verdict string", "last long, jumped long, owner long, marks string", "append", GroupStateTimeout.NoTimeout)


def bounded_source(spark, schema, path: str, files: int) -> DataFrame:
    """A stream of Parquet files that takes at most so many in a batch: what comes faster waits in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def in_batches(stream: DataFrame, linger: str | None):
    """A writer of the stream that waits so long to gather a batch; None: as soon as there is anything."""
    return stream.writeStream.trigger(processingTime=linger or "0 seconds")


def sent_and_late(stream: DataFrame, at: str, length: str, late: str, dropped: str) -> DataFrame:
    """(start, issued, late): how many requests of each window were sent, and how many the sender dropped, as too many were in flight; a dropped one is a plain count, its event time is when it was due."""
    return tumbling(stream, at, length, late, [], F.count_if(~F.col(dropped)).alias("issued"), F.count_if(F.col(dropped)).alias("late"))


def expiring(stream: DataFrame, by: str, deadline_ms: str) -> DataFrame:
    """(by, verdict): keys as they are written, and once more when the deadline of the last write has passed in processing time. The state of a key is its deadline; it goes when the key expires."""

    def run(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired")], columns=[by, "verdict"])
            return
        last = max(int(b[deadline_ms].max()) for b in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutDuration(max(1, last - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame([(key[0], "written")], columns=[by, "verdict"])

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, deadline_ms).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, verdict string", "deadline long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def leases(stream: DataFrame, node: str, at: str, expires: str, delay: str) -> DataFrame:
    """(node, verdict): renewed for renewals of a node's lease (expires, a timestamp), and expired once the watermark of `at` passes the last one. A renewal never shortens a lease."""

    def run(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired")], columns=[node, "verdict"])
            return
        last = max(int(b[expires].max().timestamp() * 1000) for b in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], "renewed")], columns=[node, "verdict"])

    kind = stream.schema[node].dataType.simpleString()
    return stream.withWatermark(at, delay).select(node, at, expires).groupBy(node).applyInPandasWithState(run, f"{node} {kind}, verdict string", "until long", "append", GroupStateTimeout.EventTimeTimeout)
