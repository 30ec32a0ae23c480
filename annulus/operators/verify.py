"""Checks of histories: real-time order, reads with a legal prefix, rollbacks, expected final states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def realtime_violations(history: DataFrame, key: str, version: str, invoked: str, completed: str) -> DataFrame:
    """(key, version, invoked, earlier): mutations that began after one of a greater version (`earlier`, the greatest) had ended. A running maximum over both kinds of instants, in time, stands for the join of all pairs."""
    ends = history.select(key, F.col(completed).alias("at"), F.lit(1).alias("kind"), F.col(version).alias("v"))
    starts = history.select(key, F.col(invoked).alias("at"), F.lit(0).alias("kind"), F.col(version).alias("v"))
    order = W.partitionBy(key).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    ended = F.max(F.when(F.col("kind") == 1, F.col("v"))).over(order)
    return starts.unionByName(ends).withColumn("earlier", ended).filter((F.col("kind") == 0) & (F.col("earlier") > F.col("v"))).select(key, F.col("v").alias(version), F.col("at").alias(invoked), "earlier")


def duplicate_versions(history: DataFrame, key: str, version: str) -> DataFrame:
    return history.groupBy(key, version).agg(F.count("*").alias("n")).filter("n > 1")


def illegal_reads(history: DataFrame) -> DataFrame:
    """(key, sequence, reason) of reads without a legal place, from (key, sequence, kind, value, version, invoked, completed), kind put, delete or read; version orders the mutations of a key.

    Each read takes the earliest prefix of the versions that gives its value, is not before a mutation that had ended when it began or a read that had, and not past one that began after it ended. A key's history is checked in order by one worker, so this is for bounded test histories.
    """

    def check(pdf):
        import pandas as pd

        writes = pdf[pdf.kind != "read"].sort_values("version")
        reads = pdf[pdf.kind == "read"].sort_values(["completed", "invoked"])
        invoked, completed = writes.invoked.tolist(), writes.completed.tolist()
        values = [None, *[None if k == "delete" else v for k, v in zip(writes.kind, writes.value, strict=True)]]
        bad, done = [], []
        for r in reads.itertuples():
            least = max([0, *[i + 1 for i, c in enumerate(completed) if c < r.invoked], *[p for c, p in done if c < r.invoked]])
            most = min([len(invoked), *[i for i, s in enumerate(invoked) if s > r.completed]])
            fits = [p for p in range(least, most + 1) if values[p] == (None if pd.isna(r.value) else r.value)]
            if fits:
                done.append((r.completed, fits[0]))
            else:
                bad.append((r.key, r.sequence, "no legal prefix"))
        return pd.DataFrame(bad, columns=["key", "sequence", "reason"])

    columns = ["key", "sequence", "kind", "value", "version", "invoked", "completed"]
    key = history.schema["key"].dataType.simpleString()
    sequence = history.schema["sequence"].dataType.simpleString()
    return history.select(*columns).groupBy("key").applyInPandas(check, f"key {key}, sequence {sequence}, reason string")


def mismatches(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, observed): rows of either side that the other lacks or contradicts."""
    a, b = expected.select(key, F.col(value).alias("expected"), F.lit(True).alias("in_a")), observed.select(key, F.col(value).alias("observed"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full")
    return both.filter(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("expected").eqNullSafe(F.col("observed"))).select(key, "expected", "observed")


def rollbacks(history: DataFrame, keep: int = 64) -> DataFrame:
    """(key, seq, verdict, kind) of each read, from a key's acknowledged writes and reads in order (key, seq, op put|delete|read, value, ambiguous).

    A read of a possible state matches and settles it; a read of an older acknowledged state is a rollback of a kind, and settles it; where older states were evicted (more than keep) it is undecidable, else impossible. An ambiguous write adds a possible state; a definite one replaces all.
    """

    def run(pdf):
        import pandas as pd

        out, possible, past, lost = [], [None], [None], 0

        def remember(value) -> None:
            nonlocal lost
            if value in past:
                past.remove(value)
            past.append(value)
            if len(past) > keep:
                past.pop(0)
                lost += 1

        for r in pdf.sort_values("seq").itertuples():
            value = None if r.op == "delete" or pd.isna(r.value) else r.value
            if r.op != "read":
                possible = [*possible, value] if r.ambiguous else [value]
                remember(value)
                continue
            if value in possible:
                verdict, kind = "matches", None
            elif value in past:
                verdict = "rollback"
                kind = "acknowledged_value_lost" if value is None else "acknowledged_delete_lost" if None in possible else "older_value_reappeared"
            else:
                verdict, kind = ("undecidable" if lost else "impossible"), None
            if kind or verdict == "matches":
                possible = [value]
                remember(value)
            out.append((r.key, r.seq, verdict, kind))
        return pd.DataFrame(out, columns=["key", "seq", "verdict", "kind"])

    schema = f"key {history.schema['key'].dataType.simpleString()}, seq long, verdict string, kind string"
    return history.select("key", "seq", "op", "value", "ambiguous").groupBy("key").applyInPandas(run, schema)


def allowed_states(ledger: DataFrame, key: str) -> DataFrame:
    """(key, allowed): final values that a key may have, after its last definite write and any ambiguous ones behind it (key, seq, op, value, ambiguous); null stands for missing."""
    order = W.partitionBy(key).orderBy("seq")
    last = F.max(F.when(~F.col("ambiguous"), F.col("seq"))).over(W.partitionBy(key))
    state = F.struct(F.when(F.col("op") == "put", F.col("value")).alias("v"))
    tail = ledger.withColumn("last", F.coalesce(last, F.lit(-1))).filter(F.col("seq") >= F.col("last"))
    first = F.max(F.when(F.col("last") < 0, 1).otherwise(0)).alias("fresh")
    found = tail.groupBy(key).agg(F.collect_set(state).alias("states"), first)
    missing = F.array(F.struct(F.lit(None).cast("string").alias("v")))
    return found.select(key, F.sort_array(F.array_distinct(F.transform(F.when(F.col("fresh") == 1, F.concat("states", missing)).otherwise(F.col("states")), lambda s: s["v"]))).alias("allowed"))


# What a key may end with, by its last write, whether that write's outcome is known, and whether it had a value before.
FORMS = {("put", True): "value", ("put", False): "value-or-missing", ("rewrite", True): "value", ("rewrite", False): "old-or-new-value", ("delete", True): "missing", ("delete", False): "value-or-missing"}


def expectations(ledger: DataFrame, key: str) -> DataFrame:
    """(key, form, before, after) from each key's last write (key, seq, op put or delete, value, known) and the value of its last known put before that: what the key may end with."""
    last = ledger.groupBy(key).agg(F.max("seq").alias("last"))
    marked = ledger.join(last, key)
    final = marked.filter(F.col("seq") == F.col("last")).select(key, "op", "value", "known")
    earlier = marked.filter((F.col("seq") < F.col("last")) & F.col("known")).groupBy(key).agg(F.max_by(F.struct("op", "value"), "seq").alias("was"))
    both = final.join(earlier, key, "left")
    before = F.when(F.col("was.op") == "put", F.col("was.value"))
    kind = F.when((F.col("op") == "put") & before.isNotNull(), "rewrite").otherwise(F.col("op"))
    form = F.coalesce(*[F.when((kind == k) & (F.col("known") == known), F.lit(name)) for (k, known), name in FORMS.items()])
    return both.select(key, form.alias("form"), before.alias("before"), F.when(F.col("op") == "put", F.col("value")).alias("after"))


def unexpected(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, form, observed): keys whose value isn't one that they may end with (see expectations)."""
    both = expected.join(observed.select(key, F.col(value).alias("observed")), key, "left")
    is_new, is_old, gone = F.col("observed").eqNullSafe(F.col("after")), F.col("observed").eqNullSafe(F.col("before")), F.col("observed").isNull()
    fine = F.when(F.col("form") == "value", is_new).when(F.col("form") == "missing", gone).when(F.col("form") == "old-or-new-value", is_new | is_old).otherwise(gone | F.when(F.col("after").isNull(), is_old).otherwise(is_new))
    return both.filter(~fine).select(key, "form", "observed")
