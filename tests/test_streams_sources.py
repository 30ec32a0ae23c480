"""Streams over files, and readers and writers."""

import json

from pyspark.sql import functions as F

from annulus import sources, streaming


def run(stream, path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_streams(spark, tmp_path):
    rows = [(1, 1, "a", 0), (1, 2, "b", 1), (1, 2, "b", 2), (1, 2, "c", 2), (1, 5, "d", 3), (2, 1, "x", 70)]
    source = spark.createDataFrame(rows, "k long, seq long, fp string, t long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    run(streaming.ordered_apply(read(), "k", "seq", "fp"), tmp_path, "applied")
    got = sorted(map(tuple, spark.table("applied").collect()))
    assert got == [(1, 1, "applied"), (1, 2, "applied"), (1, 2, "conflict"), (1, 2, "duplicate"), (1, 5, "gap"), (2, 1, "applied")]
    run(streaming.deduplicated(read(), "ts", "1 hour", ["k", "seq"]), tmp_path, "once")
    assert spark.table("once").count() == 4
    run(streaming.tumbling(read(), "ts", "1 minute", "0 seconds", ["k"], F.count("*").alias("n")), tmp_path, "windows", "complete")
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [(1, 5), (2, 1)]


def test_event_log(spark, tmp_path):
    lines = [{"event": "a", "unix_ms": 2, "fields": {"token": 18446744073709551615}}, {"event": "b", "unix_ms": 1, "fields": {}}]
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    events, bad = sources.event_log(spark, str(tmp_path / "e.jsonl"))
    assert [r["event"] for r in events.orderBy("unix_ms", "line").collect()] == ["b", "a"] and bad.count() == 1
    token = events.filter("event = 'a'").select(F.try_variant_get("fields", "$.token", "decimal(20,0)")).first()[0]
    assert int(token) == 18446744073709551615


def test_profile_log(spark, tmp_path):
    (tmp_path / "p.log").write_text("1 node put 3 9 0:1 4:2\n2 node put 5 12 0:2 4:3\n2 node get 1 1 7:1\n")
    got = sorted((r["name"], r["bucket"], r["n"]) for r in sources.profile_log(spark, str(tmp_path / "p.log")).collect())
    assert got == [("get", 7, 1), ("put", 0, 2), ("put", 4, 3)]


def test_tables(spark, tmp_path):
    rows = sources.generated(spark, 3)
    sources.write_tsv(rows.select("key", F.hex("value").alias("value")), f"{tmp_path}/t")
    back = sources.samples_tsv(spark, f"{tmp_path}/t", "key string, value string").filter("key <> 'key'")
    assert back.count() == 3
    assert sources.markdown(spark.range(1)).endswith("| 0 |")
    sources.write_state(rows, f"{tmp_path}/s")
    sources.write_state(rows.limit(2), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("s")] == ["s"]
    (tmp_path / "b.csv").write_text("system,rps\nx,12.5\ny,bad\n")
    assert [tuple(r) for r in sources.benchmark_csv(spark, f"{tmp_path}/b.csv", "system string, rps double").collect()] == [("x", 12.5), ("y", None)]
    (tmp_path / "c.tsv").write_text("1.5\tnode\t2\t3\n")
    assert tuple(sources.samples_tsv(spark, f"{tmp_path}/c.tsv").first()) == (1.5, "node", 2.0, 3.0)
    sources.write_ledger(rows.select("key"), f"{tmp_path}/l")
    sources.write_summary(rows.groupBy().count(), f"{tmp_path}/sum")
    assert spark.read.json(f"{tmp_path}/l").count() == 3 and spark.read.json(f"{tmp_path}/sum").first()["count"] == 3


def test_generated_values(spark):
    def expected(key, turn, size):
        mask, out = (1 << 64) - 1, b""
        x = key ^ ((turn << 17 | turn >> 47) & mask) ^ 0x9E3779B97F4A7C15
        while len(out) < size:
            x ^= x >> 12
            x ^= x << 25 & mask
            x ^= x >> 27
            out += (x * 0x2545F4914F6CDD1D & mask).to_bytes(8, "big")
        return out[:size]

    rows = sources.generated(spark, 50, 3, 21)
    assert all(bytes(r["value"]) == expected(r["key"], 3, 21) for r in rows.collect())
    seen = rows.filter("key <> 4").withColumn("value", F.when(F.col("key") == 7, b"x").otherwise(F.col("value")))
    gone = spark.range(8, 10).withColumnRenamed("id", "key")
    assert sorted(map(tuple, sources.dataset_errors(rows, gone, seen).collect())) == [(4, "missing"), (7, "wrong"), (8, "still there"), (9, "still there")]


def test_run_folder_and_milestones(spark, tmp_path):
    for name, mode in (("latency-1", "latency"), ("overload-2", "latency"), ("other", "fault")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "summary.json").write_text(json.dumps({"mode": mode, "n": 1}, indent=1))
    assert sorted((r["run"], r["kind"]) for r in sources.run_folder(spark, f"{tmp_path}/runs", "latency").collect()) == [("latency-1", "latency"), ("overload-2", "overload")]
    assert sources.run_folder(spark, f"{tmp_path}/runs").count() == 3
    lines = [("topology_published", 3, {"epoch": 4}), ("migration_phase_changed", 5, {"phase": "Complete", "epoch": 18446744073709551615}), ("migration_phase_changed", 9, {"phase": "Copying", "epoch": 9}), ("scaling_transition_complete", 4, {"target_epoch": 6})]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"event": e, "unix_ms": t, "fields": f}) for e, t, f in lines))
    events, _ = sources.event_log(spark, f"{tmp_path}/m.jsonl")
    assert int(sources.published_epoch(events).first()["epoch"]) == 18446744073709551615
    assert sources.latest_milestones(events, "migration_phase_changed").first()["unix_ms"] == 9


def test_more_streams(spark, tmp_path):
    rows = [("a", 1, "x", 1, "entry"), ("a", 2, "y", 2, "entry"), ("a", 1, "x", 1, "entry"), ("a", 1, "z", 1, "entry"), ("a", 5, "", 0, "checkpoint"), ("a", 4, "q", 0, "entry"), ("a", 6, "r", 2, "entry"), ("b", 1, "x", 7, "entry"), ("b", 3, "x", 8, "entry")]
    steps = f"{tmp_path}/steps"
    for i, r in enumerate(rows):  # one file a batch, in order
        spark.createDataFrame([r], "k string, seq long, fp string, own long, kind string").coalesce(1).write.mode("append").parquet(steps)
        import time

        time.sleep(0.01)
    schema = spark.read.parquet(steps).schema
    found = run(streaming.ordered_apply(streaming.bounded_source(spark, schema, steps, 1), "k", "seq", "fp", "own", "kind"), tmp_path, "ordered")
    assert found.recentProgress and sorted(map(tuple, spark.table("ordered").collect())) == sorted([("a", 1, "applied"), ("a", 2, "applied"), ("a", 1, "duplicate"), ("a", 1, "conflict"), ("a", 5, "checkpoint"), ("a", 4, "duplicate"), ("a", 6, "stale"), ("b", 1, "applied"), ("b", 3, "gap")])
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    first = spark.createDataFrame([("m", "f", 0, False), ("m", "f", 1, True), ("m", "g", 2, False), ("n", "h", 3, False)], "id string, fp string, t long, dropped boolean").withColumn("ts", at(F.col("t"))).withColumn("until", at(F.col("t") + 10))
    first.coalesce(1).write.parquet(f"{tmp_path}/first")
    late = first.limit(1).withColumn("id", F.lit("z")).withColumn("ts", at(F.lit(500))).withColumn("until", at(F.lit(900)))
    read = lambda: spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/first")
    run(streaming.retried(read(), "id", "fp", "ts", "60 SECONDS"), tmp_path, "retried")
    assert sorted(map(tuple, spark.table("retried").collect())) == [("m", "f", "first"), ("m", "f", "retry"), ("m", "g", "conflict"), ("n", "h", "first")]
    run(streaming.sent_and_late(read(), "ts", "1 minute", "0 seconds", "dropped"), tmp_path, "sent", "complete")
    assert [(r["issued"], r["late"]) for r in spark.table("sent").collect()] == [(3, 1)]
    time.sleep(1.1)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/first")
    run(streaming.leases(read(), "id", "ts", "until", "0 seconds"), tmp_path, "leases")
    got = sorted(map(tuple, spark.table("leases").collect()))
    assert [g for g in got if g[1] == "expired"] == [("m", "expired"), ("n", "expired")] and ("z", "renewed") in got
    streaming.in_batches(read().groupBy().count(), "10 milliseconds")


def test_expiring(spark, tmp_path):
    import time

    rows = spark.createDataFrame([("k", int(time.time() * 1000) + 1)], "k string, until long")
    rows.write.parquet(f"{tmp_path}/in")
    query = streaming.expiring(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k", "until").writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and spark.table("gone").count() < 2:
        time.sleep(0.5)
    query.stop()
    assert sorted(r["verdict"] for r in spark.table("gone").collect()) == ["expired", "written"]


def test_entry_errors(spark):
    from annulus.operators import log

    ranges = spark.createDataFrame([(0, 100, "a", ["b", "c"]), (100, 0, "b", ["c"])], "start long, end long, owner string, followers array<string>")
    good = (1, "m", "k", "v", False, 5, "a", 5, "a", 50)
    rows = [good, (0, *good[1:]), (1, "", *good[2:]), (1, "m", "", *good[3:]), (*good[:4], True, *good[5:]), (*good[:7], None, "a", 50), (*good[:7], 4, "a", 50), (*good[:5], 4, "a", 4, "a", 50), (*good[:6], "b", 5, "b", 50), (*good[:6], "b", 5, "b", 500)]
    frame = spark.createDataFrame(rows, "stream_seq long, mutation_id string, key string, value string, deleted boolean, epoch long, owner string, version_epoch long, version_owner string, token long")
    errors = lambda node: sorted(str(r["error"]) for r in log.entry_errors(frame, ranges, node, 5, bits=12).collect())
    want = ["None", "None", "another epoch", "deleted entry with a value", "key size", "mutation id size", "no version", "not the current owner", "sequence must be greater than zero", "version of another stream"]
    assert errors("c") == want and errors("b").count("not a follower") == 1


def test_command_line(spark, tmp_path, capsys):
    from annulus.__main__ import main

    main(["list"])
    assert "key_balance" in capsys.readouterr().out.split()
    main(["run", "scenario_transitions", "unused", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    main(["explain", "scenario_transitions", "unused"])
    assert "Scan" in capsys.readouterr().out
