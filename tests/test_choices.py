"""Choices of a load, settings of runs, flat rows: small cases."""

import math

import pytest
from pyspark.sql import functions as F

from annulus.functions import choices
from annulus.operators import log, stages


def test_strides(spark):
    got = spark.range(1, 400).select("id", choices.coprime_stride(F.col("id")).alias("s"), choices.gcd(F.col("id"), F.lit(84)).alias("g")).collect()
    for r in got:
        want = 1 if r["id"] <= 1 else next(s for s in range(37, 999) if math.gcd(s, r["id"]) == 1)
        assert r["s"] == want and r["g"] == math.gcd(r["id"], 84)


def test_mixes(spark):
    texts = ["90:9:1", " 1 : 2 : 3 ", "1:2", "0:0:0", "a:1:1", "1:-1:1", "1:1:1:1", None, ""]
    got = [r["m"] and tuple(r["m"]) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", choices.parse_mix(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [(90, 9, 1, 100), (1, 2, 3, 6), None, None, None, None, None, None, None]


@pytest.mark.parametrize("text", ["zipf:0", "zipf:inf", "zipf:x", "hotspot:0.5", "hotspot:0:0.5", "hotspot:0.001:0.5", "other", "uniform:1"])
def test_no_distribution(text):
    with pytest.raises(ValueError):
        choices.Distribution.parse(text, 100)


def test_zipf_is_a_binary_search(spark):
    rows = spark.range(2000).select(F.lit(0.0).alias("a"), ((F.col("id") + 0.5) / 2000).alias("b"))
    law = choices.Distribution.parse("zipf:1.2", 300)
    upto, total = [], 0.0
    for k in range(300):
        total += 1 / (k + 1) ** 1.2
        upto.append(total)
    for r in law.sample(rows, "a", "b").collect():
        assert r["drawn"] == min(sum(u <= r["b"] * total for u in upto), 299)
    assert law.sample(rows, "a", "b").count() == 2000


def test_pools_and_rates(spark):
    one = spark.range(1).select(
        choices.delete_pool(F.array(F.lit(10.0), F.lit(20.0)), F.lit(10.0), F.lit(0.1), F.lit(1000)).alias("least"),
        choices.delete_pool(F.array(F.lit(1000.0)), F.lit(10.0), F.lit(0.9), F.lit(1000)).alias("most"),
        choices.delete_pool(F.array(F.lit(1000.0)), F.lit(10.0), F.lit(0.02), F.lit(1000)).alias("between"),
        choices.delete_pool(F.array(F.lit(1000.0)), F.lit(10.0), F.lit(0.0), F.lit(1000)).alias("none"),
        choices.cohort_rates(F.lit("closed"), F.lit(99)).alias("closed"),
        choices.cohort_rates(F.lit("open"), F.lit(99)).alias("open"),
    ).first()
    assert (one["least"], one["most"], one["between"], one["none"]) == (50, 500, 200, 0)
    assert tuple(one["closed"]) == (59, 24, 14) and tuple(one["open"]) == (11, 4, 2)


def test_json(spark):
    rows = spark.createDataFrame([(1, '{"b": {"x": 1, "y": [2, {"z": 3.5}, "s", null]}, "a": true, "n": -4}'), (2, "7"), (3, "bad"), (4, None)], "id long, j string")
    got = sorted((r["id"], r["path"], r["number"]) for r in choices.leaves(rows, "id", "j").collect())
    assert got == [(1, "b.x", 1.0), (1, "b.y.0", 2.0), (1, "b.y.1.z", 3.5), (1, "n", -4.0), (2, "", 7.0)]
    same = spark.createDataFrame([('{"a": 1, "b": {"d": null, "c": 2}}',), ('{"b": {"c": 2, "d": null}, "a": 1}',), ('{"a": 1, "b": {"c": 2}}',), ("bad",)], "j string").select(choices.canonical(F.col("j")).alias("c")).collect()
    assert same[0]["c"] == same[1]["c"] != same[2]["c"] and same[3]["c"] is None


def test_flat_stages(spark):
    schema = "run string, stages array<struct<target_rate: long, ops: map<string, long>, errors: map<string, long>, latency_us: map<string, struct<p50: long, p99: long>>>>"
    runs = spark.createDataFrame([("r", [(100, {"get": 5}, {"rpc": 2}, {"get": (10, 20)}), (200, {}, {}, {})])], schema)
    first, second = stages.flat_stage(runs).orderBy("nth").collect()
    assert (first["ops_get"], first["ops_put"], first["err_rpc"], first["err_deadline"], first["get_p99"], first["put_p50"]) == (5, 0, 2, 0, 20, None)
    assert second["target_rate"] == 200 and second["ops_get"] == 0 and second["get_p50"] is None


def test_medians(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", 2.0), ("a", 2.0), ("b", 7.0), ("c", None), ("d", 1.0), ("d", 2.0)]
    got = {r["k"]: r["v"] for r in stages.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert got == {"a": 2.0, "b": 7.0, "d": 1.5}


def test_replay_needs_every_entry(spark):
    state = spark.createDataFrame([("k", 1, "old")], "key string, seq long, value string")
    journal = spark.createDataFrame([("k", 5, "x", 5), ("j", 6, "y", 6), ("j", 2, "z", 2)], "key string, seq long, value string, watermark long")
    assert sorted(map(tuple, log.replay_checked(state, journal, "key", ["seq"], 4).collect())) == [("j", 6, "y"), ("k", 5, "x")]
    with pytest.raises(ValueError, match="lacks 1"):
        log.replay_checked(state, journal, "key", ["seq"], 3)
    assert log.replay_checked(state, journal, "key", ["seq"], 9).count() == 1


def test_entry_ignores_only_absent_packages(tmp_path):
    """With a module of the operators broken, the entry fails; without the package, it goes on."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("annulus", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(here, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    ask = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print('op8_bpe' in q, len(q) > 100)"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    if (tmp_path / "annulus" / "llm").exists():
        assert ask().stdout.strip() == "True True"
        os.remove(tmp_path / "annulus" / "llm" / "bpe.py")
        assert ask().returncode != 0
        shutil.rmtree(tmp_path / "annulus" / "llm")
    if (tmp_path / "corpus_pipeline.py").exists():
        os.remove(tmp_path / "corpus_pipeline.py")
    assert ask().stdout.strip() == "False True"
