"""Readers and writers of event logs, result folders, profiles and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed) of a JSONL log: events as (unix_ms, line, event, fields as a variant, whose large integers stay exact). Lines keep their order in their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda at, kind: F.try_variant_get("v", at, kind)
    ok = F.col("v").isNotNull() & get("$.event", "string").isNotNull() & get("$.unix_ms", "bigint").isNotNull()
    events = parsed.filter(ok).select(get("$.unix_ms", "bigint").alias("unix_ms"), "file", "line", get("$.event", "string").alias("event"), F.try_variant_get("v", "$.fields", "variant").alias("fields"))
    return events, parsed.filter(~F.coalesce(ok, F.lit(False))).select("file", "line", "value")


def run_folder(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """Summaries of runs (one JSON document in each), those of a mode; latency runs get a kind from their name's prefix."""
    runs = spark.read.option("multiLine", True).json(f"{path}/*/summary.json").withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    kind = F.when(F.startswith("run", F.lit("latency-")), "latency").when(F.startswith("run", F.lit("overload-")), "overload").otherwise("other")
    return (runs.filter(F.col("mode") == mode) if mode else runs).withColumn("kind", kind)


def profile_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, bucket, n): the last cumulative line of each histogram in each file; lines are: ms role name count sum bucket:count..."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 5)
    last = lines.groupBy("file", F.col("f")[2].alias("name")).agg(F.max_by("f", "line").alias("f"))
    pair = F.split("pair", ":")
    return last.select("file", "name", F.explode(F.slice("f", 6, 1 << 20)).alias("pair")).select("file", "name", pair[0].cast("int").alias("bucket"), pair[1].cast("long").alias("n"))


def benchmark_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a benchmark's CSV files, with a header; what doesn't fit the schema is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def samples_tsv(spark: SparkSession, path: str, schema: str = "at double, name string, user double, sys double") -> DataFrame:
    """Processor samples, without a header, separated by tabs."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def write_event_log(events: DataFrame, path: str) -> None:
    """JSONL with (event, unix_ms, fields)."""
    events.select("event", "unix_ms", "fields").write.mode("append").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_ledger(requests: DataFrame, path: str) -> None:
    """A request ledger as JSON lines, all its columns; nulls are left out."""
    requests.write.mode("append").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A small summary as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_state(rows: DataFrame, path: str) -> None:
    """A table as it is now, replacing what was there: written beside it, then renamed, so that a reader sees the old or the new one, and a failed write leaves the old."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(fresh.toString())
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)


def markdown(rows: DataFrame, limit: int = 1_000) -> str:
    """A small result as a Markdown table."""
    head = f"| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}"
    return "\n".join([head, *[f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows.limit(limit).collect()]])


#: Fixed values of the generator: what the state starts from, its shifts and its multiplier.
SEED, SHIFTS, FACTOR = 0x9E3779B97F4A7C15, (12, 25, 27), 0x2545F4914F6CDD1D


def value_of(key: int, turn: int, size: int) -> bytes:
    """The value of a key in a round: blocks of an xorshift* generator whose state starts from both."""
    mask = (1 << 64) - 1
    state, out = (key ^ (turn << 17 | turn >> 47) ^ SEED) & mask, b""
    while len(out) < size:
        state ^= state >> SHIFTS[0]
        state = (state ^ state << SHIFTS[1]) & mask
        state ^= state >> SHIFTS[2]
        out += (state * FACTOR & mask).to_bytes(8, "big")
    return out[:size]


def generated(spark: SparkSession, n: int, turn: int = 0, size: int = 64) -> DataFrame:
    """(key, value): the reproducible data set of n keys in a round, made in batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value_of(k, turn, size) for k in batch.column(0).to_pylist()], pa.binary())], names=["key", "value"])

    return spark.range(n).select(F.col("id").alias("key")).mapInArrow(run, "key long, value binary")


def dataset_errors(expected: DataFrame, deleted: DataFrame, observed: DataFrame) -> DataFrame:
    """(key, error): keys of a data set (key, value) that are missing, wrong, or (deleted ones) still there."""
    want = expected.join(deleted.select("key"), "key", "left_anti").select("key", F.col("value").alias("want"))
    both = want.withColumn("wanted", F.lit(True)).join(observed.select("key", F.col("value").alias("got"), F.lit(True).alias("there")), "key", "full")
    error = F.when(F.col("wanted").isNull(), "still there").when(F.col("there").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("got")), "wrong")
    return both.select("key", error.alias("error")).filter("error IS NOT NULL")


def latest_milestones(events: DataFrame, name: str) -> DataFrame:
    """The last event of a name in each file, in (unix_ms, line) order."""
    order = W.partitionBy("file").orderBy(F.desc("unix_ms"), F.desc("line"))
    return events.filter(F.col("event") == name).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


# The events that say which topology was published, by where the epoch stands.
PUBLISHED = {"epoch": ("topology_published", "failover_published", "fault_published", "full_rf_restored", "fault_full_rf_restored"), "target_epoch": ("scaling_transition_complete",)}
PHASES_PUBLISHED = ("Published", "CleaningUp", "Complete")


def published_epoch(events: DataFrame) -> DataFrame:
    """(file, epoch): the topology that each log published last."""
    field = lambda name: F.try_variant_get("fields", f"$.{name}", "decimal(20,0)")
    phase = (F.col("event") == "migration_phase_changed") & F.try_variant_get("fields", "$.phase", "string").isin(*PHASES_PUBLISHED)
    epoch = F.when(F.col("event").isin(*PUBLISHED["epoch"]) | phase, field("epoch")).when(F.col("event").isin(*PUBLISHED["target_epoch"]), field("target_epoch"))
    told = events.withColumn("epoch", epoch).filter("epoch IS NOT NULL")
    return told.groupBy("file").agg(F.max_by("epoch", F.struct("unix_ms", "line")).alias("epoch"))
