"""How a load picks operations and keys, what a run's settings come to, and texts that are compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of Euclid's algorithm that 64-bit numbers need at most, and candidates among which a stride is found.
EUCLID, CANDIDATES = 94, 128
#: Steps that a number below LEAST_STRIDE + CANDIDATES needs with any other.
SHORT = 16
LEAST_STRIDE = 37


def gcd(a: Column, b: Column, steps: int = EUCLID) -> Column:
    """The greatest common divisor, by Euclid's algorithm."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).otherwise(0).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["a"]


def coprime_stride(total: Column) -> Column:
    """The least step from LEAST_STRIDE on that shares no factor with a total, so that a walk by it reaches every slot; 1 for totals up to 1."""
    found = F.filter(F.sequence(F.lit(LEAST_STRIDE), F.lit(LEAST_STRIDE + CANDIDATES)), lambda s: gcd(total, s, SHORT) == 1)
    return F.when(total <= 1, F.lit(1).cast("long")).otherwise(F.get(found, F.lit(0)).cast("long"))


def parse_mix(text: Column) -> Column:
    """GET:PUT:DELETE as a struct (get, put, delete, total); null if it isn't three whole numbers of which one is above 0."""
    parts = F.transform(F.split(text, ":"), lambda p: F.when(F.trim(p).rlike(r"\A\+?[0-9]+\z"), F.trim(p).try_cast("long")))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p)
    return F.when((F.size(parts) == 3) & (total > 0), F.struct(F.get(parts, F.lit(0)).alias("get"), F.get(parts, F.lit(1)).alias("put"), F.get(parts, F.lit(2)).alias("delete"), total.alias("total")))


def pick(mix: Column, draw: Column) -> Column:
    """The operation of a number below a mix's total: weights are passed in order."""
    return F.when(draw < mix["get"], "get").when(draw < mix["get"] + mix["put"], "put").otherwise("delete")


def choose(mix: Column, step: Column, worker: Column, stride: Column) -> Column:
    """The operation of a worker's step on the walk by a stride."""
    return pick(mix, F.pmod(step * stride + worker * 11, mix["total"]))


@dataclass(frozen=True)
class Distribution:
    """How the keys of a load are drawn: uniform, zipf:<theta>, or hotspot:<key share>:<traffic share>."""

    kind: str
    keys: int
    theta: float = 0.0
    hot_keys: int = 0
    traffic: float = 0.0

    @staticmethod
    def parse(text: str, keys: int) -> Distribution:
        kind, *rest = [p.strip() for p in text.strip().split(":")]
        if kind.lower() == "uniform" and not rest:
            return Distribution("uniform", keys)
        if kind == "zipf" and len(rest) == 1 and 0 < float(rest[0]) < float("inf") and keys > 0:
            return Distribution("zipf", keys, theta=float(rest[0]))
        if kind == "hotspot" and len(rest) == 2 and 0 < float(rest[0]) < 1 and 0 < float(rest[1]) < 1:
            hot = int(keys * float(rest[0]) + 0.5)
            if 0 < hot < keys:
                return Distribution("hotspot", keys, hot_keys=hot, traffic=float(rest[1]))
        raise ValueError(f"no distribution of {keys} keys: {text!r}")

    def sample(self, rows: DataFrame, first: str, second: str, out: str = "drawn") -> DataFrame:
        """rows with a key drawn by uniform numbers in [0, 1) (first chooses the side of a hotspot, second the key). The Zipf law's cumulative shares are joined by ranges of shares, not as one array."""
        scaled = lambda n: F.least(F.floor(F.col(second) * n), F.lit(n - 1))
        if self.kind == "uniform":
            return rows.withColumn(out, scaled(self.keys))
        if self.kind == "hotspot":
            return rows.withColumn(out, F.when(F.col(first) < self.traffic, scaled(self.hot_keys)).otherwise(self.hot_keys + scaled(self.keys - self.hot_keys)))
        from annulus.operators import ring

        bits = 40
        law = rows.sparkSession.range(self.keys).select("id", (1.0 / F.pow(F.col("id") + 1.0, F.lit(self.theta))).alias("w"))
        shares = running_share(law, "id", "w")
        cut = F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(F.col("share") * float(1 << bits)) - 1)).cast("long")
        ends = shares.select("id", F.when(F.col("id") == self.keys - 1, F.lit((1 << bits) - 1).cast("long")).otherwise(cut).alias("end")).groupBy("end").agg(F.min("id").alias(out))
        from pyspark.sql import Window as W

        order = W.orderBy("end")
        ranges = ends.select(out, "end", F.coalesce(F.lag("end").over(order), F.lit((1 << bits) - 1).cast("long")).alias("start"))
        return ring.ring_join(rows.withColumn("_t", F.floor(F.col(second) * float(1 << bits)).cast("long")), ranges, bits, token="_t").drop("_t", "start", "end")


def running_share(rows: DataFrame, order: str, weight: str) -> DataFrame:
    """rows with `share`: the part of all weight up to and including each, in order. Sums of slices first, so that no task sums all rows."""
    from pyspark.sql import Window as W

    sliced = rows.withColumn("_slice", F.floor(F.col(order) / 4096))
    whole = sliced.groupBy("_slice").agg(F.sum(weight).alias("_w"))
    before = whole.select("_slice", (F.sum("_w").over(W.orderBy("_slice")) - F.col("_w")).alias("_before"), F.sum("_w").over(W.partitionBy()).alias("_all"))
    upto = F.sum(weight).over(W.partitionBy("_slice").orderBy(order))
    return sliced.join(F.broadcast(before), "_slice").withColumn("share", (F.col("_before") + upto) / F.col("_all")).drop("_slice", "_before", "_all")


def delete_pool(rates: Column, seconds: Column, delete_share: Column, keys: Column) -> Column:
    """How many keys deletes may use up: what all rates ask for, between 5 and 50 % of the keys, and never all of them; 0 without deletes."""
    expected = F.ceil(F.aggregate(rates, F.lit(0.0), lambda a, r: a + r * seconds * delete_share))
    wanted = F.least(F.greatest(expected, F.floor(keys * 0.05)), F.floor(keys * 0.5))
    return F.when(delete_share <= 0, F.lit(0).cast("long")).otherwise(F.least(wanted, F.greatest(keys - 1, F.lit(0))).cast("long"))


# The percent of a rate that rewrites, new writes and deletes get, in a closed and an open load.
COHORTS = {"closed": (60, 25, 15), "open": (12, 5, 3)}


def cohort_rates(mode: Column, total: Column) -> Column:
    """(rewrite, write_new, delete): whole operations a second of each cohort."""
    of = lambda shares: F.struct(*[F.floor(total * s / 100).cast("long").alias(n) for n, s in zip(("rewrite", "write_new", "delete"), shares, strict=True)])
    return F.when(mode == "closed", of(COHORTS["closed"])).otherwise(of(COHORTS["open"]))


def scene(mode: Column, scenario: Column, fault: Column) -> Column:
    """Which replay fits a run: expansion, fault, or none."""
    grows = scenario.isin("grow", "shrink", "round-trip", "churn", "replace")
    return F.when((mode == "correctness") | ((mode == "scaling") & F.coalesce(grows, F.lit(False))), "expansion").when((mode == "availability") | ((mode == "fault") & (fault == "owner")), "fault")


def change_direction(label: Column) -> Column:
    return F.when(label.isin("scale_in", "shrink"), "shrink").when(label == "replace", "replace").otherwise("grow")


# The transitions of each scaling scenario.
TRANSITIONS = {"grow": ("grow",), "shrink": ("shrink",), "round-trip": ("grow", "shrink"), "churn": ("grow", "shrink"), "replace": ("replace",), "control": ("control",)}
# The strata that can occur in each kind of transition.
STRATA = {
    "grow": ("new_target", "owner_changed", "replicas_changed", "unchanged"),
    "shrink": ("removed_source", "owner_changed", "replicas_changed", "unchanged"),
    "replace": ("removed_source", "new_target", "owner_changed", "replicas_changed", "unchanged"),
    "control": ("unchanged",),
}


def transitions(spark) -> DataFrame:
    """(scenario, nth, label): what each scenario does, in order."""
    return spark.createDataFrame([(s, i, label) for s, labels in TRANSITIONS.items() for i, label in enumerate(labels)], "scenario string, nth int, label string")


def expected_strata(present: DataFrame, label: str) -> DataFrame:
    """(stratum): those that are present and can occur in a transition."""
    can = present.sparkSession.createDataFrame([(s,) for s in STRATA[label]], "stratum string")
    return present.select("stratum").intersect(can)


def canonical(json: Column) -> Column:
    """JSON text with the keys of all objects in order; a null stays apart from a key that is missing. Null for text that isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def leaves(rows: DataFrame, key: str, json: str, depth: int = 8) -> DataFrame:
    """(key, path, number): the numbers in a JSON column, by their path (keys and places, joined by points). Objects and arrays are opened level by level, to a depth, in one pass; what is no container goes through as it is."""
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v"))
    for _ in range(depth):
        named = lambda step: F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", F.col("path"), step))
        inside = lambda k, v: F.struct(named(k).alias("path"), v.alias("v"))
        objects = F.transform(F.map_entries(F.variant_get("v", "$", "map<string,variant>")), lambda e: inside(e["key"], e["value"]))
        arrays = F.transform(F.variant_get("v", "$", "array<variant>"), lambda v, i: inside(i.cast("string"), v))
        kind = F.schema_of_variant("v")
        opened = F.when(kind.startswith("OBJECT"), objects).when(kind.startswith("ARRAY"), arrays).otherwise(F.array(F.struct("path", "v")))
        level = level.select(key, F.explode(opened).alias("x")).select(key, "x.path", "x.v")
    is_number = F.schema_of_variant("v").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return level.filter(is_number).select(key, "path", F.variant_get("v", "$", "double").alias("number"))
