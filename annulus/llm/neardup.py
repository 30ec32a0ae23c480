"""SimHash near-duplicates by a hierarchical index in Gray order."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Words whose shingles are hashed at once.
WORDS_AT_ONCE = 1 << 16
#: Fingerprints that are searched in one task, and most that may share the bits by which they were dealt; groups above are dealt again by more bits.
TASK, OVERFULL = 1 << 14, 1 << 14
#: Children of an index node; queries that go down the index at once.
FAN, QUERIES = 16, 256

_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text: bit set where it is in over half the hashes of its word shingles. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, n = np.zeros((8, 8), np.int64), len(words) - SHINGLE + 1
    for first in range(0, n, WORDS_AT_ONCE):
        part = words[first : first + WORDS_AT_ONCE + SHINGLE - 1]
        hashes = np.frombuffer(b"".join([digest(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:], strict=False)]), np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(hashes[:, i], minlength=256) @ _BIT
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp): the id, a hash of the text that tells its rows apart, and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "mark", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, mark long, fp long")


def masks_below(mask: int) -> list[int]:
    """The free bits of a mask cut into RADIUS + 1 runs, each added to it: two fingerprints that agree under mask and differ in at most RADIUS bits agree under one of these."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    size = -(-len(free) // (RADIUS + 1))
    return [mask | sum(1 << i for i in free[k : k + size]) for k in range(0, len(free), size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _front(codes: np.ndarray, mask: int) -> np.ndarray:
    """The bits of codes with those under mask moved to the front."""
    order = [i for i in range(63, -1, -1) if mask >> i & 1] + [i for i in range(63, -1, -1) if not mask >> i & 1]
    out = np.zeros_like(codes)
    for to, i in zip(range(63, -1, -1), order, strict=True):
        out |= (codes >> np.uint64(i) & np.uint64(1)) << np.uint64(to)
    return out


class GrayIndex:
    """Codes in Gray order under nodes of FAN children. A node keeps the bits on which all codes below agree, less those its parent already has (`mask`), and their values (`code`). The differences of a query add up on the way down, and a whole group goes once they exceed the radius."""

    def __init__(self, codes: np.ndarray):
        """codes: in Gray order."""
        ones, zeros = codes.copy(), ~codes
        levels = [(ones | zeros, codes)]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones | zeros, ones))
        self.levels = []
        for depth, (agreed, code) in enumerate(levels):
            above = levels[depth + 1][0][np.arange(len(agreed)) // FAN] if depth + 1 < len(levels) else np.zeros_like(agreed)
            self.levels.append((agreed & ~above, code))

    def within(self, queries: np.ndarray, must: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's place, code's place) that differ in at most radius bits, and in none under must."""
        mask, code = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(code))
        node = np.tile(np.arange(len(code)), len(queries))
        sums = np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, code = self.levels[depth]
            differs = (queries[q] ^ code[node]) & mask[node]
            sums = sums + np.bitwise_count(differs)
            keep = (sums <= radius) & (differs & must == 0)
            q, node, sums = q[keep], node[keep], sums[keep]
            if depth:
                size = len(self.levels[depth - 1][0])
                q, sums = np.repeat(q, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < size
                q, node, sums = q[there], node[there], sums[there]
        return q, node


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label[x] is then the smallest member of x's set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label[:] = up
        a, b = a[apart], b[apart]


def forest(fps: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links among fps (distinct, signed) that agree under mask: each linked one with the smallest of its set."""
    fps = np.sort(fps)
    codes = _front(fps.view(np.uint64), mask)
    order = np.argsort(gray_rank(codes), kind="stable")
    codes = codes[order]
    fixed = mask.bit_count()
    must = np.uint64(((1 << fixed) - 1) << (64 - fixed))
    index, label = GrayIndex(codes), np.arange(len(codes))
    for first in range(0, len(codes), QUERIES):
        q, found = index.within(codes[first : first + QUERIES], must, RADIUS)
        a, b = order[q + first], order[found]
        less = a < b
        unite(label, a[less], b[less])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges, u > v, whose connected components are those of all pairs of fingerprints in at most RADIUS differing bits; fewer than one edge for each fingerprint and dealing.

    Fingerprints are dealt by runs of 16 bits: a pair within 3 bits agrees in one of four. What shares a run is searched together, many runs in a task. A run's fingerprints above OVERFULL are dealt again, by four runs of their free bits, until none is.
    """
    n = distinct.count()
    tasks = max(1, n // TASK)

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        under = F.array(*[F.lit(_signed(m)) for m in masks])
        return rows.select("fp", F.explode(under).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    def search(key, rows: pa.Table) -> pa.Table:
        u, v = forest(np.array(rows.column("fp").to_numpy()), key[0].as_py() % (1 << 64))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    masks, rows, found = masks_below(0), dealt(distinct, masks_below(0)), None
    while True:
        over = checkpointed(rows.groupBy("mask", "value").count().filter(F.col("count") > OVERFULL))
        any_over = not over.isEmpty()
        fit = rows.join(over, ["mask", "value"], "left_anti") if any_over else rows
        edges = fit.select("fp", "mask", F.pmod(F.xxhash64("mask", "value"), F.lit(tasks)).alias("task")).groupBy("mask", "task").applyInArrow(lambda key, t: search(key, t), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        if not any_over:
            return found.distinct()
        full = rows.join(over.drop("count"), ["mask", "value"], "left_semi")
        below = {_signed(m): [_signed(x) for x in masks_below(m)] for m in masks}
        step = F.create_map(*[x for m, more in below.items() for x in (F.lit(m), F.array(*map(F.lit, more)))])
        masks = [m for more in below.values() for m in more]
        masks = [m % (1 << 64) for m in masks]
        rows = checkpointed(full.select("fp", F.explode(step[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for the nodes of edges (u, v). Large and small stars alternate until nothing changes; every step is joins on checkpointed edges."""
    edges = checkpointed(edges)
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = checkpointed(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp, component_id, first): every row's fingerprint, the smallest id of its component, and whether it is (a copy of) the row that stands for the component: the smallest non-null id, then mark.

    Fingerprints link at RADIUS or fewer differing bits; all rows of one fingerprint are one node, so copies are never paired. Null, empty and blank texts have fingerprint zero, which links like any other. Null ids: component_id is null only if all ids of the component are. Repeated rows each give a row. An empty table gives an empty one. Other columns are not looked at.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("one")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "one", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("one").alias("best"))
    # Each fingerprint's component; where one holds a large part of all rows, the join's large side is split at run time.
    of = rooted.join(best, "root").select("fp", "best")
    same = (F.col("id").isNull() == F.col("best.no_id")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    return marked.join(of, "fp").select("id", "mark", "fp", F.col("best.id").alias("component_id"), same.alias("first"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Up to so many ids that stand on more than one row (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_REPEATS = 100_000


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, with all its columns: texts go through one shuffle, that of the join with what is kept. Rows that share id and text are counted on the slim frame, and only those of kept ones that repeat are grouped.

    Nulls, empty texts, repeats and empty tables: see group. Columns keep their names, whatever they are.
    """
    keep = checkpointed(group(docs, id_col, text_col).filter("first").groupBy("id", "mark").agg(F.count("*").alias("n")))
    row = docs.select(F.struct("*").alias("row")).withColumn("own", F.xxhash64(F.col("row")[text_col]))
    same = F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark"))
    once = row.join(keep.filter("n = 1"), same, "left_semi").select("row.*")
    again = keep.filter("n > 1")
    n_again = again.count()
    if not n_again:
        return once
    again = F.broadcast(again) if n_again <= BROADCAST_REPEATS else again
    return once.unionByName(row.join(again, same, "left_semi").groupBy(F.col("row")[id_col].alias("id"), "own").agg(F.first("row").alias("row")).select("row.*"))
