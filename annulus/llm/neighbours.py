"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.llm.common import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most rows of a block of candidates and of queries; a task works on one of each at a time. Each row travels once for each block of queries, each query once for each block of rows, so that large blocks make small shuffles.
CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 65_536, 65_536
#: Queries whose estimates are held at once, and how many times k of their best estimates are ranked first.
AT_ONCE, FIRST = 64, 8
#: Width of the error bound, in standard deviations of the estimate.
WIDTH = 1.9
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension and a seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, with two scalars for each: their length, and the inner product of the unit vector with its code."""
    dim = vectors.shape[1]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / length[:, None]) @ rotation(dim, seed).T
    fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(turned > 0, axis=1), length, fit


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of queries (rows) with coded vectors (columns), and the bound of their error.

    With code x, unit vector o and unit query q: <o, q> is about <x, q> / <x, o>, and is off by sqrt((1 - f^2) / f^2) / sqrt(dim - 1) in a standard deviation, f = <x, o>.
    """
    dim = queries.shape[1]
    own = np.sqrt((queries * queries).sum(axis=1))
    turned = ((queries / own[:, None]) @ rotation(dim, seed).T).astype(np.float32)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32)
    signs *= 2
    signs -= 1
    scale = (length / fit / np.sqrt(dim)).astype(np.float32)
    about = turned @ signs.T
    about *= scale
    about *= own[:, None].astype(np.float32)
    error = (WIDTH * length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    return about, own[:, None].astype(np.float32) * error


def top(query_ids, queries, ids, vectors, bits, length, fit, k: int, seed: int):
    """(query's index, ids, scores) of each query's k best of a block, by exact products in doubles.

    A query's rows of best estimates are ranked first; the k-th best product is then a floor, and of the others those are ranked whose upper bound reaches it.
    """
    n, some_first = len(ids), FIRST * k
    for first in range(0, len(queries), AT_ONCE):
        some = slice(first, first + AT_ONCE)
        about, error = estimate(queries[some], bits, length, fit, seed)
        about[query_ids[some, None] == ids[None, :]] = -np.inf
        for i, (own, bound) in enumerate(zip(about, error, strict=True)):
            query = queries[first + i]
            near = np.argpartition(own, n - some_first)[n - some_first :] if n > some_first else np.arange(n)
            near = near[own[near] > -np.inf]
            score = (vectors[near].astype(np.float64) * query).sum(axis=1)
            if n > some_first:
                floor = np.partition(score, len(score) - k)[len(score) - k]
                # A floor in single precision, less what rounding may take from an estimate.
                reach = own + bound >= np.float32(floor) - np.float32(1e-5) * np.abs(np.float32(floor))
                reach[near] = False
                more = np.flatnonzero(reach)
                near, score = np.concatenate([near, more]), np.concatenate([score, (vectors[more].astype(np.float64) * query).sum(axis=1)])
            best = np.lexsort((ids[near], -score))[:k]
            yield first + i, ids[near[best]], score[best]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector), without vectors that are null, empty, zero, or hold null or non-finite components, and without null ids. Floats stay floats; anything else becomes doubles."""
    of = rows.schema[vector_col].dataType.elementType.simpleString()
    whole = F.aggregate("vector", F.lit(True), lambda a, x: a & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    vector = F.col(vector_col).cast(f"array<{of if of == 'float' else 'double'}>")
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.coalesce(some, F.lit(False)))


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query(id column) holds, the k nearest other rows by inner product, nearest first, ties to the smaller id. Fewer than k others: all of them.

    Every row is coded as the signs of its randomly rotated components, packed, with two correction scalars. Queries and rows are dealt in blocks, each query block against each block of rows; a block's estimates and their error bounds choose the rows whose exact inner product (in doubles, on the original vectors) is taken. Rows travel with code and vector, once for each block of queries; of a query's k best of each block, the k best of all are kept by a limit within groups, which drops most before the shuffle.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of different length are never compared. Of rows that share an id, the smallest vector, component by component, stands for all. Other columns are not looked at.
    """
    spark = rows.sparkSession
    one = usable(rows, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    slim = checkpointed(one.withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False))))
    dims = slim.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"))
    # A small table still makes a block for each core.
    least = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / 1024))
    blocks = checkpointed(dims.select("dim", F.greatest(F.ceil(F.col("n") / CANDIDATES_A_BLOCK), least).cast("int").alias("bases"), F.ceil(F.col("asking") / QUERIES_A_BLOCK).cast("int").alias("quests")))
    sized = slim.join(F.broadcast(blocks), "dim")  # a row for each length of vectors
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    of = slim.schema["vector"].dataType.simpleString()
    kind = np.float32 if of == "array<float>" else np.float64

    def pack(batches):
        for batch in batches:
            at = np.array(batch.column("dim").to_pylist(), int)
            size = len(at)
            vectors, bits, length, fit = [b""] * size, [b""] * size, np.zeros(size), np.zeros(size)
            for d in np.unique(at):
                which = np.flatnonzero(at == d)
                v = _matrix(batch.column("vector").take(pa.array(which)))
                b, length[which], fit[which] = encode(v.astype(np.float64), seed)
                for i, w in enumerate(which):
                    vectors[w], bits[w] = v[i].tobytes(), b[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "dim", "base", "quests")] + [pa.array(vectors, pa.binary()), pa.array(bits, pa.binary()), pa.array(length), pa.array(fit)], names=["id", "dim", "base", "quests", "vector", "bits", "length", "fit"])

    coded = sized.filter("quests > 0").select("id", "vector", "dim", deal("base", "bases").alias("base"), "quests").mapInArrow(pack, "id long, dim int, base int, quests int, vector binary, bits binary, length double, fit double")
    quests = sized.filter("asks").select("id", "vector", "dim", deal("quest", "quests").alias("quest"), F.explode(F.sequence(F.lit(0), F.col("bases") - 1)).alias("base"))
    bases = coded.select("*", F.explode(F.sequence(F.lit(0), F.col("quests") - 1)).alias("quest")).drop("quests")

    def plain(column: pa.ChunkedArray, of) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), of).reshape(len(column), -1)

    def search(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(asked) and len(known):
            query_ids = asked.column("id").to_numpy()
            scalars = (known.column(c).to_numpy() for c in ("length", "fit"))
            for i, ids, scores in top(query_ids, _matrix(asked.column("vector")).astype(np.float64), known.column("id").to_numpy(), plain(known.column("vector"), kind), plain(known.column("bits"), np.uint8), *scalars, k, seed):
                for to, what in zip(found, (np.full(len(ids), query_ids[i]), ids, scores), strict=True):
                    to.append(what)
        joined = [np.concatenate(x) if x else [] for x in found]
        return pa.table({"query_id": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    keys = ("dim", "quest", "base")
    near = quests.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInArrow(lambda key, a, b: search(key, a, b), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
