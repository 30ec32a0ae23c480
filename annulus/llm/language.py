"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lengths of the character n-grams, and the number of slots that they are hashed to.
SPECTRUM, SLOTS = (1, 2, 3), 1 << 16
#: For each language: most distinct texts to learn from, and landmarks among them. Those of the smallest hash are taken.
MOST_LEARNT, LANDMARKS = 150, 24
#: Texts and landmarks of all languages, about: with many languages, each has fewer, but one at least.
ALL_LEARNT, ALL_LANDMARKS = 12_000, 960
#: Texts whose presences are multiplied at once.
TEXTS_AT_ONCE = 64
RIDGE, SHARPNESS = 1e-2, 6.0
#: Characters that are hashed at once.
AT_ONCE = 1 << 20
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """The sorted slots of the n-grams that a whole text holds, of all lengths, in lower case with digits alike. n-grams that span a piece's end are hashed with the next piece."""
    seen = np.zeros(SLOTS, bool)
    overlap = max(SPECTRUM) - 1
    for first in range(0, max(len(text), 1), AT_ONCE):
        piece = text[first : first + AT_ONCE + overlap].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[(codes >= 48) & (codes <= 57)] = 48
        rolling = np.zeros(len(codes), np.uint64)
        for n in range(1, max(SPECTRUM) + 1):
            if len(codes) < n:
                break
            rolling = (rolling[: len(codes) - n + 1] if n > 1 else rolling) * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in SPECTRUM:
                mixed = rolling * np.uint64(0xD6E8FEB86659FD93)
                seen[(mixed >> np.uint64(64 - 16)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmarks.

    The kernel of two texts is the number of n-grams that both hold, over the root of the product of their own numbers. All of a text's regressions are linear in its presences, so they come to one table (slots by languages).
    """

    def __init__(self, langs: list[str], texts: list[np.ndarray], landmarks: list[int]):
        self.langs = sorted(set(langs))
        marks = presences([texts[i] for i in landmarks])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
        to_space = vectors[:, keep] / np.sqrt(values[keep])
        space = products(marks.T, texts) @ to_space
        space = np.hstack([space, np.ones((len(space), 1))])
        place = {x: i for i, x in enumerate(self.langs)}
        at = np.array([place[lang] for lang in langs])
        is_lang = np.full((len(langs), len(place)), -1.0)
        is_lang[np.arange(len(langs)), at] = 1.0
        weight = np.sqrt(1 / np.bincount(at)[at])[:, None]
        left = space * weight
        ridge = np.eye(left.shape[1]) * RIDGE
        ridge[-1, -1] = 1e-9
        solved = np.linalg.solve(left.T @ left + ridge, left.T @ (is_lang * weight))
        self.table, self.bias = np.ascontiguousarray(marks.T @ (to_space @ solved[:-1]), np.float32), solved[-1]

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        """Regression values, texts by languages."""
        return products(self.table, slots) + self.bias


def presences(slots: list[np.ndarray]) -> np.ndarray:
    """A row for each text: over the root of their number, ones in its slots."""
    out = np.zeros((len(slots), SLOTS), np.float32)
    for row, s in zip(out, slots, strict=True):
        row[s] = 1 / np.sqrt(max(len(s), 1))
    return out


def products(table: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """The presences of texts times a table of SLOTS rows, TEXTS_AT_ONCE texts at a time."""
    found = [presences(slots[i : i + TEXTS_AT_ONCE]) @ table for i in range(0, len(slots), TEXTS_AT_ONCE)]
    return np.concatenate([np.zeros((0, table.shape[1])), *found])


def learn(known: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of every language that has a label, from at most MOST_LEARNT distinct texts of each (fewer where there are more than ALL_LEARNT in all), of which only the presences come to the driver; None without any label."""
    spark = known.sparkSession
    some = known.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("place")).distinct()
    n_langs = some.select("lang").distinct().count()
    if not n_langs:
        return None
    quota = max(1, min(MOST_LEARNT, ALL_LEARNT // n_langs))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place"))
    chosen = [(r["lang"], r["place"]) for r in some.withColumn("rank", rank).filter(F.col("rank") <= quota).select("lang", "place").collect()]
    ids = spark.createDataFrame(chosen, "its string, at long")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([presence(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["lang", "place", "slots"])

    source = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("place"), F.col(text_col).alias("text"))
    taken = source.join(F.broadcast(ids), (F.col("lang") == F.col("its")) & (F.col("place") == F.col("at")), "left_semi")
    rows = {(r["lang"], r["place"]): r["slots"] for r in taken.mapInArrow(run, "lang string, place long, slots array<int>").dropDuplicates(["lang", "place"]).collect()}
    order = sorted(rows)
    marks, seen = [], {}
    for i, (lang, _) in enumerate(order):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= max(1, min(LANDMARKS, ALL_LANDMARKS // n_langs)):
            marks.append(i)
    return Model([lang for lang, _ in order], [np.array(rows[k], np.int32) for k in order], marks)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every whole text: the language of the largest regression value, and its share of a softmax of all (0 to 1).

    Null texts and those without a letter: `und`, score 0; so are all without a model. Texts are scored in batches, by products of their presences with the model's table. Repeated rows and null ids are kept as they are. An empty table gives an empty one. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.table, model.bias))

    def run(batches):
        langs_of, table, bias = shared.value or ([], None, None)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            which = [i for i, t in enumerate(texts) if langs_of and t and has_letter(t)]
            if which:
                values = np.exp(SHARPNESS * (products(table, [presence(texts[i]) for i in which]) + bias))
                best = values.argmax(axis=1)
                for i, b in zip(which, best, strict=True):
                    langs[i] = langs_of[b]
                sure[which] = values.max(axis=1) / values.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sure)], names=["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double").select(F.col("id").alias(id_col), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learnt from; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
