"""Byte-level BPE encoding and decoding by recursive DuckDB queries."""

from __future__ import annotations

import base64
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of text (or tokens) that are handled at once, and words whose ids are kept between batches; a longer text is a batch of its own, in pieces of whole words.
TEXT_AT_ONCE, WORDS_KEPT = 1 << 20, 1 << 19
DUCKDB_MEMORY = "300MB"

#: Ids of known words that are kept between batches, at most.
IDS_KEPT = 1 << 23
#: Words above so many bytes are contracted in windows of so many, of which a new one starts every STEP bytes; windows that must be longer by ENCODE_LONG.
LONG, STEP = 160, 80
#: Tokens that are tried to join two windows before a wider one is made.
JOINS = 12

#: A row for each pair of neighbouring tokens of each word, with its place, joins the merge table. A step finds each word's best pair, the leftmost of least rank, and contracts it. Words without a pair in the merge table are done.
ENCODE = """
WITH RECURSIVE step(word, done, toks) AS (
  SELECT word, false, toks FROM fresh
  UNION ALL
  SELECT s.word, best IS NULL,
         CASE WHEN best IS NULL THEN toks ELSE toks[:(best & 255) - 1] || [(best >> 8)::INT] || toks[(best & 255) + 2:] END
  FROM step s LEFT JOIN (
    SELECT p.word, min((m.rank::BIGINT << 8) | p.place) AS best
    FROM (SELECT word, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS place FROM step WHERE NOT done) p
    JOIN merges m ON m.left_id = p.a AND m.right_id = p.b
    GROUP BY p.word) x USING (word)
  WHERE NOT s.done)
SELECT word, toks FROM step WHERE done
"""

#: The same for long windows, all in rows. A step contracts the pairs of least rank from the left, in runs of one token every other, up to the first that makes a pair of lesser rank with a neighbour (prone: with its own kind or the pair's left token), which the next step then takes.
ENCODE_LONG = """
WITH RECURSIVE step(word, place, tok, more) AS (
  SELECT word, place, tok, true FROM fresh_rows
  UNION ALL
  SELECT word, place, CASE WHEN chosen THEN best ELSE tok END, best IS NOT NULL
  FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY place), false) AS gone
    FROM (
      SELECT *, able AND coalesce(sum((able AND risky)::INT) OVER (PARTITION BY word ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS chosen
      FROM (
        SELECT e.*, hit AND row_number() OVER (PARTITION BY e.word, hit, nth - k ORDER BY place) % 2 = 1 AS able,
               e.prone OR coalesce(l.rank < e.best, false) OR coalesce(r.rank < e.best, false) AS risky
        FROM (
          SELECT *, sum(hit::INT) OVER (PARTITION BY word ORDER BY place ROWS UNBOUNDED PRECEDING) AS k
          FROM (
            SELECT *, coalesce(rank = best, false) AS hit
            FROM (
              SELECT a.*, m.rank, m.prone, min(m.rank) OVER (PARTITION BY a.word) AS best
              FROM (
                SELECT word, place, tok, lag(tok) OVER w AS before, lead(tok) OVER w AS follows, lead(tok, 2) OVER w AS beyond, row_number() OVER w AS nth
                FROM step WHERE more WINDOW w AS (PARTITION BY word ORDER BY place)) a
              LEFT JOIN merges m ON m.left_id = a.tok AND m.right_id = a.follows))) e
        LEFT JOIN merges l ON e.hit AND l.left_id = e.before AND l.right_id = e.best
        LEFT JOIN merges r ON e.hit AND r.left_id = e.best AND r.right_id = e.beyond)))
  WHERE NOT gone)
SELECT word, list(tok ORDER BY place) AS toks FROM step WHERE NOT more GROUP BY word
"""

DECODE = """
SELECT text, string_agg(v.chars, '' ORDER BY t.place) AS chars
FROM tokens t JOIN vocabulary v USING (id) GROUP BY text
"""


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))


class Coder:
    """A vocabulary in a DuckDB database of its own: `vocabulary` has each token's bytes as characters U+0000 to U+00FF, `merges` every way in which two tokens make one. Words once encoded are kept: `known` numbers them, `starts` and `sizes` say where their ids stand in `ids`."""

    def __init__(self, lines: list[bytes], pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern, self.single = regex.compile(pattern), np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._forget()
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        made = {(a, b): r for a, b, r in merges}
        prone = [min(made.get((r, a), r), made.get((r, r), r)) < r for a, _, r in merges]
        left, right, rank = zip(*merges, strict=True) if merges else ((), (), ())
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        given = {
            "merges": pa.table({"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32()), "prone": pa.array(prone, pa.bool_())}),
            "vocabulary": pa.table({"id": pa.array(ranks.values(), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in ranks])}),
        }
        for name, rows in given.items():
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = self.starts = self.sizes = np.zeros(0, np.int32)

    def _query(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.db.register(name, rows)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def _learn(self, fresh: list[str | bytes]) -> None:
        """Encodes words (and windows of words, as bytes) that aren't known yet."""
        plain = [w if isinstance(w, bytes) else w.encode("utf-8", "replace") for w in fresh]
        size = np.array([len(b) for b in plain])
        toks = self.single[np.frombuffer(b"".join(plain), np.uint8)]
        word = np.repeat(np.arange(len(fresh), dtype=np.int32), size)
        is_long = size > LONG
        short = np.flatnonzero(~is_long).astype(np.int32)
        found = [self._query(ENCODE, fresh=pa.table({"word": pa.array(short), "toks": _lists(toks[~is_long[word]], size[short])}))]
        if is_long.any():
            place, of = np.arange(len(word)), is_long[word]
            found.append(self._query(ENCODE_LONG, fresh_rows=pa.table({"word": word[of], "place": place[of], "tok": toks[of]})))
        for rows in found:
            its = rows.column("toks").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
            sizes = pa.compute.list_value_length(its).to_numpy(zero_copy_only=False).astype(np.int32)
            self._keep([fresh[i] for i in rows.column("word").to_pylist()], its.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes)

    def _keep(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _window(self, piece: bytes) -> np.ndarray:
        """The ids of a window."""
        if piece not in self.known:
            self._learn([piece])
        code = self.known[piece]
        return self.ids[self.starts[code] : self.starts[code] + self.sizes[code]]

    def _joined(self, whole: bytes, at: int, head: int, end: int, width: int) -> tuple[np.ndarray | None, int]:
        """The ids of a stretch that starts at a place, with token head, and goes past end; and where it ends. None where the windows there begin otherwise."""
        first = at // STEP * STEP
        if width == LONG and (regular := whole[first : first + LONG]) in self.known and first + len(regular) > end:
            ids = self._window(regular)
            ends = first + np.cumsum(self.bytes_of[ids])
            k = int(np.searchsorted(ends, at, "right"))
            if k < len(ids) and ids[k] == head and ends[k] == at + self.bytes_of[head]:
                return ids[k:], first + len(regular)
        piece = whole[at : at + width]
        ids = self._window(piece) if at + len(piece) > end else None
        return (ids, at + len(piece)) if ids is not None and ids[0] == head else (None, end)

    def _long_word(self, whole: bytes) -> np.ndarray:
        """The ids of a word of any length, from windows, in memory that a window bounds.

        If the tokens of X M end with token M, and those of M Y begin with it, the tokens of X M Y are those of X, M and Y: the first pair contracted across a border of M would be the leftmost of least rank of X M or of M Y too. So windows are joined where both have one token at one place. The windows that start every STEP bytes are contracted together; where the next of them lacks the token, one that starts with it is made; where that begins otherwise, other tokens are tried, then wider windows.
        """
        out, ids, at, end, ready = [], self._window(whole[:LONG]), 0, min(LONG, len(whole)), 0
        while end < len(whole):
            if end > ready:
                if len(self.ids) > IDS_KEPT:
                    self._forget()
                ready = end + LONG * 4096
                if fresh := list({whole[i : i + LONG] for i in range(end // STEP * STEP - LONG, ready, STEP)} - {b""} - self.known.keys()):
                    self._learn(fresh)
            width, more = LONG, None
            while more is None:
                begins = at + np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]
                for j in np.flatnonzero(begins <= max(end - LONG // 4, at))[: -JOINS - 1 : -1]:
                    more, far = self._joined(whole, int(begins[j]), int(ids[j]), end, width)
                    if more is not None:
                        break
                else:
                    width *= 2
                    if out:
                        at -= int(self.bytes_of[out[-1]].sum())
                        ids = np.concatenate([out.pop(), ids])
                    else:
                        while width <= end:
                            width *= 2
                        j, more, far = 0, self._window(whole[:width]), min(width, len(whole))
            out.append(ids[:j])
            ids, at, end = more, int(begins[j]), far
        return np.concatenate([*out, ids])

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if len(self.known) > WORDS_KEPT or len(self.ids) > IDS_KEPT:
            self._forget()
        fresh = list(set(words) - self.known.keys())
        # Characters are bytes at least.
        if short := [w for w in fresh if len(w) <= LONG // 4 or len(w.encode("utf-8", "replace")) <= LONG]:
            self._learn(short)
        of_long = {w: self._long_word(w.encode("utf-8", "replace")) for w in set(fresh).difference(short)}
        if not of_long:
            code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            sizes = self.sizes[code]
            before = np.cumsum(sizes) - sizes
            return self.ids[np.repeat(self.starts[code] - before, sizes) + np.arange(sizes.sum())], sizes
        # Some word is long: these stand between the others, and aren't kept.
        ids, sizes, some = [], np.zeros(len(words), np.int64), []
        for i, w in enumerate([*words, None]):
            if w is None or w in of_long:
                if some:
                    got, sizes[i - len(some) : i] = self.ids_of(some)
                    ids.append(got)
                    some = []
                if w is not None:
                    ids.append(of_long[w])
                    sizes[i] = len(of_long[w])
            else:
                some.append(w)
        return np.concatenate(ids), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. A text is taken in pieces of whole words where it is very long."""
        ids, counts, words, ends = [], np.zeros(len(texts), np.int64), [], []

        def flush() -> None:
            got, sizes = self.ids_of(words)
            ids.append(got)
            total = np.concatenate([[0], np.cumsum(sizes)])
            first = 0
            for i, end in ends:
                counts[i] += total[end] - total[first]
                first = end
            words.clear()
            ends.clear()

        for i, text in enumerate(texts):
            if len(text) <= TEXT_AT_ONCE:
                words += self.pattern.findall(text)
            else:
                for m in self.pattern.finditer(text):
                    words.append(m[0])
                    if len(words) >= TEXT_AT_ONCE // 4:
                        ends.append((i, len(words)))
                        flush()
            ends.append((i, len(words)))
        flush()
        return np.concatenate(ids), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        text, out = np.repeat(np.arange(len(counts)), counts), [b""] * len(counts)
        for first in range(0, len(ids), TEXT_AT_ONCE):
            some = slice(first, first + TEXT_AT_ONCE)
            got = self._query(DECODE, tokens=pa.table({"text": text[some], "place": np.arange(len(ids[some])), "id": ids[some]}))
            for i, chars in zip(got.column("text").to_pylist(), got.column("chars").to_pylist(), strict=True):
                out[i] += chars.encode("latin-1")
        return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of every whole text, and the bytes that they decode to.

    path: a vocabulary of ranks (base64 token and rank on each line), read once on the driver and sent with the job (about 1 MB). Every match of pattern is encoded by itself; special tokens are ordinary text. In each partition a recursive DuckDB query contracts, in each distinct new word, the leftmost pair of least rank until none is left; ordered aggregation decodes.
    Null and empty texts have no ids and decode to nothing. Null ids and repeated rows are kept as they are. An empty table gives an empty one. Other columns are not looked at.
    """
    with open(path, "rb") as f:
        lines = f.read().splitlines()
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches):
        coder = None
        for batch in batches:
            coder = coder or Coder(shared.value, pattern)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= TEXT_AT_ONCE):
                    size += len(texts[last])
                    last += 1
                ids, counts = coder.encode(texts[first:last])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), _lists(ids, counts), pa.array(coder.decode(ids, counts), pa.binary())], names=["id", "ids", "decoded"])
                first = last

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary").select(F.col("id").alias(id_col), "ids", "decoded")


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ids and decoded bytes."""
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
