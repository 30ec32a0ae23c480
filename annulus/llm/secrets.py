"""Secret scans by multipart credential linking."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds in the order in which spans of one start are listed. The first three need no partner.
BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("identifier", "secret", "endpoint")
KINDS = (*BASE_KINDS, *LINKED_KINDS)

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

WEAK_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?i:user_?name|user|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?i:pwd|pass|passphrase|private_?key|client_?key|auth|credential|signature|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.ASCII)
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:(?<![A-Za-z0-9])(?i:host(?:name)?|endpoint|server|base_?url|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/_-]{3,})|[a-z][a-z0-9+]{1,15}://[A-Za-z0-9][A-Za-z0-9.:/_@-]{3,}""", re.ASCII)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) of what is a secret by itself."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """Candidates that mean nothing alone."""
    found = []
    if ":" in text or "=" in text:
        found += [(3, *m.span()) for m in WEAK_IDENTIFIER.finditer(text)]
        found += [(4, *m.span()) for m in WEAK_SECRET.finditer(text)]
        found += [(5, *m.span()) for m in ENDPOINT.finditer(text)]
    if found or "AKIA" in text:
        found += [(4, *m.span()) for m in BARE_SECRET.finditer(text)]
    return found


def near(starts: list[int], spans: list[tuple[int, int]], span: tuple[int, int], reach: int) -> bool:
    """Whether one of spans, sorted by start, overlaps span widened by reach on either side. Their ends must not fall (see `reaching`), so that only the neighbours of the place count."""
    low, high = span[0] - reach, span[1] + reach
    i = bisect_left(starts, low)
    return (i < len(starts) and starts[i] <= high) or (i > 0 and spans[i - 1][1] >= low)


def reaching(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans by start, with the farthest end up to each: of spans that nest, a short inner one doesn't hide a long outer one."""
    most = 0
    return [(a, most := max(most, b)) for a, b in sorted(spans)]


def scan(text: str, reach: int) -> list[tuple[int, int, int]]:
    """All spans of a text: the base ones, and weak parts with a complementary part within reach in their scope, which ends at a blank line."""
    base = base_spans(text)
    weak = weak_parts(text)
    if weak:
        breaks = [m.start() for m in BLANK_LINE.finditer(text)]
        # A scope gets a coordinate range of its own, farther than any reach from the next, so that one join does for all scopes.
        shift = lambda at: at + bisect_left(breaks, at) * (2 * reach + 1)
        taken = sorted((a, b) for _, a, b in base)
        ends = [b for _, b in reaching(taken)]
        free = lambda a, b: not ((i := bisect_left(taken, (b, -1))) and ends[i - 1] > a)
        weak = sorted({x for x in weak if free(x[1], x[2])}, key=lambda x: (x[1], -x[2], x[0]))
        kept, end = [], -1
        for x in weak:  # of parts that overlap, the first and longest
            if x[1] >= end:
                kept.append(x)
                end = x[2]
        # AKIA keys identify; assigned values and long hex are secrets.
        role = {0: 4, 1: 3, 2: 4, 3: 3, 4: 4, 5: 5}
        by_role: dict[int, list[tuple[int, int]]] = {3: [], 4: [], 5: []}
        for k, a, b in [*base, *kept]:
            s = shift(a)
            by_role[role[k]].append((s, s + b - a))
        by_role = {k: reaching(v) for k, v in by_role.items()}
        starts = {k: [a for a, _ in v] for k, v in by_role.items()}
        close = lambda k, span: near(starts[k], by_role[k], span, reach)
        for k, a, b in kept:
            at = (s := shift(a), s + b - a)
            if close(4, at) if k != 4 else close(3, at) or close(5, at):
                base.append((k, a, b))
    return sorted(base, key=lambda x: (x[1], x[0], x[2]))


def link_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Secrets of every whole text: (id, spans), spans being structs (kind, start, end) by start, then kind; code points, end exclusive.

    Access identifiers, secrets and endpoints are joined by their intervals within scopes (stretches without a blank line). A weak part is reported only if a complementary one lies within `reach` code points in its scope: an identifier or an endpoint needs a secret, a secret needs an identifier or an endpoint. Parts that overlap a span of the base kinds are not reported again.
    A null or empty text has no spans. Repeated rows each give a row; a null id stays null. Other columns are not looked at. An empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in scan(t, reach)] if t else [] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind string, start long, end long>>").select(F.col("id").alias(id_col), "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *map(of, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
