"""Plain versions of operators, which the tests hold the engine against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter

import xxhash

from annulus.llm import quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_text(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 42)


def hash_pair(a: int, b: int) -> int:
    """The engine's hash of two longs: the first one's is the seed of the second's."""
    return xxhash.xxh64_intdigest(struct.pack("<q", signed(b)), xxhash.xxh64_intdigest(struct.pack("<q", signed(a)), 42))


def features(text):
    h = [hash_text(w.lower()) for w in WORD.findall(text or "")]
    return [x % quality.FEATURES for x in [*h, *map(hash_pair, h, h[1:])]]


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_scores(texts: list, good: list[bool]) -> list[float]:
    """The length-normalised log-likelihood ratio of each text, counting everything in dictionaries."""
    raw, target = Counter(), Counter()
    for t, g in zip(texts, good, strict=True):
        own = Counter(features(t))
        raw += own
        target += own if g else Counter()
    n, m, prior = sum(raw.values()), sum(target.values()), quality.PRIOR
    worth = {f: math.log((target[f] * n / c + prior) / (m + prior)) if m else 0.0 for f, c in raw.items()}
    return [sum(worth[f] for f in fs) / len(fs) if (fs := features(t)) else 0.0 for t in texts]


def kept(texts: list, good: list[bool]) -> list[bool]:
    out = []
    for t, score in zip(texts, quality_scores(texts, good), strict=True):
        c = base_counts(t)
        out.append(c[0] >= 20 and 100 * c[4] <= 30 * c[0] and score >= quality.THRESHOLD)
    return out


def secret_spans(text: str, reach: int) -> list[tuple[int, int, int]]:
    """All spans of a text, every part compared with every other."""
    base = secrets.base_spans(text)
    weak = sorted({x for x in secrets.weak_parts(text) if not any(x[1] < b and a < x[2] for _, a, b in base)}, key=lambda x: (x[1], -x[2], x[0]))
    parts, end = [], -1
    for x in weak:
        if x[1] >= end:
            parts.append(x)
            end = x[2]
    scope = lambda at: sum(m.start() < at for m in secrets.BLANK_LINE.finditer(text))
    role = {0: 4, 1: 3, 2: 4, 3: 3, 4: 4, 5: 5}
    everything = [(role[k], a, b) for k, a, b in [*base, *parts]]
    found = list(base)
    for k, a, b in parts:
        wanted = (3, 5) if k == 4 else (4,)
        if any(r in wanted and scope(c) == scope(a) and c <= b + reach and d >= a - reach for r, c, d in everything):
            found.append((k, a, b))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def simhash(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [hash_text(g) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: list[int]) -> dict[int, int]:
    """The least fingerprint that each reaches by steps of 3 bits or fewer."""
    distinct = sorted(set(fps))
    label = {f: f for f in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def water(sizes, weights, epochs=3):
    """Targets by rounds of clamping."""
    clamped = {}
    while True:
        rest = sum(sizes.values()) - sum(clamped.values())
        weight = sum(weights[s] for s in sizes if s not in clamped)
        share = {s: weights[s] * rest / weight for s in sizes if s not in clamped} if weight else {}
        over = [s for s, t in share.items() if t > epochs * sizes[s]]
        if not over:
            return share | clamped
        clamped |= {s: epochs * sizes[s] for s in over}


def mixed(docs: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """(id, text) of the mix of (id, text, source), ids distinct: whole repetitions, then documents in the seeded order up to the target."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t))
    target = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    out = []
    for source in sizes:
        own = sorted((int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:15], 16), i, t) for i, t, s in docs if s == source)
        reps = int(target[source] // sizes[source]) if sizes[source] else 0
        left = round(target[source]) - reps * sizes[source]
        for _, i, t in own:
            n = len(WORD.findall(t))
            out += [(i, t)] * reps if n else []
            if n and left >= n:
                out.append((i, t))
            elif n and left > 0:
                out.append((i, t[: [m.end() for m in WORD.finditer(t)][left - 1]]))
            left -= n
    return out
