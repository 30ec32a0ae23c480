"""Glob patterns over bytes as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escape(byte: int) -> str:
    return f"\\x{byte:02x}"


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def glob_to_regex(pattern: bytes | str) -> str:
    """An anchored regular expression, over text decoded as ISO-8859-1, for a glob: * any run, ? one byte, [..] a class (only ^ negates; ends of a range are compared as signed bytes, in either order; a class that isn't closed ends with the pattern), \\ the next byte as it is."""
    data = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
    runs, i, n = [[]], 0, len(data)
    while i < n:
        c = data[i : i + 1]
        if c == b"*":
            while data[i + 1 : i + 2] == b"*":
                i += 1
            runs.append([])
        elif c == b"?":
            runs[-1].append(".")
        elif c == b"[":
            i += 1
            negated = data[i : i + 1] == b"^"
            i += negated
            members: set[int] = set()
            while i < n and data[i : i + 1] != b"]":
                if data[i : i + 1] == b"\\" and i + 1 < n:
                    i += 1
                    members.add(data[i])
                elif data[i + 1 : i + 2] == b"-" and i + 2 < n:
                    low, high = sorted((_signed(data[i]), _signed(data[i + 2])))
                    members |= {x % 256 for x in range(low, high + 1)}
                    i += 2
                else:
                    members.add(data[i])
                i += 1
            inside = "".join(map(_escape, sorted(members)))
            runs[-1].append(f"[{'^' if negated else ''}{inside}]" if inside else "." if negated else "(?!)")
        else:
            if c == b"\\" and i + 1 < n:
                i += 1
            runs[-1].append(_escape(data[i]))
        i += 1
    first, *rest = map("".join, runs)
    # What stands between two stars is taken where it first fits, and never tried elsewhere: each run has a length of its own, so no other place could do better, and a key is passed once for each run.
    between = "".join(f"(?>.*?{run})" for run in rest[:-1] if run)
    return rf"(?s)\A{first}{between}{'.*' + rest[-1] if rest else ''}\z"


def matches(key: Column, pattern: bytes | str) -> Column:
    """Whether a key (binary or string) matches a glob."""
    return F.decode(key.cast("binary"), "ISO-8859-1").rlike(glob_to_regex(pattern))
