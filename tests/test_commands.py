"""Scalar commands, globs and the mutation log, by hand-made cases."""

import fnmatch
import itertools

import pytest
from pyspark.sql import functions as F

from annulus.functions import glob, scalars
from annulus.operators import keyspace, log, metrics, verify


@pytest.mark.parametrize("start, end, want", [(0, 4, "Hello"), (1, 3, "ell"), (-3, -1, "llo"), (0, 100, "Hello"), (-100, 2, "Hel"), (3, 1, ""), (5, 6, ""), (0, -100, "H")])
def test_getrange(spark, start, end, want):
    got = spark.range(1).select(scalars.getrange(F.lit("Hello").cast("binary"), F.lit(start), F.lit(end)).cast("string"), scalars.getrange(F.lit("").cast("binary"), F.lit(start), F.lit(end)).cast("string")).first()
    assert tuple(got) == (want, "")


def test_setrange(spark):
    put = lambda v, at, p: scalars.setrange(F.lit(v).cast("binary"), F.lit(at), F.lit(p).cast("binary"))
    got = spark.range(1).select(put("Hello", 1, "xy"), put("ab", 4, "c"), put(None, 2, "z"), put("ab", 9, ""), put("ab", 1, "wxyz")).first()
    assert [bytes(x) for x in got] == [b"Hxylo", b"ab\0\0c", b"\0\0z", b"ab", b"awxyz"]


def test_numbers(spark):
    rows = spark.createDataFrame([(None, 1, 1), (" 41 ", 1, 42), ("x", 1, None), ("9223372036854775807", 1, None), ("-5", -3, -8), ("", 1, None)], "v string, by long, want long")
    assert rows.filter(~scalars.incrby(F.col("v"), F.col("by")).eqNullSafe(F.col("want"))).count() == 0


def test_deadlines(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.ttl_seconds(F.lit(True), F.lit(1001), F.lit(0))) == 2
    assert one(scalars.ttl_seconds(F.lit(False), F.lit(1001), F.lit(0))) == -2 and one(scalars.ttl_seconds(F.lit(True), F.lit(None).cast("long"), F.lit(0))) == -1
    assert one(scalars.deadline("EX", F.lit(scalars.LARGEST), F.lit(5))) is None and one(scalars.deadline("PX", F.lit(7), F.lit(5))) == 12
    none = F.lit(None).cast("long")
    assert [one(scalars.expire_allowed(g, none, F.lit(9))) for g in ("NX", "XX", "GT", "LT")] == [True, False, False, True]
    assert one(log.live(F.lit(False), F.lit(10), F.lit(10))) is False
    assert one(log.next_deadline(F.lit(None).cast("long"), F.lit(5), F.lit(True))) == 5 and one(log.next_deadline(F.lit(0), F.lit(5), F.lit(True))) is None


def test_globs_with_many_stars(spark):
    import random
    import re

    def plain(text, pattern):
        """The textbook recursion."""
        if not pattern:
            return not text
        if pattern[0] == "*":
            return plain(text, pattern[1:]) or bool(text) and plain(text[1:], pattern)
        return bool(text) and (pattern[0] in ("?", text[0])) and plain(text[1:], pattern[1:])

    pick = random.Random(3)
    for _ in range(40):
        pattern = "".join(pick.choices("ab?*", k=pick.randrange(0, 8)))
        texts = ["".join(pick.choices("ab", k=pick.randrange(0, 9))) for _ in range(200)]
        # Python reads these expressions like Java does, but for the name of the end.
        regex = re.compile(glob.glob_to_regex(pattern).replace(r"\z", r"\Z"))
        assert [bool(regex.search(t)) for t in texts] == [plain(t, pattern) for t in texts]
    long = spark.range(1).select(F.repeat(F.lit("a"), 200_000).alias("k"))
    assert long.select(glob.matches(F.col("k"), "*a" * 12 + "*b").alias("m")).first()["m"] is False


def test_globs(spark):
    patterns = ["*", "a*c", "a?c", "[a-c]x", "[^a-c]x", "a\\*", "[c-a]x", "*b*", "[ab", "x**y", "[]", "a[^]c", ""]
    texts = ["", "abc", "ac", "bx", "dx", "a*", "a", "xzzy", "b", "a\nc", "x"]
    want = {
        (p, t): fnmatch.fnmatchcase(t, p.replace("[^", "[!").replace("[c-a]", "[a-c]"))
        for p, t in itertools.product(["*", "a*c", "a?c", "[a-c]x", "[^a-c]x", "[c-a]x", "*b*", "x**y", ""], texts)
    } | {("a\\*", t): t == "a*" for t in texts} | {("[ab", t): t in ("a", "b") for t in texts} | {("[]", t): False for t in texts}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        if p == "a[^]c":
            continue
        got = {r["t"]: r["m"] for r in frame.select("t", glob.matches(F.col("t"), p).alias("m")).collect()}
        assert got == {t: want[p, t] for t in texts}, p
    # Ends of a range are signed bytes: 'a' (97) to 0xff (-1) runs through 0.
    low = spark.createDataFrame([(bytearray([b]),) for b in (0, 96, 97, 98, 255, 254)], "k binary")
    assert [r[0] for r in low.select(glob.matches(F.col("k"), b"[a-\xff]")).collect()] == [True, True, True, False, True, False]


def test_pages_never_split_a_token(spark):
    rows = spark.createDataFrame([(f"k{i}", i // 3, i % 4 != 1) for i in range(60)], "key string, token long, live boolean")
    seen, at = [], 0
    while True:
        page = keyspace.page(rows, at, 1, 1 << 20).collect()
        tokens = {r["token"] for r in page}
        if not page:
            break
        assert len(tokens) == 1
        seen += [r["key"] for r in page]
        at = max(tokens) + 1
    assert sorted(seen) == sorted(f"k{i}" for i in range(60) if i % 4 != 1)


def test_scan_reaches_every_key(spark):
    rows = spark.createDataFrame([(f"k{i}", 1 + i // 2, True) for i in range(21)], "key string, token long, live boolean")
    seen, cursor = [], 1
    while cursor:
        got = keyspace.scan(rows, cursor, 5, F.lit(True)).collect()
        seen += [r["key"] for r in got]
        cursor = got[0]["next"]
    assert sorted(seen) == sorted(f"k{i}" for i in range(21))


def test_latest_and_retries(spark):
    rows = spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 1, "y"), ("b", 1, 1, None), ("b", 1, 0, "z")], "key string, epoch long, seq long, value string")
    assert sorted(map(tuple, log.latest(rows, "key", ["epoch", "seq"]).collect())) == [("a", 2, 1, "y"), ("b", 1, 1, None)]
    tries = spark.createDataFrame([("m", "f", 1), ("m", "f", 2), ("n", "f", 3), ("n", "g", 4)], "id string, fp string, at long")
    assert {r["id"]: (r["attempts"], r["answer"], r["conflict"]) for r in log.retries(tries, "id", "fp", ["at"]).collect()} == {"m": (2, "f", False), "n": (2, "f", True)}
    a, b = (spark.range(1).select(log.fingerprint(*x)).first()[0] for x in ((F.lit("ab"), F.lit("c")), (F.lit("a"), F.lit("bc"))))
    assert a != b


def test_histories(spark):
    h = spark.createDataFrame([("k", 1, "put", "a", 1, 0, 10), ("k", 2, "put", "b", 2, 20, 30), ("k", 3, "read", "a", None, 11, 19), ("k", 4, "read", "a", None, 40, 50), ("k", 5, "delete", None, 3, 60, 70), ("k", 6, "read", None, None, 65, 66)], "key string, sequence long, kind string, value string, version long, invoked long, completed long")
    assert [r["sequence"] for r in verify.illegal_reads(h).collect()] == [4]
    late = spark.createDataFrame([("k", 5, 0, 10), ("k", 3, 11, 20), ("k", 9, 5, 30)], "key string, version long, invoked long, completed long")
    assert [(r["version"], r["earlier"]) for r in verify.realtime_violations(late, "key", "version", "invoked", "completed").collect()] == [(3, 5)]


def test_rollbacks(spark):
    steps = [("put", "a", False), ("put", "b", False), ("read", "b", False), ("read", "a", False), ("delete", None, False), ("read", "b", False), ("put", "c", True), ("read", "c", False), ("read", "q", False), ("read", None, False)]
    h = spark.createDataFrame([("k", i, *s) for i, s in enumerate(steps)], "key string, seq long, op string, value string, ambiguous boolean")
    got = [(r["verdict"], r["kind"]) for r in verify.rollbacks(h).orderBy("seq").collect()]
    assert got == [("matches", None), ("rollback", "older_value_reappeared"), ("rollback", "acknowledged_delete_lost"), ("matches", None), ("impossible", None), ("rollback", "acknowledged_value_lost")]
    states = verify.allowed_states(h.filter("op <> 'read' and seq > 4 or seq = 4"), "key").first()["allowed"]
    assert states == [None, "c"]


def test_histogram_tops(spark):
    got = spark.createDataFrame([(70624, 70655), (71331, 71359), (70865, 70911), (1, 1), (2047, 2047), (2048, 2049)], "v long, want long")
    assert got.filter(metrics.hdr_top(F.col("v")) != F.col("want")).count() == 0


def test_stop_window(spark):
    rows = [(1, 0, 0, 5, 0), (1, 10, 1, 5, 0), (1, 20, 1, 6, 0), (1, 30, 1, 7, 1), (1, 40, 2, 7, 1), (1, 50, 2, 8, 2), (2, 0, 0, 0, 0), (2, 9, 0, 4, 0)]
    got = {r["k"]: tuple(r)[1:] for r in metrics.stop_window(spark.createDataFrame(rows, "k long, at long, busy long, done long, seen long"), "k", "at", "busy", "done", "seen").collect()}
    assert got == {1: (10, 40, 50), 2: (None, None, None)}


def test_natural_order(spark):
    names = spark.createDataFrame([("rate_10",), ("rate_2",), ("base",)], "n string")
    assert [r["n"] for r in names.orderBy(scalars.natural_order(F.col("n"))).collect()] == ["base", "rate_2", "rate_10"]


def log_of(spark, lines):
    """Commands (now_ms, words) in order."""
    return spark.createDataFrame([(i, now, words.split(" ")) for i, (now, words) in enumerate(lines)], "seq long, now_ms long, args array<string>")


def replies(spark, lines, **more):
    from annulus.operators import commands

    got = {r["seq"]: r["reply"] for r in commands.execute(log_of(spark, lines), **more).collect()}
    assert sorted(got) == list(range(len(lines)))
    return [got[i] if len(got[i]) > 1 else got[i][0] for i in range(len(lines))]


def test_fold_of_commands(spark):
    lines = ["SET k 5", "INCRBY k 3", "APPEND k 0", "PEXPIRE k 1500", "TTL k", "PERSIST k", "SETNX k q", "GETSET k x", "INCR k", "STRLEN k", "GETDEL k", "GET k", "SETNX k q", "EXPIRE k 0", "DEL k", "SET k 9223372036854775807 PX 100", "INCRBY k 1", "nonsense k", "GET", "GET k x", "get k"]
    want = ["OK", "8", "2", "1", "2", "1", "0", "80", "ERR value is not an integer or out of range", "1", "x", None, "1", "1", "0", "OK", "ERR increment or decrement would overflow", "ERR unknown command 'NONSENSE'", "ERR wrong number of arguments for 'get' command", "ERR wrong number of arguments for 'get' command", "9223372036854775807"]
    assert replies(spark, [*enumerate(lines), (500, "GET k"), (500, "GET other")]) == [*want, None, None]


def test_many_keys_and_renames(spark):
    lines = ["MSET a 1 b 2 a 3", "MGET a b c a", "EXISTS a a c", "DEL a c", "MGET a", "SET x v PX 50", "RENAME x y", "MGET x y", "PTTL y", "RENAMENX b y", "RENAMENX y z", "RENAME y q", "RENAMENX z z", "RENAME z z", "RENAME b z", "GET z", "MSETNX m 1", "MSETNX m 2", "MSETNX m 1 n 2", "MSET a", "UNLINK z m", "RENAME z"]
    want = ["OK", ["3", "2", None, "3"], "2", "1", None, "OK", "OK", [None, "v"], "47", "0", "1", "ERR no such key", "0", "OK", "OK", "2", "1", "0", "ERR MSETNX with more than one key is not supported: the keys can't be set as one", "ERR wrong number of arguments for 'mset' command", "2", "ERR wrong number of arguments for 'rename' command"]
    assert replies(spark, list(enumerate(lines))) == want


def test_extensions_and_scripts(spark):
    from annulus.operators import commands

    double = lambda state, now, name, args: ((state[0] * 2, state[1]), state[0] * 2) if state else (None, None)

    def script(store, by):
        store.call("SET", store.key, "7")
        store.call("INCRBY", store.key, by)
        return float(store.call("GET", store.key)) + 0.5

    name = commands.script_hash("set 7, add, answer a half more")
    more = {"DOUBLE": double, "GET": double, **commands.evalsha({name: script})}
    lines = ["SET k ab", "DOUBLE k", "GET k", f"EVALSHA k {name} 3", "GET k", f"EVALSHA k {name} x", "GET k", "EVALSHA k 00"]
    assert replies(spark, [(0, x) for x in lines], extensions=more) == ["OK", "abab", "abab", "10", "10", "ERR value is not an integer or out of range (incrby)", "10", "NOSCRIPT No matching script"]
    assert [commands.script_reply(x) for x in (None, False, True, 3.0, 3.9, "a", float("inf"))] == [None, None, "1", "3", "3", "a", "ERR not a finite number"]
    assert commands.Overlay("k", None, 0).pcall("GET", "other").startswith("ERR")


@pytest.mark.parametrize(
    "state, line, after, reply",
    [
        (None, "SETEX 2 v", ("v", 2010), "OK"), (None, "SETEX 0 v", None, "ERR invalid expire time in 'setex' command"), (("v", 99), "GETEX PX 5", ("v", 15), "v"), (("v", 99), "GETEX PERSIST", ("v", None), "v"), (("v", 99), "GETEX", ("v", 99), "v"), (("v", 99), "GETEX EX 1 PERSIST", ("v", 99), "ERR syntax error"),
        (("Hello", None), "GETRANGE -3 -1", ("Hello", None), "llo"), (("ab", None), "SETRANGE 4 c", ("ab\0\0c", None), "5"), (("ab", None), "SETRANGE -1 c", ("ab", None), "ERR offset is out of range"), (("5", None), "DECRBY 7", ("-2", None), "-2"), ((" 7", None), "INCRBY 1", ("8", None), "8"),
        (("-5", None), "DECRBY -9223372036854775808", ("-5", None), "ERR decrement would overflow"), (("1", 50), "DECR", ("0", 50), "0"), (("", None), "INCR", ("", None), "ERR value is not an integer or out of range"), (("0" * 30 + "7", None), "INCR", ("8", None), "8"), (("9" * 5000, None), "INCR", ("9" * 5000, None), "ERR value is not an integer or out of range"),
        (None, "INCRBYFLOAT 3", ("3.0", None), "3.0"), (("1e16", None), "INCRBYFLOAT 0", ("10000000000000000.0", None), "10000000000000000.0"), (("0", None), "INCRBYFLOAT 1e-7", ("0.0000001", None), "0.0000001"), (("x", None), "INCRBYFLOAT 1", ("x", None), "ERR value is not a valid float"), (("1_0", None), "INCRBYFLOAT 1", ("1_0", None), "ERR value is not a valid float"), (("", None), "INCRBYFLOAT .5", ("0.5", None), "0.5"), (("1e308", None), "INCRBYFLOAT 1e308", ("1e308", None), "ERR increment would produce NaN or Infinity"),
        (("v", None), "EXPIREAT 0", None, "1"), (("v", None), "EXPIRE 4611686018427387904", ("v", None), "ERR invalid expire time in 'expire' command"), (("v", 99), "PEXPIRE 5 NX", ("v", 99), "0"), (("v", None), "PEXPIRE 5 XX", ("v", None), "0"), (("v", None), "PEXPIRE 5 GT", ("v", None), "0"), (("v", None), "PEXPIRE 5 LT", ("v", 15), "1"), (("v", 12), "PEXPIRE 5 GT", ("v", 15), "1"), (("v", 15), "PEXPIRE 5 LT", ("v", 15), "0"), (("v", 12), "PEXPIRE 5 GT LT", ("v", 12), "ERR syntax error"),
        (("v", 1511), "TTL", ("v", 1511), "2"), (("v", 1511), "PTTL", ("v", 1511), "1501"), (("v", 10), "EXISTS", None, "0"), (("v", None), "TYPE", ("v", None), "string"),
        (("v", 99), "SET w", ("w", None), "OK"), (("v", 99), "SET w KEEPTTL", ("w", 99), "OK"), (("v", 99), "SET w NX GET", ("v", 99), "v"), (None, "SET w NX GET", ("w", None), None), (None, "SET w XX", None, None), (None, "SET w NX XX", None, "ERR syntax error"), (None, "SET w EX 1 PX 1", None, "ERR syntax error"), (None, "SET w EX", None, "ERR syntax error"), (None, "SET w PXAT 77 nx", ("w", 77), "OK"), (None, "SET w EXAT 0", None, "ERR invalid expire time in 'set' command"), (None, "SET w bad", None, "ERR syntax error"),
    ],
)
def test_one_command(state, line, after, reply):
    from annulus.operators import commands

    name, *args = line.split(" ")
    assert commands.apply(state, 10, name, args) == (after, reply)


def test_numbered_is_a_sort(spark):
    from annulus.operators import metrics

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("nth_of"))
    assert all(r["nth"] == r["k"] + 1 for r in metrics.numbered(rows, "k", 7).collect())
    assert metrics.numbered(rows.limit(0), "k").count() == 0


def test_components_of_ties(spark):
    from annulus.shared import components

    pairs = [(f"n{i}", f"n{i + 1}") for i in range(30) if i % 11] + [("n3", "n25"), ("z", "a")]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u string, v string")).collect()} == label


def test_gaps_across_blocks(spark, monkeypatch):
    import random

    from annulus.operators import log

    pick = random.Random(2)
    rows = [(s, n) for s in (1, 2) for n in range(400) if pick.random() < 0.9] + [(3, 5), (1, 7), (1, 7)]
    want = sorted((s, n, max(m for t, m in rows if t == s and m < n)) for s, n in set(rows) if any(t == s and m < n for t, m in rows) and (s, n - 1) not in rows)
    frame = spark.createDataFrame(rows, "s long, n long")
    for block in (1 << 16, 16, 1):
        monkeypatch.setattr(log, "BLOCK", block)
        assert sorted(map(tuple, log.gaps(frame, "s", "n").collect())) == want
