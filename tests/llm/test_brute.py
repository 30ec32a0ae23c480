"""Operators and the pipeline against plain versions, on tables with planted cases; texts of millions of characters; odd rows in every stage."""

import math
import random
import re
import string
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annulus.llm import bpe, language, mixing, neardup, pii, quality, secrets, sharding

LONG = 5_000_000
KEY = b"a key of these tests"


@pytest.fixture(scope="module")
def long_texts():
    """One letter, one word again and again, one line of different words."""
    pick = random.Random(4)
    words = ["".join(pick.choices(string.ascii_lowercase, k=6)) for _ in range(5000)]
    return ["a" * LONG, "word " * (LONG // 5), " ".join(pick.choices(words, k=LONG // 7))]


def test_secrets_against_all_pairs():
    pick = random.Random(12)
    pieces = ["token=", "0123456789abcdef" * 2, "f" * 33, "user: bob", "login=alice", "host: db.example.com", "https://x.example/y", "pass: xyzzy", "pwd=qwerty", "AKIA" + "A1" * 9, "\n\n", "\n \n", " ", "secret: abcdefgh", "Z" * 40, ". ", "x" * 60, "auth=Bearer", "endpoint='svc.local/a'"]
    for _ in range(400):
        text = "".join(pick.choice(pieces) + pick.choice(["", " ", " " * 90]) for _ in range(pick.randrange(2, 14)))
        assert secrets.scan(text, 200) == brute.secret_spans(text, 200), text
    text = "token=" + "0" * 32 + "Z" * 500 + " user: bob"
    assert secrets.scan(text, 200) == brute.secret_spans(text, 200) and [k for k, *_ in secrets.scan(text, 200)] == [0, 2, 3]


def test_quality_scores(spark):
    pick = random.Random(13)
    words = [f"{c}{i}" for i in range(60) for c in "aBé"]
    texts = [" ".join(pick.choices(words[: 20 + i], k=pick.randrange(0, 120))) for i in range(80)] + ["x", "", None, "A b A b", "İSTANBUL ΣΑΣ ΣΑΣ"]
    good = [i % 5 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).select("row.doc_id", "score", "kept").collect()}
    want, keeps = brute.quality_scores(texts, good), brute.kept(texts, good)
    for i, (score, keep) in enumerate(zip(want, keeps, strict=True)):
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9, abs_tol=1e-12) and got[i]["kept"] == keep
    assert len({got[i]["kept"] for i in range(80)}) == 2


def test_shards_are_parts_of_one_line(spark):
    pick = random.Random(14)
    rows = [(i, "t" * pick.randrange(200)) for i in range(900)] + [(2000 + i, "a text of five copies") for i in range(5)] + [(7, "one row, many times over") for _ in range(1500)] + [(None, "no id") for _ in range(300)] + [(3000 + i, "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = 6
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("row"), "doc_id").alias("k2")).collect()
    line = sorted(((r["k1"], r["k2"], r["doc_id"] if r["doc_id"] is not None else -1, len(r["text"]) + 8) for r in hashed))
    total, at, place = sum(x[3] for x in line), 0, []
    for x in line:
        place.append((x, at, at + x[3]))
        at += x[3]
    first, last = {}, {}
    for (k1, *_), a, b in place:
        first.setdefault(k1, a)
        last[k1] = b
    whole, by_row = {}, {}
    cut = lambda middle: min(shards - 1, int(middle * shards / total))
    for (k1, k2, i, _), a, b in place:
        whole.setdefault((k1, i), set()).add(cut((first[k1] + last[k1]) / 2))
        by_row.setdefault((k1, i), Counter())[cut((a + b) / 2)] += 1
    got = {}
    marks = {(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]): r["k1"] for r in hashed}
    crc = {(r["doc_id"] if r["doc_id"] is not None else -1, r["c"]): r["text"] for r in docs.select("doc_id", "text", F.crc32("text").alias("c")).collect()}
    for r in sharding.shard(docs, shards).collect():
        i = r["doc_id"] if r["doc_id"] is not None else -1
        got.setdefault((marks[i, crc[i, r["text_crc32"]]], i), Counter())[r["shard"]] += 1
    assert sum(sum(c.values()) for c in got.values()) == len(rows)
    for key, counts in got.items():  # a text is placed whole, or, where it is large, row by row
        assert set(counts) == whole[key] or counts == by_row[key]
    assert len(got[marks[7, "one row, many times over"], 7]) > 1


def test_names_over_a_table(spark):
    pick = random.Random(15)
    given, family = [f"G{c}n" for c in map("".join, zip(string.ascii_lowercase, string.ascii_lowercase[::-1], strict=True))], [f"F{a}{b}" for a in "aeiou" for b in "bdfglmnrst"]
    people = [(t, pick.choice(given), pick.choice(family)) for t in pick.choices(["Mr.", "Mrs", "Dr.", "Frau"], k=400)]
    texts = [f"{t} {g} {f} came. {f} said that {g} and {t} {f} left, {g} {f} too." for t, g, f in people]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.replace(docs, KEY).select("row.*").collect()}
    pattern = re.compile(r"(\S+) (\w+) (\w+) came\. (\w+) said that (\w+) and (\S+) (\w+) left, (\w+) (\w+) too\.$")
    made = {}
    for i, (t, g, f) in enumerate(people):
        t1, g1, f1, f2, g2, t2, f3, g3, f4 = pattern.match(rows[i]).groups()
        assert (t1, t2) == (t, t) and g1 == g2 == g3 and f1 == f2 == f3 == f4  # coreference
        gender = pii.GENDER[t.rstrip(".").lower()]
        for kind, name, new in ((f"given:{gender}", g, g1), ("family", f, f1)):
            assert made.setdefault((kind, name), new) == new  # the same everywhere
    for kind in {k for k, _ in made}:
        own = [v for (k, _), v in made.items() if k == kind]
        assert len(set(own)) == len(own)  # distinct
    assert not {v.lower() for v in made.values()} & {x.lower() for x in given + family}  # no original


def test_surrogates_of_long_shapes():
    for n in (1, 2, 99, 100, 101, 150, 400, 5000):
        text = "a" * n
        new = pii.shaped(text, KEY, "t")
        assert len(new) == n and new != text and pii.shaped(text, b"other", "t") != new
        if n > 90:
            assert all(new[i : i + 90] != text[i : i + 90] for i in range(0, n - 89, 10))  # no stretch of the old one
    two = [pii.shaped(f"{'ab' * 120}{c}", KEY, "t") for c in "abcdefghijklmnopqrstuvwxyz"]
    assert len(set(two)) == 26 and len({pii.shaped(f"{c}{'ab' * 120}", KEY, "t") for c in "abcdefghijklmnopqrstuvwxyz"}) == 26
    assert pii.shaped("A1-b_2", KEY, "t")[2] == "-" and pii.shaped("...", KEY, "t") == "..."
    address = "a" * LONG + "@b.com"
    new, spans = pii.rewrite(address, KEY, {})
    assert spans == [("email", 0, len(address))] and len(new) == len(address) and new.count("a") < LONG // 10


def test_long_texts_in_functions(long_texts):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        coder = bpe.Coder(f.read().splitlines(), public_tokenizers.PATTERN)
    for text in long_texts:
        assert secrets.scan(text, 200) == ([(2, 0, LONG)] if text[1] == "a" else [])  # a run of hexadecimal digits
        assert pii.rewrite(text, KEY, {}) == (text, [])
        assert len(language.presence(text)) > 0 and 0 <= neardup.fingerprint(text) < 1 << 64
        ids, counts = coder.encode([text])
        assert counts[0] == len(ids) and coder.decode(ids, counts) == [text.encode()]


def test_long_texts_in_columns(spark, long_texts):
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate([*long_texts, "short text", None])], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).select("row.doc_id", *quality.RESULTS).collect()}
    assert [judged[i]["n_words"] for i in range(5)] == [1, LONG // 5, LONG // 7, 2, 0]
    assert judged[1]["n_repeat_words"] == LONG // 5 and judged[2]["n_repeat_words"] == 0 and judged[0]["word_chars"] == LONG
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).select("row.doc_id", "size").collect()}
    assert [sizes[i] for i in range(5)] == [1, LONG // 5, LONG // 7, 2, 0]
    assert sum(r["size"] for r in sharding.shard(docs, 3).collect()) == sum(map(len, long_texts)) + 10 + 40
    assert neardup.group(docs).count() == 5


def pipeline_tables(spark, folder, docs, labels, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    pick = random.Random(16)
    words = [f"w{i}" for i in range(90)]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    texts = [text(pick.randrange(5, 90)) for _ in range(60)]
    texts += [texts[3], texts[30].upper(), "a b c d e f g h " * 9, texts[5] + " write to me@corp.com or 4111-1111-1111-1111", "Mr. Adam Berger " + texts[7] + " Berger", "", "one two"]
    docs = [(i, t, "en", "abc"[i % 3], 0) for i, t in enumerate(texts)]
    good = [i % 4 == 0 and i < 60 for i in range(len(texts))]
    pipeline_tables(spark, tmp_path, docs, [(i, int(g), 0) for i, g in enumerate(good)])
    spark.conf.set(pii.SURROGATE_KEY, "tests")
    try:
        key = pii.session_key(spark)
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset(pii.SURROGATE_KEY)
    stay = [d for d, keep in zip(docs, brute.kept(texts, good), strict=True) if keep]
    label = brute.classes([brute.simhash(d[1]) for d in stay])
    least = {}
    for d in stay:
        group = label[brute.simhash(d[1])]
        least[group] = min(least.get(group, d[0]), d[0])
    one = [d for d in stay if least[label[brute.simhash(d[1])]] == d[0]]
    clean = [(d[0], pii.rewrite(d[1], key, {})[0], d[3]) for d in one]
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == Counter((i, tuple(own.encode_ordinary(t))) for i, t in brute.mixed(clean))
    assert len(one) < len(stay) < len(docs) and any("@" in t for _, t, _ in clean)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    pick = random.Random(17)
    text = lambda n: " ".join(f"w{pick.randrange(500)}" for _ in range(n))
    same = text(50)
    odd = [(None, same, None, None, None), (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, None, None, None, None), (3, "", "", "", 0), (4, " \n", "en", "b", 2), (5, text(40), None, None, None), (None, None, None, None, None), (6, text(200_000), "en", "a", 1)]
    wide = [(*r, "row", 1, 2, "kept", "own", 3) for r in odd]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, id long, kept string, own string, mark long"
    pipeline_tables(spark, tmp_path, wide, [(1, 1, 0), (None, 1, 0), (2, None, None)], schema)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for part, n in ((docs, None), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, str(tmp_path))
            rows = out.collect()
            if stage is not corpus_pipeline.tokens:
                assert out.columns == docs.columns
            assert n is None or len(rows) == n
    kept = {(r["doc_id"], r["mark"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {(1, 3), (2, 3), (5, 3), (6, 3)}
    one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert one.filter("doc_id = 1").count() == 1 and one.filter("doc_id = 6").first()["text"].count(" ") == 199_999
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).filter("doc_id = 1").count() == 2
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == len(odd)
