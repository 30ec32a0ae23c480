"""The pipeline on a small table, each stage against what it should do."""

import random

import corpus_pipeline
from annulus.llm import queries


def test_pipeline(spark, tmp_path):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    good = [(i, text(60), "en", "ab"[i % 2], 0) for i in range(30)]
    rows = [*good, (100, good[3][1], "en", "a", 0), (101, "too short", "en", "a", 0), (102, "a b c d e f g h " * 9, "en", "b", 0), (103, text(50) + " me@corp.com", "en", "b", 0), (104, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:-1])
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == [*range(30), 100, 103]
    assert ids[1] == [*range(30), 103]
    assert ids[2] == ids[1] and "corp" not in str(seen[2].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    assert ids[4] == ids[3] and len(seen[4].collect()) == len(seen[3].collect())
    whole = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(str, seen[4].collect()))


def test_queries_have_their_columns(spark):
    want = {"op1": "doc_id n_assign n_access n_hex base_sha256 spans", "op2": "doc_id size source_size target taken", "op3": "query_id rank vec_id score", "op4": "doc_id size text_crc32 law shard slot grown_shard", "op5": "page_id host path rule verdict", "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "doc_id fingerprint component_id", "op10": "doc_id text n_entities spans"}
    found = {name.split("_")[0]: f for name, f in queries.queries().items()}
    assert set(found) == set(want)
    assert set(queries.oracle_sql()) <= set(queries.queries())
