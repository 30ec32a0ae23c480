"""One query for each operator of this subpackage, over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from annulus.llm import bpe, language, mixing, neardup, neighbours, pii, quality, secrets, sharding, urls
from annulus.llm.common import table


def op1_secrets(spark, sf_dir):
    return secrets.digest(secrets.link_credentials(table(spark, sf_dir, "documents")))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def op3_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), urls.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    return language.identify(docs, language.learn(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_neardup(spark, sf_dir):
    found = neardup.group(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), neardup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_pii(spark, sf_dir):
    replaced = pii.replace(table(spark, sf_dir, "documents"), pii.session_key(spark))
    return replaced.select("row.doc_id", "row.text", F.size("spans").cast("long").alias("n_entities"), secrets.joined(F.col("spans")).alias("spans"))


def queries():
    return {f.__name__: f for f in (op1_secrets, op2_mixing, op3_neighbours, op4_sharding, op5_urls, op6_quality, op7_language, op8_bpe, op9_neardup, op10_pii)}


#: Op 2 in DuckDB: the level is found by running sums over the sources in the order in which they fill, and the random order is the one of the engine (60 bits of an MD5).
MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM s),
v AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, source_size * 3.0::DOUBLE / weight AS fills FROM v),
o AS (SELECT *, (sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER b, 0)::BIGINT AS rest,
             (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS rest_weight
      FROM f WINDOW b AS (ORDER BY fills, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT fills AS l_fills, nth AS l_nth, rest AS l_rest, rest_weight AS l_weight FROM o
      WHERE fills > rest::DOUBLE / rest_weight ORDER BY fills, nth LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN l_fills IS NULL OR (fills, nth) < (l_fills, l_nth) THEN 3.0::DOUBLE * source_size
                  ELSE weight * l_rest::DOUBLE / l_weight END AS target
      FROM o LEFT JOIN l ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS reps FROM t),
c AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.reps, round(u.target)::BIGINT - u.reps * u.source_size AS more,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (reps * size + greatest(0, least(size, more - before)))::BIGINT AS taken
FROM c
"""


def oracle_sql():
    return {"op2_mixing": MIXING_SQL}
