"""Queries on changes of a cluster and what verifies them, and small functions over tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.functions.tokens import portable_token
from annulus.operators import commands, log, ring
from annulus.plans import keyspace, placement
from annulus.sources import datasets as data

HALF = 1 << 59


def range_commit(spark, sf_dir):
    """The records of a range (the upper half) replaced by staged ones."""
    state = keyspace.records(spark, sf_dir).select("key", "token", F.col("seq").alias("v"))
    inside = ring.contains(F.col("token"), F.lit(HALF), F.lit((1 << 60) - 1))
    staged = state.filter(inside & (F.col("v") % 2 == 0)).withColumn("v", F.col("v") + 1_000_000)
    return state.filter(~inside).unionByName(staged)


def source_cleanup(spark, sf_dir):
    """Keys that a node holds and, in the new ring, no longer replicates."""
    before, after = placement._two(spark, sf_dir)
    held = F.array_contains(F.concat(F.array("owner"), "followers"), "NATION_1")
    keys = ring.ring_join(data.keys(spark, sf_dir), before.filter(held).select("start", "end")).drop("start", "end")
    return ring.ring_join(keys, after).filter(~held).select("key")


def digest_equality(spark, sf_dir):
    """Ranges whose digest differs between a source and its copy."""
    state = keyspace.records(spark, sf_dir).withColumn("range", F.shiftright("token", 56).cast("int"))
    copy = state.filter("seq % 13 <> 0")
    record = F.concat_ws("|", "key", F.col("seq").cast("string"))
    a, b = log.range_digest(state, "range", record), log.range_digest(copy, "range", record)
    both = a.join(b.select("range", F.col("records").alias("copied"), F.col("digest").alias("other")), "range", "full")
    return both.select("range", "records", "copied", (F.col("digest").eqNullSafe(F.col("other"))).alias("equal"))


def stage_match(spark, sf_dir):
    """Stages of two runs (finished orders and others) by their rate; a rate that one lacks keeps its row."""
    o = data.read(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    run = lambda where, name: o.filter(where).groupBy(F.floor(F.col("o_totalprice") / 20_000).alias("rate")).agg(F.count("*").alias(name))
    return run(done, "a").join(run(~done, "b"), "rate", "full").select("rate", "a", "b")


def byte_page(spark, sf_dir):
    """A snapshot page of at most 2,000 bytes of keys and values, at least one record, tombstones included."""
    order = W.orderBy("token", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.octet_length("key") + F.octet_length("value") + 64
    first = keyspace.records(spark, sf_dir).orderBy("token", "key").limit(200)
    return first.withColumn("upto", F.sum(size).over(order)).withColumn("nth", F.row_number().over(W.orderBy("token", "key"))).filter("upto <= 2000 or nth = 1").select("key", "token")


def moved_cohorts(spark, sf_dir):
    """Keys that change owner, dealt to three cohorts in token order; how many of each."""
    moved = placement._both(spark, sf_dir).filter("owner_before <> owner_after").select("key", "token")
    # A rank within 16 slices of the ring and the slices' sums, instead of one sort of all keys.
    slices = moved.withColumn("slice", F.shiftright("token", 56))
    before = slices.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = slices.join(F.broadcast(before), "slice").withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("slice").orderBy("token", "key")) - 1)
    return placed.groupBy((F.col("i") % 3).alias("cohort")).agg(F.count("*").alias("n"), F.min("token").alias("first"))


def _command_log(spark, sf_dir):
    """Events as commands on their user's key, twenty kinds in turn."""
    m = data.mutations(spark, sf_dir)
    own, digit = (F.col("seq") % 50).cast("string"), (F.col("seq") % 10).cast("string")
    kinds = [
        ("SET", own), ("SET", own, "NX"), ("SET", own, "XX", "GET"), ("SET", own, "EX", "100000"), ("SETNX", own), ("GETSET", own), ("GETDEL",), ("GETEX", "PERSIST"), ("APPEND", digit), ("STRLEN",),
        ("GETRANGE", "0", "0"), ("INCRBY", digit), ("DECRBY", "3"), ("EXPIRE", "500000", "NX"), ("EXPIRE", "50000", "LT"), ("PERSIST",), ("PTTL",), ("EXISTS",), ("TYPE",), ("DEL",),
    ]
    args = F.lit(None).cast("array<string>")
    for i, (name, *rest) in enumerate(kinds):
        args = F.when(F.col("seq") % len(kinds) == i, F.array(F.lit(name), F.col("key"), *[F.lit(x) if isinstance(x, str) else x for x in rest])).otherwise(args)
    return m.select("seq", F.col("at_ms").alias("now_ms"), args.alias("args"))


def command_fold(spark, sf_dir):
    """Replies of a log of commands."""
    return commands.execute(_command_log(spark, sf_dir)).select("seq", F.get("reply", F.lit(0)).alias("reply"))


def multi_key_commands(spark, sf_dir):
    """Replies of MSET, MGET, DEL and EXISTS on three keys each, of orders of a customer."""
    o = data.read(spark, sf_dir, "orders")
    key = lambda i: F.concat(F.lit("c"), ((F.col("o_custkey") + i) % 97).cast("string"))
    kind = F.col("o_orderkey") % 4
    value = F.col("o_orderkey").cast("string")
    args = (
        F.when(kind == 0, F.array(F.lit("MSET"), key(0), value, key(1), value, key(0), F.concat(value, F.lit("b"))))
        .when(kind == 1, F.array(F.lit("MGET"), key(0), key(1), key(0)))
        .when(kind == 2, F.array(F.lit("EXISTS"), key(0), key(0), key(2)))
        .otherwise(F.array(F.lit("DEL"), key(2), key(3)))
    )
    found = commands.execute(o.select(F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("now_ms"), args.alias("args")))
    return found.select("seq", F.array_join("reply", ",", "nil").alias("reply"))


#: The fold of _command_log as a recursive query: a step takes each key's next command.
COMMANDS_SQL = """, c AS (SELECT key, seq, at_ms AS now, seq % 20 AS k, (seq % 50)::VARCHAR AS s, seq % 10 AS a, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM m),
r AS (
  SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS v, NULL::BIGINT AS d, NULL::VARCHAR AS reply FROM c
  UNION ALL
  SELECT key, i, seq,
    CASE WHEN k IN (0, 3, 5) THEN s WHEN k IN (1, 4) THEN coalesce(v, s) WHEN k = 2 THEN CASE WHEN v IS NOT NULL THEN s END WHEN k IN (6, 19) THEN NULL
         WHEN k = 8 THEN coalesce(v, '') || a WHEN k = 11 THEN coalesce((n + a)::VARCHAR, v) WHEN k = 12 THEN coalesce((n - 3)::VARCHAR, v) ELSE v END,
    CASE WHEN k = 3 THEN now + 100000000 WHEN k IN (0, 2, 5, 6, 7, 15, 19) THEN NULL
         WHEN k = 13 AND v IS NOT NULL AND d IS NULL THEN now + 500000000 WHEN k = 14 AND v IS NOT NULL AND (d IS NULL OR now + 50000000 < d) THEN now + 50000000 ELSE d END,
    CASE WHEN k IN (0, 3) THEN 'OK' WHEN k = 1 THEN CASE WHEN v IS NULL THEN 'OK' END WHEN k IN (2, 5, 6, 7) THEN v
         WHEN k = 4 THEN (v IS NULL)::INT::VARCHAR WHEN k = 8 THEN (length(coalesce(v, '')) + 1)::VARCHAR WHEN k = 9 THEN length(coalesce(v, ''))::VARCHAR WHEN k = 10 THEN coalesce(v[1], '')
         WHEN k = 11 THEN coalesce((n + a)::VARCHAR, 'ERR value is not an integer or out of range') WHEN k = 12 THEN coalesce((n - 3)::VARCHAR, 'ERR value is not an integer or out of range')
         WHEN k = 13 THEN (v IS NOT NULL AND d IS NULL)::INT::VARCHAR WHEN k = 14 THEN (v IS NOT NULL AND (d IS NULL OR now + 50000000 < d))::INT::VARCHAR
         WHEN k = 15 THEN (d IS NOT NULL)::INT::VARCHAR WHEN k = 16 THEN CASE WHEN v IS NULL THEN -2 WHEN d IS NULL THEN -1 ELSE d - now END::VARCHAR
         WHEN k IN (17, 19) THEN (v IS NOT NULL)::INT::VARCHAR WHEN k = 18 THEN CASE WHEN v IS NULL THEN 'none' ELSE 'string' END END
  FROM (
    SELECT *, TRY_CAST(coalesce(v, '0') AS BIGINT) AS n FROM (
      SELECT c.*, CASE WHEN r.d IS NULL OR c.now < r.d THEN r.v END AS v, CASE WHEN c.now < r.d THEN r.d END AS d FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1)))
SELECT seq, reply FROM r WHERE i > 0"""

#: The state of a key before a command is that of the last MSET or DEL that named it.
MULTI_SQL = """
WITH o AS (SELECT o_orderkey AS seq, o_custkey AS c, o_orderkey % 4 AS k FROM orders),
w AS (SELECT seq, 'c' || c % 97 AS key, seq || 'b' AS v FROM o WHERE k = 0 UNION ALL SELECT seq, 'c' || (c + 1) % 97, seq::VARCHAR FROM o WHERE k = 0
      UNION ALL SELECT seq, 'c' || (c + x) % 97, NULL FROM o, (VALUES (2), (3)) t(x) WHERE k = 3),
q AS (SELECT seq, k, x.pos, 'c' || (c + x.off) % 97 AS key FROM o JOIN (VALUES (1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 2), (3, 0, 2), (3, 1, 3)) x(kind, pos, off) ON k = kind),
s AS (SELECT q.*, w.v FROM q ASOF LEFT JOIN w ON q.key = w.key AND q.seq > w.seq)
SELECT seq, CASE k WHEN 1 THEN string_agg(coalesce(v, 'nil'), ',' ORDER BY pos) ELSE count(v)::VARCHAR END AS reply FROM s GROUP BY seq, k
UNION ALL SELECT seq, 'OK' FROM o WHERE k = 0"""


def oracle_sql():
    rec, sql = keyspace._BASE, keyspace._sql
    t, b, keys = placement._ring_sql("t", 10, 32), placement._ring_sql("b", 9, 32), placement._keys_sql()
    both = placement._with(t, b, keys, placement._place_sql("b"), placement._place_sql("t"), select="SELECT key, token, x.owner AS ob, x.reps AS rb, y.owner AS oa, y.reps AS ra FROM b_placed x JOIN t_placed y USING (key, token)")
    log_ = f"WITH {rec.split('w AS (')[0].rstrip().rstrip(',')}"
    tok = "('0x' || substr(md5({} || r), 1, 15))::BIGINT"
    digest = f"bit_xor({tok.format(chr(39) + 'a' + chr(39))}) || ':' || bit_xor({tok.format(chr(39) + 'b' + chr(39))})"
    return {
        "range_commit": sql(f"SELECT key, token, CASE WHEN token > {HALF} THEN seq + 1000000 ELSE seq END AS v FROM s WHERE token <= {HALF} OR seq % 2 = 0"),
        "source_cleanup": f"SELECT key FROM ({both}) WHERE list_contains(rb, 'NATION_1') AND NOT list_contains(ra, 'NATION_1')",
        "digest_equality": sql(f"SELECT range, a.records, b.records AS copied, a.d IS NOT DISTINCT FROM b.d AS equal FROM (SELECT range, count(*) AS records, {digest} AS d FROM x GROUP BY 1) a FULL JOIN (SELECT range, count(*) AS records, {digest} AS d FROM x WHERE seq % 13 <> 0 GROUP BY 1) b USING (range)", "x AS (SELECT (token >> 56)::INT AS range, key || '|' || seq AS r, seq FROM s)"),
        "stage_match": "SELECT rate, a, b FROM (SELECT floor(o_totalprice / 20000)::BIGINT AS rate, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT floor(o_totalprice / 20000)::BIGINT AS rate, count(*) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) USING (rate)",
        "byte_page": sql("SELECT key, token FROM (SELECT *, sum(strlen(key) + strlen(value) + 64) OVER (ORDER BY token, key ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY token, key) AS nth FROM s) WHERE upto <= 2000 OR nth = 1"),
        "moved_cohorts": f"SELECT i % 3 AS cohort, count(*) AS n, min(token) AS first FROM (SELECT token, row_number() OVER (ORDER BY token, key) - 1 AS i FROM ({both}) WHERE ob <> oa) GROUP BY 1",
        "command_fold": log_.replace("WITH ", "WITH RECURSIVE ", 1) + COMMANDS_SQL,
        "multi_key_commands": MULTI_SQL,
    }


def queries():
    return {name: globals()[name] for name in oracle_sql()}
