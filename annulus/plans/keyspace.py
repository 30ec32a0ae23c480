"""Queries on a keyspace and a mutation log, and scalar commands over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.functions import glob, scalars
from annulus.functions.tokens import portable_token
from annulus.operators import keyspace, log
from annulus.sources import datasets as data

#: The clock of all queries, in ms: 2024-01-29 09:20 UTC.
NOW = 1_706_520_000_000
TOKEN = 1 << 59


def records(spark, sf_dir):
    """The state after the mutation log: the last write of each key, with its token and whether it is live."""
    writes = data.mutations(spark, sf_dir).filter("op <> 'get'").withColumn("deleted", F.col("op") == "delete")
    state = log.latest(writes.select("key", "epoch", "seq", "value", "deleted", "expires_at_ms", "at_ms"), "key", ["epoch", "seq"])
    return state.withColumn("token", portable_token(F.col("key"))).withColumn("live", log.live(F.col("deleted"), F.col("expires_at_ms"), F.lit(NOW)))


def lww_merge(spark, sf_dir):
    return records(spark, sf_dir).select("key", "epoch", "seq", "deleted", "expires_at_ms")


def tombstones(spark, sf_dir):
    return records(spark, sf_dir).filter("deleted").select("key", "epoch", "seq")


def live_keys(spark, sf_dir):
    return records(spark, sf_dir).filter("live").select("key", "value")


def dbsize(spark, sf_dir):
    return records(spark, sf_dir).filter("live").agg(F.count("*").alias("n"))


def scan_page(spark, sf_dir):
    return keyspace.page(records(spark, sf_dir), TOKEN, 100, 4_000)


def scan_step(spark, sf_dir):
    return keyspace.scan(records(spark, sf_dir), TOKEN, 50, glob.matches(F.col("key"), "*[02468]"))


def random_key_at_token(spark, sf_dir):
    return keyspace.at_or_after(records(spark, sf_dir), TOKEN)


def walk_budget(spark, sf_dir):
    return keyspace.within_budget(records(spark, sf_dir), 4_096)


def keys_glob(spark, sf_dir):
    pages = data.read(spark, sf_dir, "pages")
    return pages.filter(glob.matches(F.col("url"), r"https://*.example.[a-n]*/en/[^1-5]*[!-9]")).select("page_id", "url")


def mget(spark, sf_dir):
    asked = data.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("user:"), (F.col("c_custkey") * 7).cast("string")).alias("key"))
    return keyspace.lookup(records(spark, sf_dir), asked)


def exists_dup(spark, sf_dir):
    asked = data.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("user:"), F.col("l_suppkey").cast("string")).alias("key"))
    return asked.join(records(spark, sf_dir).filter("live").select("key"), "key", "left_semi").agg(F.count("*").alias("n"))


def expiry_sweep(spark, sf_dir):
    return log.sweep(records(spark, sf_dir).filter("not deleted"), NOW, 50).select("key", "expires_at_ms")


def ttl_seconds(spark, sf_dir):
    state, live = records(spark, sf_dir), F.col("live")
    now = F.lit(NOW - 5 * 86_400_000)
    return state.select("key", scalars.ttl_seconds(live | F.col("expires_at_ms").isNotNull() & ~F.col("deleted"), F.col("expires_at_ms"), now).alias("ttl"), scalars.ttl_ms(live, F.col("expires_at_ms"), now).alias("pttl"))


def expire_guard(spark, sf_dir):
    state = records(spark, sf_dir).filter("not deleted")
    new = F.lit(NOW - 7 * 86_400_000)
    return state.select("key", *[scalars.expire_allowed(g, F.col("expires_at_ms"), new).alias(g.lower()) for g in ("NX", "XX", "GT", "LT")])


def getrange(spark, sf_dir):
    urls = data.read(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("v"))
    cut = lambda a, b: scalars.getrange(F.col("v"), F.lit(a), F.lit(b)).cast("string")
    return urls.select("page_id", cut(8, 12).alias("a"), cut(-5, -1).alias("b"), cut(-1000, 3).alias("c"), cut(5, 2).alias("d"), cut(0, -1000).alias("e"))


def setrange(spark, sf_dir):
    urls = data.read(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("v"))
    put = lambda at, patch: scalars.setrange(F.col("v"), F.lit(at), F.lit(patch).cast("binary")).cast("string")
    return urls.select("page_id", put(2, "<>").alias("a"), put(7, "").alias("b"))


def strlen(spark, sf_dir):
    return data.read(spark, sf_dir, "documents").select("doc_id", scalars.strlen(F.col("text")).cast("long").alias("n"))


def append_fold(spark, sf_dir):
    turns = data.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    value = F.array_join(F.transform("t", lambda t: t["text"]), "")
    return turns.select("conv_id", F.octet_length(value).cast("long").alias("n"), F.md5(value.cast("binary")).alias("digest"))


def incr_fold(spark, sf_dir):
    events = data.mutations(spark, sf_dir)
    by = F.when(F.col("op") == "put", F.col("seq") % 10).when(F.col("op") == "delete", -(F.col("seq") % 7)).otherwise(1)
    return events.groupBy("key").agg(F.sum(by).alias("value"))


def mset_last_wins(spark, sf_dir):
    items = data.read(spark, sf_dir, "lineitem")
    pairs = items.select(F.col("l_orderkey").alias("call"), (F.col("l_partkey") % 3).alias("key"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("value"))
    return pairs.groupBy("call", "key").agg(F.max_by("value", F.struct("pos", "value")).alias("value"))


def changelog_replay(spark, sf_dir):
    writes = data.mutations(spark, sf_dir).filter("op <> 'get'").withColumn("deleted", F.col("op") == "delete").select("key", "epoch", "seq", "value", "deleted")
    snapshot = log.latest(writes.filter("seq < 3000"), "key", ["epoch", "seq"])
    journal = writes.filter("seq >= 2000").withColumn("watermark", F.col("seq"))
    return log.replay(snapshot, journal, "key", ["epoch", "seq"], 2_500).select("key", "epoch", "seq", "deleted")


def contiguity_gaps(spark, sf_dir):
    return log.gaps(data.mutations(spark, sf_dir).filter("op <> 'get'").withColumn("stream", F.col("user_id") % 8), "stream", "seq")


def dedup_conflicts(spark, sf_dir):
    events = data.mutations(spark, sf_dir).withColumn("mutation", F.concat_ws("-", (F.col("seq") % 2_500).cast("string"), "op"))
    return log.retries(events.withColumn("fp", F.md5(F.concat_ws("|", "key", "op"))), "mutation", "fp", ["seq"])


def range_digests(spark, sf_dir):
    state = records(spark, sf_dir).withColumn("range", F.shiftright("token", 56).cast("int"))
    return log.range_digest(state, "range", F.concat_ws("|", "key", F.col("epoch").cast("string"), F.col("seq").cast("string")))


def ordered_digests(spark, sf_dir):
    state = records(spark, sf_dir).withColumn("range", F.shiftright("token", 56).cast("int"))
    return log.ordered_digest(state, "range", "token", ["token", "key"], F.concat_ws("|", "key", F.col("epoch").cast("string"), F.col("seq").cast("string")))


def linearizable_mutations(spark, sf_dir):
    """Writes of a key that began after another ended, yet have a smaller version: violations of real-time order."""
    from annulus.operators.verify import realtime_violations

    writes = data.mutations(spark, sf_dir).filter("op <> 'get'")
    history = writes.select("key", "seq", "epoch", F.col("at_ms").alias("invoked"), (F.col("at_ms") + (F.col("seq") % 5) * 60_000).alias("completed"), (F.col("seq") * 7919 % 10_007).alias("version"))
    return realtime_violations(history, "key", "version", "invoked", "completed").select("key", "version", "earlier")


_TOK = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_BASE = f"""m AS (
  SELECT 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('signup', 'purchase') THEN 'put' ELSE 'get' END AS op,
         1 + floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 10)::BIGINT AS epoch, event_id AS seq, props AS value, epoch_ns(ts) // 1000000 AS at_ms,
         CASE WHEN event_type = 'signup' THEN epoch_ns(ts) // 1000000 + 3600000 END AS expires_at_ms, user_id
  FROM events),
w AS (SELECT *, op = 'delete' AS deleted FROM m WHERE op <> 'get'),
s AS (SELECT *, {_TOK.format('key')} AS token, NOT deleted AND (expires_at_ms IS NULL OR {NOW} < expires_at_ms) AS live
      FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) = 1)"""


def _sql(select: str, more: str = "") -> str:
    return f"WITH {_BASE}{', ' + more if more else ''}\n{select}"


def oracle_sql():
    ms = f"{NOW - 5 * 86_400_000}"
    ttl = lambda exists: f"CASE WHEN NOT ({exists}) THEN -2 WHEN expires_at_ms IS NULL THEN -1 ELSE greatest(0, expires_at_ms - {ms}) END"
    new = NOW - 7 * 86_400_000
    return {
        "lww_merge": _sql("SELECT key, epoch, seq, deleted, expires_at_ms FROM s"),
        "tombstones": _sql("SELECT key, epoch, seq FROM s WHERE deleted"),
        "live_keys": _sql("SELECT key, value FROM s WHERE live"),
        "dbsize": _sql("SELECT count(*) AS n FROM s WHERE live"),
        "scan_page": _sql(f"""SELECT key, token FROM s JOIN p USING (token) WHERE live AND (nth = 1 OR (k <= 100 AND b <= 4000 AND e <= 10000))""", f"""
p AS (SELECT token, row_number() OVER o AS nth, sum(k) OVER o AS k, sum(b) OVER o AS b, sum(e) OVER o AS e
      FROM (SELECT token, count(*) FILTER (live) AS k, coalesce(sum(strlen(key) + 64) FILTER (live), 0) AS b, count(*) AS e FROM s WHERE token >= {TOKEN} GROUP BY 1) WINDOW o AS (ORDER BY token))"""),
        "scan_step": _sql("SELECT key, token, coalesce((SELECT min(token) FROM s WHERE live AND token > last), 0) AS next FROM s, l WHERE live AND token <= last AND token >= " + str(TOKEN) + " AND regexp_full_match(key, '.*[02468]')", f"l AS (SELECT max(token) AS last FROM (SELECT token FROM s WHERE live AND token >= {TOKEN} ORDER BY token, key LIMIT 50))"),
        "random_key_at_token": _sql(f"SELECT key, token FROM s WHERE live ORDER BY token < {TOKEN}, token, key LIMIT 1"),
        "walk_budget": _sql("SELECT count(*) AS keys, coalesce(sum(strlen(key) + 64), 0)::BIGINT AS bytes, coalesce(sum(strlen(key) + 64), 0) > 4096 AS too_large FROM s WHERE live"),
        "keys_glob": r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.*\.example\.[a-n].*/en/[^1-5].*[!-9]', 's')",
        "mget": _sql("SELECT c_custkey AS pos, 'user:' || (c_custkey * 7) AS key, v.value FROM customer LEFT JOIN (SELECT key, value FROM s WHERE live) v ON v.key = 'user:' || (c_custkey * 7)"),
        "exists_dup": _sql("SELECT count(*) AS n FROM lineitem WHERE 'user:' || l_suppkey IN (SELECT key FROM s WHERE live)"),
        "expiry_sweep": _sql(f"SELECT key, expires_at_ms FROM s WHERE NOT deleted AND expires_at_ms <= {NOW} ORDER BY expires_at_ms, key LIMIT 50"),
        "ttl_seconds": _sql(f"SELECT key, CASE WHEN a < 0 THEN a ELSE ceil(a / 1000) END::BIGINT AS ttl, pttl FROM (SELECT key, {ttl('live OR (expires_at_ms IS NOT NULL AND NOT deleted)')} AS a, {ttl('live')}::BIGINT AS pttl FROM s)"),
        "expire_guard": _sql(f"SELECT key, expires_at_ms IS NULL AS nx, expires_at_ms IS NOT NULL AS xx, coalesce({new} > expires_at_ms, false) AS gt, coalesce({new} < expires_at_ms, true) AS lt FROM s WHERE NOT deleted"),
        "getrange": "SELECT page_id, substr(url, 9, 5) AS a, right(url, 5) AS b, left(url, 4) AS c, '' AS d, left(url, 1) AS e FROM pages",
        "setrange": "SELECT page_id, left(url, 2) || '<>' || substr(url, 5) AS a, url AS b FROM pages",
        "strlen": "SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents",
        "append_fold": "SELECT conv_id, strlen(v) AS n, md5(v) AS digest FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS v FROM conversations GROUP BY 1)",
        "incr_fold": _sql("SELECT key, sum(CASE op WHEN 'put' THEN seq % 10 WHEN 'delete' THEN -(seq % 7) ELSE 1 END)::BIGINT AS value FROM m GROUP BY 1"),
        "mset_last_wins": 'SELECT l_orderkey AS "call", l_partkey % 3 AS key, max_by(l_suppkey, (l_linenumber, l_suppkey)) AS value FROM lineitem GROUP BY 1, 2',
        "changelog_replay": _sql("SELECT key, epoch, seq, deleted FROM w WHERE seq < 3000 OR seq > 2500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) = 1"),
        "contiguity_gaps": _sql("SELECT * FROM (SELECT user_id % 8 AS stream, seq, lag(seq) OVER (PARTITION BY user_id % 8 ORDER BY seq) AS before FROM w) WHERE before IS NOT NULL AND seq <> before + 1"),
        "dedup_conflicts": _sql("SELECT mutation, count(*) AS attempts, min_by(fp, seq) AS answer, count(DISTINCT fp) > 1 AS conflict FROM (SELECT (seq % 2500) || '-' || op AS mutation, md5(key || '|' || op) AS fp, seq FROM m) GROUP BY 1"),
        "range_digests": _sql(f"SELECT (token >> 56)::INT AS range, count(*) AS records, bit_xor({_TOK.format(chr(39) + 'a' + chr(39) + ' || r')}) || ':' || bit_xor({_TOK.format(chr(39) + 'b' + chr(39) + ' || r')}) AS digest FROM (SELECT token, key || '|' || epoch || '|' || seq AS r FROM s) GROUP BY 1"),
        "ordered_digests": _sql("SELECT range, sum(n)::BIGINT AS records, sha256(string_agg(d, '' ORDER BY part)) AS digest FROM (SELECT (token >> 56)::INT AS range, token >> 50 AS part, count(*) AS n, sha256(string_agg(sha256(key || '|' || epoch || '|' || seq), '' ORDER BY token, key)) AS d FROM s GROUP BY 1, 2) GROUP BY 1"),
        "linearizable_mutations": _sql("SELECT key, version, earlier FROM (SELECT a.key, a.version, max(b.version) AS earlier FROM h a JOIN h b ON a.key = b.key AND b.completed < a.invoked GROUP BY a.key, a.version, a.invoked) WHERE earlier > version", "h AS (SELECT key, at_ms AS invoked, at_ms + (seq % 5) * 60000 AS completed, seq * 7919 % 10007 AS version FROM w)"),
    }


def queries():
    return {f.__name__: f for f in (lww_merge, tombstones, live_keys, dbsize, scan_page, scan_step, random_key_at_token, walk_budget, keys_glob, mget, exists_dup, expiry_sweep, ttl_seconds, expire_guard, getrange, setrange, strlen, append_fold, incr_fold, mset_last_wins, changelog_replay, contiguity_gaps, dedup_conflicts, range_digests, ordered_digests, linearizable_mutations)}
