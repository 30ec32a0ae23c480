"""Queries on placement: rings, owners, replicas, changes of members."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.operators import ring
from annulus.sources import datasets as data

#: Nine members grow to ten; virtual nodes; replicas.
BASE, TARGET, VNODES, RF = 9, 10, 32, 3
LEAST_OWNED = 9


def _named(ranges):
    return ranges.select("start", "end", "owner", F.array_join("followers", "|").alias("followers"))


def _two(spark, sf_dir):
    return data.ranges_of(spark, sf_dir, BASE, VNODES, RF), data.ranges_of(spark, sf_dir, TARGET, VNODES, RF)


def ring_tokens(spark, sf_dir):
    return data.ring_of(spark, sf_dir, TARGET, VNODES)


def derived_ranges(spark, sf_dir):
    return _named(data.ranges_of(spark, sf_dir, TARGET, VNODES, RF))


def key_owner(spark, sf_dir):
    return ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, VNODES)).select("key", "token", "owner")


def key_replicas(spark, sf_dir):
    placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, VNODES, RF))
    return placed.select("key", F.concat_ws("|", F.array("owner"), "followers").alias("replicas"))


def ring_owned_keys(spark, sf_dir):
    placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, VNODES))
    return ring.owned_keys(placed, data.members(spark, sf_dir))


def key_balance(spark, sf_dir):
    placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, VNODES))
    found = ring.balance(ring.owned_keys(placed, data.members(spark, sf_dir, TARGET)))
    return found.select("nodes", "total", *[F.round(c, 6).alias(c) for c in ("max_over_min", "spread", "max_over_mean", "excess", "cv")])


def subset_balance(spark, sf_dir):
    placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, VNODES))
    found = ring.balance(ring.owned_keys(placed, data.members(spark, sf_dir, 5)))
    return found.select("nodes", "total", F.round("cv", 6).alias("cv"))


def balance_vs_vnodes(spark, sf_dir):
    out = None
    for v in (1, 8, 64):
        placed = ring.ring_join(data.keys(spark, sf_dir), data.ranges_of(spark, sf_dir, TARGET, v))
        one = ring.balance(ring.owned_keys(placed, data.members(spark, sf_dir, TARGET))).select(F.lit(v).alias("vnodes"), F.round("max_over_mean", 6).alias("max_over_mean"), F.round("cv", 6).alias("cv"))
        out = one if out is None else out.unionByName(one)
    return out


def topology_delta(spark, sf_dir):
    return ring.topology_delta(*_two(spark, sf_dir))


def obligations(spark, sf_dir):
    return ring.obligations(*_two(spark, sf_dir))


def ring_segments(spark, sf_dir):
    return ring.segments(*_two(spark, sf_dir)).select("start", "end", "owner_before", "owner_after", (F.col("owner_before") != F.col("owner_after")).alias("owner_changed"), (F.array_join("replicas_before", "|") != F.array_join("replicas_after", "|")).alias("replicas_changed"))


def _both(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    of = lambda r, when: r.select("start", "end", F.col("owner").alias(f"owner_{when}"), F.concat(F.array("owner"), "followers").alias(f"replicas_{when}"))
    first = ring.ring_join(data.keys(spark, sf_dir), of(before, "before")).drop("start", "end")
    return ring.ring_join(first, of(after, "after")).drop("start", "end")


def moved_keys(spark, sf_dir):
    moved = F.count_if(F.col("owner_before") != F.col("owner_after"))
    return _both(spark, sf_dir).agg(F.count("*").alias("keys"), moved.alias("moved"), F.round(F.when(F.count("*") > 0, moved / F.count("*")).otherwise(0.0), 6).alias("migration_rate"))


def _strata(spark, sf_dir):
    old, new = (data.members(spark, sf_dir, n) for n in (BASE, TARGET))
    removed = old.join(new, "node_id", "left_anti").agg(F.collect_list("node_id").alias("removed"))
    added = new.join(old, "node_id", "left_anti").agg(F.collect_list("node_id").alias("added"))
    changes = F.broadcast(removed.join(added))  # one row
    return _both(spark, sf_dir).join(changes).withColumn("stratum", ring.stratum(*map(F.col, ("owner_before", "replicas_before", "owner_after", "replicas_after", "removed", "added"))))


def strata_counts(spark, sf_dir):
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("keys"))


def stratified_sample(spark, sf_dir):
    from annulus.operators.metrics import round_robin

    return round_robin(_strata(spark, sf_dir).select("key", "token", "stratum"), "stratum", ["token", "key"], 100)


def what_if_drop_member(spark, sf_dir):
    full = data.ring_of(spark, sf_dir, TARGET, VNODES)
    gone = full.agg(F.min("node_id").alias("gone"))
    left = full.join(F.broadcast(gone), full["node_id"] != gone["gone"]).drop("gone")
    placed = ring.ring_join(data.keys(spark, sf_dir), ring.derived_ranges(left, RF, TARGET - 1))
    return placed.groupBy("owner").agg(F.count("*").alias("owned_keys"))


def range_constituents(spark, sf_dir):
    after, before = _two(spark, sf_dir)
    return ring.constituents(before, after).drop("old_followers")


def coverage_violations(spark, sf_dir):
    """Ten members shrink to nine; every first follower is admitted where the range's end is even."""
    after, before = _two(spark, sf_dir)
    admitted = before.filter("end % 2 = 0").select("start", "end", F.get("followers", F.lit(0)).alias("node_id"))
    return ring.coverage_violations(before, after, admitted)


def arc_share(spark, sf_dir):
    return ring.arc_share(data.ranges_of(spark, sf_dir, TARGET, VNODES)).select("owner", "tokens", F.col("arc").cast("long").alias("arc"), F.round("share", 9).alias("share"))


def probe_targets(spark, sf_dir):
    return ring.probe_targets(data.members(spark, sf_dir))


def members_changed(spark, sf_dir):
    old = data.members(spark, sf_dir, BASE)
    new = data.members(spark, sf_dir, 12).subtract(data.members(spark, sf_dir, 2))
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def victim_candidate(spark, sf_dir):
    """The first member, from the fifth on in a circle, that owns at least LEAST_OWNED keys."""
    counts = ring_owned_keys(spark, sf_dir)
    every = W.partitionBy()
    return (
        counts.withColumn("i", F.row_number().over(W.orderBy("node_id")) - 1)
        .withColumn("turn", F.pmod(F.col("i") - 4, F.count("*").over(every)))
        .filter(F.col("owned_keys") >= LEAST_OWNED)
        .orderBy("turn")
        .limit(1)
        .select("node_id", "owned_keys")
    )


def _ring_sql(name: str, n: int, vnodes: int, where: str = "true") -> str:
    """CTEs: {name}_ring, {name}_pos, {name}_ranges with followers and reps."""
    return f"""
{name}_ring AS (
  SELECT ('0x' || substr(md5(n_name || '#' || v), 1, 15))::BIGINT AS token, n_name AS node_id, v::INT AS vnode
  FROM nation, generate_series(0, {vnodes - 1}) g(v) WHERE n_nationkey < {n} AND {where}),
{name}_pos AS (SELECT *, row_number() OVER (ORDER BY token, node_id) AS i, count(*) OVER () AS n FROM {name}_ring),
{name}_near AS (
  SELECT p.i, p.token, t.node_id, min((t.i - p.i + p.n) % p.n) AS d FROM {name}_pos p, {name}_pos t GROUP BY ALL),
{name}_reps AS (
  SELECT token, list(node_id ORDER BY d) AS reps
  FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM {name}_near) WHERE r <= {RF} GROUP BY token),
{name}_ranges AS (
  SELECT coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ()) AS start, token AS "end", reps[1] AS owner, reps[2:] AS followers, reps
  FROM {name}_reps)"""


def _keys_sql() -> str:
    return "keys AS (SELECT 'order:' || o_orderkey AS key, ('0x' || substr(md5('order:' || o_orderkey), 1, 15))::BIGINT AS token FROM orders)"


def _place_sql(name: str, keys: str = "keys") -> str:
    """{name}_placed: keys with owner and reps, by an as-of join that wraps."""
    return f"""
{name}_first AS (SELECT owner, reps FROM {name}_ranges ORDER BY "end" LIMIT 1),
{name}_placed AS (
  SELECT k.*, coalesce(r.owner, f.owner) AS owner, coalesce(r.reps, f.reps) AS reps
  FROM {keys} k ASOF LEFT JOIN {name}_ranges r ON k.token <= r."end" CROSS JOIN {name}_first f)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def oracle_sql():
    t, b, keys = _ring_sql("t", TARGET, VNODES), _ring_sql("b", BASE, VNODES), _keys_sql()
    owned = _with(t, keys, _place_sql("t"), select="SELECT n_name AS node_id, count(key) AS owned_keys FROM nation LEFT JOIN t_placed ON owner = n_name WHERE {} GROUP BY 1")
    stats = "count(*) AS nodes, sum(owned_keys)::BIGINT AS total"
    cuts = """cuts AS (SELECT coalesce(lag("end") OVER (ORDER BY "end"), max("end") OVER ()) AS start, "end", "end" AS token FROM (SELECT "end" FROM b_ranges UNION SELECT "end" FROM t_ranges))"""
    segs = (t, b, cuts, _place_sql("b", "cuts"), _place_sql("t", "cuts"), """segs AS (SELECT x.start, x."end", x.owner AS ob, x.reps AS rb, y.owner AS oa, y.reps AS ra FROM b_placed x JOIN t_placed y USING ("end"))""")
    both = (t, b, keys, _place_sql("b"), _place_sql("t"), "two AS (SELECT key, token, x.owner AS ob, x.reps AS rb, y.owner AS oa, y.reps AS ra FROM b_placed x JOIN t_placed y USING (key, token))")
    strata = f"""strata AS (SELECT key, token, CASE WHEN list_has_any(ra, (SELECT list(n_name) FROM nation WHERE n_nationkey >= {BASE} AND n_nationkey < {TARGET})) THEN 'new_target'
      WHEN ob <> oa THEN 'owner_changed' WHEN list_sort(rb) <> list_sort(ra) THEN 'replicas_changed' ELSE 'unchanged' END AS stratum FROM two)"""
    cons = (t, b, """olds AS (SELECT start AS old_start, "end" AS old_end, owner AS old_owner, followers AS old_followers, "end" AS token FROM t_ranges)""", """b_first2 AS (SELECT start, "end", owner FROM b_ranges ORDER BY "end" LIMIT 1)""", """cons AS (SELECT coalesce(r.start, f.start) AS start, coalesce(r."end", f."end") AS "end", coalesce(r.owner, f.owner) AS owner, old_start, old_end, old_owner, old_followers FROM olds ASOF LEFT JOIN b_ranges r ON olds.token <= r."end" CROSS JOIN b_first2 f)""")
    by_v = ", ".join([keys, *[x for v in (1, 8, 64) for x in (_ring_sql(f"v{v}", TARGET, v), _place_sql(f"v{v}"))], *[f"c{v} AS (SELECT n_name, count(key) AS c FROM nation LEFT JOIN v{v}_placed ON owner = n_name WHERE n_nationkey < {TARGET} GROUP BY 1)" for v in (1, 8, 64)]])
    return {
        "ring_tokens": f"WITH {t} SELECT token, node_id, vnode FROM t_ring",
        "derived_ranges": f"WITH {t} SELECT start, \"end\", owner, array_to_string(followers, '|') AS followers FROM t_ranges",
        "key_owner": _with(t, keys, _place_sql("t"), select="SELECT key, token, owner FROM t_placed"),
        "key_replicas": _with(t, keys, _place_sql("t"), select="SELECT key, array_to_string(reps, '|') AS replicas FROM t_placed"),
        "ring_owned_keys": owned.format("true"),
        "key_balance": f"""SELECT {stats}, round(CASE WHEN max(owned_keys) = 0 THEN 1.0 WHEN min(owned_keys) = 0 THEN 'inf'::DOUBLE ELSE max(owned_keys)::DOUBLE / min(owned_keys) END, 6) AS max_over_min,
            round((max(owned_keys) - min(owned_keys)) / avg(owned_keys), 6) AS spread, round(max(owned_keys) / avg(owned_keys), 6) AS max_over_mean,
            round(max(owned_keys) / avg(owned_keys) - 1, 6) AS excess, round(stddev_pop(owned_keys) / avg(owned_keys), 6) AS cv FROM ({owned.format(f"n_nationkey < {TARGET}")})""",
        "subset_balance": f"SELECT {stats}, round(stddev_pop(owned_keys) / avg(owned_keys), 6) AS cv FROM ({owned.format('n_nationkey < 5')})",
        "balance_vs_vnodes": f"WITH {by_v} " + " UNION ALL ".join(f"SELECT {v} AS vnodes, round(max(c) / avg(c), 6) AS max_over_mean, round(stddev_pop(c) / avg(c), 6) AS cv FROM c{v}" for v in (1, 8, 64)),
        "topology_delta": _with(*segs, select='SELECT start, "end", ob AS source, oa AS destination FROM segs WHERE ob <> oa'),
        "obligations": _with(*segs, select='SELECT start, "end", owner, follower FROM (SELECT start, "end", oa AS owner, rb, unnest(ra[2:]) AS follower FROM segs) WHERE NOT list_contains(rb, follower)'),
        "ring_segments": _with(*segs, select='SELECT start, "end", ob AS owner_before, oa AS owner_after, ob <> oa AS owner_changed, rb <> ra AS replicas_changed FROM segs'),
        "moved_keys": _with(*both, select="SELECT count(*) AS keys, count(*) FILTER (ob <> oa) AS moved, round(count(*) FILTER (ob <> oa) / count(*), 6) AS migration_rate FROM two"),
        "strata_counts": _with(*both, strata, select="SELECT stratum, count(*) AS keys FROM strata GROUP BY 1"),
        "stratified_sample": _with(*both, strata, select="SELECT key, token, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY token, key) AS turn FROM strata) ORDER BY turn, stratum LIMIT 100"),
        "what_if_drop_member": _with(_ring_sql("t", TARGET, VNODES, f"n_name <> (SELECT min(n_name) FROM nation WHERE n_nationkey < {TARGET})"), keys, _place_sql("t"), select="SELECT owner, count(*) AS owned_keys FROM t_placed GROUP BY 1"),
        "range_constituents": _with(*cons, select='SELECT start, "end", owner, old_start, old_end, old_owner FROM cons'),
        "coverage_violations": _with(*cons, select='SELECT start, "end", owner, old_start, old_end, old_owner FROM cons WHERE NOT coalesce(owner = old_owner OR (owner = old_followers[1] AND old_end % 2 = 0), false)'),
        "arc_share": _with(t, select='SELECT owner, count(*) AS tokens, sum(CASE WHEN start = "end" THEN 1152921504606846976 ELSE ("end" - start + 1152921504606846976) % 1152921504606846976 END)::BIGINT AS arc, round(sum(CASE WHEN start = "end" THEN 1152921504606846976 ELSE ("end" - start + 1152921504606846976) % 1152921504606846976 END)::DOUBLE / 1152921504606846976, 9) AS share FROM t_ranges GROUP BY 1'),
        "probe_targets": "WITH m AS (SELECT n_name AS node_id, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT DISTINCT a.node_id, b.node_id AS target FROM m a JOIN m b ON (b.i - a.i + a.n) % a.n IN (1, 2, a.n - 1, a.n - 2) AND a.node_id <> b.node_id",
        "members_changed": f"WITH o AS (SELECT n_name AS node_id FROM nation WHERE n_nationkey < {BASE}), n AS (SELECT n_name AS node_id FROM nation WHERE n_nationkey BETWEEN 2 AND 11) SELECT node_id, 'added' AS change FROM (FROM n EXCEPT FROM o) UNION ALL SELECT node_id, 'removed' FROM (FROM o EXCEPT FROM n)",
        "victim_candidate": f"SELECT node_id, owned_keys FROM (SELECT *, (row_number() OVER (ORDER BY node_id) - 1 - 4 + 25) % 25 AS turn FROM ({owned.format('true')})) WHERE owned_keys >= {LEAST_OWNED} ORDER BY turn LIMIT 1",
    }


def queries():
    return {f.__name__: f for f in (ring_tokens, derived_ranges, key_owner, key_replicas, ring_owned_keys, key_balance, subset_balance, balance_vs_vnodes, topology_delta, obligations, ring_segments, moved_keys, strata_counts, stratified_sample, what_if_drop_member, range_constituents, coverage_violations, arc_share, probe_targets, members_changed, victim_candidate)}
