"""Queries on the state of a cluster: leases, failures, admissions, repairs, write admission, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from annulus.operators import cluster
from annulus.plans import placement
from annulus.sources import clusters as state
from annulus.sources import datasets as data
from annulus.sources.clusters import EPOCH, FRESHNESS, GROWN, GUARD, LEASE, MEMBERS, NOW, RF, VNODES

POLICIES = (cluster.OWNER_ONLY, cluster.FIRST_SUCCESSOR, cluster.ALL_REPLICAS)


def lease_liveness(spark, sf_dir):
    return state.live(spark, sf_dir)


def known_nodes(spark, sf_dir):
    """Members, registered and fenced nodes, and the members of a target."""
    return cluster.known_nodes(data.members(spark, sf_dir, MEMBERS), state.instances(spark, sf_dir), state.fenced(spark, sf_dir), data.members(spark, sf_dir, GROWN))


def failure_quorum(spark, sf_dir):
    return cluster.failures_confirmed(data.members(spark, sf_dir, 12), state.live(spark, sf_dir), state.reports(spark, sf_dir), NOW, LEASE, FRESHNESS)


def follower_status(spark, sf_dir):
    return state.followers(spark, sf_dir)


def _status(spark, sf_dir, *policies, **more):
    """The status of every range under each policy, from one reading of the state."""
    own = state.ranges(spark, sf_dir)
    rows = (own, state.followers(spark, sf_dir, own), *(f(spark, sf_dir) for f in (state.live, state.instances, state.fenced)))
    out = None
    for policy in policies:
        one = cluster.replica_status(*rows, policy, RF, GUARD, **more).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


def replica_status(spark, sf_dir):
    """The status of every range under each acknowledgement policy."""
    return _status(spark, sf_dir, *POLICIES)


def write_fence(spark, sf_dir):
    """Ranges whose writes a cut-over to one more member may stop."""
    from annulus.operators import ring

    moving = ring.topology_delta(state.ranges(spark, sf_dir), state.ranges(spark, sf_dir, GROWN))
    status = _status(spark, sf_dir, cluster.OWNER_ONLY, cut_over=moving)
    return status.filter(F.col("write_block_reason").startswith("topology cutover")).select("start", "end", "owner")


def policy_readiness(spark, sf_dir):
    """Ranges by whether each policy may be taken up."""
    own, out = state.ranges(spark, sf_dir), None
    followers = state.followers(spark, sf_dir, own)
    for policy in POLICIES:
        one = cluster.policy_ready(own, followers, policy, RF, GUARD).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


def required_followers(spark, sf_dir):
    """For every key, whom a write waits for, under the policy of the first successor."""
    own = state.ranges(spark, sf_dir)
    found = cluster.required_followers(data.keys(spark, sf_dir), own, state.followers(spark, sf_dir, own), cluster.FIRST_SUCCESSOR, RF, GUARD)
    return found.select("key", F.array_join("required", "|").alias("required"), "error")


def reconcile_repairs(spark, sf_dir):
    own = state.ranges(spark, sf_dir)
    return cluster.reconciled(own, state.instances(spark, sf_dir), state.admissions(spark, sf_dir, own), state.repairs(spark, sf_dir, own), EPOCH)


def missing_streams(spark, sf_dir):
    """Streams that a change from ten members to nine needs, and that aren't there."""
    own = state.ranges(spark, sf_dir)
    return cluster.missing_streams(own, state.ranges(spark, sf_dir, MEMBERS - 1), state.admissions(spark, sf_dir, own), 1)


def consistency_rules(spark, sf_dir):
    """Violations of each rule of a state."""
    own = state.ranges(spark, sf_dir)
    rows = (state.instances(spark, sf_dir), state.fenced(spark, sf_dir), state.admissions(spark, sf_dir, own), state.repairs(spark, sf_dir, own))
    return cluster.state_violations(own, *rows, EPOCH).groupBy("rule").agg(F.count("*").alias("violations"))


def status_of_keys(spark, sf_dir):
    """Status of the ranges that hold the keys of urgent orders."""
    keys = _urgent(spark, sf_dir)
    return cluster.status_of_keys(keys, _status(spark, sf_dir, cluster.FIRST_SUCCESSOR)).select("start", "end", "owner", "live_rf", "writable")


def _urgent(spark, sf_dir):
    from annulus.functions.tokens import portable_token

    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    return data.read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(key.alias("key"), portable_token(key).alias("token"))


def cohort_stats(spark, sf_dir):
    return cluster.cohort_stats(cluster.status_of_keys(_urgent(spark, sf_dir), _status(spark, sf_dir, cluster.FIRST_SUCCESSOR)))


def block_reasons(spark, sf_dir):
    return cluster.block_reasons(cluster.status_of_keys(_urgent(spark, sf_dir), _status(spark, sf_dir, cluster.FIRST_SUCCESSOR)))


def victim_selection(spark, sf_dir):
    """Whom rounds 1 to 3 kill, as owner and as follower of a tenth of all keys at least; earlier victims aren't live."""
    from annulus.operators import ring

    placed = ring.ring_join(data.keys(spark, sf_dir), state.ranges(spark, sf_dir))
    least = placed.count() // 10
    out = None
    for role in ("owner", "follower"):
        killed = data.members(spark, sf_dir, 0)
        for turn in range(3):
            one = cluster.victim(data.members(spark, sf_dir, MEMBERS), killed, placed, turn % (MEMBERS - turn), least, role)
            killed = killed.unionByName(one.select("node_id"))
            row = one.select(F.lit(role).alias("role"), F.lit(turn + 1).alias("round"), "node_id", "keys")
            out = row if out is None else out.unionByName(row)
    return out


def topology_validation(spark, sf_dir):
    """Rows by which a recorded ring (here with one token moved) differs from the one computed anew."""
    own = data.ring_of(spark, sf_dir, 5, VNODES)
    moved = (F.col("node_id") == "NATION_3") & (F.col("vnode") == 3)
    return cluster.ring_differences(own.withColumn("token", F.when(moved, F.col("token") + 1).otherwise(F.col("token"))), own)


def topology_read(spark, sf_dir):
    return cluster.topology_view(state.ranges(spark, sf_dir), EPOCH)


def change_descent(spark, sf_dir):
    """Changes (here orders, by status and number) that descend from the committed topology."""
    o = data.read(spark, sf_dir, "orders")
    phase = F.when(F.col("o_orderstatus") == "F", "Published").when(F.col("o_orderstatus") == "O", "Copying").otherwise("Verifying")
    base, target = F.col("o_orderkey") % 3 + EPOCH - 2, F.col("o_orderkey") % 4 + EPOCH - 1
    ok = cluster.change_state(base, target, F.lit(EPOCH), phase)
    return o.groupBy(phase.alias("phase"), ok.alias("descends")).agg(F.count("*").alias("n"))


def _state_sql() -> tuple[str, ...]:
    """The tables of annulus.sources.clusters as CTEs."""
    draw = lambda what, *names: f"('0x' || substr(md5('{what}'" + "".join(f" || ':' || {n}" for n in names) + "), 1, 15))::BIGINT"
    return (
        placement._ring_sql("r", MEMBERS, VNODES),
        "nodes AS (SELECT n_name AS node_id, n_nationkey AS nr FROM nation WHERE n_nationkey < 12)",
        "instances AS (SELECT node_id, 'p' || nr AS instance FROM nodes WHERE nr <> 8)",
        "fenced AS (SELECT node_id FROM nodes WHERE nr = 5)",
        f"""grants AS (
  SELECT node_id, CASE WHEN nr = 6 THEN {EPOCH - 1} ELSE {EPOCH} END AS epoch, CASE WHEN nr = 3 THEN 'old' ELSE 'p' || nr END AS instance,
         {NOW} + CASE WHEN nr = 0 THEN -1 ELSE nr * 100 + 1 END AS expires_at FROM nodes)""",
        f"live AS (SELECT node_id FROM grants JOIN instances USING (node_id, instance) WHERE epoch = {EPOCH} AND expires_at > {NOW} AND node_id NOT IN (FROM fenced))",
        """tasks AS (SELECT start, "end", owner, unnest(followers) AS node_id, generate_subscripts(followers, 1) - 1 AS pos FROM r_ranges)""",
        f"""made AS (
  SELECT start, "end", owner, node_id, CASE WHEN h % 41 = 1 THEN {EPOCH - 1} ELSE {EPOCH} END AS epoch, CASE WHEN h % 7 = 1 THEN 'gone' ELSE 'p' || nr END AS instance,
         CASE WHEN h % 43 = 2 THEN '' ELSE 'd' END AS digest, h % 1000 AS cursor
  FROM (SELECT *, {draw("a", '"end"', "node_id")} AS h FROM tasks JOIN nodes USING (node_id)) WHERE h % 6 <> 0)""",
        f"admissions AS (FROM made UNION ALL SELECT * FROM made WHERE {draw('a2', chr(34) + 'end' + chr(34), 'node_id')} % 60 = 0)",
        f"""repairs AS (
  SELECT start, "end", owner, node_id, CASE WHEN h % 47 = 3 THEN {EPOCH - 1} ELSE {EPOCH} END AS epoch,
         CASE WHEN h % 8 < 5 THEN 'Complete' WHEN h % 8 < 7 THEN 'Pending' ELSE 'Copying' END AS phase
  FROM (SELECT *, {draw("r", '"end"', "node_id")} AS h FROM tasks) WHERE h % 8 <> 0
  UNION ALL SELECT start, "end", owner, owner, {EPOCH}, 'Pending' FROM r_ranges WHERE {draw("s", '"end"')} % 10 = 0)""",
        f"""progress AS (
  SELECT owner, node_id, 1000 AS head, 1000 - CASE WHEN h % 9 = 0 THEN 5 ELSE 0 END AS cursor, h % 800 AS lag
  FROM (SELECT DISTINCT owner, node_id, {draw("p", "owner", "node_id")} AS h FROM tasks) WHERE h % 11 <> 0)""",
        """held AS (SELECT DISTINCT a.* FROM admissions a JOIN instances USING (node_id, instance) WHERE node_id NOT IN (FROM fenced))""",
        f"""fstat AS (
  SELECT t.start, t."end", t.owner, t.node_id, t.pos, a.instance IS NOT NULL AS admitted, l.node_id IS NOT NULL AS leased, p.lag IS NOT NULL AS lag_known,
         coalesce(p.lag, 0) AS lag_millis, coalesce(p.head, 0) AS stream_head, coalesce(p.cursor, a.cursor, 0) AS stream_cursor, coalesce(r.phase, '') AS repair_state,
         a.instance IS NOT NULL AND l.node_id IS NOT NULL AND coalesce(p.lag <= {GUARD.max_replica_lag_millis}, false) AS healthy
  FROM tasks t LEFT JOIN held a USING (start, "end", owner, node_id) LEFT JOIN repairs r USING (start, "end", owner, node_id)
  LEFT JOIN progress p ON p.owner = t.owner AND p.node_id = t.node_id LEFT JOIN live l ON l.node_id = t.node_id)""",
    )


def _status_sql(policy: str) -> str:
    need = {cluster.OWNER_ONLY: "false", cluster.FIRST_SUCCESSOR: "pos = 0", cluster.ALL_REPLICAS: "true"}[policy]
    return f"""(
  SELECT start, "end", owner, {RF} AS desired_rf, admitted + registered::INT AS current_rf, alive + leased::INT AS live_rf, admitted, healthy, leased AS owner_leased,
         write_block_reason = '' AS writable, write_block_reason, alive + leased::INT < {RF} AS under_replicated, repairing
  FROM (
    SELECT *, CASE WHEN NOT leased THEN 'owner lease unavailable'
                   WHEN '{policy}' = 'first_successor' AND n = 0 THEN 'first successor is not in desired placement'
                   WHEN '{policy}' = 'all_replicas' AND n + 1 < {RF} THEN 'complete desired replication factor is unavailable'
                   WHEN admitted + 1 < {GUARD.minimum_admitted_copies} OR healthy < {GUARD.minimum_healthy_followers} THEN 'minimum admitted-copy or healthy-follower guard is not satisfied'
                   WHEN missing IS NOT NULL THEN 'required follower ' || missing || ' is not healthy and admitted' ELSE '' END AS write_block_reason
    FROM (
      SELECT start, "end", owner, count(*) AS n, count(*) FILTER (admitted) AS admitted, count(*) FILTER (healthy) AS healthy, count(*) FILTER (admitted AND leased) AS alive,
             bool_or(NOT admitted OR repair_state <> 'Complete') AS repairing, arg_min(node_id, pos) FILTER (({need}) AND NOT healthy) AS missing,
             owner IN (FROM live) AS leased, owner IN (SELECT node_id FROM instances) AND owner NOT IN (FROM fenced) AS registered
      FROM fstat GROUP BY start, "end", owner)))"""


def oracle_sql():
    own = _state_sql()
    sql = lambda select, *more: placement._with(*own, *more, select=select)
    lag = GUARD.max_replica_lag_millis
    urgent = "urgent AS (SELECT ('0x' || substr(md5('order:' || o_orderkey), 1, 15))::BIGINT AS token FROM orders WHERE o_orderpriority = '1-URGENT')"
    held = "kept AS (SELECT DISTINCT coalesce(r.\"end\", (SELECT min(\"end\") FROM r_ranges)) AS \"end\" FROM urgent u ASOF LEFT JOIN r_ranges r ON u.token <= r.\"end\")"
    mine = f"mine AS (SELECT s.* FROM {_status_sql(cluster.FIRST_SUCCESSOR)} s JOIN kept USING (\"end\"))"
    good = f"admitted AND lag_known AND stream_cursor = stream_head AND lag_millis <= {lag}"
    ready = lambda policy, need: f"""SELECT start, "end", owner, bool_and(NOT admitted OR (lag_known AND stream_cursor = stream_head)) AND count(*) FILTER (admitted) + 1 >= {GUARD.minimum_admitted_copies} AND count(*) FILTER ({good}) >= {GUARD.minimum_healthy_followers}{f" AND count(*) + 1 >= {RF}" if policy == cluster.ALL_REPLICAS else ""} AND count(*) FILTER ({need} AND NOT ({good})) = 0 AS ready, '{policy}' AS policy FROM fstat GROUP BY 1, 2, 3"""
    key = 'start, "end", owner, node_id'
    old, new = _olds_sql()
    return {
        "lease_liveness": sql("FROM live"),
        "known_nodes": sql(f"SELECT n_name AS node_id FROM nation WHERE n_nationkey < {GROWN} UNION SELECT node_id FROM instances UNION FROM fenced"),
        "failure_quorum": sql(
            f"""SELECT node_id, node_id IN (FROM live) AS leased, coalesce(n, 0) AS reporters, node_id NOT IN (FROM live) OR coalesce(n, 0) >= 2 AS confirmed
FROM nodes LEFT JOIN (SELECT t, count(DISTINCT r) AS n FROM told WHERE t <> r AND first_seen + {LEASE} <= {NOW} AND last_seen + {FRESHNESS} >= {NOW} AND r IN (SELECT nr FROM nodes JOIN live USING (node_id)) GROUP BY 1) ON t = nr""",
            f"told AS (SELECT user_id % 12 AS t, event_id % 12 AS r, min({NOW} - 1 - event_id % 9000) AS first_seen, max({NOW} - 1 - event_id % 9000) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1, 2)",
        ),
        "follower_status": sql("FROM fstat"),
        "replica_status": sql(" UNION ALL ".join(f"SELECT *, '{p}' AS policy FROM {_status_sql(p)}" for p in POLICIES)),
        "write_fence": sql(
            """SELECT DISTINCT r.start, r."end", r.owner FROM r_ranges r, moving m
WHERE (r.start < r."end" AND m."end" > r.start AND m."end" <= r."end") OR (r.start > r."end" AND (m."end" > r.start OR m."end" <= r."end"))
   OR (m.start < m."end" AND r."end" > m.start AND r."end" <= m."end") OR (m.start > m."end" AND (r."end" > m.start OR r."end" <= m."end"))""",
            placement._ring_sql("g", GROWN, VNODES),
            """cuts AS (SELECT coalesce(lag("end") OVER (ORDER BY "end"), max("end") OVER ()) AS start, "end", "end" AS token FROM (SELECT "end" FROM r_ranges UNION SELECT "end" FROM g_ranges))""",
            placement._place_sql("r", "cuts"),
            placement._place_sql("g", "cuts"),
            """moving AS (SELECT x.start, x."end" FROM r_placed x JOIN g_placed y USING ("end") WHERE x.owner <> y.owner)""",
        ),
        "policy_readiness": sql(" UNION ALL ".join(ready(p, need) for p, need in zip(POLICIES, ("false", "pos = 0", "true"), strict=True))),
        "required_followers": sql(
            "SELECT key, CASE WHEN error IS NULL THEN coalesce(reps[2], '') END AS required, error FROM r_placed p JOIN ruled ON ruled.owner = p.owner AND ruled.\"end\" = p.at",
            f"""ruled AS (SELECT "end", owner, CASE WHEN count(*) FILTER (admitted) + 1 < {GUARD.minimum_admitted_copies} OR count(*) FILTER (admitted AND lag_known AND lag_millis <= {lag}) < {GUARD.minimum_healthy_followers}
  THEN 'minimum admitted-copy or healthy-follower guard is not satisfied'
  WHEN bool_or(pos = 0 AND NOT (admitted AND lag_known AND lag_millis <= {lag})) THEN 'required follower ' || arg_min(node_id, pos) || ' is not healthy and admitted' END AS error FROM fstat GROUP BY 1, 2)""",
            placement._keys_sql(),
            """r_placed AS (SELECT k.*, coalesce(r.owner, f.owner) AS owner, coalesce(r.reps, f.reps) AS reps, coalesce(r."end", f."end") AS at
  FROM keys k ASOF LEFT JOIN r_ranges r ON k.token <= r."end" CROSS JOIN (SELECT * FROM r_ranges ORDER BY "end" LIMIT 1) f)""",
        ),
        "reconcile_repairs": sql(
            f"""SELECT {key}, CASE action WHEN 'keep' THEN phase WHEN 'drop' THEN NULL ELSE 'Pending' END AS phase, action
FROM (SELECT {key}, r.phase, CASE WHEN t.pos IS NULL THEN 'drop' WHEN r.epoch IS DISTINCT FROM {EPOCH} THEN 'add' WHEN r.phase = 'Complete' AND a.n IS NULL THEN 'reset' ELSE 'keep' END AS action
  FROM tasks t FULL JOIN repairs r USING ({key})
  LEFT JOIN (SELECT {key}, count(*) AS n FROM admissions JOIN instances USING (node_id, instance) WHERE epoch = {EPOCH} GROUP BY ALL) a USING ({key}))"""
        ),
        "missing_streams": sql(
            """SELECT DISTINCT old_owner AS source, taker AS destination FROM (SELECT c.*, unnest([owner] || followers[:1]) AS taker FROM cons c) x
WHERE taker <> old_owner AND NOT EXISTS (SELECT 1 FROM admissions a WHERE a.start = old_start AND a."end" = old_end AND a.owner = old_owner AND a.node_id = taker)""",
            old,
            new,
            """cons AS (SELECT coalesce(r.owner, f.owner) AS owner, coalesce(r.followers, f.followers) AS followers, old_start, old_end, old_owner
  FROM olds ASOF LEFT JOIN n_ranges r ON olds.token <= r."end" CROSS JOIN (SELECT * FROM n_ranges ORDER BY "end" LIMIT 1) f)""",
        ),
        "consistency_rules": sql(
            f"""SELECT * FROM (
SELECT 'admission of another epoch' AS rule, count(*) AS violations FROM admissions WHERE epoch <> {EPOCH}
UNION ALL SELECT 'admission without a digest', count(*) FROM admissions WHERE digest = ''
UNION ALL SELECT 'duplicate admission', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM admissions GROUP BY {key} HAVING count(*) > 1)
UNION ALL SELECT 'repair of another epoch', count(*) FROM repairs WHERE epoch <> {EPOCH}
UNION ALL SELECT 'repair of no desired replica', count(*) FROM repairs WHERE ({key}) NOT IN (SELECT ({key}) FROM tasks)
UNION ALL SELECT 'complete repair without admission', count(*) FROM repairs WHERE phase = 'Complete' AND ({key}) NOT IN (SELECT ({key}) FROM admissions)) WHERE violations > 0"""
        ),
        "status_of_keys": sql('SELECT start, "end", owner, live_rf, writable FROM mine', urgent, held, mine),
        "cohort_stats": sql("SELECT min(live_rf) AS least_live_rf, count(*) FILTER (under_replicated) AS under_replicated, count(*) FILTER (NOT writable) AS not_writable FROM mine", urgent, held, mine),
        "block_reasons": sql("SELECT write_block_reason AS reason, count(*) AS ranges FROM mine WHERE NOT writable GROUP BY 1", urgent, held, mine),
        "victim_selection": sql(
            _victims_sql(),
            placement._keys_sql(),
            placement._place_sql("r"),
            "least AS (SELECT count(*) // 10 AS least FROM keys)",
            f"counts AS (SELECT 'owner' AS role, owner AS node_id, count(*) AS keys FROM r_placed GROUP BY ALL UNION ALL SELECT 'follower', f, count(*) FROM (SELECT unnest(reps[2:]) AS f FROM r_placed) GROUP BY ALL)",
            *_victim_rounds(),
        ),
        "topology_validation": placement._with(placement._ring_sql("r", 5, VNODES), select="SELECT token, node_id, vnode, 'computed' AS side FROM r_ring WHERE node_id = 'NATION_3' AND vnode = 3 UNION ALL SELECT token + 1, node_id, vnode, 'recorded' FROM r_ring WHERE node_id = 'NATION_3' AND vnode = 3"),
        "topology_read": sql(f"SELECT {EPOCH} AS epoch, owner, count(*) AS ranges, array_to_string(list_sort(list_distinct(flatten(list(followers)))), '|') AS followers FROM r_ranges GROUP BY owner"),
        "change_descent": f"""SELECT phase, CASE WHEN phase = 'Published' THEN t = {EPOCH} AND b + 1 = {EPOCH} ELSE b = {EPOCH} AND t = {EPOCH} + 1 END AS descends, count(*) AS n
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'Copying' ELSE 'Verifying' END AS phase, o_orderkey % 3 + {EPOCH - 2} AS b, o_orderkey % 4 + {EPOCH - 1} AS t FROM orders) GROUP BY ALL""",
    }


def _olds_sql() -> tuple[str, str]:
    return """olds AS (SELECT start AS old_start, "end" AS old_end, owner AS old_owner, "end" AS token FROM r_ranges)""", placement._ring_sql("n", MEMBERS - 1, VNODES)


def _victim_rounds() -> list[str]:
    """For each role, three rounds: v_<role>_<round>, each without the victims before it."""
    out = []
    for role in ("owner", "follower"):
        for turn in range(3):
            gone = " ".join(f"AND n_name NOT IN (SELECT node_id FROM v_{role}_{t})" for t in range(turn))
            out.append(f"""v_{role}_{turn} AS (
  SELECT node_id, keys FROM (
    SELECT n_name AS node_id, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation WHERE n_nationkey < {MEMBERS} {gone})
  JOIN counts USING (node_id), least WHERE role = '{role}' AND keys >= least ORDER BY (i - {turn % (MEMBERS - turn)} + n) % n LIMIT 1)""")
    return out


def _victims_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{role}' AS role, {turn + 1} AS round, node_id, keys FROM v_{role}_{turn}" for role in ("owner", "follower") for turn in range(3))


def queries():
    return {name: globals()[name] for name in oracle_sql()}
