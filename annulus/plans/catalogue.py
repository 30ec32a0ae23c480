"""All queries by name, each with the SQL that checks it."""

from __future__ import annotations

from annulus.plans import changes, cluster, keyspace, loads, measurement, placement, stages

PARTS = (placement, keyspace, measurement, changes, cluster, stages, loads)


def queries():
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
