"""Ring analytics on Spark: placement, keyspace, mutation-log and measurement queries."""
