"""Named analytics over the records tables.

Common shape: facts are aggregated by their join key before they meet a
dimension.  Partial aggregation then collapses a hot student or course on the
map side, and a join shuffles one row per key instead of one per event.  No
join carries a broadcast hint; Spark broadcasts a side only after checking its
size against ``spark.sql.autoBroadcastJoinThreshold``.
"""
