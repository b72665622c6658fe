"""Tidemark: versioned key/value tables on Spark.

Records are rows ``(k, v, lsn, xmin, xmax)``, a snapshot is a predicate over them and a small
status table, and redo, vacuum and conflict rules are joins and aggregates.
"""
