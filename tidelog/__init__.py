"""A versioned mutation-log engine on Spark.

Every put, expiring put, delete, range delete and batch is a row of a log; reads, snapshots, compaction, merges and
transactions are DataFrame operators over that log.
"""
