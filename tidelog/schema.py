"""Schemas of the log and of what surrounds it.

A sequence number is a 64-bit signed integer; ``LATEST`` stands for "no bound". ``expires_at`` is Unix time in
milliseconds, 0 for never. ``ord`` breaks ties between rows of one batch, which share a sequence number.
"""

LATEST = (1 << 63) - 1
LOG = "cf string, key string, seq long, ord int, op string, value string, expires_at long"
RANGE_DEL = "cf string, lo string, hi string, seq long"
STATE = "cf string, key string, seq long, value string"
MANIFEST = "batch_id long, cf string, level int, filename string, action string"
SNAPSHOTS = "snapshot_id string, seq long"
DEFAULT_CF = "default"
