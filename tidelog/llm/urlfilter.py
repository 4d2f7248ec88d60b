"""URL filters: a temporal join of captures with dated block-list and allow-list entries.

List entries (key, day, action: 'block', 'allow' or 'remove') become validity intervals: an entry holds from its day until
the day of the next entry of its key. A key is a host name, and covers the host and all its subdomains. Each capture is
evaluated against the entries active at its fetch day; the entry of the longest key decides, and where none is active the
capture is kept.

The as-of join puts the captures of a key and the beginnings of its intervals in one order by day, where each capture takes the last
beginning before it: one window, no pairs. The order is cut by months, so that a key is many groups: an interval has
a beginning in its first month and one at the start of each later month that it reaches into, up to the last fetch day. Keys
with many captures are dealt to several groups besides, each with all beginnings of the key. Days are whole, and entries of one
key and day are resolved before, so a group never has more beginnings than a month has days, however many entries there are.

There is no cross join and no broadcast but of the bounded list of hot keys, and of the listed keys while they are at most
``BROADCAST_ROWS``. Only DataFrame functions are used.

Defined results: captures without a URL, a host or a fetch day match nothing and are kept; rows that repeat are evaluated
each for itself; of entries of one key and day 'remove' yields to 'allow', and 'allow' to 'block'; entries with a null key,
day or action are ignored; the captures' columns stay, and an added column whose name is taken gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, hot_keys, materialize

FOREVER = "9999-12-31"
#: Groups to which the captures of a hot key are dealt.
SALTS = 16
ADDED = ("host", "verdict", "rule", "rule_since")


def host_of(url: Column) -> Column:
    """Host name in lower case without user, port, path, query and fragment; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): until is exclusive. 'remove' entries only end what was before."""
    rank = {"block": 2, "allow": 1, "remove": 0}
    known = entries.where(F.col("action").isin(*rank) & F.col("key").isNotNull() & F.col("day").isNotNull())
    order = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    daily = known.groupBy(F.lower("key").alias("key"), "day").agg(F.max(order).alias("rank"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    out = daily.withColumn("until", F.coalesce(until, F.lit(FOREVER).cast("date"))).where("rank > 0")
    return out.select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), F.col("day").alias("since"), "until")


def as_of(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """captures (id, key, day), listed (key, action, since, until): (id, key, action, since) of the interval active at each capture's day, if any."""
    first, last = captures.agg(F.min("day"), F.max("day")).first()
    hot = F.broadcast(hot_keys(captures, ["key"], captures.count()).withColumn("hot", F.lit(True)))
    month = lambda day: F.trunc(day, "month")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0))
    none = F.lit(None).cast("struct<action: string, since: date, until: date>")
    at = captures.join(hot, "key", "left").select("key", month("day").alias("month"), salt.cast("int").alias("salt"), "day", F.lit(1).alias("late"), "id", none.alias("e"))
    # an interval's beginnings: its own day, and the first days of the later months that it reaches into and that have captures at all
    low = F.greatest(month("since"), F.lit(first).cast("date") if first is None else month(F.lit(first)))
    high = F.least(F.date_sub("until", 1), F.lit(last).cast("date"))
    parts = listed.where(F.col("since") <= F.lit(last).cast("date")).where(low <= high).withColumn("month", F.explode(F.sequence(low, month(high), F.expr("interval 1 month"))))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    e = F.struct("action", "since", "until")
    parts = parts.join(hot, "key", "left").withColumn("salt", salts).select("key", "month", "salt", F.greatest("since", "month").alias("day"), F.lit(0).alias("late"), F.lit(None).cast("long").alias("id"), e.alias("e"))
    order = Window.partitionBy("key", "month", "salt").orderBy("day", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = at.unionByName(parts).withColumn("e", F.last("e", ignorenulls=True).over(order)).where("late = 1 and e is not null and day < e.until")
    return joined.select("id", "key", "e.action", "e.since")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetch_day, anything else): add host, verdict ('block' or 'keep'), rule (the deciding key) and rule_since, by names that are free."""
    own, taken = [F.col(f"`{c}`") for c in captures.columns], captures.columns
    host, verdict, rule, since = fresh(taken, *ADDED)
    row, best_, id_ = fresh([*taken, host, verdict, rule, since], "_row", "_best", "_id")
    # written, so that a row has the same number in both its uses
    rows = materialize(captures.select(*own, host_of(F.col("url")).alias(host), F.monotonically_increasing_id().alias(row)), "captures")
    suffixes = F.expr("transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.'))")
    keyed = rows.where(F.col(host).isNotNull() & F.col("fetch_day").isNotNull()).select(F.col(row).alias("id"), F.col("fetch_day").alias("day"), F.split(host, r"\.").alias("l"))
    keyed = keyed.select("id", "day", F.explode(suffixes).alias("key")).where(F.col("key").contains("."))  # a top-level name can't be listed
    listed = intervals(entries).where(F.col("key").contains("."))
    keys = materialize(listed.select("key").distinct(), "keys")
    keyed = keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key", "left_semi")
    matched = as_of(materialize(keyed, "keyed"), listed)
    best = matched.groupBy(F.col("id").alias(id_)).agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "since")).alias(best_))
    out = rows.join(best, F.col(row) == F.col(id_), "left")
    blocked = F.when(F.col(f"{best_}.action") == "block", "block").otherwise("keep")
    return out.select(*own, host, blocked.alias(verdict), F.col(f"{best_}.key").alias(rule), F.col(f"{best_}.since").alias(since))


# The tables have no fetch days and no lists. These rules derive both from urls, the same in Spark and in SQL.


def _byte(col: str, at: int) -> str:
    return f"cast(conv(substring(md5({col}), {at}, 2), 16, 10) as int)"


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url, fetch_day: a day of the two years from 2022, by a hash of the url."""
    day = F.expr(f"date_add(date '2022-01-01', ({_byte('url', 1)} * 256 + {_byte('url', 3)}) % 730)")
    return pages.select("page_id", "url", day.alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Three dated entries for about a third of all hosts and half of their parents: blocked, then allowed or removed, then blocked again."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    parent = host.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("host")).where("host like '%.%.%'").distinct()
    both = host.where(f"{_byte('host', 1)} % 3 = 0").union(parent.where(f"{_byte('host', 1)} % 2 = 0")).distinct()
    first = f"{_byte('host', 3)}"
    step = f"1 + {_byte('host', 5)}"
    entry = lambda k, action: f"struct(host as key, date_add(date '2022-01-01', {first} + {k} * ({step})) as day, {action} as action)"
    middle = f"if({_byte('host', 7)} % 2 = 0, 'allow', 'remove')"
    return both.select(F.explode(F.expr(f"array({entry(0, chr(39) + 'block' + chr(39))}, {entry(1, middle)}, {entry(2, chr(39) + 'block' + chr(39))})")).alias("e")).select("e.*")


def filter_pages(pages: DataFrame) -> DataFrame:
    out = evaluate(captures_of(pages), entries_of(pages))
    return out.select("page_id", "url", "host", F.col("fetch_day").cast("string").alias("fetch_day"), "verdict", "rule", F.col("rule_since").cast("string").alias("rule_since"))


FILTER_SQL = r"""
WITH c AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    CAST(DATE '2022-01-01' + CAST((CAST('0x' || substring(md5(url), 1, 2) AS INTEGER) * 256 + CAST('0x' || substring(md5(url), 3, 2) AS INTEGER)) % 730 AS INTEGER) AS DATE) AS fetch_day FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
p AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') AS host FROM h),
b AS (SELECT host FROM h WHERE CAST('0x' || substring(md5(host), 1, 2) AS INTEGER) % 3 = 0
      UNION SELECT host FROM p WHERE host LIKE '%.%.%' AND CAST('0x' || substring(md5(host), 1, 2) AS INTEGER) % 2 = 0),
e AS (SELECT host AS key, k, CAST(DATE '2022-01-01' + CAST(CAST('0x' || substring(md5(host), 3, 2) AS INTEGER) + k * (1 + CAST('0x' || substring(md5(host), 5, 2) AS INTEGER)) AS INTEGER) AS DATE) AS since,
    CASE WHEN k <> 1 THEN 'block' WHEN CAST('0x' || substring(md5(host), 7, 2) AS INTEGER) % 2 = 0 THEN 'allow' ELSE 'remove' END AS action FROM b, (SELECT unnest([0, 1, 2]) AS k)),
i AS (SELECT key, action, since, coalesce(lead(since) OVER (PARTITION BY key ORDER BY since), DATE '9999-12-31') AS until FROM e),
m AS (SELECT c.page_id, c.url, i.key, i.action, i.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.key) DESC) AS r
      FROM c JOIN i ON (c.host = i.key OR c.host LIKE '%.' || i.key) AND i.since <= c.fetch_day AND c.fetch_day < i.until WHERE i.action <> 'remove')
SELECT c.page_id, c.url, c.host, CAST(c.fetch_day AS VARCHAR) AS fetch_day, CASE WHEN m.action = 'block' THEN 'block' ELSE 'keep' END AS verdict,
  m.key AS rule, CAST(m.since AS VARCHAR) AS rule_since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""
