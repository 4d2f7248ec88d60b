"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 13 consecutive words of an item; an
item of fewer words, but not none, is one window. Each document position is tried against a bit set of the hashes of the
windows' first words, of at most ``MOST_BITS`` bits, made in Spark and held by a scalar subquery; what passes is verified, as the
window's very words, against the broadcast set of windows. Only DataFrame functions are used; documents are never shuffled,
only their hits are.

The set is broadcast while it has at most ``MOST_GRAMS`` windows. A larger benchmark's windows are joined by shuffle, by 128 bits
of hashes of their words, and windows that many documents hold are salted. Either way every window is tried.

Defined results: null and empty texts have no words and no hits; rows that repeat count each for itself; an empty benchmark
leaves every document clean; items without words never occur; items without an id hit, and aren't counted or named as items.
Columns of the documents stay whatever their names: an added column whose name is taken gets underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, join_hot, materialize, text_of

WINDOW = 13
#: Words whose hash is tried first.
ANCHOR = 4
MOST_GRAMS = 100_000
MOST_BITS = 1 << 23
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(col: str = "text"):
    return F.array_remove(F.split(F.translate(text_of(col), UPPER, LOWER), BREAKS), "")


def grams_of(items: DataFrame) -> DataFrame:
    """One row per distinct window: its words joined by spaces (gram), n words, the hash of its first words, its items."""
    w = items.select("item_id", words_of().alias("w"))
    w = w.select("item_id", "w", F.expr(f"least(size(w), {WINDOW})").alias("n")).where("n > 0")
    w = w.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("g"))
    anchor = F.expr(f"xxhash64({', '.join(f'get(g, {k})' for k in range(ANCHOR))})")
    return w.select("item_id", "n", F.array_join("g", " ").alias("gram"), anchor.alias("anchor")).groupBy("gram", "n", "anchor").agg(F.collect_set("item_id").alias("items"))


def bit_set(anchors: DataFrame, bits: int):
    """The column ``anchor`` as an array of longs of so many bits: a scalar subquery, so that it is no part of the plan's text."""
    words = [0] * (bits // 64)
    found = anchors.select(F.expr(f"cast(shiftright(anchor & {bits - 1}L, 6) as int)").alias("at"), F.expr("shiftleft(1L, cast(anchor & 63 as int))").alias("bit"))
    for at, value in found.groupBy("at").agg(F.bit_or("bit")).collect():  # at most MOST_BITS / 64 rows
        words[at] = value
    return anchors.sparkSession.createDataFrame([(words,)], "bits array<long>").scalar()


def hits_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (row: anything that can be grouped by, text): row, n_words, and hits: array of (at, n, items)."""
    grams = grams_of(benchmark)
    sizes = {r["n"]: r["c"] for r in grams.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most WINDOW rows
    total = sum(sizes.values())
    small = total <= MOST_GRAMS
    w = docs.select("row", F.monotonically_increasing_id().alias("row_id"), words_of().alias("_w"))
    nothing = F.expr("cast(array() as array<struct<at: int, n: int, gram: string, k1: bigint, k2: bigint>>)")
    key = "array_join(slice(_w, i + 1, n), ' ')"
    key = f"{key} as gram, 0L as k1, 0L as k2" if small else f"cast(null as string) as gram, xxhash64({key}) as k1, xxhash64(1, {key}) as k2"
    found = [nothing]
    if total:
        gets = [f"get(_w, i + {k})" for k in range(ANCHOR)]
        bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (64 * total - 1).bit_length()))
        for length in sorted({min(n, ANCHOR) for n in sizes}):
            mine = [n for n in sizes if min(n, ANCHOR) == length]
            spans = f"filter(array({', '.join(map(str, mine))}), n -> i + n <= size(_w))"
            windows = f"transform(_at, i -> transform({spans}, n -> struct(i as at, n as n, {key})))"
            w = w.withColumn(f"_set{length}", bit_set(grams.where(F.expr(f"least(n, {ANCHOR}) = {length}")), bits))
            tested = f"(shiftright(get(_set{length}, cast(shiftright(h & {bits - 1}L, 6) as int)), cast(h & 63 as int)) & 1) = 1"
            hashes = f"slice(transform(_w, (x, i) -> xxhash64(x{''.join(', ' + g for g in gets[1:length])})), 1, greatest(size(_w) - {length - 1}, 0))"
            at = f"filter(transform({hashes}, (h, i) -> if({tested}, i, null)), i -> i is not null)"
            w = w.withColumn("_at", F.expr(at)).withColumn(f"_hit{length}", F.expr(f"flatten({windows})")).drop("_at", f"_set{length}")
            found.append(F.col(f"_hit{length}"))
    w = w.select("row", "row_id", F.size("_w").cast("long").alias("n_words"), F.explode_outer(F.concat(*found)).alias("_hit"))
    if small:
        w = w.withColumn("gram", F.col("_hit.gram")).join(F.broadcast(grams.select("gram", "items")), "gram", "left")
    else:
        w = materialize(w.withColumn("k1", F.col("_hit.k1")).withColumn("k2", F.col("_hit.k2")), "windows")
        known = grams.select(F.xxhash64("gram").alias("k1"), F.xxhash64(F.lit(1), "gram").alias("k2"), "items")
        w = join_hot(w, materialize(known, "grams"), ["k1", "k2"], w.count(), F.xxhash64("row_id", "_hit.at"))
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("_hit.at").alias("at"), F.col("_hit.n").alias("n"), F.col("items").alias("items")))
    return w.groupBy("row", "row_id", "n_words").agg(F.collect_list(hit).alias("hits")).drop("row_id")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (row, text): row, n_words, n_hit, n_items, items, contaminated, spans (the hit words' numbers)."""
    at = "array_distinct(flatten(transform(hits, h -> sequence(h.at, h.at + h.n - 1))))"
    out = hits_of(docs, benchmark).withColumn("spans", F.sort_array(F.expr(at)))
    out = out.withColumn("n_hit", F.size("spans").cast("long")).withColumn("items", F.expr("array_distinct(flatten(transform(hits, h -> h.items)))"))
    out = out.withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")).drop("hits")


ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs its columns but for the text, and n_words, n_hit, n_items, items, contaminated, and spans: the hit words' numbers.

    A document is contaminated if any word is hit and the hit words are a twentieth of its words or more. The columns must
    be of types that can be grouped by (no maps).
    """
    own = [c for c in docs.columns if c != "text"]
    out = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "text"), benchmark)
    return out.select("row.*", *[F.col(a).alias(b) for a, b in zip(ADDED, fresh(own, *ADDED), strict=True)])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = judged(docs.select(F.col("doc_id").alias("row"), "text"), benchmark).withColumnRenamed("row", "doc_id")
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, whole and with all their columns, of any type."""
    k1, k2 = fresh(docs.columns, "k1", "k2")
    flat = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    keys = F.xxhash64(*flat), F.xxhash64(F.lit(7), *flat)  # 128 bits name a row
    bad = judged(docs.select(F.struct(keys[0].alias(k1), keys[1].alias(k2)).alias("row"), "text"), benchmark).where("contaminated")
    bad = materialize(bad.select("row.*").distinct(), "contaminated")
    small = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select("*", keys[0].alias(k1), keys[1].alias(k2)).join(F.broadcast(bad) if small else bad, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


REPORT_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT p.rid, p.k, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT rid, k, n FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN m ON d.rid = m.rid
"""
