"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once. The top bits of the hash name one of ``BINS`` bins and each bin keeps its least hash.
An empty bin takes the value of a bin that isn't empty, found by hashing (bin, attempt) until one is hit; every bin draws
its own sequence, so that two texts fill the same empty bin from the same source with the probability of their similarity
(optimal densification). Of each value the lowest four bits are stored, one hexadecimal digit a bin; the likeness of two
fingerprints removes the expected share of chance matches, 1/16.

Only DataFrame functions are used. Rows keep their place: a fingerprint needs no shuffle.

Defined results: null is taken as an empty text; a text without words has the fingerprint '' (likeness 1 to another such,
0 to any other); texts of one to four words have one shingle; equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
PROBES = 12
SHIFT = 64 - BIN_BITS
BODY = (1 << SHIFT) - 1
#: Rows of one group when the successor of a document is looked up, and groups of groups.
GROUP = 64
FANOUT = 4096
#: A group of over HOT_ROWS rows and over 1 / HOT_SHARE of all rows (so fewer than HOT_SHARE groups) is dealt in PIECES, fewer if ids spread over 2^58.
HOT_ROWS = 4096
HOT_SHARE = 500
PIECES = 512


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the array of BINS four-bit values of column ``text``; null where there are no words."""
    gets = ", ".join(f"get(_fw, i + {k})" for k in range(1, WORDS))
    full = F.array(*[F.lit(((s - BINS // 2) << SHIFT) | BODY) for s in range(BINS)])
    probes = ", ".join(f"get(_fv, cast(pmod(xxhash64(i, {r}), {BINS}) as int))" for r in range(PROBES))
    rest = f"array_min(transform(filter(_fm, x -> (x & {BODY}L) <> {BODY}L), x -> struct(xxhash64(i, shiftright(x, {SHIFT})) as r, x as x))).x"
    low = (1 << LOW_BITS) - 1
    return (
        df.withColumn("_fw", F.array_remove(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), ""))
        .withColumn("_fh", F.expr(f"slice(transform(_fw, (w, i) -> xxhash64(w, {gets})), 1, greatest(size(_fw) - {WORDS - 1}, least(size(_fw), 1)))"))
        # a largest value for each bin makes the first of each bin's run its least hash, and marks empty bins
        .withColumn("_fs", F.sort_array(F.concat("_fh", full)))
        .withColumn("_fm", F.expr(f"filter(_fs, (x, i) -> not (shiftright(x, {SHIFT}) <=> shiftright(get(_fs, i - 1), {SHIFT})))"))
        .withColumn("_fv", F.expr(f"transform(_fm, x -> if((x & {BODY}L) = {BODY}L, null, cast(x & {low} as tinyint)))"))
        .withColumn(out, F.expr(f"if(size(_fw) = 0, null, transform(_fv, (v, i) -> coalesce(v, {probes}, cast({rest} & {low} as tinyint))))"))
        .drop("_fw", "_fh", "_fs", "_fm", "_fv")
    )


def packed(bins: Column) -> Column:
    """A fingerprint as a string of one hexadecimal digit a bin; '' for none."""
    return F.coalesce(F.lower(F.array_join(F.transform(bins, lambda v: F.hex(v)), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1, corrected for chance matches of the stored bits."""
    chance = 1 / (1 << LOW_BITS)
    same = F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x == y), False)) / F.lit(float(BINS))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def following(groups: DataFrame, low: int, high: int) -> DataFrame:
    """groups (g, one row each): add next, the next larger g that exists; the largest gets the smallest of all.

    Works up a tree of ``FANOUT`` groups a node: a window never holds more rows than that, whatever the ids.
    """
    lead = F.lead("g").over(Window.partitionBy("_up").orderBy("g"))
    if high - low < FANOUT:
        return groups.withColumn("_up", F.lit(0)).withColumn("next", F.coalesce(lead, F.first("g").over(Window.partitionBy("_up").orderBy("g")))).drop("_up")
    up = groups.withColumn("_up", F.expr(f"g div {FANOUT}L - if(g < 0, 1, 0)"))
    tops = following(up.select(F.col("_up").alias("g")).distinct(), low // FANOUT - 1, high // FANOUT).select(F.col("g").alias("_up"), F.col("next").alias("_nextup"))
    first = up.groupBy("_up").agg(F.min("g").alias("_first")).select(F.col("_up").alias("_nextup"), "_first")
    return up.withColumn("_lead", lead).join(tops.join(first, "_nextup").select("_up", "_first"), "_up").select("g", F.coalesce("_lead", "_first").alias("next"))


def in_pieces(docs: DataFrame, least: int, pieces: int) -> DataFrame:
    """docs (_g, doc_id, text): groups of over ``least`` rows dealt to ``pieces`` new groups each, in the order of id and text; adds _copies.

    The pieces are bounded by approximate quantiles of the id and the first seven bytes of the text, which keep the order of
    strings. Equal rows of such a group are counted within each input partition, so that they travel as one row with its ``_copies``.
    """
    at = F.shiftleft(F.coalesce(F.col("doc_id").bitwiseAND(GROUP - 1) + 1, F.lit(0)).cast("long"), 56)
    at = at + F.expr("cast(conv(rpad(hex(substring(cast(text as binary), 1, 7)), 14, '0'), 16, 10) as long)")
    hot = docs.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("_g")
    shares = [k / pieces for k in range(1, pieces)]
    bounds = docs.join(F.broadcast(hot), "_g").groupBy("_g").agg(F.array_distinct(F.percentile_approx(at, shares, 4 * pieces)).alias("_bounds"))
    # written, as quantiles that are computed twice may differ
    docs = docs.join(F.broadcast(materialize(bounds, "pieces")), "_g", "left")
    cold = docs.where("_bounds is null").select((F.col("_g") * pieces).alias("_g"), "doc_id", "text", F.lit(1).cast("long").alias("_copies"))
    piece = F.size(F.filter("_bounds", lambda b: b < F.col("_at")))
    split = docs.where("_bounds is not null").withColumn("_at", at).select((F.col("_g") * pieces + piece).alias("_g"), "doc_id", "text", F.spark_partition_id().alias("_p"))
    return cold.unionByName(split.groupBy("_g", "doc_id", "text", "_p").agg(F.count(F.lit(1)).alias("_copies")).drop("_p"))


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], cols: list[str]) -> DataFrame:
    """derive(docs (doc_id, text)), with next_<col> for each of ``cols``: the values of the next row by doc_id; the last row gets those of the first.

    Null ids come first; rows of equal ids are ordered by text. Rows are dealt once, by groups of ``GROUP`` consecutive ids, and
    those without an id are a group of their own; a group with over 1 / ``HOT_SHARE`` of the rows is dealt in pieces. Only the
    first row of each group travels again, to the group before. ``derive`` must work row by row.
    """
    docs = docs.withColumn("_g", F.shiftright("doc_id", GROUP.bit_length() - 1))
    sizes = docs.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    low, high, n, most = sizes.agg(F.min("_g"), F.max("_g"), F.sum("n"), F.max("n")).first()
    low, high = (0, 0) if low is None else (low - 1, high)
    docs, top = docs.withColumn("_g", F.coalesce(F.col("_g") - low, F.lit(0).cast("long"))), high - low
    least = max(HOT_ROWS, (n or 0) // HOT_SHARE)
    hot = (most or 0) > least
    if hot:
        pieces = min(PIECES, (1 << 62) // (top + 1))
        docs, top = in_pieces(docs, least, pieces), (top + 1) * pieces
    w = Window.partitionBy("_g").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    link = following(docs.select(F.col("_g").alias("g")).distinct(), 0, top)
    heads = derive(docs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(F.col("_g").alias("next"), "text"))
    heads = heads.select("next", F.struct(*cols).alias("_head")).join(link, "next").select(F.col("g").alias("_g"), "_head")
    out = derive(docs).withColumn("_next", F.lead(F.struct(*cols)).over(w)).join(heads, "_g", "left").withColumn("_next", F.coalesce("_next", "_head"))
    if hot:  # of equal rows all but the last are followed by one of them
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        out = out.withColumn("_next", F.when(F.col("_copy") < F.col("_copies"), F.struct(*cols)).otherwise(F.col("_next"))).drop("_copy", "_copies")
    return out.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in cols]).drop("_g", "_next", "_head")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likenesses of the contract."""
    pairs = with_next(docs.select("doc_id", text_of().alias("text")), lambda d: with_fingerprint(d, "text", "bins"), ["text", "bins"])
    n = F.char_length("text")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.expr("cast(n_chars div 2 as int)"))
    pairs = pairs.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - _cut), substring(next_text, 1, _cut))"))
    pairs = with_fingerprint(pairs, "edited", "edited_bins")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
