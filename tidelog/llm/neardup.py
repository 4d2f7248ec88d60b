"""Near-duplicates by Order MinHash, verified by banded alignment.

Two texts are near-duplicates if an alignment of their words matches M of them in order with ``M / (n + m - M) >= 0.8``: a
similarity that follows edits, and that every pair with 0.8 or more of its five-word runs in common and in order reaches too.

Candidates: the k-mers of a text are its runs of ``WORDS`` words, labelled by their occurrence (first, second, ... of the same
words). Each of ``SKETCHES`` hash functions picks the ``PICKS`` least k-mers and keeps them in text order; the hash of that
ordered tuple is a bucket. Two texts meet in a bucket only if the same k-mers come in the same order. Short k-mers keep most
of their picks through scattered edits: at a similarity of 0.8, which one word in nine changed gives, two texts share one of
the sketches with a probability of 0.94, at 0.85 of 0.99, at 0.9 of 0.9999.

Exact copies are one class before sketching counts. Every text of a bucket is first paired with one leader, the one with the
least id, so that a bucket of any size is handled by as many tasks as there are, and a group of copies has few distinct pairs.
The links that alignment confirms are contracted to classes by alternating star operations in Spark.

Leaders link most of a class, not all of it. What is left are buckets whose texts are in several classes. All their pairs across
classes are compared by their lengths and by signatures, parity bitmaps of the labelled words: two of them differ in no more bits
than the texts differ in words, so a pair whose signatures differ too much can't be near-duplicates, and no other pair is given up.
Such buckets are dealt in blocks of about ``BLOCK`` texts, each pair of blocks a group of its own. Of the remaining pairs each
text's ``limit`` nearest are verified and contracted; rounds with a growing limit follow until no pair of a bucket is unverified
and unconnected.

Joins on keys that may be hot (buckets, ids of leaders, hashes of copies) are between written tables, where adaptive execution
splits a skewed partition.

Defined results: texts without words are classes of their own, even if equal; texts of fewer words than a k-mer are one k-mer;
null ids form classes by equal text only, and their class_id is null unless a copy has an id; rows that repeat an id are one
document and share a class; extra columns are ignored. A class is named by its least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialize, ship, text_of, texts_in
from .tokens import BASE, U64, chunks, mix, shingles, tokenize

#: Words of a k-mer, sketches, and k-mers that each of them picks.
WORDS = 3
SKETCHES, PICKS = 16, 3
SIMILARITY = 0.8
#: Bits of a signature; texts of a block; pairs verified for a text in the first round, and by how much more in each later one.
BITS, BLOCK, NEAREST, MORE = 2048, 2000, 4, 8
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * U64(BASE))


def occurrences(runs: np.ndarray) -> np.ndarray:
    """How many equal runs come before each."""
    order = np.argsort(runs, kind="stable")
    sorted_ = runs[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.empty(len(runs), np.int64)
    out[order] = np.arange(len(runs)) - np.repeat(new, np.diff(np.append(new, len(runs))))
    return out


def sketch(runs: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of ordered tuples."""
    with np.errstate(over="ignore"):
        labelled = mix(runs + occurrences(runs).astype(U64) * U64(BASE))
        picks = min(PICKS, len(labelled))
        out = np.zeros(SKETCHES, U64)
        for a in range(0, SKETCHES, 4):  # so many rows at once, for long texts
            ranks = (labelled[None, :] ^ SEEDS[a : a + 4, None]) * U64(0xD6E8FEB86659FD93)
            ranks ^= ranks >> U64(32)
            ranks *= U64(0xCA5A826395121157)
            at = np.argpartition(ranks, picks - 1, axis=1)[:, :picks] if len(labelled) > picks else np.tile(np.arange(len(labelled)), (len(ranks), 1))
            at.sort(axis=1)
            h = np.zeros(len(ranks), U64)
            for k in range(picks):
                h = mix(h * U64(BASE) + labelled[at[:, k]])
            out[a : a + 4] = h
    return out


def signature(words: np.ndarray) -> np.ndarray:
    """Of each bit, whether the number of labelled words that fall on it is odd."""
    with np.errstate(over="ignore"):
        labelled = mix(words + occurrences(words).astype(U64) * U64(BASE))
    odd = np.bincount((labelled % U64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_in(batch)
        out = np.zeros((len(texts), SKETCHES), np.int64)
        n, signs = np.zeros(len(texts), np.int64), [b""] * len(texts)
        for a, b in chunks(texts):
            t = tokenize(texts[a:b], digits=True)
            for k in range(b - a):
                words = t.hash[t.of(k)]
                n[a + k] = len(words)
                if len(words):
                    out[a + k] = sketch(shingles(words, WORDS)).view(np.int64)
                    signs[a + k] = signature(words).tobytes()
        columns = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n), pa.array(signs, pa.binary()), *(pa.array(out[:, i]) for i in range(SKETCHES))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "sign", *(f"s{i}" for i in range(SKETCHES))])


def _longest_common(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The most matches in order of a and b within a band: at most ``most`` elements of either may be left out."""
    i = 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    i = int(differ[0]) if len(differ) else n
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    j = 0
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        j = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - j], b[: len(b) - j]
    if not len(a) or not len(b):
        return i + j
    width = 2 * most + 1
    padded = np.zeros(len(b) + 2 * width, b.dtype)
    padded[width : width + len(b)] = b
    inside = np.zeros(len(padded), bool)
    inside[width : width + len(b)] = True
    row = np.zeros(width, np.int32)  # at k: b's position is i - most + k
    for x in range(len(a)):
        low = x - most + width
        same = (padded[low : low + width] == a[x]) & inside[low : low + width]
        new = row + same  # the diagonal before is at the same k
        new[:-1] = np.maximum(new[:-1], row[1:])
        row = np.maximum.accumulate(new)
    return i + j + int(row.max())


def _anchored(a: np.ndarray, b: np.ndarray) -> int:
    """Matches in order that are found at once: from elements that are single in both, along each one's diagonal up to the next. 0 if those change places."""
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    single = (ca[xa] == 1) & (cb[xb] == 1)
    pa_, pb = ia[xa][single], ib[xb][single]
    order = np.argsort(pa_)
    pa_, pb = pa_[order], pb[order]
    if not len(pa_) or (np.diff(pb) <= 0).any():
        return 0
    own = np.searchsorted(pa_, np.arange(len(a)), "right") - 1  # the anchor before each place of a
    at = np.where(own >= 0, np.arange(len(a)) - pa_[own] + pb[own], -1)
    until = np.append(pb[1:], len(b))[own]
    ok = (at >= 0) & (at < until)
    return int(np.count_nonzero(a[ok] == b[at[ok]]))


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """M / (n + m - M) for two sequences whose alignment matches M elements in order; 0 if it is under ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least / (1 + least) * (n + m)
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[xa], cb[xb]).sum() < need - 1e-9:  # not enough in common in any order
        return 0.0
    most = int(max(n, m) - need) + 1
    found = _longest_common(a, b, max(most, abs(n - m)))
    out = found / (n + m - found)
    return out if out >= least - 1e-12 else 0.0


def near(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Is their similarity ``least`` or more? Answered by matches along anchors where these suffice, else by the alignment."""
    n, m = len(a), len(b)
    if n and m and min(n, m) >= least * max(n, m):
        found = _anchored(a, b)
        if found and found / (n + m - found) >= least:
            return True
    return similarity(a, b, least) > 0


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        left, right = texts_in(batch, "text_a"), texts_in(batch, "text_b")
        for a, b in chunks([range(len(x) + len(y)) for x, y in zip(left, right, strict=True)]):
            ta, tb = tokenize(left[a:b], digits=True), tokenize(right[a:b], digits=True)
            for k in range(b - a):
                good[a + k] = near(ta.hash[ta.of(k)], tb.hash[tb.of(k)])
        yield batch.select(["a", "b"]).filter(pa.array(good))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (id, distinct), which are broadcast if they are few."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, repeats: bool = False) -> DataFrame:
    """The pairs (a, b) of ids whose texts are near-duplicates. Only texts of documents in pairs are shuffled. repeats: do rows repeat an id?"""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = only(docs.select(F.col("doc_id").alias("id"), text_of().alias("text")), ids)
    if repeats:
        texts = texts.distinct()
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long")


def near_pairs(ids: np.ndarray, roots: np.ndarray, n: np.ndarray, signs: np.ndarray, limit: int) -> list[tuple[int, int, bool]]:
    """(a, b, cut): of each text the ``limit`` nearest of those in other classes that may be near-duplicates; cut: it has more of them."""
    out = []
    order = np.argsort(n, kind="stable")  # by length, so that each step meets only texts of a length that may do
    ids, roots, n, signs = ids[order], roots[order], n[order], signs[order]
    step = max(1, 2_000_000 // signs.size)
    for x in range(0, len(ids), step):
        here = slice(x, x + step)
        low, high = np.searchsorted(n, SIMILARITY * n[x] - 1e-6), np.searchsorted(n, n[here][-1] / SIMILARITY + 1e-6, "right")
        to_n, to_ids = n[low:high], ids[low:high]
        may = (roots[here, None] != roots[low:high]) & (np.minimum(n[here, None], to_n) >= SIMILARITY * np.maximum(n[here, None], to_n) - 1e-6)
        if not may.any():
            continue
        differ = np.bitwise_count(signs[here, None] ^ signs[low:high]).sum(2, dtype=np.int64)
        # a similarity of s takes 2 s / (1 + s) of n + m in common, so this much may differ
        may &= differ <= (n[here, None] + to_n) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6
        for k in np.flatnonzero(may.any(axis=1)):
            to = np.flatnonzero(may[k])
            cut = len(to) > limit
            if cut:
                to = to[np.argsort(differ[k, to], kind="stable")[:limit]]
            a = int(ids[x + k])
            out.extend((min(a, b), max(a, b), cut) for b in to_ids[to].tolist())
    return out


def _near_batches(limit: int):
    def group(held: list[pa.RecordBatch]) -> list[tuple[int, int, bool]]:
        t = pa.Table.from_batches(held)
        signs = np.frombuffer(b"".join(t.column("sign").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        return near_pairs(*(t.column(c).to_numpy() for c in ("id", "root", "n")), signs, limit)

    def batch_of(found: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        a, b, cut = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, found = [], None, []
        for batch in batches:  # sorted by group; a group may go on in the next batch
            g = batch.column("g").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)] if len(g) else []
            for a, b in zip(at, at[1:]):
                if held and g[a] != last:
                    found += group(held)
                    held = []
                    if len(found) > 10_000:
                        yield batch_of(found)
                        found = []
                held.append(batch.slice(a, b - a))
                last = g[a]
        yield batch_of(found + (group(held) if held else []))

    return run


def buckets(known: DataFrame) -> DataFrame:
    """known (id, root, s0, s1, ...): (id, root, bucket), a row for each sketch."""
    of = F.array(*[F.xxhash64(F.lit(i), f"s{i}") for i in range(SKETCHES)])
    return known.select("id", "root", F.explode(of).alias("bucket"))


def leader_pairs(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (id, bucket): pairs (a, b) of each id with the least id of its bucket, a < b, each once."""
    leaders = materialize(rows.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("_z")).where("a <> _z").select("bucket", "a"), "leaders", n_rows)
    return rows.join(leaders, "bucket").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def open_buckets(rows: DataFrame) -> DataFrame:
    """Of rows (id, root, bucket): the buckets whose ids are in several classes, with their largest class and the blocks it and the rest take."""
    count = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    count = count.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return count.select("bucket", F.col("m.root").alias("main"), F.ceil(F.col("m.c") / BLOCK).alias("p"), F.ceil((F.col("c") - F.col("m.c")) / BLOCK).alias("q"))


def blocks(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """rows (id, root, bucket, main, p, q): (g, id, root, n, sign), where any two ids of a bucket that are in different classes share a group g.

    The largest class of a bucket and the rest are dealt to blocks apart, so that a few texts beside a large class are few pairs.
    """
    in_main = F.col("root") == F.col("main")
    k = F.pmod(F.xxhash64("id"), F.when(in_main, F.col("p")).otherwise(F.col("q")))
    rows = rows.withColumn("k", k)
    to = lambda many, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(many) - 1), f)
    groups = F.when(in_main, to("q", lambda j: F.xxhash64("bucket", F.lit(0), "k", j))).otherwise(
        F.concat(
            to("p", lambda i: F.xxhash64("bucket", F.lit(0), i, "k")),
            F.filter(to("q", lambda j: F.when(j != F.col("k"), F.xxhash64("bucket", F.lit(1), F.least(j, "k"), F.greatest(j, "k")))), lambda g: g.isNotNull()),
        )
    )
    return rows.select(F.explode(groups).alias("g"), "id", "root").join(signs, "id").select("g", "id", "root", "n", "sign")


def rest(docs: DataFrame, known: DataFrame, n_rows: int, signs: DataFrame, links: DataFrame, roots: DataFrame, repeats: bool) -> DataFrame:
    """The roots after all pairs of known (id, s0, s1, ...) that share a bucket are connected, or verified, or differ too much by their lengths and signatures."""
    limit, tested = NEAREST, None
    while True:
        rows = buckets(known.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
        shape = materialize(open_buckets(rows), "open", n_rows)
        if shape.isEmpty():
            return roots
        rows = materialize(rows.join(shape, "bucket"), "unlinked", n_rows)
        own = only(signs, rows.select("id").distinct())
        found = blocks(rows, own).repartition("g").sortWithinPartitions("g").mapInArrow(_near_batches(limit), "a long, b long, cut boolean")
        found = materialize(found.groupBy("a", "b").agg(F.max("cut").alias("cut")), "near", n_rows)
        pairs = found.select("a", "b")
        if tested is not None:
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs", n_rows)
        more = materialize(verified(docs, pairs, repeats), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links, "stars")
        if found.where("cut").isEmpty():
            return roots
        tested = pairs if tested is None else tested.union(pairs)
        limit *= MORE


def components(edges: DataFrame, name: str, most_rounds: int | None = None) -> DataFrame:
    """edges (a, b): (id, root) for every id in them, root the least id of its component.

    Alternating large-star and small-star: in each round every id links its larger neighbours, then its smaller ones, to its
    least neighbour, until the links are stars. Stars and the near-stars that leaders make take two or three rounds. Without
    ``most_rounds`` there is no bound; with it, links that aren't stars by then are an error. The centre of a large star is met
    as the key of a join between two written tables, which is split where it is skewed.
    """
    n = edges.count()
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name, n)
    state, rounds = None, 0
    while True:
        if rounds == most_rounds:
            raise RuntimeError(f"links aren't stars after {most_rounds} rounds")
        rounds += 1
        least = materialize(current.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        large = current.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_k"), F.col("u").alias("_u"))
        current = materialize(small.select(F.when(F.col("_k") == 0, F.col("u")).otherwise(F.col("_u")).alias("u"), "v").distinct(), name, n)
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    out = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return out.union(out.select(F.col("root").alias("id"), "root")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size."""
    spark = docs.sparkSession
    ship(spark)
    text = text_of()
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    schema = "doc_id long, k1 long, k2 long, n long, sign binary, " + ", ".join(f"s{i} long" for i in range(SKETCHES))
    sketched = materialize(keyed.mapInArrow(_sketch_batches, schema), "sketches")
    worded = sketched.where("n > 0")
    n = sketched.count()
    exact = materialize(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("c"), *[F.min(f"s{i}").alias(f"s{i}") for i in range(SKETCHES)]), "exact", n)
    known = exact.where("id is not null").select("id", *[f"s{i}" for i in range(SKETCHES)])

    # rows that repeat an id with other texts are one document: its texts' classes are linked
    repeated = worded.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("k1").alias("x"), F.max("k1").alias("y"), F.min("k2").alias("z"), F.max("k2").alias("w"))
    repeated = materialize(repeated.where("c > 1").select("doc_id", F.expr("x <> y or z <> w").alias("other")), "repeated", n)
    repeats = not repeated.isEmpty()
    links = verified(docs, materialize(leader_pairs(buckets(known.withColumn("root", F.lit(0))), n * SKETCHES), "pairs", n * SKETCHES), repeats)
    if repeats:
        own = worded.join(repeated.where("other"), "doc_id", "left_semi").join(exact.select("k1", "k2", "id"), ["k1", "k2"])
        least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = links.union(own.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b")))
    links = materialize(links, "links")
    roots = components(links, "stars")
    signs = worded.where("doc_id is not null").select(F.col("doc_id").alias("id"), "n", "sign")
    roots = rest(docs, known, n * SKETCHES, signs.distinct() if repeats else signs, links, roots, repeats)

    groups = materialize(exact.select("k1", "k2", "id", "c").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("class_id"), "c"), "groups", n)
    sizes = materialize(groups.where("class_id is not null").groupBy("class_id").agg(F.sum("c").alias("class_size"), F.count(F.lit(1)).alias("t")).where("t > 1").drop("t"), "sizes", n)
    groups = groups.join(sizes, "class_id", "left").select("k1", "k2", "class_id", F.coalesce("class_size", "c").alias("class_size"))
    bare = sketched.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return worded.select("doc_id", "k1", "k2").join(groups, ["k1", "k2"]).select("doc_id", "class_id", "class_size").union(bare)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each class: that with the least doc_id. Rows without an id stay; of rows that repeat an id the one with the least hash of its columns stays."""
    classes = materialize(near_duplicates(docs).where("doc_id is not null").select("doc_id", "class_id"), "classes", docs.count())
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    (own,) = fresh(docs.columns, "id")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = gone.withColumnRenamed("id", own)
    out = docs.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col(own), "left_anti").select(*docs.columns)
    twice = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    if twice.isEmpty():
        return out
    rank, other = fresh(docs.columns, "_rank", "_id")
    again = F.broadcast(twice.withColumnRenamed("doc_id", other)) if twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else twice.withColumnRenamed("doc_id", other)
    same = F.col("doc_id") == F.col(other)
    order = F.xxhash64(*[c for c in docs.columns if not dict(docs.dtypes)[c].startswith("map")]), text_of()
    ranked = out.join(again, same, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return out.join(again, same, "left_anti").select(*docs.columns).union(ranked.where(F.col(rank) == 1).select(*docs.columns))
