"""Helpers shared by the corpus operators: input, scratch tables, shipping code, joins with hot keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path, shared_dir
from ..ship import ship as ship_package

#: A side of at most this many rows of a few longs may be broadcast; beyond it a shuffled join runs.
BROADCAST_ROWS = 200_000


__all__ = ["BROADCAST_ROWS", "bounded_sample", "fresh", "hot_keys", "join_hot", "materialize", "scratch_path", "shared_dir", "ship", "table", "text_of", "texts_in"]


#: Rows of an Arrow batch where the session sets none: documents are long, and each Python worker holds a few batches.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Get the executors' Python workers ready: the package, and batches of a bounded size."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a written file at least, for tables of a few numbers a row.
FILE_ROWS = 500_000


def materialize(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder; a lost executor then costs a reread, not a recomputation.

    most_rows: for tables of a few numbers a row, how many rows there can be; they are written as so many files of ``FILE_ROWS``,
    or as many as the cluster has cores, in place of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if most_rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, keys: list[str], n_rows: int, share: int = 500) -> DataFrame:
    """The keys that hold over 1/share of the rows: fewer than ``share`` of them, whatever the data, so they may be broadcast."""
    least = max(64, n_rows // share)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(*keys)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n_left: int, spread: Column, how: str = "left", salts: int = 64) -> DataFrame:
    """``left`` join ``right`` (few rows a key) on ``keys``, where a key may hold a third of ``left``.

    The rows of hot keys are dealt to ``salts`` groups by ``spread`` (a hash of something that differs between them)
    and the right rows of those keys are repeated as often; all other rows join as they are. No row is dropped.
    """
    hot = F.broadcast(hot_keys(left, keys, n_left).withColumn("_hot", F.lit(True)))
    a = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


#: Values of a key (labels, languages) that a sample takes up: the most frequent.
MOST_VALUES = 500


def bounded_sample(rows: DataFrame, key: str, n: int, most_chars: int) -> list[tuple[str, object]]:
    """(text, value) of at most ``n`` rows (key, doc_id, text) of each value of ``key``, by a hash of id and text.

    Rows that repeat count once, so that a value whose rows share an id or a text has its sample too. Of a value's rows in the
    order of their hashes those are taken before which there are fewer than ``most_chars`` characters: what is collected is bounded
    by ``MOST_VALUES`` values and the characters, and one text each. Only hashes and lengths are shuffled before the choice, and those
    that can hardly be among the n are left out by their hash first, so that what meets in the task of a value is about 1.5 n rows.
    """
    k, h = F.col(key).alias("k"), F.xxhash64("doc_id", "text").alias("h")
    all_ = rows.select(k, h, F.length("text").alias("n")).groupBy("k", "h").agg(F.max("n").alias("n"))
    counts = all_.groupBy("k").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "k").limit(MOST_VALUES).collect()
    if not counts:
        return []
    place = F.pmod("h", F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.k, min(1.0, (1.5 * n + 100) / r.c))])[F.col("k")]
    near = all_.where(place < share * F.lit(float(1 << 30)))
    w = Window.partitionBy("k").orderBy(place, "h")
    near = near.withColumn("r", F.row_number().over(w)).withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    chosen = near.where((F.col("r") <= n) & (F.coalesce("before", F.lit(0)) < most_chars)).select("k", "h")
    found = rows.select(k, h, "text").join(F.broadcast(chosen), ["k", "h"]).groupBy("k", "h").agg(F.first("text").alias("text"))
    return sorted((r.text, r.k) for r in found.collect())


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added where the columns already have them: for columns that must not hide others."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_in(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's strings, null as ''."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
