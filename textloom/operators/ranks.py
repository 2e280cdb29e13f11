"""Dense ranks over any number of rows: range partitions, a count for each, and offsets; never one window over everything."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


FEW = 100_000  # rows of partitions and values that ``ranked`` may broadcast


def shuffled_join(df: DataFrame) -> DataFrame:
    """For joins of a table that may have any number of rows: they shuffle, whatever its files' size. Ids in order take less than a byte a row
    in Parquet, so Spark would gather millions of rows in the driver to broadcast them. Who knows a bound says broadcast, which goes first."""
    return df.hint("merge")


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: written to the shared folder as Parquet and read again, so that no lost executor changes it. The files go when
    the driver's JVM ends. Joins of what is read, or of its projections and sums, are shuffled."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return shuffled_join(spark.read.schema(df.schema).parquet(path))


def ranked(df: DataFrame, order: list[str | Column], within: list[str] | None = None, name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``name``, the place of a row from 0 in the order, for each value of ``within`` by itself (null is a value), and with ``total``
    the number of such rows.

    Rows go once through a range exchange on (within, order), so that a value of ``within`` with any share of the rows is spread over
    as many tasks as it fills. Their place in their partition is a counter; what stood before the partition is a running sum over one
    row for each partition and value. Rows that tie in ``order`` get ranks in no fixed order: name a key that tells rows apart. No rows
    give no rows.
    """
    spark, within = df.sparkSession, within or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, within), *[F.col(c) if isinstance(c, str) else c for c in order]]
    placed = durable(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(PLACE))
    counts = placed.groupBy("__part", *within).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    if within:
        w = Window.partitionBy(*within)
        before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = durable(counts.select("__part", *within, (before - F.col("__first")).alias("__add"), F.sum("__n").over(w).alias("__total")), "counts")
        counts = F.broadcast(counts) if counts.count() <= FEW else counts
    else:  # one row for each partition
        rows, add, seen = sorted(counts.collect()), [], 0
        for part, n, first in rows:
            add.append((part, seen - first))
            seen += n
        counts = F.broadcast(spark.createDataFrame([(p, a, seen) for p, a in add], "__part long, __add long, __total long"))
    same = F.col("a.__part") == F.col("b.__part")
    for c in within:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = placed.alias("a").join(counts.alias("b"), same).select(
        *[F.col(f"a.`{c}`") for c in df.columns], (F.col("a.__at") + F.col("b.__add")).alias(name), *([F.col("b.__total").alias(total)] if total else [])
    )
    return out
