"""Shared plumbing of the training-data operators: table access, durable cut points, hashing, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    The files outlive any executor, and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    gc.collect()
    jvm.System.gc()  # the cleaner then drops the shuffle files of what has been written
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_at = where
    return saved


def discard(saved: DataFrame) -> None:
    """Delete the files of ``save``'s result; everything that reads them must have been saved or collected."""
    spark = saved.sparkSession
    saved.saved_at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(saved.saved_at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when it has ``MOST`` words."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > _Hashes.MOST:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; bytes methods touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Forest:
    """Union-find over 0..n-1 that keeps the smaller index as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) as (id, component), the smallest id of each; nodes without an edge are absent.

    Alternates large-star and small-star: minima are pre-aggregated map-side, each round is two shuffles, and every
    round is written to the shared folder, so nothing is recomputed when an executor is lost. Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.
    """
    e = save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    size = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    while size[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node u below all of its neighbours keeps them; all others hand them the smallest
        e2 = large.where("u <> v").distinct()
        low2 = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low2.select("u", F.col("m").alias("v"))
        )
        e = save(small.where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == size:
            break
        size = now
    return e.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("id"), F.col("c").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def stream_groups(batches, n_keys: int):
    """(key, rows) of each run of equal keys in the first ``n_keys`` columns; rows come as one pyarrow table.

    The rows must be sorted by key within the partition; one group is in memory at a time.
    """
    import pyarrow as pa

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            now = tuple(keys[:, lo].tolist())
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def binary_views(column) -> list[np.ndarray]:
    """The uint64 arrays of a pyarrow binary column."""
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
