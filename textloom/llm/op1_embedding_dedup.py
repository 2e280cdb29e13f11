"""Embedding near-duplicates by an inverted multi-index.

The halves of the unit vectors have codebooks of their own (k-means on a sample of at most ``SAMPLE`` vectors); a vector's
cell is the pair of its nearest codewords. A vector visits the cells in the order of a multi-sequence traversal, by the
sum of the halves' distances. How many it visits is fitted on the sample: as many as bring the recall of pairs at the
threshold to ``TARGET``, all cells if it takes them. Equal vectors are one class, indexed once with its size; every class visits; pairs met are verified by cosine in double precision.

A cell's vectors are dealt into blocks and so are its visitors, so a cell that holds a third of all vectors is many
tasks. A task counts links with matrix products and returns one row per vector that it saw linked, with the root of its
local component: pairs are never written. A pair that only one of the two meets is counted for both.

Cases: null vectors, zero ones and such with null or non-finite components link with nothing; vectors of another length
than most meet only their like; rows that share an id are one vector (the largest value); a null id links with
nothing and has a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, save, stream_groups, table

THRESHOLD = 0.95
SAMPLE = 20_000
QUERIES = 1_000
TARGET = 0.995
PER_CELL = 64
BLOCK = 1_024
VISITORS = 8_192
FIRST_VISITS = 64


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None]


class Grid:
    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.dim = left, right, left.shape[1] + right.shape[1]

    def visit(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first. A cell of ranks (i, j) can be among the first n only if
        (i + 1)(j + 1) <= n, which is the frontier of the multi-sequence traversal."""
        cut = self.left.shape[1]
        d1, d2 = distances(x[:, :cut], self.left), distances(x[:, cut:], self.right)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        i, j = np.divmod(np.arange(len(self.left) * len(self.right)), len(self.right))
        front = (i + 1) * (j + 1) <= n
        i, j = i[front], j[front]
        total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        best = total.argsort(axis=1, kind="stable")[:, :n]
        return np.take_along_axis(o1, i[best], 1) * len(self.right) + np.take_along_axis(o2, j[best], 1)


def fit(x: np.ndarray, total: int, threshold: float, target: float) -> tuple[Grid, int]:
    """Codebooks for ``total`` vectors, and the number of cells to visit, from a sample of unit vectors."""
    cut = x.shape[1] // 2 or 1
    k = int(np.clip(round((total / PER_CELL) ** 0.5), 1, 256))
    grid = Grid(codebook(x[:, :cut], k), codebook(x[:, cut:], k))
    cells = len(grid.left) * len(grid.right)
    q = x[:QUERIES]
    a, b = np.nonzero((q @ x.T >= threshold) & (np.arange(len(x))[None] != np.arange(len(q))[:, None]))
    if len(a) > 20_000:  # enough to fit a number
        keep = np.linspace(0, len(a) - 1, 20_000).astype(int)
        a, b = a[keep], b[keep]
    # and pairs made at the very threshold, the hardest, so that the number doesn't hang on what the sample holds
    rng = np.random.default_rng(12)
    away = rng.normal(size=q.shape)
    away -= (away * q).sum(axis=1, keepdims=True) * q
    made = threshold * q + (1 - threshold**2) ** 0.5 * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    most = min(FIRST_VISITS, cells)
    while True:
        visits = grid.visit(q, most)
        mine = np.concatenate([visits[a], visits])
        other = np.concatenate([x[b], made])
        back = np.concatenate([grid.visit(x[b], most), grid.visit(made, most)]) if len(other) else mine
        own_cell = back[:, 0]
        there = np.where((mine == own_cell[:, None]).any(axis=1), (mine == own_cell[:, None]).argmax(axis=1), most)
        here = np.where((back == mine[:, :1]).any(axis=1), (back == mine[:, :1]).argmax(axis=1), most)
        rank = np.minimum(there, here)
        need = max(np.quantile(rank[part], target, method="higher") for part in (slice(0, len(a)), slice(len(a), None)) if len(rank[part]))
        if need < most or most == cells:
            return grid, int(min(most, need + 1))
        most = min(4 * most, cells)


def number_type(vectors: DataFrame) -> str:
    """Four bytes a number where the vectors hold no more; products are in double precision all the same."""
    return "<f4" if "array<float>" in dict(vectors.dtypes)["embedding"] else "<f8"


def place(vectors: DataFrame, grid: Grid, n: int) -> DataFrame:
    """``vec_id, size, cell, visits, vec`` (bytes of its numbers) of usable vectors (vec_id, embedding, size)."""
    kind = number_type(vectors)
    sent = vectors.sparkSession.sparkContext.broadcast(grid)  # at most 2 x 256 codewords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ids, rows = b.column(0).to_pylist(), [np.asarray(x, np.float64) for x in b.column(1).to_pylist()]
                cell = np.array([-len(r) for r in rows], np.int64)
                visits = [[int(c)] for c in cell]
                mine = [i for i, r in enumerate(rows) if len(r) == g.dim]
                if mine:
                    got = g.visit(unit(np.stack([rows[i] for i in mine])), n)
                    for i, v in zip(mine, got, strict=True):
                        cell[i], visits[i] = v[0], v.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(2), pa.array(cell), pa.array(visits, pa.list_(pa.int64())), pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())], ["vec_id", "size", "cell", "visits", "vec"])

    return vectors.mapInArrow(run, "vec_id long, size long, cell long, visits array<long>, vec binary")


def count_links(threshold: float, kind: str):
    """Links of visitors with a block: rows of cell, block, lot, visitor, vec_id, own, visits, vec, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _, _), rows in stream_groups(batches, 3):
            visitor = np.array(rows.column(3).to_pylist(), bool)
            ids = rows.column(4).to_numpy()
            if visitor.all() or not visitor.any():
                continue
            vecs = unit(np.stack([np.frombuffer(v, kind) for v in rows.column(7).to_pylist()]))
            x, q = np.flatnonzero(~visitor), np.flatnonzero(visitor)
            own, size = rows.column(5).to_numpy(), rows.column(8).to_numpy()
            seen = rows.column(6).take(pa.array(x)).to_pylist()
            back = {int(c): np.array([c in v for v in seen]) for c in np.unique(own[q])}
            n = np.zeros(len(ids), np.int64)
            links = []
            for at in range(0, len(q), 1024):
                part = q[at : at + 1024]
                hit = (vecs[part] @ vecs[x].T >= threshold) & (ids[part][:, None] != ids[x][None])
                n[part] += hit @ size[x]
                n[x] += size[part] @ (hit & ~np.stack([back[int(c)] for c in own[part]]))
                links.append(hit)
            hit = np.concatenate(links)
            if not hit.any():
                continue
            label = ids[x].astype(np.int64)
            far = np.iinfo(np.int64).max
            while True:  # the smallest id in reach, within the block
                mine = np.where(hit, label[None], far).min(axis=1)
                new = np.minimum(label, np.where(hit, mine[:, None], far).min(axis=0))
                if (new == label).all():
                    break
                label = new
            root = np.full(len(ids), far)
            root[x], root[q] = label, mine
            out = np.flatnonzero((n > 0) | ((root != far) & (root != ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[out], pa.int64()), pa.array(n[out]), pa.array(np.where(root[out] == far, ids[out], root[out]), pa.int64())], ["vec_id", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector of ``vectors`` (vec_id, embedding)."""
    one = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.max("embedding").alias("embedding"))
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = one.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    alone = one.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    dim, total = sizes[0]
    drawn = good.where(F.size("embedding") == dim).orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    grid, n = fit(unit(np.array(drawn.column(0).to_pylist(), np.float64)), total, threshold, target)
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    keyed = good.select("vec_id", *key, "embedding")
    classes = save(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("embedding").alias("embedding")), "classes")
    placed = save(place(classes.select(F.col("rep").alias("vec_id"), "embedding", "size"), grid, n), "placed")

    visits = placed.select("vec_id", F.col("cell").alias("own"), F.explode("visits").alias("cell"), "vec", "size")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    lots = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).cast("long").alias("lots"))
    plan = F.broadcast(sizes.join(lots, "cell"))  # a row per cell, at most 65536 and one per odd length
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = placed.join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), to("lots").alias("lot"), F.lit(False).alias("visitor"),
        "vec_id", F.col("cell").alias("own"), "visits", "vec", "size",
    )
    come = visits.join(plan, "cell").select(
        "cell", to("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), "lots").alias("lot"), F.lit(True).alias("visitor"),
        "vec_id", "own", F.array().cast("array<bigint>").alias("visits"), "vec", "size",
    )
    keys = ["cell", "block", "lot"]
    found = save(
        held.unionAll(come).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count_links(threshold, number_type(good)), "vec_id long, n long, root long"), "links"
    )
    n_links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "vec_id")
    of_class = classes.select(F.col("rep").alias("vec_id"), "k1", "k2", "size").join(n_links, "vec_id", "left").join(comp, "vec_id", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "vec_id").alias("component")
    )
    linked = keyed.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n", "component")
    return one.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair by cosine, then the smallest id in reach.
SQL = """WITH RECURSIVE one AS (SELECT vec_id, max(embedding)::DOUBLE[] AS v FROM embeddings GROUP BY vec_id),
    good AS (SELECT * FROM one WHERE vec_id IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
    link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
    reach AS (SELECT vec_id AS u, vec_id AS w FROM one UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u)
    SELECT o.vec_id, (SELECT count(*) FROM link WHERE u = o.vec_id) AS n_links, coalesce(m, o.vec_id) AS component_id, coalesce(m = o.vec_id, false) AS kept
    FROM one o LEFT JOIN (SELECT u, min(w) AS m FROM reach GROUP BY u) ON u = o.vec_id"""
