"""Operator 11: Merkle manifest of a dataset, by mountain ranges over indexed partitions.

A row is a leaf: the sha256 of its columns, each as byte count, colon and value, ``-`` for null; digests enter a hash as lower-case
hex. The leaves of each value of a partition column stand in order of their key. While a level has several nodes, every ``base``
consecutive ones become their hash, the last run being what is left, without padding. The nodes that remain (subroots), ordered by
their value, make the root in the same way.

Leaves get their index by distributed ranks. Each task then walks a range of indexed leaves with a stack that holds, for each level, the
nodes of an open run (the peaks of a mountain range). A node that fills its run is a carry: the parent is emitted as a record and pushed one level up.
The number of leaves is known, so the last run of a level is full when it has what is left. Nodes of runs that cross the edge of a task
are handed on, at most 2 * (base - 1) a level. They are merged with the same stack in spans of the index, about sixteen tasks' leaves at first; what a span can't
settle is its own top, so each next round merges about sixteen nodes a group, until a span holds the longest tree.

Proofs go down in storeys of some levels. A block of a storey is the leaves and records below one node, ``BLOCK`` leaves at most,
and one row that holds what is above it; so a task holds one block, whatever the share of a value.

Nulls: a null value of the partition column is a partition of its own, before all others; a null key stands first and is never
altered; null columns are ``-``. Empty text is ``0:``. Rows with one key stand in order of their leaf, equal rows in any order, each
with a proof of its own. No rows give no rows. Columns that aren't hashed take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil, log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ranks import ranked

from .common import save, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BASE = 2
BLOCK = 2048
ROUND = 16
NODE = "g string, n long, level int, idx long, digest binary, open boolean"
PATH = "before array<string>, after array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a row, as binary."""
    cells = []
    for c in columns.values():
        s = c.cast("string")
        cells.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.unhex(F.sha2(F.concat(*cells), 256))


def width(n: int, level: int, base: int) -> int:
    """Number of nodes of a level over n leaves."""
    return -(-n // base**level)


class Range:
    """The open runs of one tree over a stretch of its nodes, by level; ``add`` returns what is settled."""

    def __init__(self, g: str, n: int, base: int):
        self.g, self.n, self.base = g, n, base
        self.runs: dict[int, list[tuple[int, bytes]]] = {}

    def hand_on(self, level: int) -> Iterator[tuple]:
        for i, d in self.runs.pop(level, []):
            yield self.g, self.n, level, i, d, True

    def add(self, level: int, i: int, d: bytes) -> Iterator[tuple]:
        while width(self.n, level, self.base) > 1:
            run = self.runs.setdefault(level, [])
            if run and run[0][0] // self.base != i // self.base:
                yield from self.hand_on(level)
                run = self.runs.setdefault(level, [])
            run.append((i, d))
            i //= self.base
            if len(run) < min(self.base, width(self.n, level, self.base) - i * self.base):
                return
            d = hashlib.sha256("".join([x.hex() for _, x in run]).encode()).digest()
            del self.runs[level]
            level += 1
            yield self.g, self.n, level, i, d, False

    def close(self) -> Iterator[tuple]:
        for level in sorted(self.runs):
            yield from self.hand_on(level)


def walk(base: int):
    """Rows of NODE in order of (g, first leaf) to records and, ``open``, to nodes handed on; a stack of log n runs is in memory."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        at = None
        for b in batches:
            for g, n, level, i, d in zip(*(b.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest")), strict=True):
                if at is None or at.g != g:
                    if at:
                        yield from at.close()
                    at = Range(g, n, base)
                yield from at.add(level, i, d)
        if at:
            yield from at.close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("open", pa.bool_())])
        held = []
        for x in rows(batches):
            held.append(x)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def merge(base: int):
    """The nodes of one span of a tree, as ``walk``."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["first", "level"])
        at, out = Range(p["g"].iloc[0], int(p["n"].iloc[0]), base), []
        for level, i, d in zip(p["level"], p["idx"], p["digest"], strict=True):
            out += at.add(int(level), int(i), d)
        return pd.DataFrame([*out, *at.close()], columns=["g", "n", "level", "idx", "digest", "open"])

    return run


def records(leaves: DataFrame, base: int = BASE) -> DataFrame:
    """``g, n, level, idx, digest``: all nodes above the leaves of each tree; ``leaves``: g, n, idx, digest."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, most = leaves.agg(F.count("*"), F.max("n")).first()
    spread = leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest").repartitionByRange(parts, "g", "idx").sortWithinPartitions("g", "idx")
    out = save(spread.mapInArrow(walk(base), NODE), "merkle")
    done, nodes = out.where("not open").drop("open"), out.where("open").drop("open")
    step = max(1, round(log(ROUND, base)))
    level = ceil(log(max(rows // parts, 1), base)) + step  # spans of some tasks' leaves
    while rows:
        first = F.col("idx") * F.pow(F.lit(float(base)), "level").cast("long")
        by = nodes.withColumn("first", first).withColumn("span", F.floor(F.col("first") / F.lit(float(base)) ** level))
        out = save(by.groupBy("g", "span").applyInPandas(merge(base), NODE), "merkle")
        done, nodes = done.unionAll(out.where("not open").drop("open")), out.where("open").drop("open")
        if base**level >= most:
            break
        level += step
    return done


def storey(base: int, levels: int, low: int, last: bool):
    """A block of the storey from level ``low`` on: paths of its lowest nodes, or with ``last`` proofs of leaves and their verdicts."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        top = p[p["level"] < 0].iloc[0]
        p = p[p["level"] >= 0].sort_values(["level", "idx"], kind="stable")
        subroot, root = top["subroot"], top["root"]
        own = p[p["level"] == low]
        by = {int(level): (int(q["idx"].iloc[0]), [d.hex() for d in q["digest"]]) for level, q in p.groupby("level")}
        n, steps = int(own["n"].iloc[0]), {}

        def path(level: int, i: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
            """Siblings before and after a node of this block on its way up and on the way above."""
            if level == low + levels or width(n, level, base) == 1:
                return tuple(top["before"]), tuple(top["after"])
            if (level, i) not in steps:
                first, nodes = by[level]
                lo = i // base * base - first
                a, b = path(level + 1, i // base)
                steps[level, i] = ("".join(nodes[lo : i - first]), *a), ("".join(nodes[i - first + 1 : lo + base]), *b)
            return steps[level, i]

        if not last:
            ways = [path(low, int(i)) for i in own["idx"]]
            return pd.DataFrame({"g": own["g"], "idx": own["idx"], "before": [list(a) for a, _ in ways], "after": [list(b) for _, b in ways], "subroot": subroot, "root": root})
        out = []
        for i, key, d, altered in zip(own["idx"], own["key"], own["digest"], own["altered"], strict=True):
            before, after = path(low, int(i))
            up = (d if altered is None else altered).hex()
            for a, b in zip(before, after, strict=True):
                up = digest(a, up, b)
            out.append((key, d.hex(), subroot, root, digest(*[a + b for a, b in zip(before, after, strict=True)]), up, up == root))
        return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def descend(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, base: int, last: str | None) -> DataFrame:
    """Paths (``g, idx`` and PATH) of the leaves of each tree below ``tops`` (g and PATH), or, if ``last`` names the type of the leaves'
    ``key``, their proofs."""
    k = max(1, int(log(BLOCK, base)))
    most = leaves.agg(F.max("n")).first()[0] or 1
    height = next(level for level in range(200) if width(most, level, base) == 1)
    above = tops.select("g", F.lit(0).cast("long").alias("idx"), *[x.split()[0] for x in PATH.split(", ")])
    for low in range((max(height, 1) - 1) // k * k, -1, -k):
        last_one = last is not None and low == 0
        # a tree that ends at or below this storey's lowest level has one node here or none, under its top
        rows = nodes.where(f"level >= {low} and level < {low + k}").select("g", "n", "level", "idx", "digest")
        rows = rows.withColumns({"key": F.lit(None).cast("string"), "altered": F.lit(None).cast("binary")})
        if low == 0:
            rows = rows.unionByName(leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest", *[F.col(c).cast(t).alias(c) if last else F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("altered", "binary"))]))
        span = F.pow(F.lit(float(base)), F.lit(low + k) - F.col("level")).cast("long")
        path = [F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split()[0]) for x in PATH.split(", ")]
        members = rows.select("g", F.floor(F.col("idx") / span).cast("long").alias("block"), "n", "level", "idx", "digest", "key", "altered", *path)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("digest", "binary"), ("key", "string"), ("altered", "binary"))]
        lids = above.select("g", F.col("idx").alias("block"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("level"), "idx", *nothing, *[x.split()[0] for x in PATH.split(", ")])
        kind = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        # trees whose top lies lower wait for their storey
        here = rows.select("g").distinct() if low else None
        out = members.unionByName(lids if here is None else lids.join(here, "g", "left_semi")).groupBy("g", "block").applyInPandas(
            storey(base, k, low, last_one), kind if last_one else f"g string, idx long, {PATH}"
        )
        if last_one:
            return out.withColumn("key", F.col("key").cast(last))
        if low:
            out = save(out, "merkle")
            waiting = above.join(here, "g", "left_anti").select("g", "idx", *[x.split()[0] for x in PATH.split(", ")])
            above = out.unionByName(waiting)
        else:
            return out
    raise AssertionError("the lowest storey returns")


def manifest(df: DataFrame, key: str = "doc_id", part: str = "lang", columns: tuple[str, ...] = COLUMNS, base: int = BASE, altered: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, proofs). Nodes: ``g, n, level, idx, digest`` above the leaves, g being ``+`` and the value of ``part`` (empty for null).
    Proofs: key, leaf, subroot, root, proof_sha256 (the hash of the siblings), folded_root, verified, where ``altered`` gives other
    expressions for columns of rows that are held against the manifest."""
    own = {c: F.col(c) for c in columns}
    g = F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit(""))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), g.alias("g"), leaf(own).alias("digest"), (leaf(own | altered) if altered else F.lit(None).cast("binary")).alias("altered"))
    rows = save(rows.withColumn("altered", F.when(F.col("altered") != F.col("digest"), F.col("altered"))), "merkle")
    leaves = save(ranked(rows, ["key", "digest"], ["g"], name="idx", total="n"), "merkle")
    nodes = records(leaves, base)
    tops = nodes.unionByName(leaves.where("n = 1").select("g", "n", F.lit(0).alias("level"), "idx", "digest"))
    # a tree's root is its node at the highest level
    subs = tops.groupBy("g").agg(F.max_by("digest", "level").alias("digest")).withColumn("all", F.lit(""))
    subs = save(ranked(subs, ["g"], ["all"], name="idx", total="n"), "merkle").select(F.col("all").alias("g"), "idx", "n", "digest", F.col("g").alias("sub"))
    over = records(subs, base)
    root = over.unionByName(subs.where("n = 1").select("g", "n", F.lit(0).alias("level"), "idx", "digest")).groupBy("g").agg(F.lower(F.hex(F.max_by("digest", "level"))).alias("root"))
    none = F.array().cast("array<string>")
    ways = descend(subs, over, root.select("g", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), "root"), base, None)
    above = save(ways.select("idx", "before", "after", "root").join(subs, "idx").select(F.col("sub").alias("g"), "before", "after", F.lower(F.hex("digest")).alias("subroot"), "root"), "merkle")
    return nodes, descend(leaves, nodes, above, base, kind).withColumnRenamed("key", key)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, altered={"n_chars": F.when(hit, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))})[1]


def _crc(text: str) -> str:
    """crc32 of ASCII text in SQL, bit by bit."""
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    bits = "list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    return f"xor(list_reduce({byte}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"


def _cell(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


SQL = f"""WITH RECURSIVE rows AS (SELECT *, coalesce('+' || lang, '') AS g, {" || ".join(_cell(c) for c in COLUMNS)} AS own,
        CASE WHEN doc_id IS NOT NULL AND {_crc("coalesce(doc_id, 0)::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n2 FROM documents),
    leaves AS (SELECT doc_id, g, sha256(own) AS leaf, sha256({" || ".join(_cell("n2" if c == "n_chars" else c) for c in COLUMNS)}) AS alt FROM rows),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
    low AS (SELECT g, n, 0 AS level, idx, leaf AS digest FROM placed
        UNION ALL SELECT g, any_value((n + 1) // 2), any_value(level + 1), idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY g, idx // 2),
    subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (SELECT n, 0 AS level, idx, subroot AS digest FROM subs
        UNION ALL SELECT any_value((n + 1) // 2), any_value(level + 1), idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // 2),
    up AS (SELECT doc_id, g, leaf, idx, 0 AS level, n, '' AS path, alt AS fold FROM placed
        UNION ALL SELECT u.doc_id, u.g, u.leaf, u.idx // 2, u.level + 1, (u.n + 1) // 2, path || coalesce(s.digest, ''),
            sha256(CASE WHEN u.idx % 2 = 0 THEN fold || coalesce(s.digest, '') ELSE s.digest || fold END)
        FROM up u LEFT JOIN low s ON s.g = u.g AND s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1),
    mid AS (SELECT u.doc_id, u.g, u.leaf, u.path, u.fold, s.subroot, s.idx, s.n FROM up u JOIN subs s ON u.g = s.g WHERE u.n = 1),
    over AS (SELECT doc_id, g, leaf, subroot, idx, 0 AS level, n, path, fold FROM mid
        UNION ALL SELECT u.doc_id, u.g, u.leaf, subroot, u.idx // 2, u.level + 1, (u.n + 1) // 2, path || coalesce(s.digest, ''),
            sha256(CASE WHEN u.idx % 2 = 0 THEN fold || coalesce(s.digest, '') ELSE s.digest || fold END)
        FROM over u LEFT JOIN high s ON s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1)
    SELECT doc_id, leaf, subroot, r.digest AS root, sha256(path) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
    FROM over, (SELECT digest FROM high WHERE n = 1) r WHERE over.n = 1"""
