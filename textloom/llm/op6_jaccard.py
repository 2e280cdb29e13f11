"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct word n-grams as 64-bit hashes; two documents link when ``den * intersection >= num *
union``. A set is a query against inverted lists: to link, another document must occur in at least T of the query's lists.
DivideSkip splits them: the short lists are merged and counted, the L longest are only probed by binary search for
documents that occur in at least T - L short ones.

Distribution. Equal sets become one class first. By the prefix principle two sets that link share at least l of their
first ``n - ceil(n * num / den) + l`` n-grams in any fixed order; rare ones come first here (frequent n-grams are counted
over all documents; those whose count is in the top steps that hold at most ``HEAVY`` are broadcast, all others count as rare). The threshold applies to
a class as a whole too: one of whose prefix fewer than l n-grams occur in any other prefix links with nothing, and its set is
never built. The other classes that share an n-gram are routed to the smallest of them, their leader. Round one compares each class with the leader
that it shares most n-grams with only, which is linear and joins groups of near copies. Round two searches, among the classes that still share enough
n-grams across components and within each leader's group, all pairs across components, in blocks of bounded size. There it takes one shared n-gram to meet,
so classes are routed by the first ``n - ceil(n * num / den) + 1`` n-grams only. Tasks return links that join components, never all pairs.

Groups are streamed from sorted partitions, one block in memory at a time. Intermediate results are saved to the shared
folder. No partner, candidate or list is capped.

Cases: null, empty or blank text has an empty set and no component but its own; fewer words than n make the whole
sequence one n-gram; rows that share an id are judged by their own text each, as classes of their own (their ids are then numbers beyond
all ids while links are searched); a null id gets a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ranks import ranked

from .common import Forest, binary_views, components, discard, mix64, save, stream_groups, table, word_hashes, words_of

HEAVY = 500_000
HEAVY_LOCAL = 2
CHUNK = 2_000_000
BLOCK_TOKENS = 2_000_000
MU = 0.01


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set of word k-gram hashes."""
    w = word_hashes(words_of(text))
    if not len(w):
        return w
    k = min(k, len(w))
    acc = mix64(w[: len(w) - k + 1] + np.uint64(k))
    for j in range(1, k):
        acc = mix64(acc * np.uint64(3) + w[j : len(w) - k + 1 + j])
    return np.unique(acc)


def least_overlap(a: int, b, num: int, den: int):
    """The least intersection with which sets of a and b elements link."""
    return -(-num * (a + b) // (num + den))


def heavy_hitters(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams, sorted, with their counts; counted over all documents in chunks of ``CHUNK`` n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= HEAVY_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), k)
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = save(texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    step = F.floor(F.log2("n") * 16).cast("int")  # at most 1,024 steps, so that no task or driver orders all counts
    sizes = sorted((r["step"], r["m"]) for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect())
    least, room = 1024, HEAVY
    for at, m in reversed(sizes):
        room -= m
        if room < 0:
            break
        least = at
    top = found.where(step >= least).toArrow()  # at most HEAVY rows; bounds the table of the order, not the search
    discard(found)
    token, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    at = np.argsort(token)
    return token[at], n[at]


def prefix(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first n-grams of a set in the common order: those that aren't frequent by hash, then the others by count."""
    token, count = heavy
    freq = np.zeros(len(s), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        freq = np.where(token[at] == s, count[at], 0)
    n = len(s) - -(-len(s) * num // den) + shared(len(s), num, den)
    return s[np.lexsort((s, freq))[:n]]


def shared(n: int, num: int, den: int) -> int:
    """How many n-grams of their prefixes two sets share if they link and the smaller has n."""
    return 1 + n * (den - num) // (2 * den)


def describe(docs: DataFrame, k: int, num: int, den: int, heavy) -> DataFrame:
    """``doc_id, n, digest, prefix`` and what follows the text; ``docs`` has doc_id and text first."""
    more = docs.columns[2:]
    sent = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                n, digest, first = [], [], []
                for t in b.column(1):
                    s = shingles(t.as_py(), k)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    first.append(prefix(s, sent.value, num, den).view(np.int64) if len(s) else [])
                own = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, *b.columns[2:]], ["doc_id", "n", "digest", "prefix", *more])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>" + kept)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``rep, set`` for the classes in ``wanted`` (rep, doc, digest), from the text of the document that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                out, rep = [], []
                for i, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    s = shingles(t, k).tobytes()
                    if xxhash.xxh3_128_digest(s) == d:
                        rep.append(i)
                        out.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(out, pa.binary())], ["rep", "set"])

    mine = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted.hint("shuffle_hash"), "doc")
    return mine.select("rep", "digest", "text").mapInArrow(run, "rep long, set binary")


LINKS = "u long, v long"


def _links(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def star_links(num: int, den: int):
    """Links of each group's leader: rows of leader, block, rep, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _), rows in stream_groups(batches, 2):
            rep, sets = rows.column(2).to_numpy(), binary_views(rows.column(3))
            own = next((s for r, s in zip(rep, sets, strict=True) if r == leader), None)
            if own is None or len(sets) < 2:
                continue
            size = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            hit = (both >= least_overlap(len(own), size, num, den)) & (rep != leader)
            if hit.any():
                yield _links([leader] * int(hit.sum()), rep[hit].tolist())

    return run


def search(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (of positions) that link sets of different components, enough of them to join all that link.

    T-occurrence with DivideSkip; every set outside of the largest component is a query against all.
    """
    kinds, comp = np.unique(comp, return_inverse=True)
    if len(kinds) < 2:
        return []
    size = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")  # so that each list is sorted by document
    token, start = np.unique(every[order], return_index=True)
    docs, end = owner[order], np.append(start[1:], len(every))
    forest = Forest(len(kinds))
    largest = np.bincount(comp).argmax()
    out = []
    for q in np.flatnonzero(comp != largest):
        at = np.searchsorted(token, sets[q])
        at = at[np.argsort(end[at] - start[at], kind="stable")]
        need = -(-int(size[q]) * num // den)
        longest = int(end[at[-1]] - start[at[-1]])
        if longest == 1:
            continue
        n_long = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        short = at[: len(at) - n_long]
        count = np.bincount(np.concatenate([docs[start[i] : end[i]] for i in short]), minlength=0)
        found = np.flatnonzero(count >= need - n_long)
        found = found[(size[found] * den >= size[q] * num) & (size[q] * den >= size[found] * num) & (comp[found] != comp[q])]
        if not len(found):
            continue
        total = count[found]
        for left, i in enumerate(at[len(at) - n_long :][::-1]):
            run = docs[start[i] : end[i]]
            p = np.minimum(np.searchsorted(run, found), len(run) - 1)
            total = total + (run[p] == found)
            alive = total + (n_long - left - 1) >= need
            if not alive.all():
                found, total = found[alive], total[alive]
                if not len(found):
                    break
        for x in found[total >= least_overlap(int(size[q]), size[found], num, den)]:
            if forest.union(int(comp[q]), int(comp[x])):
                out.append((int(q), int(x)))
    return out


def block_links(num: int, den: int):
    """Links across components: rows of leader, i, j, rep, set, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in stream_groups(batches, 3):
            rep, comp = rows.column(3).to_numpy(), rows.column(5).to_numpy()
            found = search(binary_views(rows.column(4)), comp, num, den)
            if found:
                yield _links([int(rep[a]) for a, _ in found], [int(rep[b]) for _, b in found])

    return run


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text), ``group_id`` (a number that rows of one component share and
    no others; null for empty sets), and the other columns of ``docs``, which must not have these names."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *more)
    seen = save(describe(docs, k, num, den, heavy_hitters(docs.select("text"), k)), "described")
    sound = "digest is not null and doc_id is not null"
    classes = save(seen.where(sound).groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")).withColumn("rep", F.col("doc")), "classes")
    twice = classes.groupBy("doc").agg(F.count("*").alias("c"), F.min("digest").alias("first")).where("c > 1")
    shared_ids = not twice.isEmpty()
    if shared_ids:  # texts under one id: all classes but one of them get numbers of their own
        last = int(classes.agg(F.max("doc")).first()[0])
        clash = classes.join(twice.select("doc", "first"), "doc").where("digest <> first").select("digest")
        numbers = ranked(clash, ["digest"]).select("digest", (F.col("rank") + last + 1).alias("number"))
        classes = save(classes.join(numbers, "digest", "left").withColumn("rep", F.coalesce("number", "doc")).drop("number"), "classes")
    first_rows = seen.where(sound).select("doc_id", "digest", "prefix").join(classes.select("digest", "rep", F.col("doc").alias("doc_id")).hint("shuffle_hash"), ["digest", "doc_id"])
    rows = first_rows.select("rep", F.explode("prefix").alias("token"))
    lists = rows.groupBy("token").agg(F.min("rep").alias("leader"), F.count("*").alias("many")).where("many > 1").drop("many")
    met = save(rows.join(lists, "token").groupBy("leader", "rep").agg(F.count("*").alias("c")), "met")
    fewest = F.lit(1) + F.floor(F.ceil(F.col("n") * num / den) * (den - num) / (2 * den))  # shared() of the smallest partner
    wanted = met.groupBy("rep").agg(F.sum("c").alias("c")).join(classes, "rep").where(F.col("c") >= fewest).select("rep", "doc", "digest", "n")
    wanted = save(wanted, "wanted")
    sets = save(sets_of(docs, wanted.select("rep", "doc", "digest"), k), "sets")

    # round one: each class against the leader with which it shares most
    best = met.where("leader <> rep").groupBy("rep").agg(F.max(F.struct("c", (-F.col("leader")).alias("col2"))).alias("b"))
    pairs = best.select("rep", (-F.col("b.col2")).alias("leader")).join(wanted, "rep").select("leader", "rep", "n")
    routed = save(pairs.unionAll(pairs.select("leader").distinct().join(wanted.withColumnRenamed("rep", "leader"), "leader").select("leader", F.col("leader").alias("rep"), "n")), "routed")
    blocks = routed.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("b"), F.count("*").alias("many")).where("many > 1")
    placed = routed.where("leader <> rep").join(blocks, "leader").select(
        "leader", F.pmod(F.xxhash64("rep"), "b").cast("long").alias("block"), "rep"
    ).unionAll(blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b").cast("long") - 1)).alias("block"), F.col("leader").alias("rep")))
    dealt = placed.join(sets, "rep").select("leader", "block", "rep", "set").repartition("leader", "block").sortWithinPartitions("leader", "block")
    first = save(dealt.mapInArrow(star_links(num, den), LINKS), "star")
    comp = save(components(first), "comp")

    discard(met)

    # round two: across the components that are left in a leader's group
    # a link across components shares n-grams whose lists hold several components, and as many as shared() says
    known = wanted.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "digest", "n", F.coalesce("component", "rep").alias("comp"))
    prefixes = first_rows.select("digest", "prefix").join(known.select("digest", "rep", "comp", "n").hint("shuffle_hash"), "digest")
    hits = prefixes.select("rep", "comp", (F.col("n") - F.ceil(F.col("n") * num / den) + 1).alias("short"), F.posexplode("prefix").alias("pos", "token"))
    hits = hits.select("rep", "comp", "token", (F.col("pos") < F.col("short")).alias("routes"))
    router = F.when(F.col("routes"), F.col("comp"))
    mixed = hits.groupBy("token").agg(
        F.min("comp").alias("a"), F.max("comp").alias("z"), F.min(router).alias("ra"), F.max(router).alias("rz"), F.min("rep").alias("leader")
    ).where("a < z").select("token", "leader", F.coalesce(F.col("ra") < F.col("rz"), F.lit(False)).alias("open"))
    across = hits.join(mixed, "token").groupBy("leader", "rep", "comp").agg(F.count("*").alias("c"), F.max(F.col("routes") & F.col("open")).alias("routes"))
    across = save(across, "across")
    enough = across.groupBy("rep").agg(F.sum("c").alias("c")).join(known.select("rep", "n"), "rep").where(F.col("c") >= fewest).select("rep", "n")
    known = save(across.where("routes").join(enough, "rep").select("leader", "rep", "n", "comp"), "known")
    open_ = (
        known.groupBy("leader").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("b"))
        .where("a < z").select("leader", "b")
    )
    mine = known.join(open_, "leader").withColumn("own", F.pmod(F.xxhash64("rep"), "b").cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.least("own", j.cast("long")).alias("i"), F.greatest("own", j.cast("long")).alias("j")))
    spread = mine.select("leader", "rep", "comp", F.inline(pairs))
    dealt = (
        spread.join(sets, "rep").select("leader", "i", "j", "rep", "set", "comp")
        .repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    )
    second = save(dealt.mapInArrow(block_links(num, den), LINKS), "across")
    final = components(first.unionAll(second))

    by_class = classes.select("digest", "doc", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("group_id", F.coalesce("component", "rep"))
    if shared_ids:  # the smallest id of a component is no longer its number
        by_class = save(by_class, "groups")
        by_class = by_class.join(by_class.groupBy("group_id").agg(F.min("doc").alias("least")), "group_id").select("digest", "group_id", F.col("least").alias("component_id"))
    else:
        by_class = by_class.select("digest", "group_id", F.col("group_id").alias("component_id"))
    return seen.select("doc_id", "n", "digest", *more).join(by_class, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"), *more,
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("group_id")


#: Every pair that shares a shingle, then the smallest id in reach.
SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 90 * (a.n + b.n - k)),
    reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = d.doc_id"""
