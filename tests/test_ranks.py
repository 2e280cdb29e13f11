"""Distributed ranks, permutations, intern, trees by doubling; plans without a window over everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import features, ranks, trees, vocab


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is written by ranks, as text."""
    seen, real = [], ranks.durable

    def watched(df, name="cut"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(ranks, "durable", watched)
    return seen


def test_ranks_within_groups(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("g")).repartition(5)
    got = ranks.ranked(df, ["k"], ["g"], total="n").collect()
    for g in (None, 0, 1):
        mine = sorted((r["k"], r["rank"], r["n"]) for r in got if r["g"] == g)
        assert [x[1] for x in mine] == list(range(len(mine))) and {x[2] for x in mine} == {len(mine)}
    down = {r["k"]: r["rank"] for r in ranks.ranked(df, [F.desc("k")]).collect()}
    assert down == {k: 499 - k for k in range(500)}
    assert ranks.ranked(df.limit(0), ["k"]).count() == 0 and ranks.ranked(df.limit(0), ["k"], ["g"]).count() == 0


def test_no_window_over_everything(spark, plans):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x")], "w string, at long, tag string")
    v = vocab.parser_vocabulary(df, "w", 0)
    made = [
        vocab.first_seen(df, "w", "at"), vocab.most_common(df, "w", 1, "at"), v, vocab.label_dictionary(df, "w"), vocab.frequent(df, "w", 1, 5, "at"),
        vocab.graph_vocabulary(df, "w", "tag", 0), vocab.extend(v.select("item", "id"), df.select(F.col("tag").alias("item"))), vocab.intern(v.select("item", "id"), df, "tag", "at"),
        vocab.tag_dictionary(df, "tag", "at"), vocab.downsample(df, "at", 0.5), features.batches(df.withColumn("b", F.lit(9)), "b", "at", 10),
        features.original_order(df.withColumnRenamed("at", "doc_id"), "w", "tag"), features.shuffled(df, ["at"], 3),
    ]
    for plan in plans + [d._jdf.queryExecution().executedPlan().toString() for d in made]:
        for window in re.findall(r"Window \[.*\n.*\n.*", plan):
            assert "SinglePartition" not in window, window
    assert len(plans) >= 12


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 256, 1000])
def test_permutations_are_bijections(spark, n):
    ids = spark.range(n).select(*[features.permuted(F.col("id"), F.lit(n), s).alias(f"s{s}") for s in (1, 2)]).collect()
    for s in ("s1", "s2"):
        assert sorted(r[s] for r in ids) == list(range(n))
    if n > 16:
        assert [r["s1"] for r in ids] != [r["s2"] for r in ids]
        assert sum(abs(a["s1"] - b["s1"]) == 1 for a, b in zip(ids, ids[1:], strict=False)) < n / 3


def test_shuffles_are_the_same_on_any_partitioning(spark):
    df = spark.range(300).withColumn("b", F.when(F.col("id") < 7, 400).otherwise(F.col("id") % 3 * 10 + 10))
    a = rows(features.shuffled(df, ["id"], 5))
    assert a == rows(features.shuffled(df.repartition(9, "b"), ["id"], 5)) and [x[2] for x in sorted(a, key=lambda x: x[2])] == list(range(300))
    one, two = (features.sampled_batches(df.repartition(k), "b", "id", 100, 1, e) for k, e in ((3, 0), (4, 1)))
    one, two = one.collect(), two.collect()
    assert {(r.id, r.batch, r.slot) for r in one} != {(r.id, r.batch, r.slot) for r in two}
    for got in (one, two):
        assert sorted(r.id for r in got) == list(range(300))  # each row once an epoch
        by = {}
        for r in got:
            by.setdefault(r.batch, []).append(r)
        assert sorted(by) == list(range(len(by)))
        for batch in by.values():
            assert len({r.b for r in batch}) == 1 and sorted(r.slot for r in batch) == list(range(len(batch))) and len(batch) <= max(1, 100 // batch[0].b)


def test_batches_intern_as_one(spark):
    random.seed(1)
    df = spark.createDataFrame([(i, random.choice("abcdefgh") * random.randint(1, 4)) for i in range(200)] + [(200, None)], "at long, w string")
    whole = rows(vocab.intern(None, df, "w", "at"))
    ids = None
    for lo in range(0, 201, 67):
        ids = ranks.durable(vocab.intern(ids, df.where(F.col("at").between(lo, lo + 66)), "w", "at"))
    assert rows(ids) == whole and [x[1] for x in sorted(whole, key=lambda x: x[1])] == list(range(len(whole)))


def test_lookup_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(vocab, "HEAD", 3)
    v = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")] + [("x" * 300, 1000)], "item string, id long")
    df = spark.createDataFrame([(c,) for c in "aabzfed"] + [(None,), ("x" * 300,)], "w string")
    assert sorted((r.w or "", r.id) for r in vocab.lookup(df, "w", v, -1).collect()) == [("", -1), ("a", 0), ("a", 0), ("b", 1), ("d", 3), ("e", 4), ("f", 5), ("x" * 300, 1000), ("z", -1)]


def forest(seed, n):
    random.seed(seed)
    return [(t, i, 0 if i == 1 or random.random() < 0.1 else random.randint(max(1, i - 4), i - 1)) for t in (1, 2) for i in range(1, n + 1)]


def test_trees_against_plain_walks(spark):
    t = forest(4, 40)
    df = spark.createDataFrame(t, "tree_id long, node_id long, parent_id long")
    up = {(a, b): c for a, b, c in t}

    def line(tree, v):
        out = []
        while v := up[tree, v]:
            out.append(v)
        return out

    nodes = sorted(up)
    match = {(a, b) for a, b in nodes if b % 3 == 0}
    pick = df.where("node_id % 3 = 0")
    assert rows(trees.ancestors(df)) == sorted((a, b, x, d + 1) for a, b in nodes for d, x in enumerate(line(a, b)))
    for highest in (False, True):
        want = [(a, b, hit[-1 if highest else 0]) for a, b in nodes if (hit := [x for x in line(a, b) if (a, x) in match])]
        assert rows(trees.nearest_ancestor(df, pick, highest)) == want
    below = {v: [(line(v[0], w).index(v[1]), w) for a, w in match if a == v[0] and v[1] in line(a, w)] for v in nodes}
    assert rows(trees.find_nodes(df, pick)) == [(*v, min(below[v])[1]) for v in nodes if below[v]]
    spans = {(r.tree_id, r.node_id): (r.enter, r.last, r.depth) for r in trees.intervals(df).collect()}
    for a, v in nodes:
        enter, last, depth = spans[a, v]
        assert depth == len(line(a, v))
        assert {w for w in range(1, 41) if enter < spans[a, w][0] <= last} == {w for w in range(1, 41) if v in line(a, w)}
    assert sorted(spans[1, v][0] for v in range(1, 41)) == list(range(40))
    pairs = [(1, a, b) for a in range(1, 41, 3) for b in range(2, 41, 5)]
    want = [(t, a, b, both[0]) for t, a, b in pairs if (both := [x for x in [a, *line(t, a)] if x in [b, *line(t, b)]])]
    assert rows(trees.lowest_common(df, spark.createDataFrame(pairs, "tree_id long, a long, b long"))) == sorted(want)


def test_chain_of_ten_thousand(spark):
    n = 10_000
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("tree_id"), F.col("id").alias("node_id"), (F.col("id") - 1).alias("parent_id"))
    pick = df.where("node_id % 1000 = 0")
    near = trees.nearest_ancestor(df, pick).agg(F.count("*"), F.sum("found")).first()
    assert tuple(near) == (n - 1000, sum((v - 1) // 1000 * 1000 for v in range(1001, n + 1)))
    assert trees.lowest_common(df, spark.createDataFrame([(1, n, 77)], "tree_id long, a long, b long")).first()["lca"] == 77
    got = trees.find_nodes(df, pick).where("node_id in (1, 999, 1000, 9999)")
    assert rows(got) == [(1, 1, 1000), (1, 999, 1000), (1, 1000, 2000), (1, 9999, 10000)]
    assert sum(j.count() for j in trees.jumps(df)) < 14 * n


def test_cycles_are_errors(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2)], "tree_id long, node_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        trees.jumps(df)


def test_random_case_and_ranges(spark):
    from textloom.functions import chars
    from textloom.operators import text

    got = spark.range(4000).select(text.random_case(F.lit("aB"), F.col("id"), 3, 0.25).alias("x")).groupBy("x").count().collect()
    n = {r.x: r["count"] for r in got}
    assert set(n) == {"ab", "AB", "aB"} and all(800 < n[k] < 1200 for k in ("ab", "AB"))
    probe = spark.createDataFrame([("a",), ("m",), ("z",), ("A",)], "c string")
    assert [r.x for r in probe.select(chars.is_range(F.col("c"), "b", "z").alias("x")).collect()] == [False, True, True, False]


def test_scores_of_any_labels(spark):
    from textloom.operators import metrics

    t = spark.createDataFrame([("a", "a"), ("b", "a"), (None, None), ("c", "c")], "g string, p string")
    assert tuple(metrics.accuracy(t, "g", "p").first()) == (4, 2, 0.5)
    assert tuple(metrics.accuracy(t.limit(0), "g", "p").first()) == (0, 0, 0.0)
    gold = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (2, 1, 0, "r"), (3, 1, 0, "r"), (3, 2, 1, "p")], "sid long, dep long, head long, rel string")
    pred = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (1, 2, 0, "more"), (2, 1, 0, "y"), (3, 1, 0, "r")], "sid long, dep long, head long, rel string")
    tags = spark.createDataFrame([(1, 1, "N"), (1, 2, "N"), (2, 1, "N"), (3, 1, "N"), (3, 2, "PU"), (4, 1, "N")], "sid long, dep long, tag string")
    assert tuple(metrics.exact_graphs(gold, pred, tags).first()) == (4, 4, 3)


@pytest.mark.parametrize("name", ["tree_find", "tree_pruned", "tree_intervals", "tree_contains", "tree_descendants", "tree_ancestors", "tree_lca", "tree_nearest", "tree_adopted", "tree_moved", "tree_siblings", "tree_second_order"])
def test_no_tree_is_broadcast(spark, monkeypatch, tmp_path, name):
    """Ids in order take less than a byte a row in Parquet, so that Spark would gather millions of rows in the driver."""
    import __spark_entry__
    from textloom import catalog, catalog_annotations

    rows = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], ranks.durable

    def watched(df, name="cut"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    for module in (ranks, trees, catalog, catalog_annotations):
        monkeypatch.setattr(module, "durable", watched)
    out = __spark_entry__.queries()[name](spark, str(tmp_path))
    plans = [*seen, out._jdf.queryExecution().executedPlan().toString()]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
