"""Path weights over rows, padded batches, dependency parses."""

import itertools

import numpy as np
import pytest

from textloom.operators import decoders


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("piece", [2, 3, 256])
def test_losses_against_all_paths(spark, piece):
    rng = np.random.default_rng(piece)
    k = 3
    t, a, z = rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k)
    sents = {sid: (rng.normal(size=(n, k)), rng.integers(0, k, n)) for sid, n in ((1, 1), (2, 2), (3, 5), (9, 7))}
    data = [(sid, 10 * i + 3, [float(x) for x in s[i]], None if sid == 9 and i == 4 else int(g[i])) for sid, (s, g) in sents.items() for i in range(len(s))]
    df = spark.createDataFrame(data, "sid long, tid long, scores array<double>, tag_id int").repartition(5)
    got = {r.sid: r for r in decoders.crf_losses(df, t.tolist(), a.tolist(), z.tolist(), piece).collect()}
    assert sorted(got) == sorted(sents)
    for sid, (s, g) in sents.items():
        def score(p, s=s):
            return a[p[0]] + z[p[-1]] + sum(s[i, x] for i, x in enumerate(p)) + sum(t[y, x] for x, y in itertools.pairwise(p))

        total = np.logaddexp.reduce([score(p) for p in itertools.product(range(k), repeat=len(s))])
        assert got[sid].n == len(s) and got[sid].log_partition == pytest.approx(total)
        if sid == 9:
            assert got[sid].gold is None and got[sid].loss is None
        else:
            assert got[sid].gold == pytest.approx(score(g)) and got[sid].loss == pytest.approx(total - score(g))
            assert decoders.path_loss(s, g, t, a, z) == pytest.approx(got[sid].loss)
    assert decoders.crf_losses(df.limit(0), t.tolist(), a.tolist(), z.tolist()).count() == 0


def test_long_sentence_is_folded_in_pieces(spark):
    n = 3000
    df = spark.range(n).selectExpr("1L AS sid", "id AS tid", "array(sin(id), cos(id)) AS scores", "CAST(id % 2 AS int) AS tag_id")
    t, a, z = [[0.1, -0.2], [0.3, 0.0]], [0.5, 0.0], [0.0, -0.5]
    got = decoders.crf_losses(df, t, a, z, 16).first()
    s = np.stack([np.sin(np.arange(n)), np.cos(np.arange(n))], axis=1)
    assert got.log_partition == pytest.approx(decoders.log_partition(s, np.array(t), np.array(a), np.array(z)))


def test_batches_read_back(spark):
    rng = np.random.default_rng(0)
    sents = {sid: rng.normal(size=(n, 4)) for sid, n in ((5, 3), (1, 1), (2, 8), (7, 2), (3, 3))}
    df = spark.createDataFrame([(sid, i, [float(x) for x in r]) for sid, s in sents.items() for i, r in enumerate(s)], "sid long, tid long, scores array<double>")
    batches = decoders.padded_scores(df, [2, 4, 8], 6)
    for b in batches.collect():
        assert len({len(s) for s in b.scores}) == 1 == len({len(x) for s in b.scores for x in s}) and max(b.lengths) == len(b.scores[0])
    labels = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "cid int, item string")
    want = sorted((sid, i, "abc"[int(r[:3].argmax())]) for sid, s in sents.items() for i, r in enumerate(s))
    assert rows(decoders.decoded_batches(batches, labels)) == want
    with pytest.raises(Exception, match="longer than all buckets"):
        decoders.padded_scores(df, [2, 4], 6).collect()


def all_trees(n):
    """Heads of nodes 1..n-1 that make a tree with one child of node 0."""
    for heads in itertools.product(range(n), repeat=n - 1):
        up = (0, *heads)
        if sum(h == 0 for h in heads) != 1:
            continue
        if all(any(v == 0 for v in itertools.accumulate(range(n), lambda v, _: up[v], initial=x)) for x in range(1, n)):
            yield heads


def test_parses_against_exhaustive_search(spark):
    """Where the likeliest heads make a tree they are the best of all trees; else the result is a tree, and not better than the best."""
    rng = np.random.default_rng(4)
    data, same = [], 0
    for sid in range(120):
        n = int(rng.integers(1, 6))
        data.append((sid, n, [float(x) for x in rng.normal(size=n * n)], [float(x) for x in rng.normal(size=n * n * 4)]))
    got = {}
    for r in decoders.parsed(spark.createDataFrame(data, "sid long, n int, arcs array<double>, relations array<double>"), [3, 6], 60).collect():
        got.setdefault(r.sid, {})[r.tid] = (r.head, r.rel_id)
    for sid, n, arcs, rel in data:
        if n == 1:
            assert sid not in got
            continue
        x = np.array(arcs).reshape(n, n)
        p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        heads = tuple(got[sid][i][0] for i in range(1, n))
        trees = {h: np.prod([p[i + 1, v] for i, v in enumerate(h)]) for h in all_trees(n)}
        assert heads in trees
        free = p * (1 - np.eye(n))
        if tuple(free[1:].argmax(axis=1)) in trees:
            same += 1
            assert trees[heads] == pytest.approx(max(trees.values()))
        r = np.array(rel).reshape(n, n, 4)
        rels = [got[sid][i][1] for i in range(1, n)]
        assert rels.count(0) == 1 and 1 not in rels
        for i in range(1, n):
            if rels[i - 1] != 0 and r[i, heads[i - 1]].argmax() not in (0, 1):
                assert rels[i - 1] == r[i, heads[i - 1]].argmax()
    assert same > 20
