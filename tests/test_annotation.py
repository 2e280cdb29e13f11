"""Lemmas, chunk boundaries, readers, tree repair and path weights against small worked cases."""

import itertools
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.operators import decoders, lemmas, metrics, text
from textloom.sources import columns

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lemmas", "coarse_tags", "conll_chunks", "edge_scores", "model_split"])
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(map(str, x[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)


def test_lemmas(spark):
    bases = spark.createDataFrame([("VB", "study"), ("VB", "run"), ("VB", "take"), ("NN", "focus"), ("JJ", "big"), ("VB", "heed")], "lexicon string, base string")
    words = [("Studies", "VBZ"), ("running", "VBG"), ("taking", "VBG"), ("foci", "NNS"), ("biggest", "JJS"), ("ran", "VBD"), ("xyz", "NN"), ("two", "CD"), ("'ll", "MD"), (None, "NN")]
    t = spark.createDataFrame(words, "form string, pos string")
    exc, abb = spark.createDataFrame([("VB", "ran", "run")], "lexicon string, form string, lemma string"), spark.createDataFrame([("'ll", "MD", "will")], "form string, pos string, lemma string")
    got = {r["form"]: r["lemma"] for r in lemmas.lemmas(t, bases, exc, abb, cardinals=["two"]).collect()}
    assert got == {"Studies": "study", "running": "run", "taking": "take", "foci": "focus", "biggest": "big", "ran": "run", "xyz": "xyz", "two": "#crd#", "'ll": "will", None: None}


def test_conll_chunks(spark):
    gold, pred = ["B-P", "I-P", "O", "S-L", "S-L", "E-P", "B-P"], ["B-P", "I-P", "O", "S-L", "O", "E-P", "B-P"]
    t = spark.createDataFrame([(1, i, g, p) for i, (g, p) in enumerate(zip(gold, pred, strict=True))], "sid long, tid long, gold string, pred string")
    got = {r["type"]: (r["gold"], r["predicted"], r["correct"]) for r in metrics.conll_chunks(t).collect()}
    assert got == {"*": (3, 3, 2), "P": (2, 2, 2), "L": (1, 1, 0)}  # S S is one chunk, and so is E B


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\ta\t_\tX\t_\t2\tr\t0:q|3:s\n2\tb\t_\tY\t_\t0\troot\t_\n\n1 c _ Z _ _ 0 root _ _")
    got = [tuple(r) for r in columns.read_dependencies(spark, str(tmp_path)).select("sid", "tid", "form", "pos", "head", "rel").orderBy("sid", "tid").collect()]
    assert got == [(0, 0, "a", "X", 2, "r"), (0, 1, "b", "Y", 0, "root"), (1, 0, "c", "Z", 0, "root")]
    edges = {tuple(r) for r in columns.read_semantic_edges(spark, str(tmp_path)).where("sid = 0").select("dep", "head", "rel").collect()}
    assert edges == {(1, 2, "r"), (1, 0, "q"), (1, 3, "s"), (2, 0, "root")}
    lines = spark.createDataFrame([("__label__a __label__b x y",), ("no label",), ("__label__a ",)], "v string")
    got = lines.select(columns.labelled_text(F.col("v")).alias("x")).where("x is not null").select("x.*").collect()
    assert [(r["labels"], r["text"]) for r in got] == [(["a", "b"], "x y")]
    (tmp_path / "v.vec").write_text("2 3\na 1 2 3\nb 4 5\nc 0 0 1\n")
    assert [tuple(r) for r in columns.read_vectors(spark, str(tmp_path / "v.vec"), 3).collect()] == [("a", [1.0, 2.0, 3.0]), ("c", [0.0, 0.0, 1.0])]
    (tmp_path / "d.json").write_text('[{"doc_id": 4, "sens": [{"tok": ["a", "b"], "pos": ["X", "Y"]}]}]')
    got = columns.read_documents_json(spark, str(tmp_path / "d.json"), "pos").orderBy("tid").collect()
    assert [(r["doc_id"], r["sid"], r["tid"], r["tok"], r["pos_gold"]) for r in got] == [(4, 0, 0, "a", "X"), (4, 0, 1, "b", "Y")]


def test_repaired_trees():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 9, 20) * 20:
        h = decoders.repaired_heads(rng.random((n, n)))
        assert (h[1:] == 0).sum() == 1
        for x in range(1, n):
            for _ in range(n):
                x = h[x]
            assert x == 0
        r = decoders.relations(rng.random((n, 5)), 1, 0)
        assert (r[1:] == 1).sum() == 1 and (r != 0).all()


def test_path_weights():
    rng = np.random.default_rng(1)
    s, t, a, z = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    p = [np.exp(-decoders.path_loss(s, np.array(x), t, a, z)) for x in itertools.product(range(3), repeat=4)]
    assert abs(sum(p) - 1) < 1e-9 and sys.float_info.epsilon < min(p)


def test_coarse_and_prefix(spark):
    t = spark.createDataFrame([("NNS", "study", "studies"), ("??", "a", "b")], "p string, a string, b string")
    assert [tuple(r) for r in t.select(lemmas.coarse(F.col("p")), text.common_prefix(F.col("a"), F.col("b"))).collect()] == [("NN", 4), ("XX", 0)]
