"""Goldens of spacing, tags, vectors, buckets, decoders, trees, sources and components."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import decoders, english, features, metrics, tags, text, tokens, trees, vocab
from textloom.plans import components
from textloom.plans.pipeline import Pipeline
from textloom.sources import columns
from textloom.streaming.counts import running_vocabulary


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_spaces_and_plain_text(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate('He said ( " hi " ) , ca n\'t \'s .'.split())], "sid int, tid int, tok string")
    assert text.plain_text(text.infer_spaces(t)).first().plain == "He said (\"hi\"), can't's."
    u = spark.createDataFrame([(1, 0, "a", "X", "O"), (1, 1, "b", None, ""), (1, 2, "c", "Y", "Z")], "sid int, tid int, tok string, p string, q string")
    assert text.tagged_text(u, "p", "q").first().tagged == "a <X> b c <Y/Z>"


@pytest.mark.parametrize("given_,want", [("123", "000"), ("1-2", "0"), ("$1.5%", "00"), ("a1", "a0"), ("", ""), ("#12", "00"), ("x.y", "x.y"), ("1,234", "000"), ("5%", "0")])
def test_collapse_digits(spark, given_, want):
    got = spark.createDataFrame([(given_,)], "s string").select(text.collapse_digits(F.col("s")).alias("x")).first().x
    def by_hand(s):
        out, last, digit = "", "", [c.isdigit() for c in s]
        for i, c in enumerate(s):
            after, before = i + 1 < len(s) and digit[i + 1], i > 0 and digit[i - 1]
            gone = (c in "$.-+#" or (before and c in "-,:/=")) if after else (c == "%") if before else digit[i] and last == "0"
            if not gone:
                last = "0" if digit[i] else c
                out += last
        return out
    assert got == by_hand(given_)
    if given_ in ("123", "1-2", "a1", "x.y", ""):
        assert got == want


def test_suffix_difference(spark):
    pairs = [("studies", "study", "+ies"), ("take", "taken", "-n"), ("running", "run", "+ing"), ("x", "y", ""), ("clown", "clan", "+ow+"), ("same", "same", "-")]
    got = spark.createDataFrame(pairs, "a string, b string, w string").select(text.suffix_difference(F.col("a"), F.col("b")).alias("x"), "w").collect()
    assert [r.x for r in got] == [r.w for r in got]


@pytest.mark.parametrize("given_,want", [
    ("B-A B-A", "B-A L-A"), ("B-A B-C", "U-A U-C"), ("B-A O", "U-A O"), ("I-A", "L-A"), ("O I-A L-A", "O B-A L-A"), ("O L-A", "O U-A"), ("B-A I-A O", "B-A L-A O"),
    ("B-A U-A", "B-A L-A"), ("B-A U-C", "U-A U-C"), ("B-A I-A B-C", "B-A L-A U-C"), ("U-A I-C L-C", "U-A B-C L-C"), ("", ""), ("O O", "O O"),
])
def test_bilou_repair(spark, given_, want):
    got = spark.createDataFrame([(given_.split(),)], "t array<string>").select(tags.repaired(F.col("t")).alias("t")).first().t
    assert " ".join(got) == want


def test_schemes(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate("I-A I-A I-B O".split())], "sid int, tid int, tag string")
    assert [r.tag for r in tags.convert_scheme(t, "iob", "iobes").orderBy("tid").collect()] == ["B-A", "E-A", "S-B", "O"]
    with pytest.raises(ValueError):
        tags.convert_scheme(t, "x", "y")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "?!", '"', ")", "”"]), max_size=12))
def test_both_segmentations_agree(spark, toks):
    spans = spark.createDataFrame([(toks,)], "t array<string>").select(F.inline(tokens.segment(F.col("t")))).collect() if toks else []
    assert [i for i, s in enumerate(spans) for _ in range(s.end - s.begin)] == english.sentence_ids(toks)


def test_segment_modes():
    lex = english.Lexicon()
    told = lambda mode: [(s, t[0]) for s, t in english.sentences_of("One. Two\n\nthree.", lex, 0, mode)]
    assert [s for s, _ in told(0)] == [0] * 5 and [s for s, _ in told(1)] == [0, 0, 0, 1, 1] and [s for s, _ in told(2)] == [0, 0, 1, 1, 1] and [s for s, _ in told(3)] == [0, 0, 1, 2, 2]
    assert english.sentences_of(None, lex, 0, 3) == []
    for mode in range(4):
        assert all("One. Two\n\nthree."[b:e] == t for _, (t, b, e) in english.sentences_of("One. Two\n\nthree.", lex, 0, mode))


def test_length_splits_and_their_padding():
    h = {int(n): int(c) for n, c in zip(*np.unique(np.random.default_rng(1).integers(1, 60, 500), return_counts=True), strict=True)}
    got = features.length_splits(h, 4)
    cost = lambda s: sum(c * min(x for x in s if x >= n) for n, c in h.items())
    even = [sorted(itertools.chain.from_iterable([n] * c for n, c in h.items()))[i * 125 - 1] for i in range(1, 5)]
    assert got == sorted(set(got)) and len(got) == 4 and got[-1] == max(h) and cost(got) <= cost(even)
    assert features.length_splits({5: 100, 6: 1, 7: 1}, 3) == [5, 6, 7]
    with pytest.raises(ValueError):
        features.length_splits({5: 1}, 2)


def test_vectors_and_batches(spark):
    table = spark.createDataFrame([("Ab", [1.0]), ("ab#", [2.0]), ("0", [3.0])], "word string, vector array<double>")
    t = spark.createDataFrame([("Ab",), ("AB7",), ("5",), ("zz",), (None,)], "w string")
    assert {r.w: r.vector for r in features.word_vectors(t, "w", table, 1).collect()} == {"Ab": [1.0], "AB7": [2.0], "5": [3.0], "zz": [0.0], None: [0.0]}
    b = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 6, 0), (2, 0, 7, 1)], "g int, i int, x int, y int")
    assert rows(features.padded_batch(b, "g", "i", "x", "y")) == [(1, [5, 6], [1, 0]), (2, [7, 0], [1, -1])]


def test_paths_against_all_paths(spark):
    rng = np.random.default_rng(2)
    s, t, a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    total = lambda p: a[p[0]] + b[p[-1]] + sum(s[i, x] for i, x in enumerate(p)) + sum(t[y, x] for x, y in zip(p, p[1:], strict=False))
    best = max(itertools.product(range(3), repeat=4), key=total)
    assert decoders.bounded_path(s, t, a, b) == (pytest.approx(total(best)), pytest.approx(np.array(best)))
    soft, pos = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True), np.abs(t)
    product = lambda p: np.prod([soft[i, x] for i, x in enumerate(p)]) * np.prod([pos[x, y] for x, y in zip(p, p[1:], strict=False)])
    assert tuple(decoders.softmax_path(s, pos)) == max(itertools.product(range(3), repeat=4), key=product)
    e = spark.createDataFrame([(1, i, [float(x) for x in r]) for i, r in enumerate(s)], "sid long, tid long, scores array<double>")
    assert [r.tag_id for r in decoders.decode_paths(e, t.tolist(), start=a.tolist(), stop=b.tolist()).orderBy("tid").collect()] == list(best)
    assert decoders.plateau_rates([1, 1, 1, 1, 0.5], 1.0, 0.5, 1) == [1.0, 1.0, 0.5, 0.5, 0.5]


def test_metric_adds_up():
    m = metrics.EvalMetric().update({1, 2}, {2, 3}).update({4}, {4})
    assert m.get() == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))
    m.reset()
    assert m.get() == (0.0, 0.0, 0.0)


def test_tree_edits(spark):
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2)], "tree_id long, node_id long, parent_id long")
    pick = lambda *n: spark.createDataFrame([(1, x) for x in n], "tree_id long, node_id long")
    assert rows(trees.adopt(t, pick(2)).select("node_id", "parent_id")) == [(1, 0), (3, 1), (4, 1)]
    assert rows(trees.prune(t, pick(3, 4)).select("node_id")) == [] and rows(trees.prune(t, pick(3)).select("node_id")) == [(1,), (2,), (4,)]
    assert rows(trees.single_chain(t).select("node_id", "lowest")) == [(1, 2), (2, 2), (3, 3), (4, 4)]


def test_strict_lookup(spark):
    v = spark.createDataFrame([("a", 3)], "item string, id long")
    assert vocab.strict_lookup(spark.createDataFrame([("a",)], "w string"), "w", v).first().id == 3
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.strict_lookup(spark.createDataFrame([("b",)], "w string"), "w", v).collect()


def test_sinks_and_readers(spark, tmp_path):
    t = spark.createDataFrame([(s, i, f"{s}{i}") for s in (2, 1) for i in (1, 0)], "sid int, tid int, line string")
    columns.write_sentences(t, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "10\n11\n\n20\n21\n\n"
    (tmp_path / "x.tsv").write_text("a X\nb Y\n\nc Z")
    c = columns.fetch_corpus(spark, str(tmp_path / "x.tsv"), {"tok": 0, "pos": 1}, listed=spark.createDataFrame([(1,)], "sid int"))
    assert rows(c.select("part", "tok")) == [("dev", "c"), ("train", "a"), ("train", "b")]
    d = columns.to_documents(c, "tok", "pos").first()
    assert [(s.tok, s.gold) for s in d.sens] == [(["a", "b"], ["X", "Y"]), (["c"], ["Z"])]
    columns.write_json(columns.to_documents(c), str(tmp_path / "j"))
    assert [json.loads(line)["sens"][1]["tok"] for f in (tmp_path / "j").glob("part-*") for line in f.read_text().splitlines()] == [["c"]]
    (tmp_path / "r.xml").write_text('<all><affix form="s" org_pos="NN"><rule affix_form="ies" replacements="y" doubleConsonants="false"/><rule affix_form="s" replacements=""/></affix></all>')
    assert rows(columns.read_suffix_rules(spark, str(tmp_path / "r.xml"))) == [("s", "NN", 0, "ies", ["y"], False), ("s", "NN", 1, "s", [""], False)]
    (tmp_path / "w.txt").write_text("a b\n c \n\na b\n")
    assert rows(columns.read_words(spark, str(tmp_path / "w.txt"))) == [("a b",), ("c",)] and rows(columns.read_pairs(spark, str(tmp_path / "w.txt"))) == [("a", "b"), ("a", "b")]
    import hashlib

    assert columns.checksums(spark, str(tmp_path / "w.txt")).first().sha1 == hashlib.sha1((tmp_path / "w.txt").read_bytes()).hexdigest()
    eight = F.split(F.lit("1 form lemma X _ 2 dep _"), " ")
    assert spark.range(1).select(columns.eight_to_ten(eight).alias("x")).first().x == "1\tform\tlemma\tX\t_\t_\t2\tdep\t_\t_"
    assert spark.range(1).select(columns.scored_line(F.lit("a"), F.lit("b"), F.lit("c")).alias("x")).first().x == "a b c"


class Tokens(components.DocumentComponent):
    def __init__(self, init: int):
        self.init = init

    def decode(self, df):
        return tokens.space_tokens(df, self.init)


def test_components(spark, tmp_path):
    Tokens(3).save(str(tmp_path / "c.json"))
    again = components.Component.load(str(tmp_path / "c.json"))
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(Pipeline(again, lambda t: t.select("begin"), needs=("doc_id",))(df)) == [(3,), (5,)]
    with pytest.raises(ValueError):
        again(df.select("doc_id"))
    assert components.overlay({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3} and components.data_dir(spark).endswith(".textloom")
    with components.Timer() as t:
        pass
    assert t.rate(10) > 0
    assert rows(running_vocabulary(df)) == [("a", 1), ("b", 1)]
    assert spark.range(1).select(metrics.perplexity(F.lit(0.0)).alias("x")).first().x == 1.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["detokenize", "plain_text"])
def test_texts_are_shuffled_whole(spark, tmp_path, name):
    """A row a token made the shuffle several times the input."""
    import __spark_entry__

    data = [(1, 'b "a'), (1, "a c"), (2, None), (3, " \n"), (4, 'x, "y" (z)'), (None, "n")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert "Generate" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
    want = {"detokenize": {1: 'a b "a c', 4: 'x, "y" (z)', None: "n"}, "plain_text": {1: 'a b "c a', 4: 'x, "y" (z)', None: "n"}}[name]
    assert {r[0]: r["plain"] for r in out.collect()} == want


def test_spaced_text_is_plain_text(spark):
    import random

    random.seed(3)
    signs = ['"', '"', "(", ")", ".", ",", "a", "n't", "'", "'s", "!", "(a", 'a"b', "\xa0", "￿"]
    df = spark.createDataFrame([(i, random.choices(signs, k=random.randint(1, 14))) for i in range(500)], "sid long, toks array<string>")
    rowwise = text.plain_text(text.infer_spaces(df.select("sid", F.posexplode("toks").alias("tid", "tok"))))
    assert rows(df.select("sid", text.spaced_text(F.col("toks")))) == rows(rowwise)


def test_morphs_read_the_texts_once(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from textloom import catalog
    from textloom.operators import morphology, ranks

    spark.createDataFrame([(1, "Walk walked happiness happy unhappy"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for module in (catalog, morphology):
        monkeypatch.setattr(module, "durable", lambda df, name="cut": seen.append(plan(df)) or ranks.durable(df, name))
    out = __spark_entry__.queries()["morphs"](spark, str(tmp_path))
    assert sum("regexp_extract_all" in p for p in [*seen, plan(out)]) == 1
    got = {r["form"]: r["morphs"] for r in out.collect()}
    assert len(got) == 5 and got["walked"] == "walk/VB +ed/I_PST" and got["unhappy"] == "happy/NN un+/P"


def test_edges_are_counted_in_one_aggregation(spark):
    gold = spark.createDataFrame([(1, 1, 0, "r"), (1, 1, 0, "r"), (1, 2, 1, "x"), (2, 1, 0, "r")], "sid long, dep long, head long, rel string")
    pred = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (1, 2, 1, "x"), (2, 1, 0, "y"), (3, 1, 0, "r")], "sid long, dep long, head long, rel string")
    out = metrics.smoothed_f1(gold, pred)
    assert tuple(out.first()) == (0.5, 0.666667, 0.571429, 0.666667)
    assert plan(out).count("HashAggregate(keys=[sid") == 4 and plan(out).count("Exchange hashpartitioning(sid") == 2
