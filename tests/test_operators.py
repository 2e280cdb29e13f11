"""Small goldens of the library's own operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import chars
from textloom.operators import decoders, features, metrics, tags, tokens, trees, vocab
from textloom.sources.columns import read_columns, read_conll_u


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_space_tokens_have_slices_as_offsets(spark):
    text = "  a bb\tccc\n"
    got = tokens.space_tokens(spark.createDataFrame([(1, text), (2, " "), (3, None)], "doc_id long, text string")).collect()
    assert [(r.tok, r.begin, r.end) for r in got] == [("a", 2, 3), ("bb", 4, 6), ("ccc", 7, 10)]
    assert all(text[r.begin : r.end] == r.tok for r in got)


def test_newline_blocks(spark):
    got = rows(tokens.newline_blocks(spark.createDataFrame([(1, "a\n\nb\n")], "doc_id long, text string")))
    assert got == [(1, 0, "a", 0), (1, 1, "\n\nb", 1)]


@pytest.mark.parametrize("toks,want", [
    (["Hi", ".", "You", "!"], [(0, 2), (2, 4)]),
    ([".", "a"], [(0, 2)]),
    (["a", ".", ")", "b"], [(0, 3), (3, 4)]),
    (['"', "a", ".", '"', "b"], [(0, 4), (4, 5)]),
    ([], []),
])
def test_segment(spark, toks, want):
    df = spark.createDataFrame([(toks,)], "t array<string>").select(F.inline(tokens.segment(F.col("t"))))
    assert [tuple(r) for r in df.collect()] == want


def tagged(spark, *sens):
    return spark.createDataFrame([(s, i, t) for s, x in enumerate(sens) for i, t in enumerate(x.split())], "sid int, tid int, tag string")


def listed(df):
    return [r.tag for r in df.orderBy("sid", "tid").collect()]


def test_tag_schemes(spark):
    assert listed(tags.iob1_to_iob2(tagged(spark, "I-A I-A I-B O I-B B-B"))) == ["B-A", "I-A", "B-B", "O", "B-B", "B-B"]
    assert listed(tags.iob_to_iobes(tagged(spark, "B-A I-A B-B O B-C"))) == ["B-A", "E-A", "S-B", "O", "S-C"]
    assert listed(tagged(spark, "L-A U-B").withColumn("tag", tags.ioblu_to_iobes(F.col("tag")))) == ["E-A", "S-B"]


def test_chunks_round_trip(spark):
    t = tagged(spark, "B-A I-A O B-B B-B", "O O")
    spans = tags.chunks(t)
    assert rows(spans) == [(0, 0, 2, "A"), (0, 3, 4, "B"), (0, 4, 5, "B")]
    assert listed(tags.paint(spans, t)) == ["B-A", "E-A", "O", "S-B", "S-B", "O", "O"]


def test_bilou_chunks_pass_unknown_letters(spark):
    assert rows(tags.bilou_chunks(tagged(spark, "B-A . L-A U-B L-C B-D O L-D"))) == [(0, 0, 3, "A"), (0, 3, 4, "B")]


def test_vocabularies(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate("b a b c a b".split())], "pos int, w string")
    assert rows(vocab.first_seen(df, "w", "pos")) == [("a", 1), ("b", 0), ("c", 2)]
    assert [tuple(r) for r in vocab.most_common(df, "w", 2, "pos").collect()] == [("b", 3, 1), ("a", 2, 2)]
    v = vocab.parser_vocabulary(df, "w", 1)
    assert rows(v) == [("a", 2, 4), ("b", 3, 3)]
    assert {r.w: r.id for r in vocab.lookup(df, "w", v, 2).collect()} == {"a": 4, "b": 3, "c": 2}


def test_scores(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "g int, p int")
    r = metrics.confusion(d, "g", "p").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.accuracy) == (2, 1, 1, 1, 0.666667, 0.6)
    a = spark.createDataFrame([("a", 0, "x", 0, "x"), ("b", 1, "y", 1, "z"), (".", 1, "p", 2, "p")], "form string, head int, rel string, p_head int, p_rel string")
    assert tuple(metrics.attachment(a).first()) == (1.0, 0.5, 0.5)
    none = spark.createDataFrame([], "k int")
    assert tuple(metrics.set_f1(none, none, ["k"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_trees(spark):
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)], "tree_id int, node_id int, parent_id int")
    assert rows(trees.ancestors(t)) == [(1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 1, 2), (1, 4, 2, 1)]
    pairs = spark.createDataFrame([(1, 4, 3), (1, 4, 2)], "tree_id int, a int, b int")
    assert {(r.a, r.b): r.lca for r in trees.lowest_common(t, pairs).collect()} == {(4, 3): 1, (4, 2): 2}


def test_features(spark):
    df = spark.createDataFrame([(1, i, [float(i)]) for i in range(1, 4)], "s int, t int, v array<float>")
    got = {r.t: r.f for r in df.select("t", features.window_of("v", ["s"], "t", 1, (1, 0, -1)).alias("f")).collect()}
    assert got == {1: [2, 1, 0], 2: [3, 2, 1], 3: [0, 3, 2]}


def test_batches_are_even_parts(spark):
    df = spark.range(10).select(F.col("id"), F.lit(10).alias("b"))
    sizes = sorted(r["count"] for r in features.batches(df, "b", "id", 30).groupBy("batch").count().collect())
    assert sizes == sorted(len(x) for x in np.array_split(np.arange(10), 3))


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    total = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(t[b, a] for a, b in itertools.pairwise(p))
    assert tuple(decoders.best_path(e, t)) == max(itertools.product(range(3), repeat=5), key=total)


def test_greedy_tree_is_a_tree():
    for seed in range(20):
        head = decoders.greedy_tree(np.random.default_rng(seed).random((7, 7)))
        for n in range(1, 7):
            seen = set()
            while n and n not in seen:
                seen.add(n)
                n = head[n]
            assert n == 0


def test_column_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\nJohn\tB\nran\tO\n\n\nHi\tO")
    got = read_columns(spark, str(tmp_path / "a.tsv"), {"tok": 0, "tag": 1, "none": 5}).orderBy("sid", "tid").collect()
    assert [(r.sid, r.tid, r.tok, r.tag, r.none) for r in got] == [(0, 0, "John", "B", None), (0, 1, "ran", "O", None), (1, 0, "Hi", "O", None)]
    (tmp_path / "u.conllu").write_text("1-2\tdu\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\tP\tA=b|C=d\t0\troot\n1.1\tx\t_\t_\t_\t_\t_\t_\n")
    got = read_conll_u(spark, str(tmp_path / "u.conllu")).collect()
    assert [(r.form, r.feats) for r in got] == [("de", {"a": "b", "c": "d"})]


def test_characters(spark):
    df = spark.createDataFrame([("?!",), ("a",), ("–",), ("",)], "c string")
    got = df.select(chars.is_class(F.col("c"), "final_mark"), chars.is_class(F.col("c"), "hyphen"), chars.is_class(F.col("c"), "punct")).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, False), (False, True, False), (False, False, True)]


def test_ancestors_of_a_deep_tree(spark):
    n = 67
    t = spark.range(1, n + 1).select(F.lit(1).alias("tree_id"), F.col("id").alias("node_id"), (F.col("id") - 1).alias("parent_id")).coalesce(1)
    pairs = spark.createDataFrame([(1, n, 1), (1, n, 2)], "tree_id int, a long, b long")
    assert rows(trees.lowest_common(t, pairs)) == [(1, n, 1, 1), (1, n, 2, 2)]


def test_graph_vocabulary_joins_no_words(spark, tmp_path, monkeypatch):
    """Tags come from the documents, those without words included; words are counted where they are cut and meet nothing by document."""
    from textloom import catalog_annotations
    from textloom.operators import ranks

    docs = [(1, "a b a b a", "en"), (2, "b b c", None), (3, " ", "xx"), (4, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, real = [], ranks.durable

    def watched(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(ranks, "durable", watched)
    got = catalog_annotations.graph_vocabulary(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("word", "b", 3), ("word", "a", 4), ("tag", "de", 5), ("tag", "en", 6), ("tag", "xx", 7), ("tag", None, 8)]
    assert plans and not any("Join" in p for p in plans)
