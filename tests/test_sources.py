"""Column files in splits, corpora, task layouts, splits for language models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.sources import columns, corpora


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(text):
    out, sid, tid, gap = [], -1, 0, True
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("#"):
            continue
        if not line.strip():
            gap = True
            continue
        if gap:
            sid, tid, gap = sid + 1, 0, False
        out.append((sid, tid, line.split()))
        tid += 1
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_cut_anywhere(spark, tmp_path, end):
    """Any cut of a file into splits gives the rows of one split, sentences over many splits included."""
    random.seed(len(end))
    pieces = ["a b\n", "c\td\n", "# x\n", "\n", " \t\n", "\n\n", "e f g\n"]
    texts = ["".join(random.choice(pieces) for _ in range(300)) + "z", "a b\n" * 200, "\n\n# only\n\n", "# c\nx y\n# c\n\n# d\n\nz"]
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for i, text in enumerate(texts):
            path = tmp_path / f"{i}.tsv"
            path.write_bytes(text.replace("\n", end).encode())
            for size in ("128m", f"{max(len(text) // 8, 1)}b", "23b"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "1b")
                got = [(r.sid, r.tid, r.f) for r in columns.read_rows(spark, str(path)).orderBy("sid", "tid").collect()]
                assert got == plain(text), (i, size)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_shards_in_order(spark, tmp_path):
    t = spark.createDataFrame([(s, i, f"{s} {i}") for s in range(50) for i in range(s % 4 + 1)], "sid long, tid long, line string").repartition(6)
    columns.write_sentences(t, str(tmp_path / "o"), 5)
    files = sorted((tmp_path / "o").glob("part-*"))
    assert len(files) == 5
    lines = "".join(f.read_text() for f in files)
    assert [(int(a), int(b)) for _, _, (a, b) in plain(lines)] == [(s, i) for s in range(50) for i in range(s % 4 + 1)]


def test_documents_with_gold(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("# n\nx N\ny V\n\nz N\n")
    (tmp_path / "a.tsv").write_text("u V")
    t, labels = corpora.documents(spark, str(tmp_path), {"tok": 0, "pos": 1}, "pos")
    assert rows(t.select("doc_id", "sid", "tid", "tok", "pos_gold")) == [(0, 0, 0, "u", "V"), (1, 0, 0, "x", "N"), (1, 0, 1, "y", "V"), (1, 1, 0, "z", "N")]
    assert rows(labels) == [("N", 1), ("V", 0)]
    with pytest.raises(ValueError, match="tok"):
        corpora.documents(spark, str(tmp_path), {"pos": 1})
    with pytest.raises(ValueError, match="ner is not"):
        corpora.documents(spark, str(tmp_path), {"tok": 0}, "ner")


def test_task_layouts(spark, tmp_path):
    (tmp_path / "train.txt").write_text("John N B-NP\nSmith N I-NP\nran V O\n\nHe N I-NP\n")
    (tmp_path / "test.txt").write_text("A N I-NP\n")
    got = corpora.fetch_task(spark, str(tmp_path), "conll_2000", spark.createDataFrame([(1,)], "sid long"))
    assert rows(got.select("part", "sid", "tid", "text", "np")) == [("dev", 1, 0, "He", "S-NP"), ("test", 0, 0, "A", "S-NP"), ("train", 0, 0, "John", "B-NP"), ("train", 0, 1, "Smith", "E-NP"), ("train", 0, 2, "ran", "O")]
    for name in ("train", "dev", "test"):
        (tmp_path / f"{name}.conllu").write_text(f"# c\n1\t{name}\tl\tU\tP\tA=b|A=c|zz\t0\troot\t_\t_\tY\tgo.01\n2-3\tx\n2\tof\tof\tU\tP\t_\t1\tx\t_\t_\t_\t_\n")
        (tmp_path / f"{name}.txt").write_text(f"__label__a __label__b {name} text\nno label\n")
    got = corpora.fetch_task(spark, str(tmp_path), "ontonotes")
    assert rows(got.where("tid = 0").select("part", "form", "feats", "frame"))[0] == ("dev", "dev", {"a": "c"}, "go.01")
    assert {r.frame for r in got.where("form = 'of'").collect()} == {None}
    got = corpora.fetch_task(spark, str(tmp_path), "imdb")
    assert rows(got.select("part", "labels", "text"))[0] == ("dev", ["a", "b"], "dev text") and got.count() == 3
    with pytest.raises(ValueError, match="no task"):
        corpora.fetch_task(spark, str(tmp_path), "none")


def test_sentences_with_chunks(spark):
    t = spark.createDataFrame([("f", 0, i, w, "P", n) for i, (w, n) in enumerate([("a", "B-X"), ("b", "I-X"), ("c", "O"), ("d", "B-Y")])] + [("f", 1, 0, "e", "Q", "O")], "path string, sid long, tid long, text string, pos string, ner string")
    a, b = corpora.sentences(t, gold=True).orderBy("sid").collect()
    assert a.tok == ["a", "b", "c", "d"] and a.pos_gold == a.pos == ["P"] * 4 and [tuple(x) for x in a.ner] == [(0, 2, "X"), (3, 4, "Y")]
    assert b.tok == ["e"] and b.ner == []
    assert "ner" not in corpora.sentences(t.drop("ner")).columns


def test_interned_corpus(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("b X\na Y\n\nb Y\n")
    t, words, marks = corpora.interned_corpus(spark, str(tmp_path / "1.tsv"))
    assert rows(words) == [("a", 1), ("b", 0)] and rows(marks) == [("X", 0), ("Y", 1)]
    assert rows(t.select("sid", "tid", "word_id", "tag_id")) == [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 0, 1)]
    (tmp_path / "2.tsv").write_text("c X\na Z\n")
    _, words, marks = corpora.interned_corpus(spark, str(tmp_path / "2.tsv"), (words, marks))
    assert rows(words) == [("a", 1), ("b", 0), ("c", 2)] and rows(marks) == [("X", 0), ("Y", 1), ("Z", 2)]


def test_unknown_relations(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 a _ X _ 2 r 0:q|3:s\n2 b _ Y _ 0 root _\n")
    known = spark.createDataFrame([("root",), ("q",)], "item string")
    assert rows(columns.read_dependencies(spark, str(tmp_path), known).select("tid", "rel")) == [(0, "<pad>"), (1, "root")]
    assert rows(columns.read_semantic_edges(spark, str(tmp_path), known).select("dep", "head", "rel")) == [(1, 0, "q"), (1, 2, "<pad>"), (1, 3, "<pad>"), (2, 0, "root")]


def test_model_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "SHARDS", 4)
    lines = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 3, " ").otherwise(F.concat(F.lit("l"), F.col("id"))).alias("line"))
    got = corpora.model_lines(lines, "line", "id")
    sizes = {(r.part, r.shard): (r.n, r.a, r.z) for r in got.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("place").alias("a"), F.max("place").alias("z")).collect()}
    want = {}
    for i in range(20_000):
        if i % 10 != 3:
            key = ("train", min(i // 4999, 3) + 1) if i < 19_998 else ("valid" if i < 19_999 else "test", 1)
            n, first, _ = want.get(key, (0, i, i))
            want[key] = (n + 1, first, i)
    assert sizes == want
    corpora.write_model_lines(got, str(tmp_path / "lm"))
    one = "".join(f.read_text() for f in sorted((tmp_path / "lm" / "part=train" / "shard=2").glob("part-*"))).splitlines()
    assert one == [f"l{i}" for i in range(4999, 9998) if i % 10 != 3]


def test_round_trip_broadcasts_no_table(spark, monkeypatch, tmp_path):
    """Lines in order take little room in Parquet, so their files' size must not decide that they are gathered in the driver."""
    from textloom import catalog_annotations
    from textloom.operators import ranks

    events = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    plans, real = [], ranks.durable

    def watched(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    for module in (ranks, catalog_annotations):
        monkeypatch.setattr(module, "durable", watched)
    out = catalog_annotations.column_round_trip(spark, str(tmp_path))
    assert "SortMergeJoin" in (last := out._jdf.queryExecution().executedPlan().toString())
    for join in re.findall(r"BroadcastHashJoin .*", "\n".join([*plans, last])):  # offsets of partitions and splits of files only
        assert "__part" in join or "block" in join, join
    assert out.count() == 400 and {tuple(r) for r in out.select("sid").distinct().collect()} == {(i,) for i in range(40)}


def test_ranks_of_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    from textloom.operators import ranks

    monkeypatch.setattr(ranks, "FEW", 5)
    df = spark.range(300).select("id", (F.col("id") % 50).alias("g"))
    out = ranks.ranked(df, ["id"], ["g"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r["rank"] == r["id"] // 50 for r in out.collect())
