"""Corpora as documents: task layouts, tables of tokens with gold columns, interned corpora, splits for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tags, vocab
from ..operators.ranks import ranked
from .columns import labelled_text, read_columns, read_conll_u

# Kind, files of train, dev and test, columns, and the column whose tags become IOBES.
COLUMN, TREE, LABELLED = "columns", "conllu", "labelled"
NER = {"text": 0, "pos": 1, "np": 2, "ner": 3}
TASKS: dict[str, tuple[str, dict[str, str], dict[str, int], str | None]] = {
    "conll_2000": (COLUMN, {"train": "train.txt", "test": "test.txt"}, {"text": 0, "pos": 1, "np": 2}, "np"),
    "conll_03": (COLUMN, {"train": "eng.train", "dev": "eng.testa", "test": "eng.testb"}, NER, "ner"),
    "onto-ner": (COLUMN, {"train": "eng.train", "dev": "eng.testa", "test": "eng.testb"}, NER, "ner"),
    "fashion": (COLUMN, {"train": "eng.train", "dev": "eng.testa", "test": "eng.testb"}, NER, "ner"),
    "conll_03_german": (COLUMN, {"train": "deu.train", "dev": "deu.testa", "test": "deu.testb"}, {"text": 0, "lemma": 1, "pos": 2, "np": 3, "ner": 4}, "ner"),
    "germeval": (COLUMN, {"train": "NER-de-train.tsv", "dev": "NER-de-dev.tsv", "test": "NER-de-test.tsv"}, {"text": 1, "ner": 2}, "ner"),
    "wsd": (COLUMN, {"train": "semcor.tsv", "test": "semeval2015.tsv"}, {"text": 0, "lemma": 1, "pos": 2, "sense": 3}, None),
    "ud_english": (TREE, {"train": "en_ewt-ud-train.conllu", "dev": "en_ewt-ud-dev.conllu", "test": "en_ewt-ud-test.conllu"}, {}, None),
    "ud_german": (TREE, {"train": "de_gsd-ud-train.conllu", "dev": "de_gsd-ud-dev.conllu", "test": "de_gsd-ud-test.conllu"}, {}, None),
    "ontonotes": (TREE, {"train": "train.conllu", "dev": "dev.conllu", "test": "test.conllu"}, {}, None),
    "conll_12": (TREE, {"train": "train.propbank.conllu", "dev": "dev.propbank.conllu", "test": "test.propbank.conllu"}, {}, None),
    "penn": (TREE, {"train": "train.conll", "dev": "valid.conll", "test": "test.conll"}, {}, None),
    "imdb": (LABELLED, {"train": "train.txt", "dev": "dev.txt", "test": "test.txt"}, {}, None),
    "ag_news": (LABELLED, {"train": "train.txt", "dev": "dev.txt", "test": "test.txt"}, {}, None),
}


def schemed(t: DataFrame, tag: str, source: str = "iob", target: str = "iobes", keys: tuple[str, ...] = ("path", "sid")) -> DataFrame:
    """The tags of one column in another scheme; sentences are told apart by ``keys``."""
    own = t.select(F.struct(*keys).alias("sid"), "tid", F.col(tag).alias("tag"), F.struct(*t.columns).alias("__row"))
    return tags.convert_scheme(own, source, target).select("__row.*", F.col("tag").alias("__tag")).withColumn(tag, F.col("__tag")).drop("__tag")


def fetch_task(spark: SparkSession, folder: str, task: str, listed: DataFrame | None = None) -> DataFrame:
    """``part, path`` and the rows of a task's files below ``folder``: ``sid, tid`` and its columns, or ``labels, text`` of labelled lines. Without
    dev files, train sentences whose ``sid`` is ``listed`` (sid) are dev."""
    if task not in TASKS:
        raise ValueError(f"no task {task}; there are {', '.join(sorted(TASKS))}")
    kind, files, cols, scheme = TASKS[task]
    out = None
    for part, name in files.items():
        path = f"{folder}/{name}"
        if kind == LABELLED:
            rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), labelled_text(F.col("value")).alias("x")).where("x is not null").select("path", "x.*")
        else:
            rows = read_conll_u(spark, path) if kind == TREE else read_columns(spark, path, cols)
            rows = schemed(rows, scheme) if scheme else rows
        rows = rows.withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    if listed is not None and "dev" not in files:
        marks = listed.select("sid").distinct().withColumn("__dev", F.lit(True))
        out = out.join(marks, "sid", "left").withColumn("part", F.when(F.col("__dev") & (F.col("part") == "train"), "dev").otherwise(F.col("part"))).drop("__dev")
    return out.select("part", *[c for c in out.columns if c != "part"])


def documents(spark: SparkSession, path: str, cols: dict[str, int], key: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(tokens, labels): ``doc_id, sid, tid`` and the named columns, a file being a document, numbered by name; ``key`` is read as
    ``key_gold``, and labels (item, cid) are its values by first occurrence."""
    if "tok" not in cols:
        raise ValueError("name the column of tok")
    if key is not None and key not in cols:
        raise ValueError(f"{key} is not a column")
    rows = read_columns(spark, path, {f"{k}_gold" if k == key else k: i for k, i in cols.items()})
    ids = ranked(rows.select("path").distinct(), ["path"], name="doc_id")
    out = rows.join(ids, "path").select("doc_id", *[c for c in rows.columns if c != "path"])
    return out, vocab.first_seen(out, f"{key}_gold", "doc_id", "sid", "tid") if key else None


def sentences(t: DataFrame, gold: bool = False) -> DataFrame:
    """``path, sid, tok, pos`` (and ``pos_gold``) and ``ner``, the chunks (begin, end, label) of the tags, of rows path, sid, tid, text, pos, ner."""
    s = t.groupBy("path", "sid").agg(F.sort_array(F.collect_list(F.struct("tid", "text", "pos"))).alias("t"))
    s = s.select("path", "sid", F.col("t.text").alias("tok"), F.col("t.pos").alias("pos"), *([F.col("t.pos").alias("pos_gold")] if gold else []))
    if "ner" not in t.columns:
        return s
    found = tags.chunks(t.select(F.struct("path", "sid").alias("sid"), "tid", F.col("ner").alias("tag")))
    found = found.groupBy("sid.path", "sid.sid").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))).alias("ner"))
    none = F.array().cast("array<struct<begin:long,end:long,label:string>>")
    return s.join(found, ["path", "sid"], "left").withColumn("ner", F.coalesce(F.col("ner").cast("array<struct<begin:long,end:long,label:string>>"), none))


def interned_corpus(spark: SparkSession, path: str, stored: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, words, tags) of files with a word and a tag a line: ``path, sid, tid, word_id, tag_id`` and the ids by first occurrence; with
    ``stored`` ids (words, tags) new items come after these."""
    rows = read_columns(spark, path, {"word": 0, "tag": 1})
    words = vocab.intern(stored and stored[0], rows, "word", "path", "sid", "tid")
    marks = vocab.intern(stored and stored[1], rows, "tag", "path", "sid", "tid")
    out = vocab.lookup(vocab.lookup(rows, "word", words, -1).withColumnRenamed("id", "word_id"), "tag", marks, -1).withColumnRenamed("id", "tag_id")
    return out.select("path", "sid", "tid", "word_id", "tag_id"), words, marks


SHARDS = 10_000


def model_lines(lines: DataFrame, line: str, *order: str) -> DataFrame:
    """``part, shard, place, line``: lines for a language model, by their place in the order among all, blank ones included: train before
    0.9999 of them, in at most ``SHARDS`` shards of equal size (the last takes the rest), valid before 0.99995, then test. Blank lines then go."""
    rows = ranked(lines.select(line, *order), list(order), name="place", total="n")
    train, held = F.floor(F.col("n") * 9999 / 10000), F.floor(F.col("n") * 99995 / 100000)
    part = F.when(F.col("place") < train, "train").when(F.col("place") < held, "valid").otherwise("test")
    size = F.greatest(F.floor(train / SHARDS), F.lit(1))
    shard = F.when(part == "train", F.least(F.floor(F.col("place") / size), F.lit(SHARDS - 1)) + 1).otherwise(1).cast("long")
    return rows.where(F.trim(line) != "").select(part.alias("part"), shard.alias("shard"), "place", F.col(line).alias("line"))


def write_model_lines(rows: DataFrame, path: str) -> None:
    """Folders ``part=../shard=..`` of text, each in the order of the lines; a task writes a range of shards."""
    dealt = rows.repartitionByRange("part", "shard", "place").sortWithinPartitions("part", "shard", "place")
    dealt.select("part", "shard", F.col("line").alias("value")).write.mode("overwrite").partitionBy("part", "shard").text(path)
