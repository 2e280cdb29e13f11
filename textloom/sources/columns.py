"""Column files: one token per line, a blank line between sentences, ``#`` comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked

FIELDS = ("id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel")


def conll_line(cols: dict[str, Column]) -> Column:
    """A ten-column row; missing fields and nulls are ``_``."""
    return F.concat_ws("\t", *[F.coalesce(cols[f].cast("string"), F.lit("_")) if f in cols else F.lit("_") for f in FIELDS])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, sid, tid, line``: the lines of sentences; a sentence is a stretch of lines that aren't blank, comments left out.

    A file may be larger than a task: Spark splits it by bytes, and a line knows the split that it was read in and its place there. Sentences and
    places are counted within each split; what a split's first sentence continues comes from sums over the splits of the file, a row for each.
    So no file, and no sentence, has to fit into a task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blank = F.rlike("value", F.lit(r"^\s*$"))
    w = Window.partitionBy("path", "block").orderBy("at")
    lines = raw.where(~F.startswith("value", F.lit("#"))).select("path", "block", "at", "value", blank.alias("blank"), F.lag(blank).over(w).alias("gap"))
    # a sentence begins after a blank line; the first line of a split waits for the split before
    lines = lines.withColumn("begins", ~F.col("blank") & F.coalesce("gap", F.lit(False))).withColumn("sid", F.count_if("begins").over(w))
    lines = lines.withColumn("tid", F.count_if(~F.col("blank")).over(Window.partitionBy("path", "block", "sid").orderBy("at")) - 1)
    whole = lines.groupBy("path", "block").agg(
        F.min_by("blank", "at").alias("first_blank"), F.max_by("blank", "at").alias("last_blank"), F.max("sid").alias("begun"), F.max_by(F.col("tid") + 1, "at").alias("open")
    )
    f = Window.partitionBy("path").orderBy("block")
    whole = whole.withColumn("opens", ~F.col("first_blank") & F.coalesce(F.lag("last_blank").over(f), F.lit(True)))  # the first line begins a sentence
    whole = whole.withColumn("begun", F.col("begun") + F.col("opens").cast("int"))
    so_far = f.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("sids", F.coalesce(F.sum("begun").over(so_far), F.lit(0)) + F.col("opens").cast("int") - 1)
    # lines of the sentence that is open at the end of a split: those since its last beginning, which may lie some splits back
    whole = whole.withColumn("since", F.sum(F.when(F.col("begun") > 0, 1).otherwise(0)).over(f))
    whole = whole.withColumn("held", F.sum("open").over(Window.partitionBy("path", "since").orderBy("block")))
    whole = whole.select("path", "block", "sids", F.when(F.col("opens"), 0).otherwise(F.coalesce(F.lag("held").over(f), F.lit(0))).alias("carried"))
    out = lines.where("not blank").join(whole, ["path", "block"])
    tid = F.col("tid") + F.when(F.col("sid") == 0, F.col("carried")).otherwise(0)
    return out.select("path", (F.col("sid") + F.col("sids")).cast("long").alias("sid"), tid.cast("long").alias("tid"), F.col("value").alias("line"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``path, sid, tid, f``: the fields of each line; the last sentence needs no blank line."""
    return lines_of(spark, path).select("path", "sid", "tid", F.split(F.trim(F.replace("line", F.lit("\r"), F.lit(""))), r"\s+").alias("f"))


def read_columns(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """``path, sid, tid`` and the named columns; short rows give nulls."""
    return read_rows(spark, path).select("path", "sid", "tid", *[F.get("f", F.lit(i)).alias(k) for k, i in columns.items()])


PAD = "<pad>"


def known_relation(rows: DataFrame, rel: str, relations: DataFrame | None) -> DataFrame:
    """A relation that ``relations`` (item) lacks becomes the padding one."""
    if relations is None:
        return rows
    own = relations.select(F.col("item").alias(rel), F.lit(True).alias("__known")).distinct()
    return rows.join(own, rel, "left").withColumn(rel, F.when(F.col("__known"), F.col(rel)).otherwise(F.lit(PAD))).drop("__known")


def read_dependencies(spark: SparkSession, path: str, relations: DataFrame | None = None) -> DataFrame:
    """``path, sid, tid, form, pos, head, rel`` of rows of eight or ten columns, told apart line by line."""
    rows, at = read_rows(spark, path), F.when(F.size("f") >= 10, F.lit(6)).otherwise(F.lit(5))
    rows = rows.select(
        "path", "sid", "tid", F.get("f", F.lit(1)).alias("form"), F.get("f", F.lit(3)).alias("pos"),
        F.get("f", at).try_cast("int").alias("head"), F.get("f", at + 1).alias("rel"),
    )
    return known_relation(rows, "rel", relations).select("path", "sid", "tid", "form", "pos", "head", "rel")


def eight_to_ten(fields: Column) -> Column:
    """A ten-column row from the fields of an eight-column one, whose head and relation move by one column."""
    own = [F.coalesce(F.get(fields, F.lit(i)), F.lit("_")) for i in range(7)]
    return F.concat_ws("\t", *own[:5], F.lit("_"), own[5], own[6], F.lit("_"), F.lit("_"))


def read_semantic_edges(spark: SparkSession, path: str, relations: DataFrame | None = None) -> DataFrame:
    """``path, sid, dep, head, rel``: one row per edge of eight-column rows, more edges as ``head:rel|head:rel`` in the last."""
    rows = read_rows(spark, path)
    more = F.when(F.get("f", F.lit(7)) != "_", F.split(F.get("f", F.lit(7)), r"\|")).otherwise(F.array().cast("array<string>"))
    extra = F.transform(more, lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("head"), F.regexp_extract(x, "^[^:]*:(.*)$", 1).alias("rel")))
    first = F.array(F.struct(F.get("f", F.lit(5)).try_cast("int").alias("head"), F.get("f", F.lit(6)).alias("rel")))
    edges = rows.select("path", "sid", (F.col("tid") + 1).alias("dep"), F.inline(F.concat(first, F.coalesce(extra, F.array().cast("array<struct<head:int,rel:string>>")))))
    return known_relation(edges.where("head is not null"), "rel", relations).select("path", "sid", "dep", "head", "rel").distinct()


def labelled_text(line: Column) -> Column:
    """(labels, text) of ``__label__a __label__b text``; null where either is empty."""
    marks = F.regexp_extract(line, r"^\s*((?:__label__\S+\s+)*)", 1)
    labels = F.transform(F.regexp_extract_all(marks, F.lit(r"__label__(\S+)"), 1), lambda x: x)
    text = F.trim(F.regexp_replace(line, r"^\s*(?:__label__\S+\s+)*", ""))
    return F.when((F.size(labels) > 0) & (text != ""), F.struct(labels.alias("labels"), text.alias("text")))


def read_documents_json(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``path, doc_id, sid, tid, tok`` and the tag column ``key`` as gold, from lists of documents with ``sens``."""
    docs = spark.read.json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "doc_id", F.posexplode("sens").alias("sid", "s"))
    pairs = F.arrays_zip(F.col("s.tok").alias("tok"), F.col(f"s.{key}").alias(f"{key}_gold"))
    return docs.select("path", "doc_id", "sid", F.posexplode(pairs).alias("tid", "x")).select("path", "doc_id", "sid", "tid", "x.*")


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``word, vector`` of lines with a word and ``dim`` numbers; a header and lines of other lengths are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == dim + 1)
    return rows.select(F.get("f", F.lit(0)).alias("word"), F.transform(F.slice("f", 2, dim), lambda x: x.cast("double")).alias("vector"))


def morph_features(feats: Column) -> Column:
    """A map of ``Key=Value|..``, keys in lower case; what has no = is left out, of a key that comes twice the last one stays."""
    pair = F.transform(F.filter(F.split(feats, r"\|"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.lower(F.get(F.split(x, "="), F.lit(0))).alias("k"), F.get(F.split(x, "="), F.lit(1)).alias("v")))
    return F.map_from_entries(F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda y: y["k"] == x["k"])))


def read_conll_u(spark: SparkSession, path: str) -> DataFrame:
    """CoNLL-U without its multiword ranges and empty nodes; features as a map, and ``frame``, column 11 where column 10 is Y."""
    cols = {"id": 0, "form": 1, "lemma": 2, "upos": 3, "pos": 4, "feats": 5, "head": 6, "deprel": 7, "frame": 11, "__has": 10}
    rows = read_columns(spark, path, cols).where(~F.rlike("id", F.lit("[.-]")))
    rows = rows.withColumn("feats", F.when(F.contains("feats", F.lit("=")), morph_features(F.col("feats"))))
    return rows.withColumn("frame", F.when(F.col("__has") == "Y", F.col("frame"))).drop("__has")


def write_lines(df: DataFrame, path: str) -> None:
    """Writes ``line`` as text, in the order of the partitions."""
    df.select("line").write.mode("overwrite").text(path)


def edge_list(edges: Column) -> Column:
    """``head:rel|head:rel`` of an array of (head, rel), by head; ``_`` for none."""
    parts = F.transform(F.sort_array(edges), lambda e: F.concat_ws(":", e["head"].cast("string"), e["rel"]))
    return F.when(F.size(edges) > 0, F.array_join(parts, "|")).otherwise(F.lit("_"))


def graph_lines(t: DataFrame, edges: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``sid, tid, line``: ten-column rows of tokens (sid, tid) whose last but one cell lists the edges (sid, dep, head, rel) of the token as
    ``head:rel|head:rel``."""
    own = edges.groupBy("sid", F.col("dep").alias("tid")).agg(edge_list(F.collect_list(F.struct("head", "rel"))).alias("__edges"))
    return t.join(own, ["sid", "tid"], "left").select("sid", "tid", conll_line(cols | {"phead": F.col("__edges")}).alias("line"))


def sentence_lines(t: DataFrame, line: str = "line") -> DataFrame:
    """``sid, block``: the lines of each sentence in order, as one text that ends with a blank line."""
    g = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", line))).alias("t"))
    return g.select("sid", F.concat(F.array_join(F.col(f"t.{line}"), "\n"), F.lit("\n")).alias("block"))


def write_sentences(t: DataFrame, path: str, shards: int | None = None) -> None:
    """Files of sentences with a blank line after each, in the order of ``sid`` over all files; a file is a range of sentences."""
    blocks = sentence_lines(t)
    dealt = blocks.repartitionByRange(shards, "sid") if shards else blocks.repartitionByRange("sid")
    dealt.sortWithinPartitions("sid").select("block").write.mode("overwrite").text(path)


def scored_line(token: Column, gold: Column, pred: Column) -> Column:
    """``token gold pred`` of an evaluation file."""
    return F.concat_ws(" ", token, gold, pred)


def merge_tags(gold: DataFrame, auto: DataFrame, column: int = 3) -> DataFrame:
    """``sid, tid, line``: the rows of ``gold`` (sid, tid, f) with the tag of ``auto`` (sid, tid, gold, pred) in a column; rows that don't agree
    on the gold tag are an error."""
    both = gold.join(auto.select("sid", "tid", F.col("gold").alias("__gold"), F.col("pred").alias("__pred")), ["sid", "tid"], "left")
    same = F.get("f", F.lit(column)) == F.col("__gold")
    cells = F.transform("f", lambda x, i: F.when(i == column, F.col("__pred")).otherwise(x))
    line = F.when(same, F.array_join(cells, "\t")).otherwise(F.raise_error(F.lit("the rows don't agree on the gold tag")).cast("string"))
    return both.select("sid", "tid", line.alias("line"))


def split_blocks(blocks: DataFrame, mark: str = "sent_id = 220") -> DataFrame:
    """Adds ``part`` to blocks (a sentence each): dev where the block holds the mark."""
    return blocks.withColumn("part", F.when(F.contains("block", F.lit(mark)), "dev").otherwise("train"))


def first_share(blocks: DataFrame, ratio: float, order: str = "sid") -> DataFrame:
    """The first share of the blocks, by ``order``."""
    return ranked(blocks, [order], name="__i", total="__n").where(F.col("__i") < F.floor(F.col("__n") * ratio)).drop("__i", "__n")


def fetch_corpus(spark: SparkSession, train: str, columns: dict[str, int], test: str | None = None, dev: str | None = None, listed: DataFrame | None = None) -> DataFrame:
    """``part, path, sid, tid`` and the columns of train, dev and test files; without dev files, the train sentences whose ``sid`` is listed."""
    out = read_columns(spark, train, columns).withColumn("part", F.lit("train"))
    if dev is None and listed is not None:
        from ..operators.vocab import dev_sample

        out = dev_sample(out.drop("part"), "sid", listed)
    for name, path in (("dev", dev), ("test", test)):
        if path is not None:
            out = out.unionByName(read_columns(spark, path, columns).withColumn("part", F.lit(name)))
    return out


def to_documents(t: DataFrame, token: str = "tok", tag: str | None = None) -> DataFrame:
    """``path, sens``: documents as arrays of sentences with their tokens and, if named, gold tags."""
    cols = [F.col(token).alias("tok"), *([F.col(tag).alias("gold")] if tag else [])]
    s = t.groupBy("path", "sid").agg(F.sort_array(F.collect_list(F.struct("tid", *cols))).alias("t"))
    fields = [F.col("t.tok").alias("tok"), *([F.col("t.gold").alias("gold")] if tag else [])]
    return s.select("path", F.struct("sid", *fields).alias("s")).groupBy("path").agg(F.sort_array(F.collect_list("s")).alias("sens"))


def write_json(docs: DataFrame, path: str) -> None:
    """One document a line, its nulls left out."""
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the distinct stripped lines."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``word, other`` of lines with two words."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("word"), F.get(f, F.lit(1)).alias("other")).where("other is not null")


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """``affix, pos, rank, suffix, replacements, doubled`` of XML files of ``affix`` elements with ``rule`` elements."""
    rule = "rule array<struct<_affix_form:string,_replacements:string,_doubleConsonants:boolean>>"
    r = spark.read.option("rowTag", "affix").schema(f"_form string, _org_pos string, {rule}").xml(path)
    r = r.select(F.col("_form").alias("affix"), F.col("_org_pos").alias("pos"), F.posexplode("rule").alias("rank", "r"))
    return r.select("affix", "pos", "rank", F.col("r._affix_form").alias("suffix"), F.split("r._replacements", ",", -1).alias("replacements"), F.coalesce("r._doubleConsonants", F.lit(False)).alias("doubled"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha1`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))
