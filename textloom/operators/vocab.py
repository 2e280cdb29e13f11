"""Label maps, dictionaries, vocabularies and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

HEAD = 100_000  # items of a vocabulary that are broadcast; the others are joined by a shuffle


def first_seen(df: DataFrame, item: str, *order: str) -> DataFrame:
    """``item, cid``: dense ids by first occurrence."""
    seen = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*order)).alias("at"))
    return ranked(seen, ["at", "item"], name="cid").select("item", "cid")


def frequencies(df: DataFrame, item: str, *order: str) -> DataFrame:
    return df.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("freq"), F.min(F.struct(*order)).alias("at"))


def most_common(df: DataFrame, item: str, k: int, *order: str) -> DataFrame:
    """The k most frequent items, ties by first occurrence: a top-k report."""
    top = ranked(frequencies(df, item, *order), [F.desc("freq"), "at"]).where(F.col("rank") < k)
    return top.select("item", "freq", (F.col("rank") + 1).alias("rank"))


def parser_vocabulary(df: DataFrame, item: str, more_than: int, reserved: int = 3) -> DataFrame:
    """``item, freq, id``: items above a frequency, by frequency and then name, after the reserved ids."""
    f = df.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("freq")).where(F.col("freq") > more_than)
    return ranked(f, [F.desc("freq"), "item"]).select("item", "freq", (F.col("rank") + reserved).alias("id"))


def lookup(df: DataFrame, item: str, vocab: DataFrame, miss: int) -> DataFrame:
    """Adds ``id``, or ``miss``. The ids below ``HEAD``, the frequent ones where a vocabulary goes by frequency, are broadcast; only other
    items meet the rest by a shuffle, in which rows that are settled are dealt by all their values, so that no item is hot."""
    pairs = vocab.where("item is not null").select(F.col("item").alias("__item"), F.col("id").cast("long").alias("__id"))
    head = F.broadcast(pairs.where((F.col("__id") < HEAD) & (F.octet_length("__item") < 256)))  # at most HEAD rows
    rest = pairs.where((F.col("__id") >= HEAD) | (F.octet_length("__item") >= 256)).withColumnsRenamed({"__item": "__key", "__id": "__far"})
    near = df.join(head, F.col(item) == F.col("__item"), "left").drop("__item")
    settled = F.col("__id").isNotNull() | F.col(item).isNull()
    near = near.withColumns({"__open": ~settled, "__key2": F.when(settled, F.xxhash64(*df.columns).cast("string")).otherwise(F.col(item))})
    far = near.join(rest.withColumn("__any", F.lit(True)), F.col("__open").eqNullSafe(F.col("__any")) & (F.col("__key2") == F.col("__key")), "left")
    return far.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__id", "__far", F.lit(miss)).alias("id"))


def transitions(t: DataFrame) -> DataFrame:
    """``prev, cur, n, ratio``: tag bigrams with <START> and <STOP>, over the count of the first."""
    w = Window.partitionBy("sid").orderBy("tid")
    inner = t.select("sid", "tid", F.coalesce(F.lag("tag").over(w), F.lit("<START>")).alias("prev"), F.col("tag").alias("cur"))
    ends = t.groupBy("sid").agg(F.max_by("tag", "tid").alias("prev")).select("prev", F.lit("<STOP>").alias("cur"))
    pairs = inner.select("prev", "cur").unionAll(ends).groupBy("prev", "cur").agg(F.count("*").alias("n"))
    total = pairs.groupBy("prev").agg(F.sum("n").alias("total"))
    return pairs.join(total, "prev").select("prev", "cur", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def downsample(df: DataFrame, order: str | list[str], p: float) -> DataFrame:
    """Keeps a row where the running sum of p passes an integer, and the first; the rows in the order of a key."""
    i = F.col("__i") + 1
    rows = ranked(df, [order] if isinstance(order, str) else order, name="__i")
    return rows.where((i == 1) | (F.floor(i * p) > F.floor((i - 1) * p))).drop("__i")


def tag_dictionary(t: DataFrame, tag: str, *order: str, outside: bool = False) -> DataFrame:
    """``item, cid``: ``O`` first if ``outside``, tags by first occurrence, then <START> and <STOP>."""
    spark = t.sparkSession
    rows = t.where(F.col(tag) != "O") if outside else t
    own = first_seen(rows, tag, *order).select("item", (F.col("cid") + int(outside)).cast("long").alias("cid"))
    n = own.agg((F.count("*") + int(outside)).alias("n"))
    ends = n.select(F.inline(F.array(F.struct(F.lit("<START>").alias("item"), F.col("n").alias("cid")), F.struct(F.lit("<STOP>").alias("item"), (F.col("n") + 1).alias("cid")))))
    out = own.unionAll(ends)
    return out.unionAll(spark.range(1).select(F.lit("O"), F.lit(0).cast("long"))) if outside else out


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """``item, cid``: the distinct labels in lexical order."""
    own = df.where(F.col(label).isNotNull()).select(F.col(label).alias("item")).distinct()
    return ranked(own, ["item"], name="cid")


def frequent(df: DataFrame, item: str, min_freq: int, most: int, *order: str) -> DataFrame:
    """``item, freq, cid``: items of at least ``min_freq``, by frequency and then first occurrence, ``most`` of them."""
    top = frequencies(df, item, *order).where(F.col("freq") >= min_freq)
    return ranked(top, [F.desc("freq"), "at"], name="cid").where(F.col("cid") < most).select("item", "freq", "cid")


def graph_vocabulary(t: DataFrame, word: str, tag: str, more_than: int, reserved: int = 3, tagged: DataFrame | None = None) -> DataFrame:
    """``kind, item, id``: words above a frequency, then tags in lexical order (null last) in one numbering after the reserved ids. The tags are
    those of ``tagged``, if given, whose rows may lack words."""
    words = t.groupBy(F.col(word).alias("item")).agg(F.count("*").alias("freq")).where(F.col("freq") > more_than).select(F.lit("word").alias("kind"), "item", (-F.col("freq")).alias("by"))
    tags = (t if tagged is None else tagged).select(F.lit("tag").alias("kind"), F.col(tag).alias("item"), F.lit(0).cast("long").alias("by")).distinct()
    return ranked(words.unionAll(tags), [F.desc("kind"), "by", F.asc_nulls_last("item")]).select("kind", "item", (F.col("rank") + reserved).alias("id"))


def extend(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """``item, id``: the words that the vocabulary lacks are numbered after it, in lexical order."""
    new = words.select("item").where("item is not null").distinct().join(vocab.select("item"), "item", "left_anti")
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    more = ranked(new, ["item"]).crossJoin(F.broadcast(last))  # one row
    return vocab.select("item", F.col("id").cast("long").alias("id")).unionAll(more.select("item", (F.col("last") + 1 + F.col("rank")).cast("long")))


def intern(stored: DataFrame | None, df: DataFrame, item: str, *order: str) -> DataFrame:
    """``item, id``: the stored ids as they are, and new items of ``df`` numbered after them by first occurrence in it. So ids never change,
    and the batches of a stream, one after another, get the ids of all rows at once."""
    fresh = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*order)).alias("at"))
    if stored is None:
        return ranked(fresh, ["at", "item"], name="id").select("item", "id")
    fresh = fresh.join(stored.select("item"), "item", "left_anti")
    last = stored.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("last"))
    more = ranked(fresh, ["at", "item"]).crossJoin(F.broadcast(last))  # one row
    return stored.select("item", F.col("id").cast("long").alias("id")).unionAll(more.select("item", (F.col("last") + F.col("rank")).alias("id")))


def normalised(vectors: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """``item, id, vector`` for each item of ``ids``: its vector (item, vector), or zeros, over the standard deviation of all cells."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    full = ids.select("item", "id").join(vectors.select("item", F.col("vector").cast("array<double>").alias("vector")), "item", "left").withColumn("vector", F.coalesce("vector", zeros))
    spread = full.select(F.explode("vector").alias("x")).agg(F.stddev_pop("x").alias("__sd"))
    return full.crossJoin(F.broadcast(spread)).select("item", "id", F.transform("vector", lambda x: x / F.col("__sd")).alias("vector"))  # one row


def strict_lookup(df: DataFrame, item: str, vocab: DataFrame) -> DataFrame:
    """Ids of items; an item that the vocabulary lacks is an error."""
    found = df.join(vocab.select(F.col("item").alias(item), "id"), item, "left")
    return found.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col(item))).cast("long")))


def dev_sample(df: DataFrame, index: str, listed: DataFrame) -> DataFrame:
    """Adds ``part``: dev for the rows whose index is listed (a column of that name), train for the others."""
    marks = listed.select(index).distinct().withColumn("__dev", F.lit(True))
    return df.join(marks, index, "left").withColumn("part", F.when(F.col("__dev"), "dev").otherwise("train")).drop("__dev")
