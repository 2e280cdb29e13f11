"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some token positions of a window, so a window that differs there still hashes alike. The masks are
chosen so that each choice of at most ``ALLOWED`` of ``WINDOW`` positions is ignored by some mask at some shift; hence every
overlap that would pass the verification has a hit. Window hashes of
the benchmark are joined with those of all documents; around every hit the document and the item are laid over each
other on the hit's diagonal, and the overlap counts if some run of ``WINDOW`` aligned tokens has at most the allowed
number of substitutions. Native: HOFs and joins only.

Tokens are runs of letters and digits of the lower-cased text. Items with fewer tokens than a mask spans are found by
whole-item hashes of that length and must agree as a whole.

Scale: documents are never joined with each other. Hits are aggregated by the content hash of the text; to verify them every text is shuffled
once by that hash, and copies of a text with a hit are each verified. The benchmark's hashes are broadcast up to
``BROADCAST_ROWS`` rows (counted first), and joined by a shuffle beyond.

Cases: null or empty text is clean; null or empty items match nothing; repeated rows get the same verdict; a document
shorter than any mask can match short items only; other columns are ignored; an empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

MASKS = ("110101111", "11100110011", "1110110000011")
WINDOW = 13
ALLOWED = 2
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seed_hashes(df: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """``keep, hash, pos`` for each window of each mask; ``df`` has ``words``.

    Shifted slices of the token hashes are zipped, so that the window hashes are plain columns of one generated stage
    and not lambdas.
    """
    h = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    out = None
    for span in sorted({len(m) for m in masks}):
        own = [(no, m) for no, m in enumerate(masks) if len(m) == span]
        used = sorted({i for _, m in own for i, x in enumerate(m) if x == "1"})
        n = F.greatest(F.size("h") - span + 1, F.lit(0))
        pos = F.slice(F.sequence(F.lit(0), F.size("h")), F.lit(1), n)
        shifted = [F.slice("h", F.lit(i + 1), n).alias(f"t{i}") for i in used]
        rows = h.select(*keep, F.inline(F.arrays_zip(pos.alias("pos"), *shifted)))
        hashed = F.array(*[F.xxhash64(F.lit(no), *[F.col(f"t{i}") for i, x in enumerate(m) if x == "1"]) for no, m in own])
        part = rows.select(*keep, "pos", F.explode(hashed).alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def leaks(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          masks: tuple[str, ...] = MASKS, window: int = WINDOW, allowed: int = ALLOWED) -> DataFrame:
    """One row per distinct contaminated text: ``k1, k2`` (its content hash), ``items`` (sorted ids), ``overlap`` (the
    most aligned tokens that agree)."""
    items = save(bench.select(F.col(item).alias("item_id"), tokens(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).distinct(), "bench")
    span = min(map(len, masks))
    short = [r["n"] for r in items.where(F.size("item_words") < span).select(F.size("item_words").alias("n")).distinct().collect()]
    all_masks = masks + tuple("1" * n for n in sorted(short))  # at most as many more as the span
    seeds = save(
        seed_hashes(items.withColumn("words", F.col("item_words")).withColumn("len", F.size("item_words")), all_masks, "item_id", "len")
        .withColumnRenamed("pos", "q"), "seeds",
    )
    few = seeds.count() <= BROADCAST_ROWS
    keyed = docs.select(content_key(text)[0].alias("k1"), content_key(text)[1].alias("k2"), F.col(text).alias("body")).where("body is not null")
    found = seed_hashes(keyed.select("k1", "k2", tokens(F.col("body")).alias("words")), all_masks, "k1", "k2")
    hits = found.join(F.broadcast(seeds) if few else seeds, "hash").select(
        "k1", "k2", F.struct("item_id", (F.col("pos") - F.col("q")).alias("diag"), "len").alias("hit")
    )
    by_text = save(hits.groupBy("k1", "k2").agg(F.collect_set("hit").alias("hits")), "hits")
    near = keyed.join(by_text.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "hits", tokens(F.col("body")).alias("words"))
    cut = F.transform("hits", lambda h: F.struct(
        h["item_id"].alias("item_id"), F.greatest(-h["diag"], F.lit(0)).alias("q0"),
        F.slice(F.col("words"), F.greatest(h["diag"], F.lit(0)) + 1, h["len"]).alias("part"),
    ))
    laid = near.select("k1", "k2", F.inline(F.array_distinct(cut)))
    laid = laid.join(F.broadcast(items) if few else items, "item_id")
    need = F.least(F.lit(window), F.size("item_words"))
    size = F.least(F.size("part"), F.size("item_words") - F.col("q0"))
    agree = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.when(F.get("part", i) == F.get("item_words", i + F.col("q0")), 1).otherwise(0)
    )
    laid = laid.withColumns({"size": size, "need": need}).where("size >= need").withColumn("agree", agree)
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.col("size") - F.col("need")),
        lambda i: F.aggregate(F.slice("agree", i + 1, F.col("need")), F.lit(0), lambda a, x: a + x),
    ))
    slack = F.when(F.col("need") < window, F.lit(0)).otherwise(F.lit(allowed))
    good = laid.where(best >= F.col("need") - slack)
    total = F.aggregate("agree", F.lit(0), lambda a, x: a + x)
    return good.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(total).alias("overlap"))


def content_key(text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))


def mark(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``doc_id, contaminated, n_items, items, overlap`` for every row."""
    found = leaks(docs, bench, text, **kw)
    ids = docs.select(F.col(doc_id).alias("doc_id"), content_key(text)[0].alias("k1"), content_key(text)[1].alias("k2"))
    return ids.join(found, ["k1", "k2"], "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"),
    )


def drop_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without contaminated texts, all columns as they are."""
    bad = leaks(docs, bench, text, **kw).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    a, b = content_key(text)
    return docs.join(bad, (a == F.col("__k1")) & (b == F.col("__k2")), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
