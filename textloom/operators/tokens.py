"""Space tokens, newline blocks and rule segmentation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def space_words(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, tok``: where no offsets are needed, one generator and nothing else."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("tid", "tok"))


def token_arrays(docs: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """``doc_id, toks``: the tokens of each document that has any, in an array. Texts are shuffled once and whole, not a row a token. Rows that
    share an id are one document, whose tokens go by their place in their text, then by themselves."""
    find = lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    g = docs.where(F.rlike("text", F.lit(pattern))).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    mixed = F.array_sort(F.flatten(F.transform("texts", lambda text: F.transform(find(text), lambda tok, i: F.struct(i.alias("tid"), tok.alias("tok"))))))
    return g.select("doc_id", F.when(F.size("texts") == 1, find(F.col("texts")[0])).otherwise(mixed["tok"]).alias("toks"))


def space_tokens(docs: DataFrame, init: int = 0) -> DataFrame:
    """``doc_id, tid, tok, begin, end`` in characters. A document is one row and is read where it lies; there is no running sum within an array
    among the built-in functions, so an Arrow pass finds the tokens with their places, a text at a time."""
    find = re.compile(r"[^ \t\n\x0b\f\r]+").finditer  # what \S is in the JVM
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int32()), ("tok", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tids, toks, begins, ends = held = [], [], [], [], []
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                doc = doc.as_py()
                for i, m in enumerate(find(text.as_py() or "")):
                    ids.append(doc)
                    tids.append(i)
                    toks.append(m.group())
                    begins.append(m.start() + init)
                    ends.append(m.end() + init)
                    if len(ids) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)
                        for c in held:
                            c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tid int, tok string, begin long, end long")


def newline_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, bid, block, begin``: a block keeps the line feeds before it."""
    from pyspark.sql import Window

    b = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\n*[^\n]+"), F.lit(0))).alias("bid", "block"))
    w = Window.partitionBy("doc_id").orderBy("bid").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("begin", F.coalesce(F.sum(F.length("block")).over(w), F.lit(0)))


def segment(tokens: Column) -> Column:
    """Sentences of an array of tokens, as (begin, end) of token positions.

    A token of final marks closes a sentence unless it begins one; a closing bracket or quote at the beginning of a
    sentence joins the one before.
    """
    span = "array<struct<begin:int,end:int>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("begin"), F.lit(True).alias("right"), F.expr(f"cast(array() as {span})").alias("out"))

    def step(a: Column, tok: Column) -> Column:
        first = F.substring(tok, 1, 1)
        right = F.when(first == '"', ~a["right"]).otherwise(a["right"])
        opens = a["begin"] == a["i"]
        glued = opens & (F.size(a["out"]) > 0) & (F.rlike(first, F.lit(r"[)}\]>\x{201D}]")) | ((first == '"') & right))
        closes = ~opens & F.rlike(tok, F.lit(r"^[.?!\x{203C}\x{2047}-\x{2049}]+$"))
        last = F.element_at(a["out"], -1)
        out = (
            F.when(glued, F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(last["begin"].alias("begin"), (a["i"] + 1).alias("end")))))
            .when(closes, F.concat(a["out"], F.array(F.struct(a["begin"].alias("begin"), (a["i"] + 1).alias("end")))))
            .otherwise(a["out"])
        )
        return F.struct((a["i"] + 1).alias("i"), F.when(glued | closes, a["i"] + 1).otherwise(a["begin"]).alias("begin"), right.alias("right"), out.alias("out"))

    def finish(a: Column) -> Column:
        rest = F.array(F.struct(a["begin"].alias("begin"), a["i"].alias("end")))
        return F.when(a["begin"] < a["i"], F.concat(a["out"], rest)).otherwise(a["out"])

    return F.aggregate(tokens, zero, step, finish)
