"""Tag schemes and chunks over token rows ``sid, tid, tag``: lag, lead and running sums, one shuffle by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentence():
    return Window.partitionBy("sid").orderBy("tid")


def kind(tag: Column) -> Column:
    return F.substring(tag, 1, 1)


def label(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 20)


def iob1_to_iob2(t: DataFrame) -> DataFrame:
    """An I- after another type, O or the beginning becomes B-."""
    before = F.lag("tag").over(sentence())
    opens = before.isNull() | (before == "O") | (label(before) != label(F.col("tag")))
    return t.withColumn("tag", F.when((kind(F.col("tag")) == "I") & opens, F.concat(F.lit("B-"), label(F.col("tag")))).otherwise(F.col("tag")))


def iob_to_iobes(t: DataFrame) -> DataFrame:
    goes_on = F.coalesce(kind(F.lead("tag").over(sentence())) == "I", F.lit(False))
    c = F.col("tag")
    out = F.when((kind(c) == "B") & ~goes_on, F.concat(F.lit("S-"), label(c))).when((kind(c) == "I") & ~goes_on, F.concat(F.lit("E-"), label(c)))
    return t.withColumn("tag", out.otherwise(c))


def ioblu_to_iobes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^L-", "E-"), "^U-", "S-")


def chunks(t: DataFrame) -> DataFrame:
    """``sid, begin, end, label``: a chunk ends at O, at another type and before B."""
    c = F.col("tag")
    before = F.lag("tag").over(sentence())
    new = (c != "O") & (before.isNull() | (before == "O") | (label(before) != label(c)) | (kind(c) == "B"))
    marked = t.withColumn("cid", F.sum(F.when(new, 1).otherwise(0)).over(sentence())).where("tag <> 'O'")
    return marked.groupBy("sid", "cid").agg(
        F.min("tid").alias("begin"), (F.max("tid") + 1).alias("end"), F.min_by(label(c), "tid").alias("label")
    ).drop("cid")


def bilou_chunks(t: DataFrame) -> DataFrame:
    """``sid, begin, end, label``: B opens, L closes what is open under L's label, U stands alone, O resets; all else passes."""
    k = kind(F.col("tag"))
    w = sentence().rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(k == "B", F.col("tid")).when(k.isin("O", "L", "U"), F.lit(-1))
    opened = t.withColumn("open", F.last(state, ignorenulls=True).over(w))
    closing = opened.where((k == "U") | ((k == "L") & (F.col("open") >= 0)))
    return closing.select("sid", F.when(k == "U", F.col("tid")).otherwise(F.col("open")).alias("begin"), (F.col("tid") + 1).alias("end"), label(F.col("tag")).alias("label"))


def paint(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """IOBES tags from chunks; spans become rows of their tokens, so that the join is by key and not by range."""
    rows = spans.select("sid", "begin", "end", "label", F.explode(F.sequence("begin", F.col("end") - 1)).alias("tid"))
    k = (
        F.when(F.col("end") - F.col("begin") == 1, "S").when(F.col("tid") == F.col("begin"), "B").when(F.col("tid") == F.col("end") - 1, "E").otherwise("I")
    )
    marked = rows.select("sid", "tid", F.concat(k, F.lit("-"), F.col("label")).alias("tag"))
    return tokens.select("sid", "tid").join(marked, ["sid", "tid"], "left").select("sid", "tid", F.coalesce("tag", F.lit("O")).alias("tag"))


# Pairs of BILOU letters that need repair, and what they become under one label and under two.
PAIRS = {
    "BB": ("BI", "UB"), "BU": ("BL", "UU"), "BO": ("UO", "UO"), "IB": ("II", "LB"), "IU": ("II", "LU"), "IO": ("LO", "LO"), "LI": ("II", "LB"), "LL": ("IL", "LB"), "OI": ("OB", "OB"),
    "OL": ("OB", "OB"), "UI": ("BI", "UB"), "UL": ("BL", "UB"),
}


def repaired(tag_list: Column) -> Column:
    """A sentence's BILOU tags, made well-formed pair by pair from the left; an open chunk at the end is closed."""
    table = F.create_map(*[F.lit(x) for k, (same, other) in PAIRS.items() for x in (f"{k}=", same)], *[F.lit(x) for k, (same, other) in PAIRS.items() for x in (f"{k}/", other)])
    put = lambda tag, letter: F.when(letter == "O", F.lit("O")).otherwise(F.concat(letter, F.substring(tag, 2, 1 << 20)))

    def step(acc: Column, cur: Column) -> Column:
        prev = F.element_at(acc, -1)
        key = F.concat(kind(prev), kind(cur), F.when(label(prev) == label(cur), F.lit("=")).otherwise(F.lit("/")))
        new = F.element_at(table, key)
        changed = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(put(prev, F.substring(new, 1, 1)), put(cur, F.substring(new, 2, 1))))
        return F.when(F.size(acc) == 0, F.array(cur)).when(new.isNotNull(), changed).otherwise(F.concat(acc, F.array(cur)))

    def close(acc: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.when(kind(last) == "B", put(last, F.lit("U"))).when(kind(last) == "I", put(last, F.lit("L"))).otherwise(last)
        return F.when(F.size(acc) == 0, acc).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(end)))

    return F.aggregate(tag_list, F.array().cast("array<string>"), step, close)


def convert_scheme(t: DataFrame, source: str, target: str) -> DataFrame:
    """Tags from one scheme to another: iob to iob (as IOB2) or iobes, ioblu to iobes."""
    if (source, target) == ("iob", "iob"):
        return iob1_to_iob2(t)
    if (source, target) == ("iob", "iobes"):
        return iob_to_iobes(iob1_to_iob2(t))
    if (source, target) == ("ioblu", "iobes"):
        return t.withColumn("tag", ioblu_to_iobes(F.col("tag")))
    raise ValueError(f"no way from {source} to {target}")
