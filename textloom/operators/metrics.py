"""Scores: accuracy, precision, recall, F1, chunk and edge matches, attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def f1(correct: Column, predicted: Column, gold: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(correct.cast("double"), predicted), F.lit(0.0)), F.coalesce(F.try_divide(correct.cast("double"), gold), F.lit(0.0))
    return [
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"),
    ]


def set_f1(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Of two sets of rows: one shuffle by key, then sums of flags."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), pred.select(*keys).distinct().withColumn("p", F.lit(1))
    flags = g.unionByName(p, allowMissingColumns=True).groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    s = flags.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("correct"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    return s.select("correct", "predicted", "gold", *f1(F.col("correct"), F.col("predicted"), F.col("gold")))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, tn, fn of 0/1 columns and what follows from them."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    s = df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"), F.count_if(g & ~p).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return s.select("tp", "fp", "tn", "fn", *f1(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")), ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"))


def accuracy(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """``by, n, correct, accuracy`` of labels of any kind; a null is never right. Counts add up, so that batches may be scored one by one."""
    right = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(right).alias("correct")) if by else df.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"))
    return s.select(*by, "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"))


def attachment(df: DataFrame, score_punctuation: bool = False) -> DataFrame:
    """``uas, las, label_accuracy`` of rows form, head, rel, p_head, p_rel."""
    kept = df if score_punctuation else df.where(~F.rlike("form", F.lit(r"^\p{P}+$")))
    h, r = F.col("head") == F.col("p_head"), F.col("rel") == F.col("p_rel")
    n = F.count("*")
    return kept.agg(ratio(F.count_if(h), n).alias("uas"), ratio(F.count_if(h & r), n).alias("las"), ratio(F.count_if(r), n).alias("label_accuracy"))


def conll_chunks(df: DataFrame) -> DataFrame:
    """``type, gold, predicted, correct, precision, recall, f1`` (percent) of rows sid, tid, gold, pred; type ``*`` is all.

    Here a B after E of the same type opens no chunk, and S is seen only where the type changes: not the boundaries of
    ``tags.chunks``. A chunk is correct if both begin together with one type and both end together.
    """
    w = Window.partitionBy("sid").orderBy("tid")
    later = Window.partitionBy("sid").orderBy(F.desc("tid")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, so that the frame only grows
    out = df
    for c in ("gold", "pred"):
        cur, prev = F.col(c), F.coalesce(F.lag(c).over(w), F.lit("O"))
        a, b = F.regexp_extract(prev, "^[^-]*", 0), F.regexp_extract(cur, "^[^-]*", 0)
        ta, tb = F.regexp_extract(prev, "^[^-]*-(.*)$", 1), F.regexp_extract(cur, "^[^-]*-(.*)$", 1)
        starts = F.concat(a, b).isin("BB", "IB", "OB", "OI", "EE", "EI", "OE") | (~b.isin("O", ".") & (ta != tb)) | b.isin("[", "]")
        ends = F.concat(a, b).isin("BB", "BO", "IB", "IO", "EE", "EI", "EO") | (~a.isin("O", ".") & (ta != tb)) | a.isin("[", "]")
        out = out.withColumns({f"{c}_starts": starts, f"{c}_ends": ends, f"{c}_type": tb})
    for c in ("gold", "pred"):
        out = out.withColumn(f"{c}_end", F.coalesce(F.min(F.when(F.col(f"{c}_ends"), F.col("tid"))).over(later), F.lit(-1)))
    both = F.col("gold_starts") & F.col("pred_starts") & (F.col("gold_type") == F.col("pred_type")) & (F.col("gold_end") == F.col("pred_end"))
    g, p, k = F.col("gold_starts").cast("long"), F.col("pred_starts").cast("long"), both.cast("long")
    one = lambda kind, g, p, k: F.struct(kind.alias("type"), g.alias("g"), p.alias("p"), k.alias("k"))
    zero = F.lit(0).cast("long")
    rows = out.where("gold_starts or pred_starts").select(F.inline(F.array(one(F.lit("*"), g, p, k), one(F.col("gold_type"), g, zero, k), one(F.col("pred_type"), zero, p, zero))))
    s = rows.groupBy("type").agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum("k").alias("correct")).where("gold + predicted > 0")
    percent = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2)
    return s.select(
        "type", "gold", "predicted", "correct", percent(F.col("correct"), F.col("predicted")).alias("precision"),
        percent(F.col("correct"), F.col("gold")).alias("recall"), percent(2 * F.col("correct"), F.col("gold") + F.col("predicted")).alias("f1"),
    )


def edge_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``labeled`` and the scores of edge sets sid, dep, head, rel, without and with the relation."""
    bare, full = ["sid", "dep", "head"], ["sid", "dep", "head", "rel"]
    return set_f1(gold, pred, bare).withColumn("labeled", F.lit(False)).unionByName(set_f1(gold, pred, full).withColumn("labeled", F.lit(True)))


def perplexity(loss: Column) -> Column:
    return F.when(loss > 100, F.lit(float("nan"))).otherwise(F.exp(loss))


def smoothed_f1(gold: DataFrame, pred: DataFrame, labeled: bool = True) -> DataFrame:
    """``precision, recall, f1, seq_acc`` of edge sets sid, dep, head, rel, with 1e-12 in the denominators; a sentence is right if no
    gold edge is missing. ``sid`` of sentences without gold edges must come in ``pred`` to count."""
    keys = ["sid", "dep", "head", *(["rel"] if labeled else [])]
    g, p = gold.select(*keys).withColumn("g", F.lit(1)), pred.select(*keys).withColumn("p", F.lit(1))  # rows that come again are one edge below
    # dealt by number: edges take a few bytes each in a shuffle, so that tasks merged by size would hold millions of them in memory
    dealt = g.unionByName(p, allowMissingColumns=True).repartition(int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    edges = dealt.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    both = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull())
    per = edges.groupBy("sid").agg(both.alias("k"), F.count("g").alias("g"), F.count("p").alias("p"))
    s = per.agg(F.sum("k").alias("k"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.avg((F.col("k") == F.col("g")).cast("int")).alias("seq_acc"))
    a, b = F.col("k") / (F.col("p") + 1e-12), F.col("k") / (F.col("g") + 1e-12)
    return s.select(F.round(a, 6).alias("precision"), F.round(b, 6).alias("recall"), F.round(2 * a * b / (a + b + 1e-12), 6).alias("f1"), F.round("seq_acc", 6).alias("seq_acc"))


def graph_scores(gold: DataFrame, pred: DataFrame, tokens: DataFrame, mark: str = "PU") -> DataFrame:
    """``part, ur, up, uf, lr, lp, lf`` in percent of edges sid, dep, head, rel whose dependent isn't tagged ``mark`` in ``tokens`` (sid, dep,
    tag): of all, and of non-local ones, whose dependent doesn't have one head in each. A ratio over nothing is 0."""
    g = gold.select("sid", "dep", "head", F.col("rel").alias("g")).distinct()
    p = pred.select("sid", "dep", "head", F.col("rel").alias("p")).distinct()
    own = tokens.where(F.col("tag") != mark).select("sid", "dep")
    edges = g.join(p, ["sid", "dep", "head"], "full").join(own, ["sid", "dep"], "left_semi")
    w = Window.partitionBy("sid", "dep")
    edges = edges.withColumn("local", (F.count("g").over(w) == 1) & (F.count("p").over(w) == 1))
    rows = edges.select("g", "p", F.explode(F.when(F.col("local"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("nonlocal")))).alias("part"))
    s = rows.groupBy("part").agg(F.count("g").alias("gold"), F.count("p").alias("pred"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("u"), F.count_if(F.col("g") == F.col("p")).alias("l"))
    percent = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 6)
    c = F.col
    return s.select(
        "part", *[x for k in "ul" for x in (percent(c(k), c("gold")).alias(f"{k}r"), percent(c(k), c("pred")).alias(f"{k}p"), percent(2 * c(k), c("gold") + c("pred")).alias(f"{k}f"))],
    )


def exact_graphs(gold: DataFrame, pred: DataFrame, tokens: DataFrame, mark: str = "PU") -> DataFrame:
    """``graphs, unlabeled, labeled``: sentences of ``tokens`` (sid, dep, tag), and those in which every gold edge (sid, dep, head, rel) whose dependent isn't
    tagged ``mark`` is predicted, without and with its relation; edges that are predicted besides don't count."""
    own = tokens.where(F.col("tag") != mark).select("sid", "dep")
    g = gold.select("sid", "dep", "head", F.col("rel").alias("g")).distinct().join(own, ["sid", "dep"], "left_semi")
    both = g.join(pred.select("sid", "dep", "head", F.col("rel").alias("p")).distinct(), ["sid", "dep", "head"], "left")
    missed = both.groupBy("sid").agg(F.max(F.col("p").isNull()).alias("arc"), F.max(F.coalesce(F.col("p") != F.col("g"), F.lit(True))).alias("rel"))
    s = tokens.select("sid").distinct().join(missed, "sid", "left")
    fine = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    return s.agg(F.count("*").alias("graphs"), fine("arc").alias("unlabeled"), fine("rel").alias("labeled"))


class EvalMetric:
    """Counts that add up over batches of chunk sets or labels, and the scores that follow from them."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.correct = self.predicted = self.gold = 0

    def update(self, gold: set, predicted: set) -> EvalMetric:
        self.correct += len(gold & predicted)
        self.predicted += len(predicted)
        self.gold += len(gold)
        return self

    def get(self) -> tuple[float, float, float]:
        p = self.correct / self.predicted if self.predicted else 0.0
        r = self.correct / self.gold if self.gold else 0.0
        return p, r, 2 * p * r / (p + r) if p + r else 0.0
