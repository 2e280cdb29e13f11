"""Sequence and tree decoders: numpy in Arrow batches, one sentence at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .ranks import durable, ranked


def best_path(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Tags of the highest sum of emissions and ``transitions[to, from]``; ties go to the smaller tag."""
    v, back = scores[0], []
    for s in scores[1:]:
        total = transitions + v[None]
        back.append(total.argmax(axis=1))
        v = total.max(axis=1) + s
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def greedy_tree(p: np.ndarray) -> np.ndarray:
    """Heads of a tree grown from node 0 by always taking the likeliest arc; ``p[dependent, head]``."""
    n = len(p)
    cost = -np.log(np.where(np.eye(n, dtype=bool), 0, p) + 1e-20)
    head = np.zeros(n, int)
    best, free = cost[:, 0].copy(), np.ones(n, bool)
    free[0] = False
    for _ in range(n - 1):
        node = int(np.where(free, best, np.inf).argmin())
        free[node] = False
        closer = free & (cost[:, node] < best)
        best[closer], head[closer] = cost[closer, node], node
    return head


def tree_heads(arcs: DataFrame, n: int) -> DataFrame:
    """``sid, dep, head`` from rows ``sid, probs`` (n x n, row by row: dependent, head)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = [greedy_tree(np.array(x[: n * n]).reshape(n, n)) for x in b["probs"]]
            if len(b):
                yield pd.DataFrame({"sid": np.repeat(b["sid"].to_numpy(), n), "dep": np.tile(np.arange(n), len(b)), "head": np.concatenate(heads)})

    return arcs.mapInPandas(run, "sid long, dep int, head int")


def log_partition(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> float:
    """Log of the summed weight of all tag paths; ``transitions[to, from]``, weights into the first and out of the last tag."""
    a = start + scores[0]
    for s in scores[1:]:
        a = s + np.logaddexp.reduce(transitions + a[None], axis=1)
    return float(np.logaddexp.reduce(a + stop))


def path_loss(scores: np.ndarray, tags: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> float:
    """Negative log-likelihood of one tag path."""
    own = start[tags[0]] + scores[np.arange(len(tags)), tags].sum() + transitions[tags[1:], tags[:-1]].sum() + stop[tags[-1]]
    return log_partition(scores, transitions, start, stop) - float(own)


def single_root(p: np.ndarray, best: np.ndarray, root: int, rows: np.ndarray, others: np.ndarray) -> None:
    """Make exactly one of ``rows`` choose ``root``, at the least loss of probability; changes ``best`` and ``p``."""
    chosen = rows[best[rows] == root]
    if not len(rows):
        return
    if not len(chosen):
        best[rows[(p[rows, root] / p[rows, best[rows]]).argmax()]] = root
    elif len(chosen) > 1:
        was = p[chosen, root].copy()
        p[chosen, root] = 0
        best[chosen] = others[p[np.ix_(chosen, others)].argmax(axis=1)]
        best[chosen[(p[chosen, best[chosen]] / was).argmin()]] = root


def cycle_of(head: np.ndarray, seen: set[int]) -> list[int]:
    """A cycle in the heads through no node of ``seen``, sorted; each node walked joins ``seen``."""
    for first in range(1, len(head)):
        path, x = [], first
        while x and x not in seen:
            seen.add(x)
            path.append(x)
            x = int(head[x])
        if x in path:
            return sorted(path[path.index(x) :])
    return []


def repaired_heads(probs: np.ndarray) -> np.ndarray:
    """Likeliest heads with one root and no cycle; ``probs[dependent, head]``, node 0 is the root.

    Cycles are broken in the order of a walk from node 1 on, each at the arc that loses least against a head outside of
    what hangs below the cycle. Node 0 keeps head 0; a cycle without any other head but the root's child goes under it.
    """
    p = probs * (1 - np.eye(len(probs)))
    tokens = np.arange(1, len(p))
    head = p.argmax(axis=1)
    head[0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        single_root(p, head, 0, tokens, tokens)
        seen: set[int] = set()
        while cycle := cycle_of(head, seen):
            below = set(cycle)
            while more := [int(x) for x in tokens if int(head[x]) in below and int(x) not in below]:
                below.update(more)
            free = np.array([x for x in tokens if int(x) not in below])
            new = free[p[np.ix_(cycle, free)].argmax(axis=1)]
            at = int(np.nan_to_num(p[cycle, new] / p[cycle, head[cycle]]).argmax())
            head[cycle[at]] = new[at]
    return head


def relations(probs: np.ndarray, root: int, pad: int) -> np.ndarray:
    """Likeliest relations of nodes 1.., never ``pad``, exactly one of them ``root``; node 0 takes its own likeliest."""
    p = probs.astype(float).copy()
    p[:, pad] = 0
    best = p.argmax(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        single_root(p, best, root, np.arange(1, len(p)), np.arange(p.shape[1]))
    return best


def repaired_tree(arcs: DataFrame) -> DataFrame:
    """``sid, dep, head`` from rows ``sid, n, probs`` (n x n, row by row: dependent, head); one row is one sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, n, x in zip(b["sid"], b["n"], b["probs"], strict=True):
                yield pd.DataFrame({"sid": sid, "dep": np.arange(n), "head": repaired_heads(np.array(x, float).reshape(n, n))})

    return arcs.mapInPandas(run, "sid long, dep int, head int")


def bounded_path(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[float, np.ndarray]:
    """Score and tags of the best path with weights into its first and out of its last tag; ``transitions[to, from]``."""
    first, last = scores.astype(float).copy(), len(scores) - 1
    first[0] += start
    first[last] += stop
    path = best_path(first, transitions)
    return float(first[np.arange(len(path)), path].sum() + transitions[path[1:], path[:-1]].sum()), path


def softmax_path(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Tags of the highest product of softmax scores and ``transitions[from, to]``, in logs; ties go to the smaller tag."""
    z = scores - scores.max(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        return best_path(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), np.log(transitions.T))


def decode_paths(emissions: DataFrame, transitions: list[list[float]], softmax: bool = False, start: list[float] | None = None, stop: list[float] | None = None) -> DataFrame:
    """``sid, tid, tag_id`` from rows sid, tid, scores; the scores of a sentence are one row on the way, so that a task holds one
    sentence at a time. Without ``softmax`` a path is a CRF's, with weights into its first and out of its last tag."""
    m = np.array(transitions, float)
    a, b = (np.zeros(len(m)) if x is None else np.array(x, float) for x in (start, stop))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, rows in zip(batch["sid"], batch["rows"], strict=True):
                tid, scores = [r["tid"] for r in rows], np.array([r["scores"] for r in rows], float)
                path = softmax_path(scores, m) if softmax else bounded_path(scores, m, a, b)[1]
                yield pd.DataFrame({"sid": sid, "tid": tid, "tag_id": path})

    whole = emissions.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", F.col("scores").cast("array<double>").alias("scores")))).alias("rows"))
    return whole.mapInPandas(run, "sid long, tid long, tag_id int")


PIECE = 256


def log_product(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The product of matrices of log weights, ``m[to, from]``."""
    return np.logaddexp.reduce(later[:, :, None] + earlier[None, :, :], axis=1)


def crf_losses(emissions: DataFrame, transitions: list[list[float]], start: list[float], stop: list[float], piece: int = PIECE) -> DataFrame:
    """``sid, n, log_partition, gold, loss`` from rows sid, tid, scores, tag_id: log of the summed weight of all tag paths, score of the given
    path, and its negative log-likelihood (null, as gold, where a tag is null).

    A token is a matrix of log weights, ``transitions[to, from]`` plus its scores; the first one has the weights into it instead. Products of them are
    associative, so a sentence is folded in pieces of ``piece`` tokens, and these in groups of as many, until one is left: no task holds a
    sentence, however long. Of the given path a piece keeps its score, its first and its last tag.
    """
    m, into, out_of = np.array(transitions, float), np.array(start, float), np.array(stop, float)
    k = len(m)
    part = "sid long, at long, n long, first int, last int, gold double, m array<double>"

    def whole(x):
        """Arrow hands nulls among whole numbers on as NaN."""
        return None if x is None or x != x else int(x)

    def joined(rows: list) -> tuple:
        """One piece of rows (n, first, last, gold, m) in order."""
        n, first, last, gold, out = rows[0]
        for n2, first2, last2, gold2, m2 in rows[1:]:
            n, out = n + n2, log_product(m2, out)
            known = None not in (gold, gold2, last, first2)
            gold = gold + gold2 + m[first2, last] if known else None
            last = last2
        return n, first, last, gold, out

    def token(pos: int, scores: list[float], tag: int | None) -> tuple:
        s = np.array(scores, float)
        if pos:
            own = m + s[:, None]
        else:
            own = np.full((k, k), -np.inf)
            own[:, 0] = into + s
        return 1, tag, tag, None if tag is None else float(s[tag]) + (0.0 if pos else float(into[tag])), own

    def fold(tokens: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                done = []
                for sid, at, rows in zip(b["sid"], b["at"], b["rows"], strict=True):
                    if tokens:
                        own = [token(int(r["at"]), r["scores"], whole(r["tag_id"])) for r in rows]
                    else:
                        own = [(int(r["n"]), whole(r["first"]), whole(r["last"]), None if r["gold"] != r["gold"] else r["gold"], np.array(r["m"]).reshape(k, k)) for r in rows]
                    done.append((sid, at, *(x if not isinstance(x, np.ndarray) else x.ravel().tolist() for x in joined(own))))
                out = pd.DataFrame(done, columns=["sid", "at", "n", "first", "last", "gold", "m"])
                yield out.astype({"first": "Int32", "last": "Int32"})

        return run

    pos = ranked(emissions.select("sid", "tid", F.col("scores").cast("array<double>").alias("scores"), F.col("tag_id").cast("int").alias("tag_id")), ["tid"], ["sid"], name="at")
    own, most, tokens = pos.select("sid", "at", "scores", "tag_id"), 1, True
    while True:
        cells = [c for c in own.columns if c != "sid"]
        groups = own.groupBy("sid", F.floor(F.col("at") / piece).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("rows"))
        own = durable(groups.select("sid", F.col("block").alias("at"), "rows").mapInPandas(fold(tokens), part), "crf")
        most, tokens = own.agg(F.max("at")).first()[0], False
        if not most:
            break
    ends = F.array(*map(F.lit, out_of.tolist()))
    last = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("m", i * k) + F.get(ends, i))  # the first token's matrix has one column
    top = F.array_max(last)
    total = top + F.log(F.reduce(F.transform(last, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    gold = F.col("gold") + F.get(ends, F.col("last"))
    return own.select("sid", "n", total.alias("log_partition"), gold.alias("gold"), (total - gold).alias("loss"))


def padded_scores(t: DataFrame, splits: list[int], budget: int, pad: float = 0.0) -> DataFrame:
    """``bucket, batch, sids, lengths, scores`` from rows sid, tid, scores: batches of sentences of like length as a network returns them, the scores
    of each padded to the longest of its batch. ``budget`` bounds the tokens of a batch; a sentence longer than all splits is an error."""
    n = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", F.col("scores").cast("array<double>").alias("scores")))).alias("rows"))
    n = n.select("sid", F.size("rows").alias("n"), F.col("rows.scores").alias("scores"))
    by = n.select("sid", "n", features.bucket(F.col("n"), splits).alias("bucket"))
    by = by.withColumn("bucket", F.coalesce("bucket", F.raise_error(F.lit("a sentence is longer than all buckets")).cast("int")))
    dealt = n.join(features.batches(by, "bucket", "sid", budget).select("sid", "bucket", "batch"), "sid")
    g = dealt.groupBy("bucket", "batch").agg(F.sort_array(F.collect_list(F.struct("sid", "n", "scores"))).alias("rows"), F.max("n").alias("longest"))
    empty = F.transform(F.get(F.get("rows.scores", F.lit(0)), F.lit(0)), lambda _: F.lit(pad))
    scores = F.transform("rows.scores", lambda s: features.pad_to(s, F.col("longest"), empty))
    return g.select("bucket", "batch", F.col("rows.sid").alias("sids"), F.col("rows.n").alias("lengths"), scores.alias("scores"))


def decoded_batches(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """``sid, tid, tag`` from padded batches: the label (item, cid) of the largest score of each token, padding left out. Only the scores of as many
    labels as there are count. Sentences come back under their id, so that no order has to be restored."""
    names = labels.agg(F.sort_array(F.collect_list(F.struct("cid", "item"))).alias("map"))  # a row; as many entries as labels
    rows = batches.select(F.posexplode("sids").alias("at", "sid"), "lengths", "scores").select("sid", F.slice(F.get("scores", F.col("at")), F.lit(1), F.get("lengths", F.col("at"))).alias("s"))
    cells = rows.select("sid", F.posexplode("s").alias("tid", "scores")).crossJoin(F.broadcast(names))
    some = F.slice("scores", F.lit(1), F.size("map"))
    best = F.array_position(some, F.array_max(some)).cast("int") - 1
    return cells.select("sid", F.col("tid").cast("long").alias("tid"), F.get("map.item", best).alias("tag"))


def parsed(sentences: DataFrame, splits: list[int], budget: int, root: int = 0, pad: int = 1) -> DataFrame:
    """``sid, tid, head, rel_id`` from rows sid, n, arcs, relations: logits of arcs (n x n, dependent by head; node 0 is the root) and of relations (n x n
    x r), row by row. Sentences are dealt to batches of like size, ``budget`` arc cells each; an Arrow batch of each takes softmax over heads and relations,
    repairs heads and relations, and gives one row a token, from 1."""
    by = sentences.select("sid", "n", features.bucket(F.col("n"), splits).alias("bucket"))
    by = by.withColumn("bucket", F.coalesce("bucket", F.raise_error(F.lit("a sentence is longer than all buckets")).cast("int"))).withColumn("cells", F.col("bucket") * F.col("bucket"))
    dealt = sentences.join(features.batches(by, "cells", "sid", budget).select("sid", "bucket", "batch"), "sid")

    def soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, n, arcs, rels in zip(b["sid"], b["n"], b["arcs"], b["relations"], strict=True):
                if n < 2:
                    continue
                heads = repaired_heads(soft(np.array(arcs, float).reshape(n, n)))
                r = soft(np.array(rels, float).reshape(n, n, -1)[np.arange(n), heads])
                out.append(pd.DataFrame({"sid": sid, "tid": np.arange(1, n), "head": heads[1:], "rel_id": relations(r, root, pad)[1:]}))
            if out:
                yield pd.concat(out)

    spread = dealt.repartition("bucket", "batch").sortWithinPartitions("bucket", "batch", "sid")
    return spread.select("sid", "n", "arcs", "relations").mapInPandas(run, "sid long, tid long, head int, rel_id int")


def semantic_edges(arcs: DataFrame, relations_: DataFrame) -> DataFrame:
    """``sid, tid, head, rel_id`` from rows sid, n, logits (n x n: head, dependent; node 0 is the root): an edge where the logit is
    above 0. Tokens and heads count from 0 without the root, which is n - 1. ``relations_``: sid, head, dep, scores."""
    cells = arcs.select("sid", "n", F.posexplode("logits").alias("at", "logit")).where("logit > 0")
    cells = cells.select("sid", "n", F.floor(F.col("at") / F.col("n")).alias("head"), (F.col("at") % F.col("n")).alias("dep")).where("dep > 0")
    best = relations_.select("sid", "head", "dep", (F.array_position("scores", F.array_max("scores")) - 1).alias("rel_id"))
    e = cells.join(best, ["sid", "head", "dep"])
    return e.select("sid", (F.col("dep") - 1).alias("tid"), F.when(F.col("head") == 0, F.col("n") - 1).otherwise(F.col("head") - 1).alias("head"), "rel_id")


def plateau_rates(losses: list[float], rate: float, factor: float = 0.1, patience: int = 10, threshold: float = 1e-4, cooldown: int = 0, least: float = 0.0, eps: float = 1e-8) -> list[float]:
    """The learning rate after each loss: cut by ``factor`` when more than ``patience`` losses in a row are no better than the best."""
    best, bad, rest, out = float("inf"), 0, 0, []
    for x in losses:
        better = x < best * (1 - threshold)
        best, bad = (x, 0) if better else (best, bad + 1)
        if rest > 0:
            rest, bad = rest - 1, 0
        if bad > patience:
            rate = max(rate * factor, least) if rate - max(rate * factor, least) > eps else rate
            rest, bad = cooldown, 0
        out.append(rate)
    return out


def exponential_rate(updates: Column, rate: float, decay: float, every: float) -> Column:
    return F.lit(rate) * F.pow(F.lit(decay), updates / every)
