"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``ORDER`` characters that they share, the decay to the power of the
stretches they span in both; gaps and inserted characters weaken a match but don't break it. It is normalised, and sharpened
by exp(``GAMMA`` (k - 1)), which keeps it a kernel. A text's strings are overlapping windows of ``LONGEST`` characters of its
words, each word with a mark before it, so that a stem is one window whatever ending follows. Landmarks are windows whose
document frequency in labelled toxic texts stands out, chosen so that every toxic text that has such windows is reached,
rare languages too. A text's pooled vector holds, for each landmark, the largest kernel of any
of its windows. The Nyström map (the inverse root of the landmarks' kernel matrix) and a linear SVM score
it, and a logistic fit on margins of held-out folds gives 0 to 1. The machine learns each training text twice, as it is and, for
less, with a sign inserted in its words.

Words are runs without white space, stripped of other signs at both ends; runs of single characters are also joined
(``i d i o t``). Whole texts are scored. Documents are labelled by a broadcast of at most ``SAMPLE`` ids of each class,
by a hash of the id, so that no text is shuffled; document frequencies cover these, the machine is fitted on at most ``FITTED``
of them of each class, and ``CANDIDATES`` and ``LANDMARKS`` fix the size of the model. What the
driver gets is bounded by these four. Scoring is one map-only pass; kernels of windows seen before in a task come from a
bounded table.

Cases: null, empty and wordless texts score as a text that shares no subsequence with any landmark; repeated rows get the same score;
repeated labels count as toxic if any is; without labels of both classes everything scores 0; ties of odds go by the window;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, save, table

ORDER = 3
DECAY = 0.8
GAMMA = 3.0
LONGEST = 8
MARK = "^"
LANDMARKS = 120
CANDIDATES = 3_000
FOLDS = 5
GAPPED = 0.05  # what a gapped copy counts for
REACH = 4  # landmarks of its own that each toxic text should have
SAMPLE = 10_000
FITTED = 3_000
CACHE = 200_000
ALPHABET = 64
SPELT = re.compile(r"(?<!\S)(?:[^\W_]\s+){2,}[^\W_](?!\S)")
SIGNS = re.compile(r"^[\W_]+|[\W_]+$")


class _Windows(dict):
    """Word -> its windows; forgets all when it is full."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= 2 * CACHE:
            self.clear()
        w = MARK + (word if word.isalpha() else SIGNS.sub("", word))
        half = LONGEST // 2
        out = () if len(w) < ORDER else (w,) if len(w) <= LONGEST else tuple(w[i : i + LONGEST] for i in range(0, len(w) - half, half))
        self[word] = out
        return out


_WINDOWS = _Windows()


def windows(text: str | None) -> set[str]:
    """Distinct windows of a text's words, and of joined runs of single characters."""
    low = (text or "").lower()
    plain = set(low.split())
    plain.update("".join(run.split()) for run in SPELT.findall(low))
    return set(itertools.chain.from_iterable(map(_WINDOWS.__getitem__, plain)))


def symbols(group: list[str]) -> np.ndarray:
    """Windows of one length as small numbers: a to z, the mark, digits, signs, and 34 for other letters."""
    code = np.array([list(map(ord, w)) for w in group], np.int64)
    out = np.where(code < 128, 29, 30 + code % 34)
    out[(code >= 48) & (code <= 57)] = 28
    out[code == ord(MARK)] = 27
    letter = (code >= 97) & (code <= 122)
    out[letter] = code[letter] - 96
    return out


def _picks(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _PICKS:
        p = np.array(list(itertools.combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _PICKS[n] = (p, (DECAY ** (p[:, -1] - p[:, 0] + 1)).astype(np.float32))
    return _PICKS[n]


_PICKS: dict = {}


def features(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all subsequences of words of one length."""
    p, weight = _picks(len(group[0]))
    s = symbols(group)
    code = s[:, p[:, 0]]
    for j in range(1, ORDER):
        code = code * ALPHABET + s[:, p[:, j]]
    return code, weight


def own_kernel(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """k(s, s): equal subsequences of a word add up before they are squared."""
    order = np.argsort(code, axis=1)
    c, w = np.take_along_axis(code, order, 1), weight[order].astype(np.float64)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    start = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w.ravel(), start)
    return np.bincount(start // c.shape[1], sums * sums, minlength=len(c))


@dataclass
class Table:
    """Landmarks by subsequence: ``row`` of each code (0: none), and the weight of each row in each normalised landmark."""

    landmarks: list[str]
    row: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(landmarks: list[str]) -> Table:
        row, own, at = np.zeros(ALPHABET**ORDER, np.int32), [], 0
        for j, z in enumerate(landmarks):
            code, weight = features([z])
            norm = float(np.sqrt(own_kernel(code, weight))[0])
            new = np.unique(code[0][row[code[0]] == 0])
            row[new] = at + 1 + np.arange(len(new))
            at += len(new)
            own.append((row[code[0]], j, weight / norm))
        t = np.zeros((at + 1, len(landmarks)), np.float32)
        for rows, j, weight in own:
            np.add.at(t[:, j], rows, weight)
        return Table(landmarks, row, t)

    def kernels(self, group: list[str]) -> np.ndarray:
        """Sharpened kernels of windows with all landmarks."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(group):
            by.setdefault(len(w), []).append(i)
        out = np.zeros((len(group), len(self.landmarks)), np.float32)
        for n, at in by.items():
            step = max(1, 60_000 // max(1, len(_picks(n)[1])))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                code, weight = features([group[i] for i in part])
                norm = np.sqrt(own_kernel(code, weight)).astype(np.float32)
                dots = np.zeros((len(part), len(self.landmarks)), np.float32)
                rows = self.row[code]
                for j in range(rows.shape[1]):  # subsequences of no landmark add nothing
                    hit = np.flatnonzero(rows[:, j])
                    if len(hit):
                        dots[hit] += weight[j] * self.weight[rows[hit, j]]
                out[part] = np.exp(GAMMA * (np.minimum(dots / norm[:, None], 1) - 1))
        return out


@dataclass
class Model:
    table: Table
    weight: np.ndarray  # of the pooled kernels: the SVM's, through the Nyström map
    bias: float
    slope: float
    shift: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


class Pool:
    """Pooled kernels of texts, with a bounded table of windows."""

    def __init__(self, table: Table):
        self.table, self.at, self.used = table, {}, 0
        self.rows = np.zeros((1024, len(table.landmarks)), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [windows(t) for t in texts]
        new = list(set().union(*bags) - self.at.keys())
        if self.used + len(new) > CACHE:
            self.at, self.used = {}, 0
            new = list(set().union(*bags))
        if new:
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((max(len(new), len(self.rows)), self.rows.shape[1]), np.float32)])
            self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.rows[self.used : self.used + len(new)] = self.table.kernels(new)
            self.used += len(new)
        out = np.full((len(texts), self.rows.shape[1]), np.exp(-GAMMA), np.float32)  # nothing shared
        for i, bag in enumerate(bags):
            if bag:
                out[i] = self.rows[list(map(self.at.__getitem__, bag))].max(axis=0)
        return out


def svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 20.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * cost * share
    step = 1 / (1 + 2 * np.linalg.norm(z * np.sqrt(c)[:, None], 2) ** 2)
    w = np.zeros(z.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - s * (z @ v))
        grad = np.append(v[:-1], 0) - 2 * z.T @ (c * s * gap)
        new = v - step * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Logistic fit on margins, by Newton steps; a toxic row counts for the square root of the clean rows to each."""
    c = share * np.where(y > 0, max(1.0, (y == 0).sum() / (y > 0).sum()) ** 0.5, 1.0)
    goal = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([(c * (p - goal) * margin).sum() + 1e-3 * a, (c * (p - goal)).sum()])
        h = c * p * (1 - p)
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        d = np.linalg.solve(m, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def gapped(text: str | None) -> str:
    """The text with a sign in the middle of every longer word."""
    return " ".join(w if len(w) < 4 else f"{w[: len(w) // 2]}-{w[len(w) // 2 :]}" for w in (text or "").split())


def candidates(train: DataFrame) -> dict[str, float]:
    """Windows that stand out in toxic texts, with their log odds; document frequencies over all of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b, n = whole.slice(lo, 200), {}
                for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    for w in windows(text):
                        n.setdefault(w, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), *(pa.array([v[k] for v in n.values()], pa.int64()) for k in (0, 1))], ["w", "good", "bad"])

    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    seen = train.select("doc_id", "toxic", "text").mapInArrow(run, "w string, good long, bad long").groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log(((F.col("bad") + 0.5) / (sizes[1] + 1)) / ((F.col("good") + 0.5) / (sizes[0] + 1)))
    bad = seen.where("bad > 1").withColumn("odds", odds).where("odds > 1")
    return {r["w"]: r["odds"] for r in bad.orderBy(F.desc(F.col("odds") * F.col("bad")), "w").limit(CANDIDATES).collect()}


def bags_of(train: DataFrame, some: dict[str, float]) -> list[list[str]]:
    """The toxic texts' windows among ``some``, of at most ``FITTED`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(windows(t) & some.keys()) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["bag"])

    return [r["bag"] for r in drawn(train, 1).select("text").mapInArrow(run, "bag array<string>").collect()]


def drawn(train: DataFrame, toxic: int, sample: int = FITTED) -> DataFrame:
    """The rows of at most ``sample`` ids of a class; only ids are ordered, and the drawn ones are broadcast."""
    mine = train.where(F.col("toxic") == toxic)
    ids = mine.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample)
    return mine.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "toxic", "text")


def choose_landmarks(bags: list[list[str]], odds: dict[str, float], most: int) -> list[str]:
    """Windows by their odds in texts that have too few chosen ones, until every text has ``REACH`` or there are ``most``."""
    texts: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            texts.setdefault(w, []).append(i)
    have = np.zeros(len(bags), np.int64)
    at = {w: np.array(x) for w, x in texts.items()}
    chosen: list[str] = []
    while at and len(chosen) < most:
        gain = {w: odds[w] * float((0.5 ** have[x] * (have[x] < REACH)).sum()) for w, x in at.items()}
        best = min(gain, key=lambda w: (-gain[w], w))
        if gain[best] <= 0:
            break
        chosen.append(best)
        have[at.pop(best)] += 1
    return chosen


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of documents that have labels (doc_id, toxic), of at most ``sample`` ids of each class."""
    some = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return docs.join(F.broadcast(some[0].unionAll(some[1])), "doc_id").select("doc_id", "text", "toxic")


def fit(train: DataFrame, sample: int = FITTED) -> Model | None:
    """``train`` has doc_id, text and toxic."""
    train = save(train.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text"), "labelled")
    odds = candidates(train)
    if not odds:
        return None
    landmarks = choose_landmarks(bags_of(train, odds), odds, LANDMARKS)
    if not landmarks:
        return None
    found = Table.of(landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(found)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = part.column(2).to_pylist()
                both = [pa.array([x.tobytes() for x in pool(some)], pa.binary()) for some in (texts, list(map(gapped, texts)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *both], ["doc_id", "toxic", "pooled", "gapped"])

    rows = drawn(train, 0, sample).unionAll(drawn(train, 1, sample)).mapInArrow(run, "doc_id long, toxic int, pooled binary, gapped binary").toPandas().sort_values(["doc_id", "toxic", "pooled"])
    y = np.tile(rows["toxic"].to_numpy(), 2)
    pooled = np.stack([np.frombuffer(x, np.float32) for c in ("pooled", "gapped") for x in rows[c]]).astype(np.float64)
    value, vector = np.linalg.eigh(found.kernels(found.landmarks).astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = pooled @ root
    plain = np.arange(len(y)) < len(rows)
    share = np.where(plain, 1.0, GAPPED)
    w, b = svm(x, y, share)
    held = np.arange(len(y)) % len(rows) % FOLDS  # margins of texts that the machine has not seen, of both classes
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        part = held != k
        if 0 < y[part].sum() < part.sum():
            wk, bk = svm(x[part], y[part], share[part])
            margin[~part] = x[~part] @ wk + bk
    slope, shift = platt(margin, y, share)
    return Model(found, root @ w, b, slope, shift)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` (doc_id, text)."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: LANDMARKS windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(sent.value.table)
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                got = sent.value.score(pool(b.column(1).to_pylist()).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = labelled(docs.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    out = score(docs, fit(train))
    return out.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
