"""Language ID by nearest centroid: TF-IDF vectors of byte n-grams (1 to 3, hashed) against several centroids a language.

Document frequencies come from all training documents. Centroids are fitted by spherical k-means on at most
``PER_LANGUAGE`` training texts of each language, chosen by a hash of the id; the bound is the only one. A text goes to
the language of the nearest centroid by cosine, and is rejected if its cosine is below ``SLACK`` times the ``WORST`` quantile
of what the first characters of the language's own training texts have, as many as the text has, rounded down to a power of
two. No single text sets a limit, short texts have their own, and none falls below ``FLOOR``.

Scoring is one map-only pass; a text's vector has a fixed size, so its length costs time only.

Cases: null text and text without a letter give ``und``, score 0 and rejected; no training rows at all: the same for
all; ties go to the language that sorts first; repeated rows are judged each; rows with null ``lang`` aren't learned
from; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, save, table

BITS = 13
DIMS = 1 << BITS
PER_LANGUAGE = 300
CENTROIDS = 4
SLACK = 0.7
WORST = 0.01
FLOOR = 0.02
LENGTHS = 15
UND = "und"
LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte 1-, 2- and 3-grams of the lower-cased text, one blank at either end."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    salt, prime, shift = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        codes = np.concatenate([b * salt, (two + np.uint32(1 << 24)) * prime, (three ^ np.uint32(0x5BD1E995)) * salt]) >> shift
    return np.bincount(codes, minlength=DIMS)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    least: dict[str, np.ndarray]  # the least cosine by the power of two of the length

    def vectors(self, texts: list[str]) -> np.ndarray:
        v = np.stack([counts(t) for t in texts]).astype(np.float32)
        v = np.log1p(v) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def judge(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.langs or not texts:
            return [(UND, 0.0, True)] * len(texts)
        cos = self.vectors(texts) @ self.centroids.T
        at = cos.argmax(axis=1)
        out = []
        for t, row, j in zip(texts, cos, at, strict=True):
            near = float(np.clip(row[j], 0, 1))
            out.append((self.langs[j], near, near < float(self.least[self.langs[j]][power(t)])))
        return out


def power(text: str) -> int:
    """Of two, of the length rounded down."""
    return min(len(text).bit_length(), LENGTHS) - 1


def limits(near: dict[int, list[float]]) -> np.ndarray:
    """The least cosine of each power of two from the cosines of training texts; one without any takes that of the next
    shorter or else of the next longer."""
    out = np.full(LENGTHS, np.nan)
    for k, v in near.items():
        out[k] = max(FLOOR, SLACK * float(np.quantile(v, WORST)))
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.full(LENGTHS, FLOOR)
    return out[known[np.maximum(np.searchsorted(known, np.arange(LENGTHS), side="right") - 1, 0)]]


def kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread rows; empty clusters go."""
    c = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].mean(axis=0) for j in np.unique(own)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Over all rows; each task returns one number per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df[:DIMS] += counts(t.as_py()) > 0
                n += 1
        df[DIMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["dim", "n"])

    found = np.zeros(DIMS + 1, np.int64)
    for r in texts.mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        found[r["dim"]] = r["n"]
    return int(found[DIMS]), found[:DIMS]


def sample(train: DataFrame, per_language: int) -> DataFrame:
    """At most so many texts of each language, the first by a hash of the id; rows that share an id count once, with the text that sorts first.

    A limit on the hash, from how many rows a language has, leaves about twice as many before anything is grouped or ranked.
    """
    order, span = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40)), float(1 << 40)
    limits = train.groupBy("lang").agg((F.lit((2 * per_language + 100) * span) / F.count("*")).alias("limit"))  # a row a language
    near = train.select("lang", "doc_id", "text", order.alias("order")).join(F.broadcast(limits), "lang").where("order <= limit")
    once = near.groupBy("lang", "doc_id", "order").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("order", "doc_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_language).select("lang", "doc_id", "text")


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """``train`` has doc_id, text and lang."""
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n, df = document_frequency(train.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(idf, [], np.zeros((0, DIMS)), {})
        for b in batches:
            texts = [(x, i, t) for x, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if LETTER.search(t)]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                v = own.vectors([t for _, _, t in part]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in part]), pa.array([i for _, i, _ in part], pa.int64()), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "doc_id", "v"])

    drawn = save(sample(train, per_language), "language-sample")
    by: dict[str, list] = {}
    for r in drawn.mapInArrow(vectors, "lang string, doc_id long, v binary").collect():
        by.setdefault(r["lang"], []).append((r["doc_id"] or 0, bytes(r["v"])))
    langs, rows = [], []
    for lang in sorted(by):
        v = np.stack([np.frombuffer(x, np.float16) for _, x in sorted(by[lang])]).astype(np.float32)
        c = kmeans(v, centroids)
        langs += [lang] * len(c)
        rows.append(c)
    model = Model(idf, langs, np.concatenate(rows) if rows else np.zeros((0, DIMS), np.float32), {})
    sent = train.sparkSession.sparkContext.broadcast(model)  # fixed size: dimensions x centroids

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cosines of the first 1, 2, 4, ... characters of each text to its own language's centroids."""
        m = sent.value
        own = {x: m.centroids[[i for i, y in enumerate(m.langs) if y == x]] for x in set(m.langs)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cuts = [(k, text[: 1 << k]) for k in range(power(text) + 1) if LETTER.search(text[: 1 << k])]
                if cuts:
                    near = (m.vectors([t for _, t in cuts]) @ own[lang].T).max(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts)), pa.array([k for k, _ in cuts], pa.int32()), pa.array(near.astype(np.float64))], ["lang", "power", "near"])

    near: dict[str, dict[int, list[float]]] = {lang: {} for lang in by}
    if langs:
        for r in drawn.where(F.length("text") > 0).select("lang", "text").mapInArrow(nearest, "lang string, power int, near double").collect():  # LENGTHS numbers a text
            if r["lang"] in near:
                near[r["lang"]].setdefault(r["power"], []).append(r["near"])
    model.least = {lang: limits(v) for lang, v in near.items()}
    return model


def identify(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns, then lang_pred, score and rejected; ``keep`` may be all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: dimensions x centroids
    names = list(keep)
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    at = names.index(text) if text in names else len(names)
    given = docs.select(*names) if text in names else docs.select(*names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = b.column(at).to_pylist()
                out: list = [(UND, 0.0, True)] * len(texts)
                ok = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                for i, got in zip(ok, m.judge([texts[i] for i in ok]), strict=True):
                    out[i] = got
                cols = [*b.columns[: len(names)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "rejected"])

    return given.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 5) != 0))
    out = identify(docs.select("doc_id", "text"), model, "doc_id")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
