"""Best-fit packing by a configuration linear program.

Documents become token pieces once; only the histogram of piece lengths (at most ``capacity`` rows) goes to the driver.
There the covering LP over configurations, min sum x_p with sum_p a_lp x_p >= d_l, is solved by multiplicative weights:
lengths that lag behind their demand gain weight, and an unbounded knapsack by dynamic programming prices configurations
for the weights, whose scaled prices give a lower bound. The fractional solution is rounded by whole parts and running sums of the
others, and the residue packed from the histogram. Pieces then get a rank among their length and take the slot of that rank.

Ranks need no global order: each length is dealt into buckets of about ``BUCKET`` pieces, ranked in its bucket, and
offset by the bucket counts. The slot table has a row for each configuration and length in it, at most some thousands,
whatever the number of documents; it is broadcast.

Tokens are those of the public byte-level BPE vocabulary, its added tokens where a text holds them, then an end id.
tiktoken reads the same vocabulary as ranks and gives the same ids as tokenizers, several times as fast.

Cases: null text is empty, a piece with the end id only; repeated rows are packed each; ties of length are
interchangeable; very long texts are cut into full pieces, with the first piece the shorter one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

CAPACITY = 1024
END_ID = 2
BUCKET = 20_000
#: The weights' rate, and for the first sweep the largest share of a demand in a step and how near the best price a configuration
#: must be. Each later sweep halves these two; none begins after so many rounds.
RATE, SHARE, NEAR = 10.0, 0.05, 0.02
ROUNDS = 2_000
GAP = 0.0005
COLUMNS = 64  # configurations of a round
SHORT = 32  # lengths below are priced one by one
WORTHS = (0.01, 0.001, 1e-9)  # how far below a whole sequence's price a configuration that is used may be; the better packing is taken
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str | None = None):
    """The byte-level BPE of the public vocabulary; one for each process."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        _ENCODERS[path] = tiktoken.Encoding("textloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


_ENCODERS: dict = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*enc.encode(t.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for c, v in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, PIECES)


def price(lens: np.ndarray, gain: np.ndarray, capacity: int) -> np.ndarray:
    """An unbounded knapsack: the largest gain of what capacities 0..capacity hold.

    A length that a shorter one outdoes is left out. Each short length is taken in all its multiples at once, by a running maximum
    along a row for each rest; the others by ranges from m up to 2 m, in which no more than m capacities at a time depend on each other.
    """
    top = np.maximum.accumulate(gain)
    keep = gain > np.append(0.0, top[:-1])
    lens, gain, best = lens[keep], gain[keep], np.zeros(capacity + 1)
    short = int(np.searchsorted(lens, SHORT))
    for n, g in zip(lens[:short].tolist(), gain[:short].tolist(), strict=True):
        rows = -(-(capacity + 1) // n)
        grid = np.full(rows * n, -np.inf)
        grid[: capacity + 1] = best
        grid, steps = grid.reshape(rows, n), g * np.arange(rows)[:, None]
        best = (np.maximum.accumulate(grid - steps) + steps).ravel()[: capacity + 1]
    room = np.append(np.full(capacity, -np.inf), best)  # below 0 nothing fits
    best, m = room[capacity:], SHORT
    while m <= capacity:
        lo, hi = np.searchsorted(lens, (m, 2 * m))
        if hi > lo:
            rows, back, more = sliding_window_view(room, m), capacity - lens[lo:hi], gain[lo:hi, None]
            for c in range(int(lens[lo]), capacity + 1, m):
                n = min(m, capacity + 1 - c)
                best[c : c + n] = np.maximum(best[c : c + n], (rows[back + c, :n] + more).max(axis=0))
        m *= 2
    return best


class Trace:
    """What fills a capacity best, by the values of ``price``; each capacity's item is looked up once."""

    def __init__(self, lens: np.ndarray, gain: np.ndarray, best: np.ndarray):
        self.lens, self.gain, self.best, self.item = lens, gain, best, {}

    def __call__(self, c: int) -> dict[int, int]:
        """Index -> count."""
        found: dict[int, int] = {}
        while self.best[c] > 0:
            if c not in self.item:
                fits = int(np.searchsorted(self.lens, c, side="right"))
                self.item[c] = int((self.gain[:fits] + self.best[c - self.lens[:fits]]).argmax())
            j = self.item[c]
            found[j] = found.get(j, 0) + 1
            c -= int(self.lens[j])
        return found


def fullest(lens: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Packs a histogram, a configuration at a time: the longest piece, and of what is left the pieces that fill the rest best, long
    ones first. The sums that shorter pieces reach are the bits of a whole number, so a configuration costs a shift for each length
    (and each power of two of its count); one that fills a sequence is used as often as its pieces allow."""
    left, out = left.copy(), []
    full = (1 << (capacity + 1)) - 1
    while left.any():
        at = np.flatnonzero(left)
        top = int(at[-1])
        free, taken = capacity - int(lens[top]), {top: 1}
        reach, items = [1], []
        for j in at[lens[at] <= free].tolist():
            n, have = int(lens[j]), min(int(left[j]) - (j == top), free // int(lens[j]))
            k = 1
            while have > 0:
                k = min(k, have)
                items.append((j, k, n * k))
                reach.append((reach[-1] | reach[-1] << n * k) & full)
                have, k = have - k, 2 * k
        c = (reach[-1] & ((1 << (free + 1)) - 1)).bit_length() - 1
        for i in range(len(items) - 1, -1, -1):
            j, k, n = items[i]
            if n <= c and reach[i] >> (c - n) & 1:
                taken[j] = taken.get(j, 0) + k
                c -= n
        m = min(int(left[j]) // n for j, n in taken.items())
        for j, n in taken.items():
            left[j] -= m * n
        out.append((taken, m))
    return out


def greedy(lens: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: the longest piece opens a sequence, then always the longest that fits."""
    left, out = left.copy(), []
    while left.any():
        free, taken = capacity, {}
        while True:
            fits = np.flatnonzero((left > 0) & (lens <= free))
            if not len(fits):
                break
            j = int(fits[-1])
            n = int(min(left[j] - taken.get(j, 0), free // lens[j]))
            if n <= 0:
                spent = np.array([left[i] - taken.get(int(i), 0) > 0 for i in fits])
                if not spent.any():
                    break
                j = int(fits[spent][-1])
                n = int(min(left[j] - taken.get(j, 0), free // lens[j]))
            taken[j] = taken.get(j, 0) + n
            free -= n * int(lens[j])
        m = min(int(left[j]) // n for j, n in taken.items())
        for j, n in taken.items():
            left[j] -= m * n
        out.append((taken, m))
    return out


@dataclass
class Plan:
    """``x``: how often each configuration (pairs of index and count) is used, in fractions; together they hold every piece.
    ``prices`` are feasible in the dual, so that ``bound`` is below any packing; ``gap`` says how far the program is above it at most."""

    x: dict[tuple, float]
    total: float
    prices: np.ndarray
    bound: float

    @property
    def gap(self) -> float:
        return self.total / self.bound - 1 if self.bound else 0.0


def linear_program(lens: np.ndarray, need: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> Plan:
    """The configuration program by multiplicative weights.

    A length's weight falls exponentially with the share of its demand that is covered. Each round prices configurations by
    the weights: the best one, and for each of the lengths that lag most the best one that holds it, if its price is near.
    A step covers at most a fixed share of any demand in it, and never more than is open, so that steps are bounded however
    rare a length is and nothing is covered twice. A sweep ends when all is covered; the next one begins with the weights' mean over its
    rounds, in which lengths that kept lagging cost more. Sweeps end at a gap of ``gap`` between the total and the bound; none begins
    after ``rounds`` rounds, and then the gap that is left is the plan's ``gap`` (README has figures).
    """
    base, plan = lens / capacity, Plan({}, np.inf, lens / capacity, 0.0)
    share, near, done_rounds = SHARE, NEAR, 0
    while done_rounds < rounds and plan.total > plan.bound * (1 + gap):
        left, x, mean = need.astype(float), {}, np.zeros(len(lens))
        while len(o := np.flatnonzero(left > 1e-9 * need)):
            done_rounds += 1
            done = 1 - left / need
            y = base * np.exp(-RATE * (done - done.min()))
            some = lens[o]
            best = price(some, y[o], capacity)
            mean += y / best[-1]
            if len(o) == len(lens) and float(need @ y) / best[-1] > plan.bound:
                plan.bound, plan.prices = float(need @ y) / best[-1], y / best[-1]
            fill = Trace(some, y[o], best)
            lag = np.argsort(done[o], kind="stable")[:COLUMNS]
            value = (y[o][lag] + best[capacity - some[lag]]) / best[-1]
            tried = [fill(capacity)]
            for k in lag[value >= 1 - near].tolist():
                tried.append(fill(capacity - int(some[k])))
                tried[-1][k] = tried[-1].get(k, 0) + 1
            gained: dict[int, float] = {}
            for conf in tried:
                if any(gained.get(j, 0.0) >= share for j in conf):
                    continue
                step = min(min(share * need[o[j]], left[o[j]]) / n for j, n in conf.items())
                key = tuple(sorted((int(o[j]), n) for j, n in conf.items()))
                x[key] = x.get(key, 0.0) + step
                for j, n in conf.items():
                    left[o[j]] -= step * n
                    gained[j] = gained.get(j, 0.0) + step * n / need[o[j]]
        if sum(x.values()) < plan.total:
            plan.x, plan.total = x, sum(x.values())
        base, share, near = mean / price(lens, mean, capacity)[-1], share / 2, near / 2
        if float(need @ base) > plan.bound:
            plan.bound, plan.prices = float(need @ base), base
    return plan


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> count) and how often each is used; together they hold every piece exactly once.

    The program's fractions are rounded in some ways (``rounded``), and the one that needs the fewest sequences is taken.
    """
    lens = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lens], dtype=np.int64)
    if not len(lens):
        return []
    plan = linear_program(lens, need, capacity)
    tried = [rounded(plan, lens, need, capacity, worth, parts) for worth in WORTHS for parts in (True, False)]
    return [({int(lens[j]): n for j, n in c.items()}, m) for c, m in min(tried, key=sequences)]


def sequences(packed: list[tuple[dict[int, int], int]]) -> int:
    return sum(m for _, m in packed)


def rounded(plan: Plan, lens: np.ndarray, need: np.ndarray, capacity: int, worth: float, by_parts: bool) -> list[tuple[dict[int, int], int]]:
    """Configurations that are ``worth`` their price are used as often as the whole part of their fraction says and, ``by_parts``, once
    more where the sum of the other parts, in the order of their longest pieces, passes a whole number: so each length gets about
    what the program gives it, however small the fractions are. The residue is packed best-fit decreasing or by ``fullest``,
    whichever needs fewer sequences.
    """
    used = sorted(((key, v + 1e-9) for key, v in plan.x.items() if sum(n * plan.prices[j] for j, n in key) >= 1 - worth), key=lambda kv: kv[0][::-1])
    left, found, parts = need.copy(), [], 0.5
    for key, v in used:  # whole parts first, so that none is cut by what follows
        m = min(int(v), *(int(left[j]) // n for j, n in key))
        if m > 0:
            for j, n in key:
                left[j] -= m * n
            found.append((dict(key), m))
    for key, v in used if by_parts else ():
        before, parts = int(parts), parts + v % 1
        if int(parts) > before and all(left[j] >= n for j, n in key):
            for j, n in key:
                left[j] -= n
            found.append((dict(key), 1))
    return found + min(greedy(lens, left, capacity), fullest(lens, left, capacity), key=sequences)


def slots(solution: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces per sequence, offset) rows."""
    out, used, seq = [], {}, 0
    for conf, m in solution:
        at = 0
        for length, n in sorted(conf.items(), reverse=True):
            lo = used.get(length, 0)
            used[length] = lo + n * m
            out.append((length, lo, lo + n * m, seq, n, at))
            at += n * length
        seq += m
    return out


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length``; the rows must be stable (saved)."""
    spark = cut_up.sparkSession
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(solve(counts, capacity))
    table_ = spark.createDataFrame(places, "length long, lo long, hi long, seq long, per long, at long")
    buckets = max(counts.values(), default=0) // BUCKET + 1
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))
    hit = ranked.join(F.broadcast(table_), "length").where("rank >= lo and rank < hi")
    k = F.col("rank") - F.col("lo")
    return hit.withColumn("sequence_id", F.col("seq") + F.floor(k / F.col("per"))).withColumn(
        "offset", F.col("at") + (k % F.col("per")) * F.col("length")
    ).drop("bucket", "rank", "first", "lo", "hi", "seq", "per", "at")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    cut_up = save(pieces(docs, capacity=capacity), "pieces")
    return pack(cut_up, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
