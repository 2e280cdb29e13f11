"""Operator 13: periodic runs of words, by Lyndon arrays in linear time.

A run is a stretch of words with smallest period q, ``least`` words and two periods long at least, that no neighbouring word extends. By the
runs theorem each run begins, within its first period, with a longest Lyndon word of length q, for the one or the other order of
the alphabet. So for both orders ``edges`` finds the next smaller suffix of every position, with a stack of growing suffixes. It compares two suffixes
from where they are known to agree:

* The stack keeps how far neighbours agree. Of three suffixes, what the outer two share is the less of what each shares with the middle one,
  unless these are equal.
* Of all pairs compared so far, the one whose match reaches farthest right is kept. A position inside of its right copy meets the pairs that
  its left copy met, so their results are taken over; only what reaches the end of the match is compared, from there on.

So a word is compared anew only where the reach moves right. The extension to the left is done alike, from right to left, over the Lyndon
words that may begin a run. No suffix structure and no hash of words is made; words are numbers in the order of their first occurrence.

Before that, words are cut off that no run holds: in a run of 12 words and two periods every word stands in a ``g``-gram (g up to 6) that occurs twice in
it. The grams of a batch are numbered by sorting them, and what is left are stretches of ``least`` words at least. One batch of texts is in memory at a
time, ``WORDS`` words or one text; nothing is shuffled.

Null and empty texts have no words and no runs. A text of any length is handled whole. Repeated rows are handled one by one; other columns
are carried by name and don't clash, as results are added under the names that the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEAST = 12
GRAMS = 3
WORDS = 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"
WORD = r"[^\x20\x09-\x0D]+"


class Sequence:
    """Numbers with a comparison of two stretches that doubles its step while they agree."""

    def __init__(self, x: list[int]):
        self.x, self.n = x, len(x)
        self.raw = np.array(x, np.int32).tobytes()

    def ahead(self, i: int, j: int, k: int) -> int:
        """How far the suffixes from i and j (i < j) agree, if they agree k far."""
        x, n = self.x, self.n
        for _ in range(8):
            if j + k >= n or x[i + k] != x[j + k]:
                return k
            k += 1
        raw, step = self.raw, 16
        while step:
            if j + k + step <= n and raw[4 * (i + k) : 4 * (i + k + step)] == raw[4 * (j + k) : 4 * (j + k + step)]:
                k += step
                step *= 2
            else:
                step //= 2
        return k

    def back(self, i: int, j: int, k: int, most: int) -> int:
        """How far the prefixes before i and j (i < j) agree, if they agree k far; ``most`` at most."""
        x, most = self.x, min(most, i)
        for _ in range(8):
            if k >= most or x[i - 1 - k] != x[j - 1 - k]:
                return k
            k += 1
        raw, step = self.raw, 16
        while step:
            if k + step <= most and raw[4 * (i - k - step) : 4 * (i - k)] == raw[4 * (j - k - step) : 4 * (j - k)]:
                k += step
                step *= 2
            else:
                step //= 2
        return k


def edges(s: Sequence, equal: list[int], sign: int) -> tuple[list[int], list[int]]:
    """Next smaller suffix of each position (n: none) and how far it agrees with it, in the order of ``sign`` times the numbers; the end is
    smaller than any number. ``equal``: how far a suffix agrees with the next one."""
    n, x = s.n, s.x if sign > 0 else [-v for v in s.x]
    after, same = [n] * n, [0] * n  # next smaller suffix
    prior, kept = [-1] * n, [0] * n  # previous smaller suffix, below in the stack
    stack = [0] if n else []
    left, right, reach = 0, 0, 0
    for r in range(1, n):
        t = r - 1
        b = equal[t]
        if r + b > reach:
            left, right, reach = t, r, r + b
        while True:
            if r + b < n and x[t + b] < x[r + b]:
                prior[r], kept[r] = t, b
                break
            after[t], same[t] = r, b
            stack.pop()
            if not stack:
                break
            a, t = kept[t], stack[-1]
            if a < b:  # t is to r as it is to what lay above it: smaller
                prior[r], kept[r] = t, a
                break
            if a > b:  # r is to t as it is to what lay above it: smaller
                continue
            if r + b < n and x[t + b] != x[r + b]:
                continue
            if right < r < reach:
                d = right - left
                u, v = r - d, t - d if t >= right else t
                known = same[v] if v >= 0 and after[v] == u else kept[u] if prior[u] == v else b
                if known < reach - r:
                    b = max(b, known)
                    if known > b or x[t + b] != x[r + b]:
                        continue
                else:
                    b = reach - r
            b = s.ahead(t, r, b)
            if r + b >= reach:
                left, right, reach = t, r, r + b
        stack.append(r)
    return after, same


def runs_of(numbers: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs."""
    s, n, found = Sequence(numbers), len(numbers), set()
    x = np.array(numbers, np.int64)
    ends = np.flatnonzero(np.append(x[1:] != x[:-1], True))  # ends of stretches of one number
    equal = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)).tolist() if n else []
    for sign in (1, -1):
        after, same = edges(s, equal, sign)
        a, m, at = np.array(after, np.int64), np.array(same, np.int64), np.arange(n)
        period = a - at
        # the first Lyndon word of a run begins less than a period after the run
        some = np.flatnonzero((a < n) & (m >= np.maximum(1, least + 1 - 2 * period)))[::-1].tolist()
        back: dict[tuple[int, int], int] = {}
        left, right, reach = n, n, n
        for i in some:
            j, p, k = after[i], after[i] - i, 0
            if reach < i < left and j <= left:
                d = right - left
                known = back.get((i + d, j + d))
                if known is not None:
                    k = min(known, i - reach)
            if k < p:
                k = s.back(i, j, k, p)
            back[i, j] = k
            if i - k <= reach:
                left, right, reach = i, j, i - k
            length = k + p + same[i]
            if k < p and length >= max(least, 2 * p):
                found.add((i - k, length, p))
    return found


def stretches(ids: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches of one document that may hold runs."""
    n = len(ids)
    if n < least:
        return []
    code, at = ids + doc * (int(ids.max()) + 1), np.arange(n)
    for g in range(1, GRAMS + 1):
        order = np.argsort(code, kind="stable")
        new = np.append(True, np.diff(code[order]) != 0)
        twice = ~new
        twice[:-1] |= ~new[1:]
        gram = np.full(n, -1, np.int64)  # a number for each gram that occurs twice, by its first word
        gram[at[order[twice]]] = np.cumsum(new)[twice]
        if g == 1:
            one = gram
        cover, hits = np.zeros(n + g, bool), np.flatnonzero(gram >= 0)
        for k in range(g):
            cover[hits + k] = True
        cover = cover[:n]
        # stretches of covered words of one document
        cut = np.flatnonzero(np.append(True, ~(cover[1:] & cover[:-1]) | (doc[1:] != doc[:-1])))
        size = np.diff(np.append(cut, n))
        long = (size >= least) & cover[cut]
        one = np.where(np.repeat(long, size), one, -1)
        at = np.flatnonzero((gram[: n - g] >= 0) & (one[: n - g] >= 0) & (one[g:] >= 0))  # the gram and the word after it
        if not len(at):
            break
        code = gram[at] * (n + 1) + one[at + g]
    return list(zip(cut[long].tolist(), (cut[long] + size[long]).tolist(), strict=True))


class Numbers(dict):
    """Word -> number in order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def solve(texts: list[bytes | None], least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs of each text in order of start and period, and its words without the repeats, joined by blanks."""
    words = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first, number = np.concatenate([[0], np.cumsum(sizes)]), Numbers()
    ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(first[-1]))
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(ids, doc, least):
        d = int(doc[a])
        low = a - int(first[d])
        runs[d] += [(low + s, m, q) for s, m, q in runs_of(ids[a:b].tolist(), least)]
    out = []
    for ws, rs in zip(words, runs, strict=True):
        if rs:
            rs.sort(key=lambda x: (x[0], x[2]))
            drop = np.zeros(len(ws), bool)
            for s, m, q in rs:
                drop[s + q : s + m] = True
            ws = [ws[i] for i in np.flatnonzero(~drop).tolist()]
        out.append(b" ".join(ws))
    return runs, out


def find_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not named), ``runs`` (start, length, period; words from 0; by start, then period) and the text's words
    without what repeats in a run, after the run's first period."""
    keep = df.columns if keep is None else keep
    if {runs, collapsed} & set(keep):
        raise ValueError("name result columns that the rows don't have")
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(runs, T._parse_datatype_string(RUNS)), T.StructField(collapsed, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts, lo, held = batch.column(batch.num_columns - 1), 0, 0
            for i in range(batch.num_rows):
                held += len(texts[i].as_buffer() or b"") // 6 if texts[i].is_valid else 0
                if held < WORDS and i + 1 < batch.num_rows:
                    continue
                found, out = solve(texts[lo : i + 1].to_pylist(), least)
                flat = [x for rs in found for x in rs]
                parts = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
                at = np.concatenate([[0], np.cumsum([len(rs) for rs in found])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))
                own = [batch.column(c).slice(lo, i + 1 - lo) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(out, pa.binary()).cast(pa.string())], names=[*keep, runs, collapsed])
                lo, held = i + 1, 0

    return df.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where each document whose crc32(doc_id) ends in 0 repeats, from a word on, the stretch that begins there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("words"))
    d = d.withColumn("n", F.when(F.size("words") > 0, F.size("words").cast("long"))).withColumn("a", F.col("g") % F.col("n"))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return d.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _sql() -> str:
    from .op11_merkle import _crc

    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
            CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc("coalesce(doc_id, 0)::VARCHAR")} END AS h FROM documents),
        c AS (SELECT doc_id, o, h, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
        e AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM c),
        docs AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) END AS w FROM e),
        words AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM docs),
        grams AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v || ' ' || lead(word, 4) OVER v || ' ' || lead(word, 5) OVER v AS gram
            FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
        pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
        isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
        long AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 6 + q AS m FROM isles GROUP BY doc_id, q, isle),
        periodic AS (SELECT * FROM long WHERE m >= greatest(12, 2 * q)),
        runs AS (SELECT DISTINCT * FROM periodic x WHERE NOT EXISTS (FROM periodic y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.m >= x.s + x.m)),
        best AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, m := m, q := q), struct_pack(m := -m, s := s, q := q)) AS b,
            string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, CAST(floor(1000 * b.m / b.q) AS BIGINT) AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
        FROM docs d LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


SQL = _sql()
