"""Line-by-line decoding of a stream of documents: tokens and tags out of each micro-batch, in the order of the document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINES = "doc_id long, line_no long, line string, sid long"
STATE = "next long, sid long, numbers array<long>, lines array<string>"
#: Of many documents together; ``doc`` is the id as text, since a column of ids with a null would become one of doubles.
DEALT_LINES = "doc string, line_no long, line string, sid long"
DEALT_STATE = "docs array<string>, next array<long>, sids array<long>, until array<long>, waiting binary"
WAITING = pa.schema([("doc", pa.int32()), ("no", pa.int64()), ("line", pa.large_string())])
SIGN = r"[^\t\n\f\r ]"  # what \S is in the SQL; the JVM's leaves out \x0b, and Python's all blanks of Unicode
has_sign = re.compile(SIGN).search


def shallow_tag(token: Column) -> Column:
    """A tag by the form alone; stands in where no tagger is given."""
    low = F.lower(token)  # costs more than the last letter's two cases

    def ends(a: str, b: str) -> Column:
        return F.endswith(token, F.lit(a)) | F.endswith(token, F.lit(b))

    digits = (token >= "0") & (token < ":") & F.rlike(token, F.lit(r"\A[0-9]+\z"))
    return F.when(ends("s", "S"), "NNS").when(ends("d", "D") & F.endswith(low, F.lit("ed")), "VBD").when(ends("g", "G") & F.endswith(low, F.lit("ing")), "VBG").when(digits, "CD").otherwise("NN")


def _given(numbers: Iterable[int], held: dict[int, str], sid: int, out: list[tuple[int, str, int]]) -> int:
    """Moves these lines from ``held`` to ``out``, those with a sign numbered from ``sid``; the next such number."""
    for no in numbers:
        line = held.pop(no)
        if has_sign(line):
            out.append((no, line, sid))
            sid += 1
    return sid


def _following(at: int, held: dict[int, str]) -> int:
    """The first line from ``at`` on that is not there."""
    while at in held:
        at += 1
    return at


def _release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Lines of one document in order: those that follow what was released; later ones wait in the state. A line that comes again is left out. When
    the watermark has passed all that waits, it is released with its gaps, and the state goes."""
    at, sid, numbers, lines = state.get if state.exists else (0, 0, [], [])
    held = dict(zip(numbers, lines, strict=True))
    out = []
    if state.hasTimedOut:
        _given(sorted(held), held, sid, out)
        state.remove()
    else:
        latest = 0
        for b in batches:
            latest = max(latest, int(np.fmax.reduce(b["ts"].to_numpy()).astype("datetime64[ms]").astype("int64")))
            for no, line in zip(b["line_no"].tolist(), b["line"], strict=True):
                if no >= at:
                    held[no] = line or ""
        sid = _given(range(at, at := _following(at, held)), held, sid, out)
        left = sorted(held)
        state.update((at, sid, left, [held[no] for no in left]))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
    if out:  # a frame costs more than all else here
        numbers, lines, sids = zip(*out, strict=True)
        yield pd.DataFrame({"doc_id": key[0], "line_no": np.array(numbers, np.int64), "line": np.array(lines, object), "sid": np.array(sids, np.int64)}, copy=False)


def _release_dealt(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``_release`` for the documents of one state, each by itself: its next line and sentence, the time it waits until, and what waits, compressed."""
    now, docs = state.getCurrentWatermarkMs(), {}
    if state.exists:
        ids, nexts, sids, untils, waiting = state.get
        docs = {doc: [at, sid, until, {}] for doc, at, sid, until in zip(ids, nexts, sids, untils, strict=True)}
        for doc, no, line in zip(*(c.to_pylist() for c in pa.ipc.open_stream(waiting).read_all().columns), strict=True):
            docs[ids[doc]][3][no] = line
    seen, out = set(), []
    if not state.hasTimedOut:
        for b in batches:
            for doc, no, ms, line in zip(b["doc"], b["line_no"].tolist(), b["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist(), b["line"], strict=True):
                one = docs.get(doc)
                if one is None:
                    one = docs[doc] = [0, 0, 0, {}]
                seen.add(doc)
                one[2] = max(one[2], ms)
                if no >= one[0]:
                    one[3][no] = line or ""
    for doc in [doc for doc, one in docs.items() if doc in seen or one[2] < now]:
        at, sid, until, held = docs[doc]
        ready = []
        if doc in seen:
            sid = _given(range(at, at := _following(at, held)), held, sid, ready)
            docs[doc] = [at, sid, max(until, now + 1), held]
        else:
            _given(sorted(held), held, sid, ready)
            del docs[doc]
        out += [(doc, *row) for row in ready]
    if docs:
        waits = [(i, no, line) for i, one in enumerate(docs.values()) for no, line in one[3].items()]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.table(list(zip(*waits, strict=True)) or [[], [], []], schema=WAITING))
        nexts, sids, untils, _ = zip(*docs.values(), strict=True)
        state.update((list(docs), list(nexts), list(sids), list(untils), sink.getvalue().to_pybytes()))
        state.setTimeoutTimestamp(max(min(untils), now + 1))
    elif state.exists:
        state.remove()
    if out:
        ids, numbers, lines, sids = zip(*out, strict=True)
        yield pd.DataFrame({"doc": np.array(ids, object), "line_no": np.array(numbers, np.int64), "line": np.array(lines, object), "sid": np.array(sids, np.int64)}, copy=False)


def tagged_lines(ordered: DataFrame, tag: Callable[[Column], Column] = shallow_tag) -> DataFrame:
    """``doc_id, sid, n, tagged``: the tokens of a line as ``word/TAG``."""
    toks = ordered.select("doc_id", "sid", F.regexp_extract_all("line", F.lit(SIGN + "+"), F.lit(0)).alias("toks"))  # by itself: cut once, not once a use
    spelt = F.transform("toks", lambda w: F.coalesce(F.concat(w, F.lit("/"), tag(w)), w))
    return toks.select("doc_id", "sid", F.size("toks").cast("long").alias("n"), F.array_join(spelt, " ").alias("tagged"))


def decode_stream(lines: DataFrame, tag: Callable[[Column], Column] = shallow_tag, delay: str = "1 hour", states: int | None = None) -> DataFrame:
    """``doc_id, sid, n, tagged`` of a stream of rows doc_id, line_no (from 0), ts, line, which may come in any order and more than once.

    A line without a sign is no sentence. The state of a document is the number of its next line and sentence and the lines that came too early; it
    goes ``delay`` after the document's latest line. Spark takes milliseconds for each state that a micro-batch touches, so many documents of a few
    lines are better dealt to ``states`` states; that number stays as it is over restarts, and a state is read and written whole.
    """
    own = lines.select("doc_id", "line_no", "ts", "line").withWatermark("ts", delay)
    if states is None:
        ordered = own.groupBy("doc_id").applyInPandasWithState(_release, LINES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    else:
        dealt = own.select(F.pmod(F.xxhash64("doc_id"), F.lit(states)).alias("state"), F.col("doc_id").cast("string").alias("doc"), "line_no", "ts", "line")
        ordered = dealt.groupBy("state").applyInPandasWithState(_release_dealt, DEALT_LINES, DEALT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
        ordered = ordered.withColumn("doc_id", F.col("doc").cast("long"))
    return tagged_lines(ordered, tag)


def decode_lines(lines: DataFrame, tag: Callable[[Column], Column] = shallow_tag) -> DataFrame:
    """What ``decode_stream`` gives in the end, of a batch."""
    once = lines.groupBy("doc_id", "line_no").agg(F.first("line").alias("line"))
    kept = once.where(F.rlike("line", F.lit(SIGN)))
    return tagged_lines(kept.withColumn("sid", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long")), tag)


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there as Parquet, each row once whatever fails and restarts, and ends."""
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def throughput(query: StreamingQuery) -> dict[str, float]:
    """Rows read, seconds of work, and rows a second, by the query's own progress."""
    rows = seconds = 0.0
    for p in query.recentProgress:
        rows += p["numInputRows"]
        seconds += p["durationMs"].get("triggerExecution", 0) / 1000
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else 0.0}
