"""Streaming decode: shuffled files, repeats and restarts give the batch result."""

import random

from pyspark.sql import functions as F

from textloom.streaming import lines


def rows(df):
    return sorted(map(tuple, df.collect()))


SCHEMA = "doc_id long, line_no long, ts timestamp, line string"


def test_shuffled_files_with_a_restart_equal_the_batch(spark, tmp_path):
    random.seed(7)
    data = [(d, i, 1_700_000_000 + d, random.choice(["dogs running fast", "", "a 12", " ", None, "walked"])) for d in range(30) for i in range(random.randint(1, 12))]
    df = spark.createDataFrame(data, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts"))
    want = rows(lines.decode_lines(df))
    assert want[0][0] == 0 and {x[1] for x in want if x[0] == 3} == set(range(len([x for x in want if x[0] == 3])))
    random.shuffle(data)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for k, some in enumerate((data[: len(data) // 2], data[len(data) // 2 :] + data[:20])):  # some lines come twice
        part = spark.createDataFrame(some, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts"))
        part.repartition(2).write.parquet(str(tmp_path / "in" / str(k)))
        q = lines.run_to_end(lines.decode_stream(source, delay="10000 days"), str(tmp_path / "out"), str(tmp_path / "state"))
        got = rows(spark.read.parquet(str(tmp_path / "out")))
        assert set(got) <= set(want) and len(got) == len(set(got))
    assert got == want
    rate = lines.throughput(q)
    assert rate["rows"] == len(data) // 2 + len(data) % 2 + 20 and rate["rows_per_second"] > 0


def test_gaps_are_released_after_the_delay(spark, tmp_path):
    def put(k, data):
        spark.createDataFrame(data, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    seen = []
    for k, data in enumerate([[(1, 0, 1000, "one"), (1, 2, 1000, "three"), (1, 5, 1001, "six")], [(2, 0, 9000, "other")], [(3, 0, 9001, "last")]]):
        put(k, data)
        lines.run_to_end(lines.decode_stream(source, delay="10 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
        seen.append(rows(spark.read.parquet(str(tmp_path / "out")).where("doc_id = 1").select("sid", "tagged")))
    assert seen[0] == [(0, "one/NN")] and seen[-1] == [(0, "one/NN"), (1, "three/NN"), (2, "six/NN")]


def test_no_frame_for_lines_that_wait():
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    ts = pd.to_datetime([1_700_000_000_123, 1_700_000_000_001], unit="ms")
    state = State()
    assert list(lines._release((5,), iter([pd.DataFrame({"line_no": [3, 1], "ts": ts, "line": ["b", None]})]), state)) == []
    assert state.value == (0, 0, [1, 3], ["", "b"]) and state.at == 1_700_000_000_123
    (out,) = lines._release((5,), iter([pd.DataFrame({"line_no": [0, 1], "ts": ts, "line": ["a", "b"]})]), state)
    assert out.to_numpy().tolist() == [[5, 0, "a", 0], [5, 1, "b", 1]]


def test_documents_dealt_to_few_states_equal_the_batch(spark, tmp_path):
    random.seed(8)
    texts = ["dogs running fast", "", "a 12 3\u2028", " ", None, "walked", "\u00a0", "\x0b", "WINGED Red sING ing"]
    data = [(d if d else None, i, 1_700_000_000 + d, random.choice(texts)) for d in range(40) for i in range(random.randint(1, 12))]
    data += [((1 << 60) + 1, i, 1_700_000_000, f"line {i}") for i in range(5)]  # no double
    df = spark.createDataFrame(data, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts"))
    key = lambda x: (x[0] or 0, *x[1:])  # noqa: E731  a null id
    want = sorted(map(tuple, lines.decode_lines(df).collect()), key=key)
    assert len({x[0] for x in want}) > 30 and {x[0] for x in want} > {None, (1 << 60) + 1}
    random.shuffle(data)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for k, some in enumerate((data[: len(data) // 2], data[len(data) // 2 :] + data[:20])):
        spark.createDataFrame(some, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts")).repartition(2).write.parquet(str(tmp_path / "in" / str(k)))
        q = lines.run_to_end(lines.decode_stream(source, delay="10000 days", states=3), str(tmp_path / "out"), str(tmp_path / "state"))
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
        assert set(got) <= set(want) and len(got) == len(set(got))
    assert got == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_dealt_gaps_are_released_after_the_delay(spark, tmp_path):
    def put(k, data):
        spark.createDataFrame(data, "doc_id long, line_no long, ts long, line string").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    seen = []
    for k, data in enumerate([[(1, 0, 1000, "one"), (1, 2, 1000, "three"), (1, 5, 1001, "six")], [(2, 0, 9000, "other"), (2, 3, 9000, "waits")], [(3, 0, 9001, "last")]]):
        put(k, data)
        q = lines.run_to_end(lines.decode_stream(source, delay="10 seconds", states=1), str(tmp_path / "out"), str(tmp_path / "state"))
        seen.append(rows(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "sid", "tagged")))
    assert seen[0] == [(1, 0, "one/NN")] and seen[-1] == [(1, 0, "one/NN"), (1, 1, "three/NN"), (1, 2, "six/NN"), (2, 0, "other/NN"), (3, 0, "last/NN")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_the_query_holds_a_state_for_many_documents(spark, monkeypatch):
    from textloom import catalog_annotations as c

    run, kept = lines.run_to_end, []
    monkeypatch.setattr(c.line_stream, "run_to_end", lambda *a: kept.append(run(*a)) or kept[-1])
    n = c.stream_lines(spark, "/root/testdata/sf0.001").count()
    assert n > 0 and len(kept) == 2
    assert all(1 <= x["stateOperators"][0]["numRowsTotal"] <= 200 // c.DOCS_OF_A_STATE + 1 for q in kept for x in q.recentProgress)


def test_ids_far_apart_lose_no_line(spark, tmp_path):
    from textloom import catalog_annotations as c

    ids = [1, 2, -5, 2_000_000_000, 2_000_000_000_000, None]
    text = "\n".join(f"line {i}" for i in range(9))
    spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = c.stream_lines(spark, str(tmp_path)).select("doc_id", "sid", "tagged").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, k, f"line/NN {k}/CD") for i in ids for k in range(9)), key=str)
