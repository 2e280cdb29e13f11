"""Chat formatting: event-sourced reconstruction of conversations, then rendering with a loss mask.

An event log holds ``conv_id, seq, kind, turn, role, text``: ``message`` opens a turn, ``delta`` appends a streamed piece,
``edit`` replaces the text so far, ``regenerate`` drops it (deltas after it build it anew), ``delete`` withdraws the turn.
The log is partitioned by conversation once; events fold per turn, turns get their place by a running sum of lengths, and
one row per conversation comes out. Native: one shuffle, no Python.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a role or text, of this and
of other common templates, are broken by a backslash after their first character; one that is there already gets one
more, so that taking one away again restores every text. A role is URL-encoded.

Cases: null text is empty, a null role is empty; rows of a turn that come twice fold in the order of their sequence, then
role, then text; an unknown kind counts as a message; a turn whose events are all withdrawn is absent; an empty log gives
no rows; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string.
TAILS = r"(\|im_start\||\|im_end\||/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(?=" + TAILS + ")", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\(?=" + TAILS + ")", r"$1$2")


def fold_turns(events: DataFrame, placed: bool = False) -> DataFrame:
    """Final ``conv_id, turn, role, text`` of each turn; the rows stay partitioned by conversation (``placed``: they are so
    already)."""
    e = events.select(
        "conv_id", "turn",
        F.struct("seq", "role", F.coalesce("text", F.lit("")).alias("text"), "kind").alias("e"),
    )
    e = e if placed else e.repartition("conv_id")
    log = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"))
    n = F.size("log")
    base = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] == "delta", -1).otherwise(i)))
    kept = F.when(base < 0, F.col("log")).otherwise(F.slice("log", base + 1, n - base))
    return (
        log.withColumn("kept", kept).where(F.coalesce(F.col("kept")[0]["kind"], F.lit("")) != "delete")
        .select(
            "conv_id", "turn",
            F.coalesce(F.get(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform("kept", lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "").alias("text"),
        )
    )


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss``: the loss mask is an array of code point spans (begin, end exclusive) in order."""
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    t = turns.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)) + F.length("head"))
    piece = F.struct("turn", "at", "role", F.concat("head", "body", F.lit(END)).alias("text"), F.length("body").alias("n"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.transform(
        F.filter("p", lambda x: x["role"].isin(*loss_roles) & (x["n"] > 0)),
        lambda x: F.struct(x["at"].alias("begin"), (x["at"] + x["n"]).alias("end")),
    )
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    parts = F.split(formatted, END.replace("|", r"\|"))
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = F.transform(whole, lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(
        body,
        lambda x: F.struct(
            F.url_decode(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
        ),
    )


def reconstruct(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), placed: bool = False) -> DataFrame:
    return render(fold_turns(events, placed), loss_roles)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]")
    )
    # a turn number that comes twice is two turns
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.unionAll(own).withColumn("turn", F.row_number().over(w)).withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    out = reconstruct(events, placed=True).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), ""
    )
    out = out.withColumn("masked", masked)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH e AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\||\|im_end\||/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>)', '\1\2\\\3', 'g') AS esc FROM e)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(12 + length(role) + 1 + length(esc) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
