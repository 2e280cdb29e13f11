"""Queries and SQL of the library's own operators, over whole tables.

The driver tables hold no annotations, so tags, trees and edges are derived from ``events`` by fixed rules, alike in the
SQL: a user's events in order of time are a sentence, and an event's id and type give its tag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import chars
from .operators import decoders, english, features, lemmas, metrics, tags, tokens, trees, vocab
from .operators.ranks import durable


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """``sid, tid, tag, event_id, event_type``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id") % 5
    tag = F.when(k == 0, F.lit("O")).when(k == 1, F.concat(F.lit("B-"), F.col("event_type"))).otherwise(F.concat(F.lit("I-"), F.col("event_type")))
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return e.select(F.col("user_id").alias("sid"), F.row_number().over(w).cast("long").alias("tid"), tag.alias("tag"), "event_id", "event_type")


EV = """ev AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tid, event_id, event_type,
    CASE event_id % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B-' || event_type ELSE 'I-' || event_type END AS tag FROM events)"""
WORDS = """pieces AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS tid, unnest(p) AS piece FROM
        (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS p FROM documents)),
    words AS (SELECT doc_id, tid, regexp_replace(piece, '^\\s+', '') AS tok,
        CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY tid) AS BIGINT) AS "end" FROM pieces)"""
TREE = """tree AS (SELECT user_id AS tree_id, n AS node_id, n // 2 AS parent_id FROM
    (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    t = tagged(spark, d)
    rows = t.select(F.col("sid").alias("tree_id"), F.col("tid").alias("node_id"), F.floor(F.col("tid") / 2).alias("parent_id"))
    return durable(rows, "tree")  # read several times


def words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.space_words(read(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("corpus_stats", r"""SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean
    FROM (SELECT lang, len(regexp_extract_all(text, '\S+')) AS n FROM documents) GROUP BY lang""")
def corpus_stats(spark, d):
    n = read(spark, d, "documents").select("lang", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@query("space_tokens", f'WITH {WORDS} SELECT doc_id, tid, tok, "end" - length(tok) AS "begin", "end" FROM words')
def space_tokens(spark, d):
    return tokens.space_tokens(read(spark, d, "documents").select("doc_id", "text"))


@query("newline_blocks", r"""WITH b AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS bid, unnest(p) AS block FROM
    (SELECT doc_id, regexp_extract_all(text, '\n*[^\n]+') AS p FROM documents))
    SELECT doc_id, bid, block, CAST(coalesce(sum(length(block)) OVER (PARTITION BY doc_id ORDER BY bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin" FROM b""")
def newline_blocks(spark, d):
    return tokens.newline_blocks(read(spark, d, "documents").select("doc_id", "text"))


CLASS_NAMES = [k for k in chars.CLASSES]
_RE2 = {k: v.replace("'", "''") for k, v in chars.CLASSES.items()}


@query("char_classes", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '[{_RE2[k]}]')) AS {k}" for k in CLASS_NAMES) + " FROM documents")
def char_classes(spark, d):
    return read(spark, d, "documents").select("doc_id", *[chars.count_class(F.col("text"), k).alias(k) for k in CLASS_NAMES])


@query("regex_entities", r"""SELECT page_id, len(regexp_extract_all(html, '&([A-Za-z]+|#[Xx]?[0-9]+);')) AS entities,
    len(regexp_extract_all(html, '[A-Za-z0-9_.-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,12}')) AS emails, len(regexp_extract_all(html, '(https?|ftp)://')) AS links FROM pages""")
def regex_entities(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return read(spark, d, "pages").select(
        "page_id", n(r"&([A-Za-z]+|#[Xx]?[0-9]+);").alias("entities"), n(r"[A-Za-z0-9_.-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,12}").alias("emails"), n(r"(https?|ftp)://").alias("links")
    )


@query("label_ids", """SELECT source AS item, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS cid FROM documents WHERE source IS NOT NULL GROUP BY source""")
def label_ids(spark, d):
    return vocab.first_seen(read(spark, d, "documents"), "source", "doc_id")


@query("char_dictionary", """WITH c AS (SELECT item_id, generate_subscripts(p, 1) AS pos, unnest(p) AS item FROM (SELECT item_id, string_split(text, '') AS p FROM benchmark)),
    m AS (SELECT item, min(struct_pack(a := item_id, b := pos)) AS seen FROM c GROUP BY item)
    SELECT item, row_number() OVER (ORDER BY seen) AS cid FROM m UNION ALL SELECT '<unk>', 0""")
def char_dictionary(spark, d):
    c = read(spark, d, "benchmark").select("item_id", F.posexplode(F.array_remove(F.split("text", ""), "")).alias("pos", "ch"))
    ids = vocab.first_seen(c, "ch", "item_id", "pos").select("item", (F.col("cid") + 1).alias("cid"))
    return ids.unionAll(spark.range(1).select(F.lit("<unk>"), F.lit(0)))


@query("vocab_topk", f"""WITH {WORDS}, f AS (SELECT tok AS item, count(*) AS freq, min(struct_pack(a := doc_id, b := tid)) AS seen FROM words GROUP BY tok)
    SELECT item, freq, row_number() OVER (ORDER BY freq DESC, seen) AS "rank" FROM f ORDER BY freq DESC, seen LIMIT 100""")
def vocab_topk(spark, d):
    return vocab.most_common(words(spark, d), "tok", 100, "doc_id", "tid")


@query("vocab_minfreq", f"""WITH {WORDS} SELECT tok AS item, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, tok) + 2 AS id FROM words GROUP BY tok HAVING count(*) > 2""")
def vocab_minfreq(spark, d):
    return vocab.parser_vocabulary(words(spark, d), "tok", 2)


@query("id_lookup", f"""WITH {WORDS}, v AS (SELECT tok AS item, row_number() OVER (ORDER BY count(*) DESC, tok) + 2 AS id FROM words GROUP BY tok HAVING count(*) > 2)
    SELECT doc_id, CAST(sum(coalesce(id, 2)) AS BIGINT) AS id_sum, count(*) FILTER (WHERE id IS NULL) AS unknown FROM words LEFT JOIN v ON tok = item GROUP BY doc_id""")
def id_lookup(spark, d):
    w = words(spark, d).select("doc_id", "tok")
    got = vocab.lookup(w, "tok", vocab.parser_vocabulary(w, "tok", 2), 2)
    return got.groupBy("doc_id").agg(F.sum("id").alias("id_sum"), F.count_if(F.col("id") == 2).alias("unknown"))


@query("tag_transitions", f"""WITH {EV}, p AS (SELECT coalesce(lag(tag) OVER (PARTITION BY sid ORDER BY tid), '<START>') AS prev, tag AS cur FROM ev
    UNION ALL SELECT arg_max(tag, tid), '<STOP>' FROM ev GROUP BY sid), n AS (SELECT prev, cur, count(*) AS n FROM p GROUP BY prev, cur)
    SELECT prev, cur, n, round(n / CAST(sum(n) OVER (PARTITION BY prev) AS DOUBLE), 6) AS ratio FROM n""")
def tag_transitions(spark, d):
    return vocab.transitions(tagged(spark, d))


@query("downsample", "SELECT doc_id FROM documents WHERE doc_id + 1 = 1 OR floor((doc_id + 1) * 0.25) > floor(doc_id * 0.25)")
def downsample(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (F.col("doc_id") + 1).alias("i"))  # ids are dense from 0
    return vocab.downsample(rows, "i", 0.25).select("doc_id")


@query("iob2", f"""WITH {EV}, l AS (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY tid) AS b FROM ev)
    SELECT sid, tid, CASE WHEN tag LIKE 'I-%' AND (b IS NULL OR b = 'O' OR substr(b, 3) <> substr(tag, 3)) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag FROM l""")
def iob2(spark, d):
    return tags.iob1_to_iob2(tagged(spark, d)).select("sid", "tid", "tag")


@query("iobes", f"""WITH {EV}, l AS (SELECT *, lead(tag) OVER (PARTITION BY sid ORDER BY tid) AS n FROM ev)
    SELECT sid, tid, CASE WHEN tag LIKE 'B-%' AND NOT coalesce(n LIKE 'I-%', false) THEN 'S-' || substr(tag, 3)
        WHEN tag LIKE 'I-%' AND NOT coalesce(n LIKE 'I-%', false) THEN 'E-' || substr(tag, 3) ELSE tag END AS tag FROM l""")
def iobes(spark, d):
    return tags.iob_to_iobes(tagged(spark, d)).select("sid", "tid", "tag")


CHUNKS = f"""{EV}, l AS (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY tid) AS b FROM ev),
    m AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (b IS NULL OR b = 'O' OR substr(b, 3) <> substr(tag, 3) OR tag LIKE 'B-%') THEN 1 ELSE 0 END)
        OVER (PARTITION BY sid ORDER BY tid) AS cid FROM l),
    chunks AS (SELECT sid, min(tid) AS "begin", max(tid) + 1 AS "end", arg_min(substr(tag, 3), tid) AS label FROM m WHERE tag <> 'O' GROUP BY sid, cid)"""


@query("event_chunks", f'WITH {CHUNKS} SELECT sid, "begin", "end", label FROM chunks')
def event_chunks(spark, d):
    return tags.chunks(tagged(spark, d))


@query("paint_chunks", f"""WITH {CHUNKS} SELECT e.sid, e.tid, CASE WHEN c.label IS NULL THEN 'O' WHEN c."end" - c."begin" = 1 THEN 'S-' || c.label
    WHEN e.tid = c."begin" THEN 'B-' || c.label WHEN e.tid = c."end" - 1 THEN 'E-' || c.label ELSE 'I-' || c.label END AS tag
    FROM ev e LEFT JOIN chunks c ON e.sid = c.sid AND e.tid >= c."begin" AND e.tid < c."end" """)
def paint_chunks(spark, d):
    t = tagged(spark, d)
    return tags.paint(tags.chunks(t), t)


BILOU = f"""{EV}, u AS (SELECT sid, tid, substr('OBILU', CAST(event_id % 5 AS INT) + 1, 1) AS k, event_type FROM ev),
    s AS (SELECT *, last_value(CASE WHEN k = 'B' THEN tid WHEN k IN ('O', 'L', 'U') THEN -1 END IGNORE NULLS)
        OVER (PARTITION BY sid ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM u)
    """


@query("bilou_chunks", f"""WITH {BILOU} SELECT sid, CASE WHEN k = 'U' THEN tid ELSE op END AS "begin", tid + 1 AS "end", event_type AS label FROM s WHERE k = 'U' OR (k = 'L' AND op >= 0)""")
def bilou_chunks(spark, d):
    k = F.substring(F.lit("OBILU"), 1, 5)
    t = tagged(spark, d)
    t = t.withColumn("tag", F.concat(F.substr(k, (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)), F.lit("-"), F.col("event_type")))
    return tags.bilou_chunks(t)


@query("detokenize", f"""WITH {WORDS} SELECT doc_id, string_agg(tok, ' ' ORDER BY tid) AS plain FROM words GROUP BY doc_id""")
def detokenize(spark, d):
    return tokens.token_arrays(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join("toks", " ").alias("plain"))


@query("chunk_f1", f"""WITH {CHUNKS}, p AS (SELECT sid, "begin", CASE WHEN sid % 3 = 0 THEN "end" + 1 ELSE "end" END AS "end", label FROM chunks),
    n AS (SELECT (SELECT count(*) FROM (SELECT sid, "begin", "end", label FROM chunks INTERSECT SELECT sid, "begin", "end", label FROM p)) AS correct, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM chunks) AS gold)
    SELECT correct, predicted, gold, round(correct / predicted, 6) AS "precision", round(correct / gold, 6) AS recall, round(2.0 * correct / (predicted + gold), 6) AS f1 FROM n""")
def chunk_f1(spark, d):
    gold = tags.chunks(tagged(spark, d))
    pred = gold.withColumn("end", F.when(F.col("sid") % 3 == 0, F.col("end") + 1).otherwise(F.col("end")))
    return metrics.set_f1(gold, pred, ["sid", "begin", "end", "label"])


@query("confusion_prf", """WITH n AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fp,
    count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS tn, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fn FROM labels)
    SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
        CASE WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM n""")
def confusion_prf(spark, d):
    return metrics.confusion(read(spark, d, "labels"), "toxic", "quality")


@query("attachment", f"""WITH {EV}, a AS (SELECT tid // 2 AS h, event_type AS r, CASE WHEN event_id % 7 = 0 THEN tid // 3 ELSE tid // 2 END AS ph,
    CASE WHEN event_id % 11 = 0 THEN 'x' ELSE event_type END AS pr FROM ev)
    SELECT round(avg(CAST(h = ph AS INT)), 6) AS uas, round(avg(CAST(h = ph AND r = pr AS INT)), 6) AS las, round(avg(CAST(r = pr AS INT)), 6) AS label_accuracy FROM a""")
def attachment(spark, d):
    half, third = F.floor(F.col("tid") / 2), F.floor(F.col("tid") / 3)
    t = tagged(spark, d).select(
        F.col("event_type").alias("form"), half.alias("head"), F.col("event_type").alias("rel"), F.when(F.col("event_id") % 7 == 0, third).otherwise(half).alias("p_head"),
        F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("event_type")).alias("p_rel"),
    )
    return metrics.attachment(t)


@query("tree_ancestors", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id, parent_id AS ancestor, 1 AS distance FROM tree WHERE parent_id <> 0
    UNION ALL SELECT tree_id, node_id, ancestor // 2, distance + 1 FROM up WHERE ancestor // 2 <> 0) SELECT * FROM up""")
def tree_ancestors(spark, d):
    return trees.ancestors(tree(spark, d))


@query("tree_siblings", f"""WITH {TREE}, k AS (SELECT tree_id, parent_id AS node_id, count(*) AS children FROM tree GROUP BY 1, 2)
    SELECT tree_id, node_id, parent_id, coalesce(lag(node_id) OVER w, 0) AS left_id, coalesce(lead(node_id) OVER w, 0) AS right_id, coalesce(children, 0) AS children
    FROM tree LEFT JOIN k USING (tree_id, node_id) WINDOW w AS (PARTITION BY tree_id, parent_id ORDER BY node_id)""")
def tree_siblings(spark, d):
    return trees.siblings(tree(spark, d)).fillna(0, ["left_id", "right_id"])


@query("tree_lca", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id, node_id AS ancestor, 0 AS distance FROM tree
    UNION ALL SELECT tree_id, node_id, ancestor // 2, distance + 1 FROM up WHERE ancestor // 2 <> 0),
    p AS (SELECT tree_id, node_id AS a, node_id - 1 AS b FROM tree WHERE node_id > 1)
    SELECT p.tree_id, a, b, arg_min(l.ancestor, l.distance + r.distance) AS lca FROM p JOIN up l ON p.tree_id = l.tree_id AND p.a = l.node_id
    JOIN up r ON p.tree_id = r.tree_id AND p.b = r.node_id AND l.ancestor = r.ancestor GROUP BY 1, 2, 3""")
def tree_lca(spark, d):
    t = tree(spark, d)
    return trees.lowest_common(t, t.where("node_id > 1").select("tree_id", F.col("node_id").alias("a"), (F.col("node_id") - 1).alias("b")))


@query("feature_window", """WITH w AS (SELECT vec_id, embedding AS v, lead(embedding, 3) OVER o AS a, lag(embedding, 3) OVER o AS z FROM embeddings WINDOW o AS (PARTITION BY CAST(floor(sqrt(vec_id)) AS BIGINT) ORDER BY vec_id))
    SELECT vec_id, CAST(7 * 64 AS INT) AS size, round(CAST(coalesce(a[1], 0) AS DOUBLE), 6) AS ahead, round(CAST(v[1] AS DOUBLE), 6) AS here, round(CAST(coalesce(z[64], 0) AS DOUBLE), 6) AS behind FROM w""")
def feature_window(spark, d):
    w = features.window_of("embedding", ["sid"], "vec_id", 64)
    e = read(spark, d, "embeddings").withColumn("sid", F.floor(F.sqrt("vec_id"))).select("vec_id", w.alias("f"))
    at = lambda i: F.round(F.col("f")[i].cast("double"), 6)
    return e.select("vec_id", F.size("f").alias("size"), at(0).alias("ahead"), at(3 * 64).alias("here"), at(7 * 64 - 1).alias("behind"))


@query("label_argmax", "SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS best FROM embeddings")
def label_argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", features.argmax(F.col("embedding"), 10).alias("best"))


LENGTHS = [50, 200, 1000, 5000, 1_000_000]


@query("token_batches", r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) + 1 AS n FROM documents),
    b AS (SELECT doc_id, CASE WHEN n <= 50 THEN 50 WHEN n <= 200 THEN 200 WHEN n <= 1000 THEN 1000 WHEN n <= 5000 THEN 5000 ELSE 1000000 END AS bucket FROM n),
    c AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS cnt, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS i FROM b),
    p AS (SELECT *, least(greatest(cnt * bucket // 20000, 1), cnt) AS k FROM c)
    SELECT doc_id, bucket, CASE WHEN i < (cnt % k) * (cnt // k + 1) THEN i // (cnt // k + 1) ELSE cnt % k + (i - (cnt % k) * (cnt // k + 1)) // (cnt // k) END AS batch FROM p""")
def token_batches(spark, d):
    n = read(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"\S+")) + 1).alias("n"))
    b = n.select("doc_id", features.bucket(F.col("n"), LENGTHS).alias("bucket"))
    return features.batches(b, "bucket", "doc_id", 20_000).select("doc_id", "bucket", "batch")


@query("conll_rows", f"""WITH {EV} SELECT sid, tid, tid || chr(9) || event_type || chr(9) || '_' || chr(9) || tag || chr(9) || '_' || chr(9) || '_' || chr(9) || (tid // 2) || chr(9) || 'dep' || chr(9) || '_' || chr(9) || '_' AS line FROM ev""")
def conll_rows(spark, d):
    from .sources.columns import conll_line

    t = tagged(spark, d)
    cols = {"id": F.col("tid"), "form": F.col("event_type"), "cpos": F.col("tag"), "head": F.floor(F.col("tid") / 2), "deprel": F.lit("dep")}
    return t.select("sid", "tid", conll_line(cols).alias("line"))


@query("sentences")
def sentences(spark, d):
    return english.english_sentences(read(spark, d, "documents"))


MOVES = [[0.5 if i == j else 0.125 * (i - j) for j in range(4)] for i in range(4)]
INTO, OUT_OF = [0.0, 0.25, -0.5, 0.125], [0.25, 0.0, 0.0, -0.25]


def emissions(spark: SparkSession, d: str) -> DataFrame:
    """``sid, tid, scores, tag_id``: vectors as sentences of growing length, k-th of 2k + 1 tokens."""
    e = read(spark, d, "embeddings")
    sid = F.floor(F.sqrt("vec_id"))
    return e.select(sid.alias("sid"), (F.col("vec_id") - sid * sid).alias("tid"), F.slice("embedding", 1, 4).cast("array<double>").alias("scores"), (F.col("label") % 4).cast("int").alias("tag_id"))


EMISSIONS = """em AS (SELECT sid, vec_id - sid * sid AS tid, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS s, label % 4 AS tag FROM (SELECT *, CAST(floor(sqrt(vec_id)) AS BIGINT) AS sid FROM embeddings))"""


def _best(at: int) -> str:
    sums = ", ".join(f"v[{j + 1}] + {MOVES[at][j]}" for j in range(4))
    return f"[{sums}]"


@query("viterbi_tags", f"""WITH RECURSIVE {EMISSIONS}, p AS (SELECT sid, 0 AS tid, [{", ".join(f"s[{i + 1}] + {INTO[i]}" for i in range(4))}] AS v, [[0], [1], [2], [3]] AS paths FROM em WHERE tid = 0
    UNION ALL SELECT p.sid, p.tid + 1, [{", ".join(f"list_max({_best(i)}) + s[{i + 1}]" for i in range(4))}], [{", ".join(f"list_append(paths[list_position({_best(i)}, list_max({_best(i)}))], {i})" for i in range(4))}]
        FROM p JOIN em ON em.sid = p.sid AND em.tid = p.tid + 1),
    e AS (SELECT sid, max(tid) AS z FROM em GROUP BY sid), f AS (SELECT p.sid, paths, [{", ".join(f"v[{i + 1}] + {OUT_OF[i]}" for i in range(4))}] AS v FROM p JOIN e ON p.sid = e.sid AND p.tid = e.z),
    b AS (SELECT sid, paths[list_position(v, list_max(v))] AS path FROM f) SELECT sid, generate_subscripts(path, 1) - 1 AS tid, unnest(path) AS tag_id FROM b""")
def viterbi_tags(spark, d):
    return decoders.decode_paths(emissions(spark, d), MOVES, start=INTO, stop=OUT_OF)


def _log_sum(cells: list[str]) -> str:
    top = f"list_max([{', '.join(cells)}])"
    return f"({top} + ln({' + '.join(f'exp({c} - {top})' for c in cells)}))"


@query("crf_losses", f"""WITH RECURSIVE {EMISSIONS}, p AS (SELECT sid, 0 AS tid, tag, [{", ".join(f"s[{i + 1}] + {INTO[i]}" for i in range(4))}] AS v, [{", ".join(map(str, INTO))}][tag + 1] + s[tag + 1] AS gold FROM em WHERE tid = 0
    UNION ALL SELECT p.sid, p.tid + 1, em.tag, [{", ".join(f"{_log_sum([f'v[{j + 1}] + {MOVES[i][j]}' for j in range(4)])} + s[{i + 1}]" for i in range(4))}], gold + s[em.tag + 1] + [{", ".join(str(x) for row in MOVES for x in row)}][em.tag * 4 + p.tag + 1]
        FROM p JOIN em ON em.sid = p.sid AND em.tid = p.tid + 1),
    e AS (SELECT sid, max(tid) AS z FROM em GROUP BY sid), f AS (SELECT p.sid, z + 1 AS n, {_log_sum([f"v[{i + 1}] + {OUT_OF[i]}" for i in range(4)])} AS total, gold + [{", ".join(map(str, OUT_OF))}][tag + 1] AS gold FROM p JOIN e ON p.sid = e.sid AND p.tid = e.z)
    SELECT sid, n, round(total, 6) AS log_partition, round(gold, 6) AS gold, round(total - gold, 6) AS loss FROM f""")
def crf_losses(spark, d):
    got = decoders.crf_losses(emissions(spark, d), MOVES, INTO, OUT_OF, piece=8)
    return got.select("sid", "n", *[F.round(c, 6).alias(c) for c in ("log_partition", "gold", "loss")])


TAGS = ["O", "B-a", "I-a", "B-b", "I-b", "B-c", "I-c"]
SIZES = [4, 16, 64, 256, 1024, 4096]
ARGMAX = f"""best AS (SELECT sid, vec_id - sid * sid AS tid, [{", ".join(f"'{x}'" for x in TAGS)}][list_position(embedding[1:7], list_max(embedding[1:7]))] AS tag
    FROM (SELECT *, CAST(floor(sqrt(vec_id)) AS BIGINT) AS sid FROM embeddings))"""


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Scores in padded batches, and the tags read back from them."""
    sid = F.floor(F.sqrt("vec_id"))
    e = read(spark, d, "embeddings").select(sid.alias("sid"), (F.col("vec_id") - sid * sid).alias("tid"), F.slice("embedding", 1, 9).alias("scores"))
    return decoders.decoded_batches(decoders.padded_scores(e, SIZES, 100), spark.createDataFrame(list(enumerate(TAGS)), "cid int, item string"))


@query("decoded_tags", f"WITH {ARGMAX} SELECT sid, tid, tag FROM best")
def decoded_tags(spark, d):
    return decoded(spark, d)


@query("decoded_chunks", f"""WITH {ARGMAX}, l AS (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY tid) AS b FROM best),
    m AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (b IS NULL OR b = 'O' OR substr(b, 3) <> substr(tag, 3) OR tag LIKE 'B-%') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY tid) AS cid FROM l)
    SELECT sid, min(tid) AS "begin", max(tid) + 1 AS "end", arg_min(substr(tag, 3), tid) AS label FROM m WHERE tag <> 'O' GROUP BY sid, cid""")
def decoded_chunks(spark, d):
    return tags.chunks(decoded(spark, d))


@query("parsed_heads")
def parsed_heads(spark, d):
    """A sentence of seven words for each vector; the test holds heads and relations against an exhaustive search."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.lit(8).alias("n"), F.col("embedding").cast("array<double>").alias("arcs"))
    rel = F.flatten(F.transform("arcs", lambda x: F.array(x, -x, x * x, F.lit(0.05))))
    return decoders.parsed(e.withColumn("relations", rel), [8, 16, 64], 6400)


@query("mst_heads", """WITH RECURSIVE c AS (SELECT vec_id AS sid, list_transform(range(64), lambda i: -ln(CASE WHEN i // 8 = i % 8 THEN 0 ELSE abs(embedding[i + 1]::DOUBLE) END + 1e-20)) AS c FROM embeddings),
    s AS (SELECT sid, c, 0 AS k, list_transform(range(8), lambda j: c[j * 8 + 1]) AS best, list_transform(range(8), lambda j: 0) AS head, list_transform(range(8), lambda j: j > 0) AS free FROM c
        UNION ALL SELECT sid, c, k + 1, list_transform(range(8), lambda j: CASE WHEN left_[j + 1] AND c[j * 8 + node + 1] < best[j + 1] THEN c[j * 8 + node + 1] ELSE best[j + 1] END),
            list_transform(range(8), lambda j: CASE WHEN left_[j + 1] AND c[j * 8 + node + 1] < best[j + 1] THEN node ELSE head[j + 1] END), left_
        FROM (SELECT *, list_transform(range(8), lambda j: free[j + 1] AND j <> node) AS left_ FROM (SELECT *, list_position(open, list_min(open)) - 1 AS node
            FROM (SELECT *, list_transform(range(8), lambda j: CASE WHEN free[j + 1] THEN best[j + 1] ELSE 1e300 END) AS open FROM s WHERE k < 7))))
    SELECT sid, generate_subscripts(head, 1) - 1 AS dep, unnest(head) AS head FROM s WHERE k = 7""")
def mst_heads(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("probs"))
    return decoders.tree_heads(e, 8)


@query("english_tokens")
def english_tokens(spark, d):
    return english.english_tokens(read(spark, d, "documents"))


FORMS = r"""forms AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form FROM documents),
    pairs AS MATERIALIZED (SELECT form, lower(form) AS low, CASE WHEN form LIKE '%ing' THEN 'VBG' WHEN form LIKE '%ed' THEN 'VBD' WHEN form LIKE '%est' THEN 'JJS'
        WHEN form LIKE '%er' THEN 'JJR' WHEN form LIKE '%s' THEN 'NNS' ELSE 'NN' END AS pos FROM forms)"""
RULES = ", ".join(f"({10 * i}, '{x}', '{t}', '{s}', {r}, {d})" for i, (x, t, s, r, d) in enumerate(lemmas.SUFFIXES))


def forms(spark: SparkSession, d: str) -> DataFrame:
    """``form, pos``: the distinct words of Latin letters, tagged by their endings. Written once, as most who read them do so several times."""
    f = read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("form")).distinct()
    pos = F.when(F.endswith("form", F.lit("ing")), "VBG").when(F.endswith("form", F.lit("ed")), "VBD").when(F.endswith("form", F.lit("est")), "JJS")
    return durable(f.withColumn("pos", pos.when(F.endswith("form", F.lit("er")), "JJR").when(F.endswith("form", F.lit("s")), "NNS").otherwise("NN")), "forms")


@query("lemmas", f"""WITH {FORMS}, rules AS (SELECT * FROM (VALUES {RULES}) AS r(rank, lexicon, tags, suffix, replacements, twice)),
    stems AS MATERIALIZED (SELECT form, pos, rank, replacements, twice, left(low, length(low) - length(suffix)) AS stem FROM pairs JOIN rules ON ends_with(low, suffix) AND lexicon = left(pos, 2) AND contains(tags, pos)),
    tried AS MATERIALIZED (SELECT form, pos, rank + i AS rank, stem || replacements[i] AS base FROM stems, generate_series(1, 2) g(i) WHERE i <= len(replacements)
        UNION ALL SELECT form, pos, rank + 2 + i, left(stem, length(stem) - 1) || replacements[i] FROM stems, generate_series(1, 2) g(i)
        WHERE i <= len(replacements) AND twice AND length(stem) >= 2 AND right(stem, 1) = substr(stem, length(stem) - 1, 1)),
    lows AS MATERIALIZED (SELECT DISTINCT low FROM pairs),
    best AS (SELECT form, pos, arg_min(base, rank) AS base FROM tried SEMI JOIN lows ON base = low GROUP BY form, pos)
    SELECT form, pos, coalesce(base, low) AS lemma FROM pairs LEFT JOIN best USING (form, pos)""")
def lemma_forms(spark, d):
    f = forms(spark, d)
    bases = f.select(F.lower("form").alias("base")).distinct().select("base", F.explode(F.array(*map(F.lit, ("VB", "NN", "JJ", "RB")))).alias("lexicon"))
    return lemmas.lemmas(f, bases).select("form", "pos", "lemma")


@query("coarse_tags", f"WITH {FORMS} SELECT CASE left(pos, 2) WHEN 'VB' THEN 'VB' WHEN 'JJ' THEN 'JJ' ELSE 'NN' END AS coarse, count(*) AS n FROM pairs GROUP BY 1")
def coarse_tags(spark, d):
    return forms(spark, d).groupBy(lemmas.coarse(F.col("pos")).alias("coarse")).agg(F.count("*").alias("n"))


def _flags(c: str) -> str:
    a, b, ta, tb = f"split_part(p_{c}, '-', 1)", f"split_part({c}, '-', 1)", f"substr(p_{c}, 3)", f"substr({c}, 3)"
    return f"""({a} || {b} IN ('BB', 'IB', 'OB', 'OI') OR ({b} <> 'O' AND {ta} <> {tb})) AS s_{c},
        ({a} || {b} IN ('BB', 'BO', 'IB', 'IO') OR ({a} <> 'O' AND {ta} <> {tb})) AS e_{c}"""


@query("conll_chunks", f"""WITH {EV}, l AS (SELECT sid, tid, tag AS gold, CASE WHEN event_id % 7 = 0 THEN 'O' ELSE tag END AS pred FROM ev),
    q AS (SELECT *, coalesce(lag(gold) OVER w, 'O') AS p_gold, coalesce(lag(pred) OVER w, 'O') AS p_pred FROM l WINDOW w AS (PARTITION BY sid ORDER BY tid)),
    f AS (SELECT *, {_flags("gold")}, {_flags("pred")} FROM q),
    e AS (SELECT *, coalesce(min(CASE WHEN e_gold THEN tid END) OVER v, -1) AS z_gold, coalesce(min(CASE WHEN e_pred THEN tid END) OVER v, -1) AS z_pred FROM f
        WINDOW v AS (PARTITION BY sid ORDER BY tid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    k AS (SELECT substr(gold, 3) AS type, 1 AS g, 0 AS p, CAST(s_pred AND gold[3:] = pred[3:] AND z_gold = z_pred AS INT) AS k FROM e WHERE s_gold
        UNION ALL SELECT substr(pred, 3), 0, 1, 0 FROM e WHERE s_pred), t AS (SELECT * FROM k UNION ALL SELECT '*', g, p, k FROM k),
    n AS (SELECT type, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(k) AS BIGINT) AS correct FROM t GROUP BY type)
    SELECT type, gold, predicted, correct, round(coalesce(100.0 * correct / nullif(predicted, 0), 0), 2)::DOUBLE AS "precision", round(coalesce(100.0 * correct / nullif(gold, 0), 0), 2)::DOUBLE AS recall,
        round(coalesce(200.0 * correct / nullif(gold + predicted, 0), 0), 2)::DOUBLE AS f1 FROM n""")
def conll_chunks(spark, d):
    t = tagged(spark, d).select("sid", "tid", F.col("tag").alias("gold"), F.when(F.col("event_id") % 7 == 0, "O").otherwise(F.col("tag")).alias("pred"))
    return metrics.conll_chunks(t)


@query("edge_scores", f"""WITH {EV}, a AS (SELECT sid, tid AS dep, tid // 2 AS head, event_type AS rel, tid // (CASE WHEN event_id % 7 = 0 THEN 3 ELSE 2 END) AS ph,
        CASE WHEN event_id % 11 = 0 THEN 'x' ELSE event_type END AS pr FROM ev),
    n AS (SELECT false AS labeled, count(*) AS n, count(*) FILTER (head = ph) AS correct FROM a UNION ALL SELECT true, count(*), count(*) FILTER (head = ph AND rel = pr) FROM a)
    SELECT labeled, correct, n AS predicted, n AS gold, round(correct / n, 6) AS "precision", round(correct / n, 6) AS recall, round(correct / n, 6) AS f1 FROM n""")
def edge_scores(spark, d):
    t = tagged(spark, d).select("sid", F.col("tid").alias("dep"), F.floor(F.col("tid") / 2).alias("head"), F.col("event_type").alias("rel"), "event_id")
    pred = t.withColumns({
        "head": F.when(F.col("event_id") % 7 == 0, F.floor(F.col("dep") / 3)).otherwise(F.col("head")), "rel": F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("rel")),
    })
    return metrics.edge_scores(t, pred)


@query("model_split", """SELECT doc_id, CASE WHEN i < n * 9999 // 10000 THEN 'train' WHEN i < n * 99995 // 100000 THEN 'valid' ELSE 'test' END AS part
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)""")
def model_split(spark, d):
    from .sources import corpora

    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("x"), F.col("doc_id")).alias("line"))
    return corpora.model_lines(rows, "line", "doc_id").select(F.substring("line", 2, 20).cast("long").alias("doc_id"), "part")
