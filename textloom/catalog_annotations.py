"""More queries with their SQL: spacing, vocabularies, vectors, streams, trees, graph scores, inflection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _RE2, BILOU, EMISSIONS, EV, FORMS, LENGTHS, TREE, WORDS, emissions, forms, query, read, tagged, tree, words
from .functions import chars
from .operators import decoders, english, features, metrics, morphology, tags, text, tokens, trees, vocab
from .operators.ranks import durable, ranked, shared_dir
from .sources import columns, corpora
from .streaming import lines as line_stream

TOKS = r"""toks AS (SELECT doc_id AS sid, generate_subscripts(p, 1) - 1 AS tid, unnest(p) AS tok FROM
        (SELECT doc_id, regexp_extract_all(text, '\w+|[^\w\s]') AS p FROM documents))"""
SPACES = TOKS + """, k AS (SELECT *, sum(CASE WHEN tok = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY tid) AS k FROM toks),
    n AS (SELECT *, lead(tok) OVER w AS nt, lead(k) OVER w AS nk FROM k WINDOW w AS (PARTITION BY sid ORDER BY tid)),
    spaced AS (SELECT sid, tid, tok, NOT (tok = '(' OR (tok = '"' AND k % 2 = 1) OR coalesce(nt IN ('.', ':', ',', ';', ')', 'n''t', '!', '?')
        OR starts_with(nt, '''') OR (nt = '"' AND nk % 2 = 0), false)) AS space_after FROM n)"""


PIECE = r"\w+|[^\w\s]"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """``sid, tid, tok``: runs of word characters, and every other sign alone."""
    p = read(spark, d, "documents").select(F.col("doc_id").alias("sid"), F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), 0)).alias("tid", "tok"))
    return p.withColumn("tid", F.col("tid").cast("long"))


@query("space_after", f"WITH {SPACES} SELECT sid, tid, space_after FROM spaced")
def space_after(spark, d):
    return text.infer_spaces(pieces(spark, d)).select("sid", "tid", "space_after")


@query("plain_text", f"WITH {SPACES} SELECT sid, rtrim(string_agg(tok || CASE WHEN space_after THEN ' ' ELSE '' END, '' ORDER BY tid)) AS plain FROM spaced GROUP BY sid")
def plain_text(spark, d):
    docs = tokens.token_arrays(read(spark, d, "documents").select("doc_id", "text"), PIECE)
    return docs.select(F.col("doc_id").alias("sid"), text.spaced_text(F.col("toks")).alias("plain"))


@query("tagged_text", f"WITH {EV} SELECT sid, string_agg(event_type || CASE WHEN tag <> 'O' THEN ' <' || tag || '>' ELSE '' END, ' ' ORDER BY tid) AS tagged FROM ev GROUP BY sid")
def tagged_text(spark, d):
    return text.tagged_text(tagged(spark, d).withColumn("tok", F.col("event_type")), "tag")


@query("tag_dictionary", f"""WITH {EV}, f AS (SELECT tag AS item, min(struct_pack(a := sid, b := tid)) AS seen FROM ev WHERE tag <> 'O' GROUP BY tag),
    i AS (SELECT item, row_number() OVER (ORDER BY seen, item) AS cid FROM f), n AS (SELECT count(*) AS n FROM i)
    SELECT 'O' AS item, 0 AS cid UNION ALL SELECT * FROM i UNION ALL SELECT '<START>', n + 1 FROM n UNION ALL SELECT '<STOP>', n + 2 FROM n""")
def tag_dictionary(spark, d):
    return vocab.tag_dictionary(tagged(spark, d), "tag", "sid", "tid", outside=True)


@query("label_dictionary", "SELECT source AS item, row_number() OVER (ORDER BY source) - 1 AS cid FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def label_dictionary(spark, d):
    return vocab.label_dictionary(read(spark, d, "documents"), "source")


@query("vocab_frequent", f"""WITH {WORDS}, f AS (SELECT tok AS item, count(*) AS freq, min(struct_pack(a := doc_id, b := tid)) AS seen FROM words GROUP BY tok HAVING count(*) >= 3)
    SELECT item, freq, row_number() OVER (ORDER BY freq DESC, seen) - 1 AS cid FROM f ORDER BY freq DESC, seen LIMIT 500""")
def vocab_frequent(spark, d):
    return vocab.frequent(words(spark, d), "tok", 3, 500, "doc_id", "tid")


@query("graph_vocabulary", f"""WITH {WORDS}, t AS (SELECT 'word' AS kind, tok AS item, -count(*) AS n FROM words GROUP BY tok HAVING count(*) > 2
        UNION ALL SELECT DISTINCT 'tag', lang, 0 FROM documents)
    SELECT kind, item, row_number() OVER (ORDER BY kind DESC, n, item) + 2 AS id FROM t""")
def graph_vocabulary(spark, d):
    return vocab.graph_vocabulary(words(spark, d), "tok", "lang", 2, tagged=read(spark, d, "documents"))


@query("vocab_extended", f"""WITH {WORDS}, f AS (SELECT tok AS item, count(*) AS n FROM words GROUP BY tok), v AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) + 2 AS id FROM f WHERE n > 20)
    SELECT * FROM v UNION ALL SELECT item, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY item) FROM f WHERE n <= 20""")
def vocab_extended(spark, d):
    w = words(spark, d)
    return vocab.extend(vocab.parser_vocabulary(w, "tok", 20).select("item", "id"), w.select(F.col("tok").alias("item")))


@query("dev_sample", "SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'dev' ELSE 'train' END AS part FROM documents")
def dev_sample(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return vocab.dev_sample(docs, "doc_id", docs.where("doc_id % 7 = 3"))


@query("pad_vectors", "SELECT vec_id, 100 AS n, round(CAST(embedding[64] AS DOUBLE), 6) AS inner, 0.0::DOUBLE AS outer, 16 AS cut FROM embeddings")
def pad_vectors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", features.pad_to(F.col("embedding"), 100, F.lit(0.0).cast("float")).alias("long"), features.pad_to(F.col("embedding"), 16, F.lit(0.0).cast("float")).alias("short"))
    return e.select("vec_id", F.size("long").alias("n"), F.round(F.col("long")[63].cast("double"), 6).alias("inner"), F.col("long")[64].cast("double").alias("outer"), F.size("short").alias("cut"))


@query("concat_vectors", "SELECT vec_id, 72 AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[1] AS DOUBLE), 6) AS b, round(CAST(embedding[8] AS DOUBLE), 6) AS z FROM embeddings")
def concat_vectors(spark, d):
    v = features.concat_named({"word": F.slice("embedding", 1, 8), "char": F.col("embedding")})
    e = read(spark, d, "embeddings").select("vec_id", v.alias("v"))
    at = lambda i: F.round(F.col("v")[i].cast("double"), 6)
    return e.select("vec_id", F.size("v").alias("n"), at(0).alias("a"), at(64).alias("b"), at(71).alias("z"))


@query("word_vectors", f"""WITH {WORDS}, v AS (SELECT DISTINCT regexp_replace(lower(tok), '[0-9]', '#', 'g') AS word FROM words WHERE length(tok) % 3 <> 0),
    k AS (SELECT doc_id, tok, CASE WHEN tok IN (SELECT word FROM v) THEN length(tok) WHEN lower(tok) IN (SELECT word FROM v) THEN length(tok)
        WHEN regexp_replace(lower(tok), '[0-9]', '#', 'g') IN (SELECT word FROM v) THEN length(tok) WHEN regexp_replace(lower(tok), '[0-9]', '0', 'g') IN (SELECT word FROM v) THEN length(tok) ELSE 0 END AS n FROM words)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n = 0) AS unknown FROM k GROUP BY doc_id""")
def word_vectors(spark, d):
    w = words(spark, d).select("doc_id", "tok")
    known = w.where("length(tok) % 3 <> 0").select(F.regexp_replace(F.lower("tok"), "[0-9]", "#").alias("word")).distinct()
    got = features.word_vectors(w, "tok", known.withColumn("vector", F.array(F.length("word").cast("double"))), 1)
    n = F.col("vector")[0]
    return got.groupBy("doc_id").agg(F.sum(n).cast("long").alias("total"), F.count_if(n == 0).alias("unknown"))


CHARS = """c AS (SELECT item_id, generate_subscripts(p, 1) AS pos, unnest(p) AS item FROM (SELECT item_id, string_split(text, '') AS p FROM benchmark)),
    m AS (SELECT item, row_number() OVER (ORDER BY min(struct_pack(a := item_id, b := pos))) AS cid FROM c GROUP BY item),
    s AS (SELECT item_id AS doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS item FROM (SELECT item_id, string_split(reverse(text), '') AS p FROM benchmark)),
    stream AS (SELECT doc_id, pos, CAST(cid AS BIGINT) AS id FROM s JOIN m USING (item))"""


def stream(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    c = b.select("doc_id", F.posexplode(F.array_remove(F.split("text", ""), "")).alias("pos", "ch"))
    ids = vocab.first_seen(c, "ch", "doc_id", "pos").select("item", (F.col("cid") + 1).alias("cid"))
    return features.char_stream(b, ids, backward=True)


@query("char_stream", f"WITH {CHARS} SELECT * FROM stream")
def char_stream(spark, d):
    return stream(spark, d)


@query("stream_batches", f"""WITH {CHARS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) // 8 AS n FROM stream),
    b AS (SELECT doc_id, pos % n AS "row", pos // n AS col, id FROM n WHERE pos < n * 8)
    SELECT doc_id, "row", col, id, lead(id) OVER (PARTITION BY doc_id, col ORDER BY "row") AS target FROM b""")
def stream_batches(spark, d):
    return features.stream_batches(stream(spark, d), 8)


@query("char_offsets", f"""WITH {EV}, o AS (SELECT sid, tid, length(event_type) AS n, sum(length(event_type) + 1) OVER (PARTITION BY sid ORDER BY tid) - 1 AS e, sum(length(event_type) + 1) OVER (PARTITION BY sid) - 1 AS t FROM ev)
    SELECT sid, tid, CAST(e AS BIGINT) AS forward, CAST(t - e + n AS BIGINT) AS backward FROM o""")
def char_offsets(spark, d):
    return features.char_offsets(tagged(spark, d).withColumn("tok", F.col("event_type")))


@query("length_buckets")
def length_buckets(spark, d):
    n = read(spark, d, "documents").groupBy(F.regexp_count("text", F.lit(r"\S+")).alias("n")).agg(F.count("*").alias("k"))
    splits = features.length_splits({r["n"]: r["k"] for r in n.collect()}, 8)  # a row a length
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(splits)], "bucket int, longest int")


@query("semantic_edges", """WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT vec_id AS sid, i % 8 - 1 AS tid, CASE WHEN i // 8 = 0 THEN 7 ELSE i // 8 - 1 END AS head, CASE WHEN v >= 0.05 THEN 0 ELSE 1 END AS rel_id FROM c WHERE v > 0 AND i % 8 > 0""")
def semantic_edges(spark, d):
    e = read(spark, d, "embeddings")
    arcs = e.select(F.col("vec_id").alias("sid"), F.lit(8).alias("n"), F.col("embedding").cast("array<double>").alias("logits"))
    rel = arcs.select("sid", F.posexplode("logits").alias("at", "v")).select("sid", F.floor(F.col("at") / 8).alias("head"), (F.col("at") % 8).alias("dep"), F.array("v", F.lit(0.05), -F.col("v")).alias("scores"))
    return decoders.semantic_edges(arcs, rel)


@query("learning_rates", "SELECT doc_id, round(0.01 * 0.75 ** (doc_id / 100.0), 8) AS rate FROM documents")
def learning_rates(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(decoders.exponential_rate(F.col("doc_id"), 0.01, 0.75, 100.0), 8).alias("rate"))


EDGES = f"""{EV}, g AS (SELECT sid, tid AS dep, tid // 2 AS head, event_type AS rel FROM ev UNION SELECT sid, tid, tid // 5, 'x' FROM ev WHERE event_id % 4 = 0),
    p AS (SELECT sid, tid AS dep, CASE WHEN event_id % 7 = 0 THEN tid // 3 ELSE tid // 2 END AS head, CASE WHEN event_id % 11 = 0 THEN 'y' ELSE event_type END AS rel FROM ev
        UNION SELECT sid, tid, tid // 5, 'x' FROM ev WHERE event_id % 8 = 0)"""


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold edges, predicted ones, and tags. A token's own row tells all of its edges, so no distinct over all edges is needed."""
    t = tagged(spark, d)
    at = lambda n: F.floor(F.col("tid") / n)
    edge = lambda head, rel: F.struct(head.alias("head"), rel.alias("rel"))

    def rows(own: Column, more: int) -> DataFrame:
        both = F.array_distinct(F.array(own, edge(at(5), F.lit("x"))))
        return t.select("sid", F.col("tid").alias("dep"), F.inline(F.when(F.col("event_id") % more == 0, both).otherwise(F.array(own))))

    gold = rows(edge(at(2), F.col("event_type")), 4)
    pred = rows(edge(F.when(F.col("event_id") % 7 == 0, at(3)).otherwise(at(2)), F.when(F.col("event_id") % 11 == 0, "y").otherwise(F.col("event_type"))), 8)
    return gold, pred, t.select("sid", F.col("tid").alias("dep"), F.when(F.col("event_id") % 9 == 0, "PU").otherwise("X").alias("tag"))


@query("smoothed_f1", f"""WITH {EDGES}, e AS (SELECT sid, max(g) AS g, max(p) AS p FROM (SELECT *, 1 AS g, NULL AS p FROM g UNION ALL SELECT *, NULL, 1 FROM p) GROUP BY sid, dep, head, rel),
    s AS (SELECT sid, count(g) AS g, count(p) AS p, count(g + p) AS k FROM e GROUP BY sid), t AS (SELECT sum(g) AS g, sum(p) AS p, sum(k) AS k, avg(CAST(k = g AS INT)) AS seq_acc FROM s)
    SELECT round(k / (p + 1e-12), 6) AS "precision", round(k / (g + 1e-12), 6) AS recall, round(2 * (k / (p + 1e-12)) * (k / (g + 1e-12)) / (k / (p + 1e-12) + k / (g + 1e-12) + 1e-12), 6) AS f1, round(seq_acc, 6) AS seq_acc FROM t""")
def smoothed_f1(spark, d):
    gold, pred, _ = edges(spark, d)
    return metrics.smoothed_f1(gold, pred)


@query("graph_scores", f"""WITH {EDGES}, e AS (SELECT sid, dep, head, g.rel AS g, p.rel AS p FROM g FULL JOIN p USING (sid, dep, head)),
    o AS (SELECT e.* FROM e JOIN ev ON e.sid = ev.sid AND e.dep = ev.tid WHERE event_id % 9 <> 0),
    l AS (SELECT *, count(g) OVER w = 1 AND count(p) OVER w = 1 AS loc FROM o WINDOW w AS (PARTITION BY sid, dep)),
    r AS (SELECT 'all' AS part, * FROM l UNION ALL SELECT 'nonlocal', * FROM l WHERE NOT loc),
    s AS (SELECT part, count(g) AS g, count(p) AS p, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS u, count(*) FILTER (g = p) AS l FROM r GROUP BY part)
    SELECT part, round(100.0 * u / g, 6)::DOUBLE AS ur, round(100.0 * u / p, 6)::DOUBLE AS up, round(200.0 * u / (g + p), 6)::DOUBLE AS uf, round(100.0 * l / g, 6)::DOUBLE AS lr, round(100.0 * l / p, 6)::DOUBLE AS lp, round(200.0 * l / (g + p), 6)::DOUBLE AS lf FROM s""")
def graph_scores(spark, d):
    return metrics.graph_scores(*edges(spark, d))


@query("tree_children", f"""WITH {TREE} SELECT tree_id, parent_id AS node_id, node_id AS child, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY node_id) - 1 AS at, count(*) OVER (PARTITION BY tree_id, parent_id) AS n
    FROM tree WHERE parent_id <> 0""")
def tree_children(spark, d):
    return trees.children(tree(spark, d))


@query("tree_descendants", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id AS descendant, parent_id AS node_id, 1 AS depth FROM tree WHERE parent_id <> 0
    UNION ALL SELECT tree_id, descendant, node_id // 2, depth + 1 FROM up WHERE node_id // 2 <> 0) SELECT tree_id, node_id, descendant, depth FROM up""")
def tree_descendants(spark, d):
    return trees.descendants(tree(spark, d))


@query("tree_second_siblings", f"""WITH {TREE.replace("n // 2 AS", "n // 4 AS")} SELECT tree_id, node_id, coalesce(lag(node_id, 2) OVER w, 0) AS left_id, coalesce(lead(node_id, 2) OVER w, 0) AS right_id
    FROM tree WINDOW w AS (PARTITION BY tree_id, parent_id ORDER BY node_id)""")
def tree_second_siblings(spark, d):
    wide = tree(spark, d).withColumn("parent_id", F.floor(F.col("node_id") / 4))
    return trees.kth_siblings(wide, 2).fillna(0, ["left_id", "right_id"])


@query("tree_second_order", f"WITH {TREE} SELECT tree_id, parent_id // 2 AS node_id, node_id AS grandchild FROM tree WHERE parent_id // 2 > 0")
def tree_second_order(spark, d):
    return trees.second_order(tree(spark, d))


@query("tree_find", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id AS hit, parent_id AS node_id, 1 AS depth FROM tree WHERE parent_id <> 0 AND node_id % 5 = 0
    UNION ALL SELECT tree_id, hit, node_id // 2, depth + 1 FROM up WHERE node_id // 2 <> 0) SELECT tree_id, node_id, arg_min(hit, struct_pack(a := depth, b := hit)) AS found FROM up GROUP BY 1, 2""")
def tree_find(spark, d):
    t = tree(spark, d)
    return trees.find_nodes(t, t.where("node_id % 5 = 0"))


@query("tree_nearest", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id, parent_id AS a, 1 AS depth FROM tree WHERE parent_id <> 0
    UNION ALL SELECT tree_id, node_id, a // 2, depth + 1 FROM up WHERE a // 2 <> 0) SELECT tree_id, node_id, arg_min(a, depth) AS found FROM up WHERE a % 3 = 0 GROUP BY 1, 2""")
def tree_nearest(spark, d):
    t = tree(spark, d)
    return trees.nearest_ancestor(t, t.where("node_id % 3 = 0"))


@query("tree_moved", f"WITH {TREE} SELECT tree_id, node_id, CASE WHEN node_id % 6 = 0 THEN 1 ELSE parent_id END AS parent_id FROM tree")
def tree_moved(spark, d):
    t = tree(spark, d)
    return trees.move(t, t.where("node_id % 6 = 0").select("tree_id", "node_id", F.lit(1).cast("long").alias("new_parent"))).select("tree_id", "node_id", "parent_id")


@query("tree_adopted", f"""WITH RECURSIVE {TREE}, up AS (SELECT tree_id, node_id, parent_id AS a, 1 AS depth FROM tree WHERE parent_id <> 0 AND node_id % 7 <> 3
    UNION ALL SELECT tree_id, node_id, a // 2, depth + 1 FROM up WHERE a // 2 <> 0), n AS (SELECT tree_id, node_id, arg_min(a, depth) AS p FROM up WHERE a % 7 <> 3 GROUP BY 1, 2)
    SELECT tree_id, node_id, coalesce(p, 0) AS parent_id FROM tree LEFT JOIN n USING (tree_id, node_id) WHERE node_id % 7 <> 3""")
def tree_adopted(spark, d):
    t = tree(spark, d)
    return trees.adopt(t, t.where("node_id % 7 = 3")).select("tree_id", "node_id", "parent_id")


@query("tree_pruned", f"""WITH RECURSIVE {TREE}, leaf AS (SELECT tree_id, node_id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.tree_id = t.tree_id AND c.parent_id = t.node_id)),
    kept AS (SELECT * FROM leaf WHERE node_id % 3 <> 0), up AS (SELECT tree_id, node_id FROM kept UNION SELECT tree_id, node_id // 2 FROM up WHERE node_id // 2 > 0)
    SELECT tree_id, node_id, node_id // 2 AS parent_id FROM up""")
def tree_pruned(spark, d):
    t = tree(spark, d)
    return trees.prune(t, t.where("node_id % 3 = 0")).select("tree_id", "node_id", "parent_id")


@query("doubled_consonants", f"""WITH {FORMS} SELECT form, length(low) >= 4 AND (right(low, 1) = substr(low, length(low) - 1, 1) OR (right(low, 1) IN ('c', 'k') AND substr(low, length(low) - 1, 1) IN ('c', 'k'))) AS in_morphs,
    length(low) >= 2 AND right(low, 1) = substr(low, length(low) - 1, 1) AS in_lemmas FROM pairs""")
def doubled_consonants(spark, d):
    low = F.lower("form")
    return forms(spark, d).select("form", chars.doubled_consonant_morph(low).alias("in_morphs"), chars.doubled_consonant_lemma(low).alias("in_lemmas"))


RULES = ", ".join(f"({10 * i}, '{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, {r[4]}, {r[5]})" for i, r in enumerate(morphology.INFLECTIONS))


@query("inflections", f"""WITH {FORMS}, rules AS (SELECT * FROM (VALUES {RULES}) AS r(rank, lexicon, tag, suffix, replacements, tags, twice)), low_pairs AS (SELECT DISTINCT low, pos FROM pairs),
    stems AS (SELECT low, pos, rank, tag, suffix, replacements, twice, left(low, length(low) - length(suffix)) AS stem FROM low_pairs JOIN rules ON ends_with(low, suffix) AND lexicon = left(pos, 2) AND list_contains(tags, pos)),
    tried AS (SELECT low, pos, tag, suffix, rank + i AS rank, stem || replacements[i] AS base FROM stems, generate_series(1, 2) g(i) WHERE i <= len(replacements)
        UNION ALL SELECT low, pos, tag, suffix, rank + 2 + i, left(stem, length(stem) - 1) || replacements[i] FROM stems, generate_series(1, 2) g(i)
        WHERE i <= len(replacements) AND twice AND length(stem) >= 4 AND (right(stem, 1) = substr(stem, length(stem) - 1, 1) OR (right(stem, 1) IN ('c', 'k') AND substr(stem, length(stem) - 1, 1) IN ('c', 'k')))),
    hit AS (SELECT * FROM tried WHERE base IN (SELECT low FROM pairs))
    SELECT low AS form, pos, arg_min(base, rank) AS base, '+' || arg_min(suffix, rank) AS affix, arg_min(tag, rank) AS affix_tag FROM hit GROUP BY low, pos""")
def inflections(spark, d):
    f = forms(spark, d).select(F.lower("form").alias("form"), "pos").distinct()
    bases = f.select(F.col("form").alias("base"), F.explode(F.array(*map(F.lit, ("VB", "NN", "JJ", "RB")))).alias("lexicon"))
    m = F.col("morphs")
    return morphology.inflect(f, bases).select("form", "pos", m[0]["form"].alias("base"), m[1]["form"].alias("affix"), m[1]["tag"].alias("affix_tag"))


@query("morphs")
def morphs(spark, d):
    f = forms(spark, d)
    bases = f.select(F.lower("form").alias("base")).distinct().select("base", F.explode(F.array(*map(F.lit, ("VB", "NN", "JJ", "RB")))).alias("lexicon"))
    rules = morphology.rules(spark, [("NN", "N_NESS", "ness", [""], [], False, "JJ"), ("RB", "R_LY", "ly", [""], [], False, "JJ")])
    prefixes = spark.createDataFrame([("un", "P"), ("re", "P")], "prefix string, tag string")
    got = morphology.analyze(f, bases, rules, prefixes)
    return got.select("form", "pos", F.array_join(F.transform("morphs", lambda m: F.concat_ws("/", m["form"], m["tag"])), " ").alias("morphs"))


@query("merged_tags", f"""WITH {EV} SELECT sid, tid, concat_ws(chr(9), tid, event_type, '_', CASE WHEN event_id % 3 = 0 THEN 'O' ELSE tag END, '_') AS line FROM ev""")
def merged_tags(spark, d):
    t = tagged(spark, d)
    gold = t.select("sid", "tid", F.array(F.col("tid").cast("string"), F.col("event_type"), F.lit("_"), F.col("tag"), F.lit("_")).alias("f"))
    auto = t.select("sid", "tid", F.col("tag").alias("gold"), F.when(F.col("event_id") % 3 == 0, "O").otherwise(F.col("tag")).alias("pred"))
    return columns.merge_tags(gold, auto)


@query("block_parts", "SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'dev' ELSE 'train' END AS part FROM documents")
def block_parts(spark, d):
    b = read(spark, d, "documents").select("doc_id", F.col("text").alias("block"))
    return columns.split_blocks(b, "License").select("doc_id", "part")


@query("edge_rows", f"""WITH {EDGES} SELECT sid, dep, string_agg(head || ':' || rel, '|' ORDER BY head, rel) AS edges FROM g GROUP BY sid, dep""")
def edge_rows(spark, d):
    gold, _, _ = edges(spark, d)
    return gold.groupBy("sid", "dep").agg(columns.edge_list(F.collect_list(F.struct("head", "rel"))).alias("edges"))


@query("gold_ids", f"""WITH {EV}, i AS (SELECT event_type AS item, row_number() OVER (ORDER BY min(struct_pack(a := sid, b := tid)), event_type) - 1 AS cid FROM ev GROUP BY event_type)
    SELECT sid, tid, CASE WHEN event_id % 10 = 0 THEN -1 ELSE cid END AS id FROM ev JOIN i ON event_type = item""")
def gold_ids(spark, d):
    t = tagged(spark, d)
    ids = vocab.first_seen(t, "event_type", "sid", "tid").select("item", F.col("cid").alias("id"))
    gold = t.withColumn("gold", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))
    return vocab.lookup(gold, "gold", ids, -1).select("sid", "tid", "id")


def _repairs() -> str:
    return "MAP {" + ", ".join(f"'{k}{mark}': '{x}'" for k, both in tags.PAIRS.items() for mark, x in zip("=/", both, strict=True)) + "}"


def _put(tag: str, letter: str) -> str:
    return f"CASE WHEN {letter} = 'O' THEN 'O' ELSE {letter} || substr({tag}, 2) END"


_KEY = "substr(acc[i], 1, 1) || substr(l[i + 1], 1, 1) || CASE WHEN substr(acc[i], 3) = substr(l[i + 1], 3) THEN '=' ELSE '/' END"


@query("bilou_repaired", f"""WITH RECURSIVE {EV}, k AS (SELECT sid, tid, substr('OBILU', CAST(event_id % 5 AS INT) + 1, 1) AS k, event_type FROM ev),
    s AS (SELECT sid, list(CASE WHEN k = 'O' THEN k ELSE k || '-' || event_type END ORDER BY tid) AS l FROM k GROUP BY sid),
    r AS (SELECT sid, l, 1 AS i, l[1:1] AS acc FROM s UNION ALL
        SELECT sid, l, i + 1, CASE WHEN new IS NULL THEN list_append(acc, l[i + 1]) ELSE list_concat(acc[1:i - 1], [{_put("acc[i]", "substr(new, 1, 1)")}, {_put("l[i + 1]", "substr(new, 2, 1)")}]) END
        FROM (SELECT *, {_repairs()}[{_KEY}] AS new FROM r WHERE i < len(l))),
    z AS (SELECT sid, acc[1:i - 1] AS head, acc[i] AS last FROM r WHERE i = len(l))
    SELECT sid, array_to_string(list_append(head, CASE substr(last, 1, 1) WHEN 'B' THEN 'U' || substr(last, 2) WHEN 'I' THEN 'L' || substr(last, 2) ELSE last END), ' ') AS tags FROM z""")
def bilou_repaired(spark, d):
    t = tagged(spark, d)
    letter = F.substr(F.lit("OBILU"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    tag = F.when(letter == "O", letter).otherwise(F.concat(letter, F.lit("-"), F.col("event_type")))
    g = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", tag.alias("tag")))).alias("t"))
    return g.select("sid", F.array_join(tags.repaired(F.col("t.tag")), " ").alias("tags"))


def _digit(i: str) -> str:
    return f"regexp_full_match(substr(url, {i}, 1), '[0-9]')"


@query("collapsed_digits", f"""WITH RECURSIVE p AS (SELECT page_id, url, 1 AS i, '' AS made, '' AS final FROM pages UNION ALL
        SELECT page_id, url, i + 1, CASE WHEN gone THEN made ELSE made || kept END, CASE WHEN gone THEN final ELSE kept END
        FROM (SELECT *, CASE WHEN is_digit THEN '0' ELSE x END AS kept, CASE WHEN later THEN regexp_full_match(x, '[{_RE2["currency"]}.+#-]') OR (sooner AND regexp_full_match(x, '[{_RE2["hyphen"]},:/=]'))
                WHEN sooner THEN x = '%' ELSE is_digit AND final = '0' END AS gone
            FROM (SELECT *, substr(url, i, 1) AS x, {_digit("i")} AS is_digit, {_digit("i + 1")} AS later, i > 1 AND {_digit("i - 1")} AS sooner FROM p WHERE i <= length(url))))
    SELECT page_id, made AS url FROM p WHERE i = length(url) + 1""")
def collapsed_digits(spark, d):
    return read(spark, d, "pages").select("page_id", text.collapse_digits(F.col("url")).alias("url"))


@query("english_blocks")
def english_blocks(spark, d):
    return english.english_tokens(read(spark, d, "documents"), segment=3)


LIKELY = [[0.4 if i == j else 0.2 for j in range(4)] for i in range(4)]


def _likely(at: int) -> str:
    return "[" + ", ".join(f"v[{j + 1}] + ln({LIKELY[j][at]})" for j in range(4)) + "]"


@query("softmax_tags", f"""WITH RECURSIVE {EMISSIONS}, n AS (SELECT sid, tid, list_transform(s, lambda x: x - ln(list_sum(list_transform(s, lambda y: exp(y))))) AS s FROM em),
    p AS (SELECT sid, 0 AS tid, s AS v, [[0], [1], [2], [3]] AS paths FROM n WHERE tid = 0
    UNION ALL SELECT p.sid, p.tid + 1, [{", ".join(f"list_max({_likely(i)}) + s[{i + 1}]" for i in range(4))}], [{", ".join(f"list_append(paths[list_position({_likely(i)}, list_max({_likely(i)}))], {i})" for i in range(4))}]
        FROM p JOIN n ON n.sid = p.sid AND n.tid = p.tid + 1),
    e AS (SELECT sid, max(tid) AS z FROM em GROUP BY sid), b AS (SELECT p.sid, paths[list_position(v, list_max(v))] AS path FROM p JOIN e ON p.sid = e.sid AND p.tid = e.z)
    SELECT sid, generate_subscripts(path, 1) - 1 AS tid, unnest(path) AS tag_id FROM b""")
def softmax_tags(spark, d):
    return decoders.decode_paths(emissions(spark, d), LIKELY, softmax=True)


MIXED = "((({m} * {m}) % 2147483647) * 31 + {m} * 7 + {v} % 2147483647) % 2147483647"


def _mixed_sql(seed: str, turn: int, v: str) -> str:
    m = f"((({v}) % 2147483647 * 48271 + ({seed}) % 65536 * 16807 + {(turn + 1) * 69621}) % 2147483647)"
    return MIXED.format(m=m, v=f"({v})")


def permuted_sql(name: str, rows: str, seed: str, out: str = "place") -> str:
    """CTEs ``name``: the rows of ``rows`` (with i, n) and ``out``."""
    a, b = "ceil(sqrt(n::DOUBLE))::BIGINT", f"ceil(n / ceil(sqrt(n::DOUBLE)))::BIGINT"
    steps, last = [f"{name}0 AS (SELECT *, {a} AS side, {b} AS cols, i AS x, 0 AS walk FROM {rows})"], f"{name}0"
    turn = f"SELECT * REPLACE (u * cols + v AS x, walk + 1 AS walk) EXCLUDE (u, v) FROM (SELECT * REPLACE ((v + {_mixed_sql(seed, 3, 'u')}) % cols AS v) FROM (SELECT * REPLACE ((u + {_mixed_sql(seed, 2, 'v')}) % side AS u) FROM (SELECT * REPLACE ((v + {_mixed_sql(seed, 1, 'u')}) % cols AS v) FROM (SELECT * REPLACE ((u + {_mixed_sql(seed, 0, 'v')}) % side AS u) FROM (SELECT *, x // cols AS u, x % cols AS v FROM {{}})))))"
    turn = turn.replace("* REPLACE (u * cols + v AS x, walk + 1 AS walk) EXCLUDE (u, v)", "* EXCLUDE (u, v, x, walk), u * cols + v AS x, walk + 1 AS walk")
    steps.append(f"{name}w AS ({turn.format(last)} UNION ALL {turn.format(f'(SELECT * FROM {name}w WHERE x >= n)')})")
    steps.append(f"{name} AS (SELECT * EXCLUDE (x, walk, side, cols), x AS {out} FROM {name}w WHERE x < n)")
    return ", ".join(steps)


@query("shuffled_docs", f"""WITH RECURSIVE r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    {permuted_sql("p", "r", "17")} SELECT doc_id, lang, place FROM p""")
def shuffled_docs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return features.shuffled(docs, [F.desc("n_chars"), "doc_id"], 17, ["lang"]).select("doc_id", "lang", "place")


@query("sampled_batches", rf"""WITH RECURSIVE c AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) + 1 AS len FROM documents),
    b AS (SELECT doc_id, CASE WHEN len <= 50 THEN 50 WHEN len <= 200 THEN 200 WHEN len <= 1000 THEN 1000 WHEN len <= 5000 THEN 5000 ELSE 1000000 END AS bucket FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n, greatest(20000 // bucket, 1) AS size FROM b),
    {permuted_sql("p", "r", "5 * 1009 + 2 + bucket")},
    q AS (SELECT bucket, sum(k) OVER (ORDER BY bucket) - k AS start, CAST(sum(k) OVER () AS BIGINT) AS n FROM (SELECT bucket, max(n) AS m, (max(n) + max(size) - 1) // max(size) AS k FROM r GROUP BY bucket)),
    t AS (SELECT p.doc_id, p.bucket, place % size AS slot, CAST(start + place // size AS BIGINT) AS i, q.n FROM p JOIN q USING (bucket)),
    {permuted_sql("z", "t", "5 * 1009 + 2", "batch")} SELECT doc_id, bucket, batch, slot FROM z""")
def sampled_batches(spark, d):
    n = read(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"\S+")) + 1).alias("n"))
    b = n.select("doc_id", features.bucket(F.col("n"), LENGTHS).alias("bucket"))
    return features.sampled_batches(b, "bucket", "doc_id", 20_000, 5, 2).select("doc_id", "bucket", "batch", "slot")


@query("downsample_ranked", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i = 1 OR floor(i * 0.125) > floor((i - 1) * 0.125)")
def downsample_ranked(spark, d):
    return vocab.downsample(read(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 0.125).select("doc_id")


@query("original_order", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) + 1 AS len FROM documents),
    b AS (SELECT doc_id, CASE WHEN len <= 50 THEN 50 WHEN len <= 200 THEN 200 WHEN len <= 1000 THEN 1000 WHEN len <= 5000 THEN 5000 ELSE 1000000 END AS bucket FROM c)
    SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS "index", row_number() OVER (ORDER BY doc_id) - 1 AS place FROM b""")
def original_order(spark, d):
    n = read(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"\S+")) + 1).alias("n"))
    b = n.select("doc_id", features.bucket(F.col("n"), LENGTHS).alias("bucket"))
    return features.original_order(ranked(b, ["doc_id"], ["bucket"], "index"), "bucket", "index")


@query("interned", f"""WITH {WORDS}, w AS (SELECT *, doc_id % 3 AS turn FROM words), f AS (SELECT tok AS item, min(struct_pack(t := turn, a := doc_id, b := tid)) AS seen FROM w GROUP BY tok)
    SELECT item, row_number() OVER (ORDER BY seen) - 1 AS id FROM f""")
def interned(spark, d):
    """Three batches one after another; the SQL numbers all at once."""
    w, ids = words(spark, d).select("doc_id", "tid", "tok"), None
    for turn in range(3):
        ids = durable(vocab.intern(ids, w.where(F.col("doc_id") % 3 == turn), "tok", "doc_id", "tid"), "interned")
    return ids


@query("normalised_vectors", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, unnest(list_transform(embedding, lambda x: 0)) FROM embeddings WHERE vec_id % 3 = 0),
    s AS (SELECT stddev_pop(x) AS sd FROM v) SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sd END, 5) AS total FROM embeddings, s""")
def normalised_vectors(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = vocab.normalised(e.where("item % 3 <> 0"), e, 64)
    return got.select(F.col("id").alias("vec_id"), F.round(F.reduce("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


PATHS = TREE + """, up AS (SELECT tree_id, node_id, [node_id] AS path FROM tree WHERE parent_id = 0 UNION ALL SELECT t.tree_id, t.node_id, list_append(u.path, t.node_id)
        FROM tree t JOIN up u ON t.tree_id = u.tree_id AND t.parent_id = u.node_id),
    pre AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS enter, len(path) - 1 AS depth FROM up),
    size AS (SELECT tree_id, a AS node_id, count(*) AS k FROM (SELECT tree_id, unnest(path) AS a FROM up) GROUP BY 1, 2)"""


@query("tree_intervals", f"""WITH RECURSIVE {PATHS} SELECT tree_id, node_id, enter, enter + k - 1 AS "last", depth FROM pre JOIN size USING (tree_id, node_id)""")
def tree_intervals(spark, d):
    return trees.intervals(tree(spark, d))


@query("tree_contains", f"""WITH RECURSIVE {PATHS} SELECT a.tree_id, a.node_id // 3 + 1 AS a, a.node_id AS b, list_contains(a.path, a.node_id // 3 + 1) AND a.node_id <> a.node_id // 3 + 1 AS below FROM up a""")
def tree_contains(spark, d):
    t = tree(spark, d)
    pairs = t.select("tree_id", (F.floor(F.col("node_id") / 3) + 1).alias("a"), F.col("node_id").alias("b"))
    return trees.contains(pairs, trees.intervals(t))


@query("model_lines", r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    r AS (SELECT line, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, count(*) OVER () AS n FROM l),
    s AS (SELECT *, n * 9999 // 10000 AS train FROM r WHERE trim(line) <> '')
    SELECT CASE WHEN place < train THEN 'train' WHEN place < n * 99995 // 100000 THEN 'valid' ELSE 'test' END AS part,
        CASE WHEN place < train THEN least(place // greatest(train // 10000, 1), 9999) + 1 ELSE 1 END AS shard, place, line FROM s""")
def model_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return corpora.model_lines(lines, "line", "doc_id", "pos")


@query("column_round_trip", f"""WITH {EV} SELECT dense_rank() OVER (ORDER BY sid) - 1 AS sid, tid - 1 AS tid, CAST(tid AS VARCHAR) AS id, event_type AS form, tag, CAST(tid // 2 AS VARCHAR) AS head FROM ev""")
def column_round_trip(spark, d):
    """Sentences written to shards of ten-column rows and read again."""
    t = tagged(spark, d)
    cols = {"id": F.col("tid"), "form": F.col("event_type"), "cpos": F.col("tag"), "head": F.floor(F.col("tid") / 2), "deprel": F.lit("dep")}
    path = f"{shared_dir(spark)}/columns-{uuid.uuid4().hex}"
    columns.write_sentences(t.select("sid", "tid", columns.conll_line(cols).alias("line")), path, 7)
    rows = durable(columns.read_columns(spark, path, {"id": 0, "form": 1, "tag": 3, "head": 6}), "columns")
    sids = ranked(rows.select("path", "sid").distinct(), ["path", "sid"], name="place")
    return rows.join(sids, ["path", "sid"]).select(F.col("place").alias("sid"), "tid", "id", "form", "tag", "head")


DOCS_OF_A_STATE = 256


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    second = F.coalesce(F.pmod("doc_id", F.lit(86_400)), F.lit(0))  # of one day: times as far apart as ids may be would make lines late, or none at all
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.timestamp_seconds(F.lit(1_700_000_000) + second).alias("ts"), "line")


@query("stream_lines", r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS sid, regexp_extract_all(line, '\S+') AS toks FROM l WHERE regexp_matches(line, '\S')),
    t AS (SELECT doc_id, sid, generate_subscripts(toks, 1) AS i, unnest(toks) AS w FROM k)
    SELECT doc_id, sid, count(*) AS n, string_agg(w || '/' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'CD' WHEN lower(w) LIKE '%ing' THEN 'VBG' WHEN lower(w) LIKE '%ed' THEN 'VBD' WHEN lower(w) LIKE '%s' THEN 'NNS' ELSE 'NN' END, ' ' ORDER BY i) AS tagged
    FROM t GROUP BY doc_id, sid""")
def stream_lines(spark, d):
    """The lines of all documents in shuffled files, half of them before a restart of the stream. Files and states grow in number with the input,
    not in size, so each half stays one micro-batch."""
    lines, base = document_lines(spark, d), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    states = read(spark, d, "documents").count() // DOCS_OF_A_STATE + 1
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(2))
    for k in (0, 1):
        lines.where(half == k).repartition(files, F.xxhash64("line_no", "doc_id")).write.parquet(f"{base}/in/{k}")
        source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in/*")
        line_stream.run_to_end(line_stream.decode_stream(source, delay="10000 days", states=states), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query("token_accuracy", f"""WITH {EV} SELECT sid, count(*) AS n, count(*) FILTER (event_id % 7 <> 0 OR tag = 'O') AS correct, round(count(*) FILTER (event_id % 7 <> 0 OR tag = 'O') / count(*), 6) AS accuracy FROM ev GROUP BY sid""")
def token_accuracy(spark, d):
    t = tagged(spark, d).withColumn("pred", F.when(F.col("event_id") % 7 == 0, "O").otherwise(F.col("tag")))
    return metrics.accuracy(t, "tag", "pred", "sid")


@query("exact_graphs", f"""WITH {EV}, cut AS (SELECT sid * 1000 + tid // 5 AS sid, tid AS dep, tid // 2 AS head, event_type AS rel, event_id FROM ev),
    p AS (SELECT sid, dep, CASE WHEN event_id % 13 = 0 THEN dep // 3 ELSE head END AS head, CASE WHEN event_id % 11 = 0 THEN 'y' ELSE rel END AS rel FROM cut),
    m AS (SELECT c.sid, bool_or(p.rel IS NULL) AS arc, bool_or(p.rel IS DISTINCT FROM c.rel) AS rel FROM cut c LEFT JOIN p USING (sid, dep, head) WHERE c.event_id % 9 <> 0 GROUP BY c.sid)
    SELECT count(*) AS graphs, count(*) FILTER (NOT coalesce(arc, false)) AS unlabeled, count(*) FILTER (NOT coalesce(m.rel, false)) AS labeled FROM (SELECT DISTINCT sid FROM cut) LEFT JOIN m USING (sid)""")
def exact_graphs(spark, d):
    t = tagged(spark, d).select((F.col("sid") * 1000 + F.floor(F.col("tid") / 5)).alias("sid"), F.col("tid").alias("dep"), F.floor(F.col("tid") / 2).alias("head"), F.col("event_type").alias("rel"), "event_id")
    pred = t.select("sid", "dep", F.when(F.col("event_id") % 13 == 0, F.floor(F.col("dep") / 3)).otherwise(F.col("head")).alias("head"), F.when(F.col("event_id") % 11 == 0, "y").otherwise(F.col("rel")).alias("rel"))
    return metrics.exact_graphs(t, pred, t.select("sid", "dep", F.when(F.col("event_id") % 9 == 0, "PU").otherwise("X").alias("tag")))


@query("graph_lines", f"""WITH {EDGES}, e AS (SELECT sid, dep, string_agg(head || ':' || rel, '|' ORDER BY head, rel) AS e FROM g GROUP BY sid, dep)
    SELECT ev.sid, tid, concat_ws(chr(9), tid, event_type, '_', tag, '_', '_', tid // 2, 'dep', e, '_') AS line FROM ev JOIN e ON ev.sid = e.sid AND tid = dep""")
def graph_lines(spark, d):
    gold, _, _ = edges(spark, d)
    cols = {"id": F.col("tid"), "form": F.col("event_type"), "cpos": F.col("tag"), "head": F.floor(F.col("tid") / 2), "deprel": F.lit("dep")}
    return columns.graph_lines(tagged(spark, d), gold, cols)


@query("argmax_labels", """WITH l AS (SELECT source AS item, row_number() OVER (ORDER BY source) AS cid FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)), n AS (SELECT count(*) AS n FROM l)
    SELECT vec_id, item AS best FROM embeddings, n JOIN l ON cid = list_position(embedding[1:n], list_max(embedding[1:n]))""")
def argmax_labels(spark, d):
    return features.argmax_label(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", vocab.label_dictionary(read(spark, d, "documents"), "source")).select("vec_id", "best")


@query("sentence_matrices", """SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS sid, count(*) AS n, round(sum((vec_id + 1) * embedding[3]::DOUBLE), 4) AS third FROM embeddings GROUP BY 1""")
def sentence_matrices(spark, d):
    e = read(spark, d, "embeddings").select(F.floor(F.sqrt("vec_id")).alias("sid"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    weighed = F.reduce("matrix", F.struct(F.col("sid") * F.col("sid") + 1, F.lit(0.0)), lambda a, v: F.struct(a["col1"] + 1, a["col2"] + a["col1"] * F.get(v, F.lit(2))), lambda a: a["col2"])
    return features.sentence_matrix(e, "v", tid="vec_id").select("sid", F.col("n").cast("long").alias("n"), F.round(weighed, 4).alias("third"))


@query("schemes", f"""WITH {BILOU} SELECT sid, tid, CASE k WHEN 'O' THEN 'O' WHEN 'L' THEN 'E-' || event_type WHEN 'U' THEN 'S-' || event_type ELSE k || '-' || event_type END AS tag FROM u""")
def schemes(spark, d):
    t = tagged(spark, d)
    letter = F.substr(F.lit("OBILU"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    t = t.withColumn("tag", F.when(letter == "O", letter).otherwise(F.concat(letter, F.lit("-"), F.col("event_type"))))
    return tags.convert_scheme(t, "ioblu", "iobes").select("sid", "tid", "tag")


@query("labelled_lines", r"""SELECT doc_id, lang || ',' || source AS labels, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE doc_id % 4 <> 0 AND regexp_matches(text, '\S')""")
def labelled_lines(spark, d):
    """Documents as labelled lines, written and read again; lines without a label give no row."""
    docs = read(spark, d, "documents")
    line = F.concat(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("__label__"), "lang", F.lit(" __label__"), "source", F.lit(" "))).otherwise(F.lit("")), F.regexp_replace("text", r"\s+", " "))
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    docs.select(F.concat("doc_id", F.lit("\t"), line).alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), columns.labelled_text(F.regexp_replace("value", "^[0-9]+\t", "")).alias("x"))
    return rows.where("x is not null").select("doc_id", F.array_join("x.labels", ",").alias("labels"), "x.text")
