"""English morphology of (form, pos) rows: lookups, inflection, derivation and prefixes, over lexicons given as tables.

Everything runs on the distinct pairs, so its cost follows the vocabulary and not the text. Rules are tables read by one
matcher: a form's endings are joined with the rules' affixes, the bases they lead to with the lexicon, and the first rule
wins. Derivation and prefixes repeat a step on what the last one found, until nothing changes.

Lexicons: ``bases`` (lexicon, base), ``lookup`` and ``stops`` and the exceptions as (form, pos, morphs), where morphs are
(form, tag) pairs. A null form or pos has null morphs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import doubled_consonant_morph
from .lemmas import coarse
from .ranks import durable

MORPHS = "array<struct<form:string,tag:string>>"
RULE = "lexicon string, rank int, tag string, affix string, replacements array<string>, tags array<string>, lemma_tag string, doubled boolean"
# Fixed values: (lexicon, tag, affix, replacements, tags, doubled consonant), tried in this order.
INFLECTIONS = [
    ("VB", "I_3PS", "ies", ["y"], ["VBZ"], False),
    ("VB", "I_3PS", "es", [""], ["VBZ"], False),
    ("VB", "I_3PS", "s", [""], ["VBZ"], False),
    ("VB", "I_GRD", "ying", ["ie"], ["VBG"], False),
    ("VB", "I_GRD", "ing", ["", "e"], ["VBG"], True),
    ("VB", "I_PST", "ied", ["y"], ["VBD", "VBN"], False),
    ("VB", "I_PST", "ed", [""], ["VBD", "VBN"], True),
    ("VB", "I_PST", "d", [""], ["VBD", "VBN"], False),
    ("VB", "I_PST", "en", ["", "e"], ["VBD", "VBN"], True),
    ("VB", "I_PST", "n", [""], ["VBD", "VBN"], False),
    ("VB", "I_PST", "ung", ["ing"], ["VBD", "VBN"], False),
    ("NN", "I_PLR", "ies", ["y"], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "es", [""], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "s", [""], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "men", ["man"], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "ae", ["a"], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "i", ["us"], ["NNS", "NNPS"], False),
    ("NN", "I_PLR", "a", ["um"], ["NNS", "NNPS"], False),
    ("JJ", "I_COM", "ier", ["y"], ["JJR"], False),
    ("JJ", "I_COM", "er", [""], ["JJR"], True),
    ("JJ", "I_COM", "er", ["e"], ["JJR"], False),
    ("JJ", "I_SUP", "iest", ["y"], ["JJS"], False),
    ("JJ", "I_SUP", "est", ["e"], ["JJS"], False),
    ("JJ", "I_SUP", "est", [""], ["JJS"], True),
    ("RB", "I_COM", "ier", ["y"], ["RBR"], False),
    ("RB", "I_COM", "er", ["", "e"], ["RBR"], False),
    ("RB", "I_SUP", "iest", ["y"], ["RBS"], False),
    ("RB", "I_SUP", "est", ["", "e"], ["RBS"], False),
]
# Tags that stand for a base form.
BASE_TAGS = {"VB": "VB", "VBP": "VB", "NN": "NN", "NNP": "NN", "JJ": "JJ", "RB": "RB"}
# The tags of inflections, derivations and prefixes.
MORPH_TAGS = (
    "I_3PS I_GRD I_PST I_PLR I_COM I_SUP V_EN V_FY V_IZE N_AGE N_AL N_ANCE N_ANT N_DOM N_EE N_ER N_HOOD N_ING N_ISM N_IST N_ITY N_MAN N_MENT N_NESS N_SHIP N_SIS N_TION N_WARE "
    "J_ABLE J_AL J_ANT J_ARY J_ED J_FUL J_IC J_ING J_ISH J_IVE J_LESS J_LIKE J_LY J_MOST J_OUS J_SOME J_WISE J_Y R_LY P"
).split()
ROUNDS = 32


def rules(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rules from (lexicon, tag, affix, replacements, tags, doubled[, lemma tag]) in the order in which they are tried."""
    full = [(r[0], i, r[1], r[2], list(r[3]), list(r[4]), r[6] if len(r) > 6 else r[0], bool(r[5])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RULE)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON files: an object of lists by lexicon, in order."""
    one = "array<struct<affix_tag:string,affix:string,token_affixes:array<string>,token_tags:array<string>,lemma_tag:string,double_consonants:boolean>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{one}>")).alias("lexicon", "all"))
    r = text.select("lexicon", F.posexplode("all").alias("rank", "r"))
    return r.select(
        "lexicon", "rank", F.col("r.affix_tag").alias("tag"), "r.affix", F.col("r.token_affixes").alias("replacements"),
        F.col("r.token_tags").alias("tags"), "r.lemma_tag", F.col("r.double_consonants").alias("doubled"),
    )


def write_rules(found: DataFrame) -> str:
    """The JSON text that ``read_rules`` reads; rule tables are small."""
    out: dict[str, list] = {}
    for r in found.orderBy("lexicon", "rank").collect():
        out.setdefault(r["lexicon"], []).append({
            "affix_tag": r["tag"], "affix": r["affix"], "token_affixes": r["replacements"], "token_tags": r["tags"], "lemma_tag": r["lemma_tag"], "double_consonants": r["doubled"],
        })
    return json.dumps(out, indent=1)


def first_match(forms: DataFrame, table: DataFrame, bases: DataFrame, gate: Column | None, doubled: Callable[[Column], Column] = doubled_consonant_morph) -> DataFrame:
    """``form, pos, lemma, lemma_tag, affix, affix_tag`` of the first rule that leads to a base.

    ``forms`` has form, pos and lexicon (of the rules). ``gate`` may refuse a rule by its ``tags``. Within a rule the stem's
    replacements come first, then those of the stem without a doubled consonant. The rules are broadcast: a few hundred rows.
    """
    sizes = [r["n"] for r in table.select(F.length("affix").alias("n")).distinct().orderBy("n").collect()]
    ends = F.array(*[F.when(F.length("form") >= n, F.struct(F.substr("form", F.length("form") - (n - 1), F.lit(n)).alias("affix"), F.substr("form", F.lit(1), F.length("form") - n).alias("stem"))) for n in sizes])
    cut = forms.select("form", "pos", "lexicon", F.inline(F.filter(ends, lambda x: x.isNotNull())))
    hit = cut.join(F.broadcast(table), ["lexicon", "affix"])
    hit = hit if gate is None else hit.where(gate)
    stem = F.col("stem")
    shorter = F.when(F.col("doubled") & doubled(stem), F.substr(stem, F.lit(1), F.length(stem) - 1))
    tries = F.concat(F.transform("replacements", lambda r: F.concat(stem, r)), F.transform("replacements", lambda r: F.concat(shorter, r)))
    tried = hit.select("form", "pos", "rank", "lemma_tag", "affix", F.col("tag").alias("affix_tag"), F.posexplode(tries).alias("at", "lemma")).where("lemma is not null")
    known = tried.join(bases.select(F.col("lexicon").alias("lemma_tag"), F.col("base").alias("lemma")).distinct(), ["lemma_tag", "lemma"], "left_semi")
    best = known.groupBy("form", "pos").agg(F.min(F.struct("rank", "at", "lemma", "lemma_tag", "affix", "affix_tag")).alias("b"))
    return best.select("form", "pos", "b.lemma", "b.lemma_tag", "b.affix", "b.affix_tag")


def morph(form: Column, tag: Column) -> Column:
    return F.struct(form.alias("form"), tag.alias("tag"))


def inflect(pairs: DataFrame, bases: DataFrame, table: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """``form, pos, morphs`` of the pairs (form in lower case) that are inflected: an exception (lexicon, form, morphs), else a rule."""
    table = table if table is not None else rules(pairs.sparkSession, INFLECTIONS)
    gated = table.select(F.explode("tags").alias("pos")).distinct()
    own = pairs.select("form", "pos", F.substring("pos", 1, 2).alias("lexicon")).join(F.broadcast(gated), "pos", "left_semi")
    found = first_match(own, table, bases, F.array_contains("tags", F.col("pos")))
    found = found.select("form", "pos", F.array(morph(F.col("lemma"), F.col("lemma_tag")), morph(F.concat(F.lit("+"), "affix"), F.col("affix_tag"))).alias("ruled"))
    out = own.join(found, ["form", "pos"], "left")
    if exceptions is not None:
        out = out.join(exceptions.select("lexicon", "form", F.col("morphs").alias("excepted")), ["lexicon", "form"], "left")
    else:
        out = out.withColumn("excepted", F.lit(None).cast(MORPHS))
    return out.select("form", "pos", F.coalesce("excepted", "ruled").alias("morphs")).where("morphs is not null")


def _fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` has form, tag, tail and open; ``step`` replaces them until no row is open."""
    for _ in range(ROUNDS):
        state = durable(state)
        if state.where("open").isEmpty():
            return state
        state = state.where("not open").unionByName(step(state.where("open")))
    raise ValueError(f"analyses are still open after {ROUNDS} rounds: the rules hold a cycle")


def derive(pairs: DataFrame, bases: DataFrame, table: DataFrame, stops: DataFrame | None = None, exceptions: DataFrame | None = None, inflections: DataFrame | None = None) -> DataFrame:
    """``form, tag, morphs``: forms taken to their bases by derivation rules, again and again; affixes in the order of derivation.

    ``stops`` (form) are never derived; ``exceptions`` (form, tag, morphs) end a derivation. An adjective without a rule that
    is a participle is a verb's (J_ED).
    """
    none = F.lit(None).cast(MORPHS)
    empty = F.array().cast(MORPHS)
    first = pairs.select("form", "tag").distinct().select(F.col("form").alias("root"), F.col("tag").alias("root_tag"), "form", "tag", empty.alias("tail"), none.alias("ended"), F.lit(True).alias("open"))

    def step(s: DataFrame) -> DataFrame:
        now = s.select("form", "tag").distinct()
        halt = now.join(stops.select("form").distinct(), "form", "left_semi").withColumn("halt", F.lit(True)) if stops is not None else now.limit(0).withColumn("halt", F.lit(True))
        out = s.join(halt, ["form", "tag"], "left")
        if exceptions is not None:
            out = out.join(exceptions.select("form", "tag", F.col("morphs").alias("excepted")), ["form", "tag"], "left")
        else:
            out = out.withColumn("excepted", none)
        ruled = first_match(now.select("form", F.col("tag").alias("pos"), F.col("tag").alias("lexicon")), table, bases, None)
        ruled = ruled.select("form", F.col("pos").alias("tag"), "lemma", "lemma_tag", "affix", "affix_tag")
        part = inflect(now.where("tag = 'JJ'").select("form", F.lit("VBN").alias("pos")), bases, inflections).select("form", F.lit("JJ").alias("tag"), F.col("morphs").alias("part"))
        out = out.join(ruled, ["form", "tag"], "left").join(part, ["form", "tag"], "left")
        goes_on = F.col("halt").isNull() & F.col("excepted").isNull() & F.col("lemma").isNotNull()
        adjective = F.array(F.col("part")[0], morph(F.col("part")[1]["form"], F.lit("J_ED")))
        ended = F.when(F.col("halt").isNotNull(), none).otherwise(F.coalesce("excepted", F.when(F.col("lemma").isNull() & F.col("part").isNotNull(), adjective)))
        return out.select(
            "root", "root_tag", F.when(goes_on, F.col("lemma")).otherwise(F.col("form")).alias("form"), F.when(goes_on, F.col("lemma_tag")).otherwise(F.col("tag")).alias("tag"),
            F.when(goes_on, F.concat(F.array(morph(F.concat(F.lit("+"), "affix"), F.col("affix_tag"))), F.col("tail"))).otherwise(F.col("tail")).alias("tail"),
            F.when(goes_on, none).otherwise(ended).alias("ended"), goes_on.alias("open"),
        )

    done = _fixpoint(first, step)
    head = F.coalesce("ended", F.array(morph(F.col("form"), F.col("tag"))))
    return done.select(F.col("root").alias("form"), F.col("root_tag").alias("tag"), F.concat(head, "tail").alias("morphs"))


def strip_prefixes(pairs: DataFrame, bases: DataFrame, prefixes: DataFrame, exceptions: DataFrame | None = None, longest: bool = False) -> DataFrame:
    """``form, tag, morphs``: the stem, then its prefixes from the outside in.

    ``prefixes`` (prefix, tag) also count with a hyphen; the shortest whose stem is a base wins, or the ``longest``. ``be`` may
    stand before a verb, an adjective or a noun.
    """
    both = prefixes.select("prefix", "tag").unionAll(prefixes.select(F.concat("prefix", F.lit("-")), "tag"))
    table = both.groupBy("prefix").agg(F.array_join(F.sort_array(F.collect_list("tag")), "|").alias("prefix_tag"))
    sizes = [r["n"] for r in table.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    none, empty = F.lit(None).cast(MORPHS), F.array().cast(MORPHS)
    first = pairs.select("form", "tag").distinct().select(F.col("form").alias("root"), F.col("tag").alias("root_tag"), "form", "tag", empty.alias("tail"), none.alias("ended"), F.lit(True).alias("open"))

    def step(s: DataFrame) -> DataFrame:
        now = s.select("form", "tag").distinct()
        cuts = F.array(*[F.when(F.length("form") > n, F.struct(F.substr("form", F.lit(1), F.lit(n)).alias("prefix"), F.substr("form", F.lit(n + 1), F.length("form")).alias("stem"))) for n in sizes])
        cut = now.select("form", "tag", F.inline(F.filter(cuts, lambda x: x.isNotNull()))).join(F.broadcast(table), "prefix")
        own = F.array(F.struct(F.lit(1).alias("turn"), F.col("tag").alias("stem_tag")))
        be = F.array(*[F.struct(F.lit(-3 + i).alias("turn"), F.lit(t).alias("stem_tag")) for i, t in enumerate(("VB", "JJ", "NN"))])
        cut = cut.select("form", "tag", "prefix", "stem", "prefix_tag", F.inline(F.when(F.col("prefix") == "be", F.concat(be, own)).otherwise(own)))
        known = cut.join(bases.select(F.col("lexicon").alias("stem_tag"), F.col("base").alias("stem")).distinct(), ["stem_tag", "stem"], "left_semi")
        size = -F.length("prefix") if longest else F.length("prefix")
        best = known.groupBy("form", "tag").agg(F.min(F.struct(size.alias("size"), "turn", "prefix", "prefix_tag", "stem", "stem_tag")).alias("b"))
        out = s.join(best, ["form", "tag"], "left")
        out = out.join(exceptions.select("form", "tag", F.col("morphs").alias("excepted")), ["form", "tag"], "left") if exceptions is not None else out.withColumn("excepted", none)
        goes_on = F.col("excepted").isNull() & F.col("b").isNotNull()
        mark = morph(F.concat(F.regexp_replace("b.prefix", "-$", ""), F.lit("+")), F.col("b.prefix_tag"))
        return out.select(
            "root", "root_tag", F.when(goes_on, F.col("b.stem")).otherwise(F.col("form")).alias("form"), F.when(goes_on, F.col("b.stem_tag")).otherwise(F.col("tag")).alias("tag"),
            F.when(goes_on, F.concat("tail", F.array(mark))).otherwise(F.col("tail")).alias("tail"), F.col("excepted").alias("ended"), goes_on.alias("open"),
        )

    done = _fixpoint(first, step)
    head = F.coalesce("ended", F.array(morph(F.col("form"), F.col("tag"))))
    base, more = F.slice(head, 1, 1), F.slice(head, 2, 1 << 20)
    return done.select(F.col("root").alias("form"), F.col("root_tag").alias("tag"), F.concat(base, "tail", more).alias("morphs"))


def analyze(
    tokens: DataFrame, bases: DataFrame, derivations: DataFrame | None = None, prefixes: DataFrame | None = None, *, lookup: DataFrame | None = None,
    inflections: DataFrame | None = None, exceptions: DataFrame | None = None, stops: DataFrame | None = None,
    derived: DataFrame | None = None, prefixed: DataFrame | None = None,
) -> DataFrame:
    """Adds ``morphs`` to rows of form, pos: the lookup (form, pos, morphs), else the base tags, else inflection, else the form
    with its coarse tag; then derivation and prefixes of the first morph, where their tables are given."""
    pairs = tokens.select("form", "pos").where("form is not null and pos is not null").distinct().withColumn("low", F.lower("form"))
    low = pairs.select(F.col("low").alias("form"), "pos").distinct()
    base_tag = F.element_at(F.create_map(*[F.lit(x) for kv in BASE_TAGS.items() for x in kv]), F.col("pos"))
    out = low.join(inflect(low, bases, inflections, exceptions).withColumnRenamed("morphs", "inflected"), ["form", "pos"], "left")
    if lookup is not None:
        out = out.join(lookup.select("form", "pos", F.col("morphs").alias("found")), ["form", "pos"], "left")
    else:
        out = out.withColumn("found", F.lit(None).cast(MORPHS))
    known = F.coalesce("found", F.when(base_tag.isNotNull(), F.array(morph(F.col("form"), base_tag))), "inflected")
    out = out.select("form", "pos", F.coalesce(known, F.array(morph(F.col("form"), coarse(F.col("pos"))))).alias("morphs"), known.isNotNull().alias("open"))
    out = durable(out, "morphs") if derivations is not None or prefixes is not None else out  # read twice by each part
    for part in ("derivation", "prefix"):
        heads = out.where("open").select(F.col("morphs")[0]["form"].alias("form"), F.col("morphs")[0]["tag"].alias("tag")).where("tag in ('VB', 'NN', 'JJ', 'RB')").distinct()
        if part == "derivation" and derivations is not None:
            more = derive(heads, bases, derivations, stops, derived, inflections)
        elif part == "prefix" and prefixes is not None:
            more = strip_prefixes(heads, bases, prefixes, prefixed)
        else:
            continue
        more = more.select(F.col("form").alias("head"), F.col("tag").alias("head_tag"), F.col("morphs").alias("parts"))
        same = (F.col("morphs")[0]["form"] == F.col("head")) & (F.col("morphs")[0]["tag"] == F.col("head_tag")) & F.col("open")
        joined = F.when(F.col("parts").isNull(), F.col("morphs")).otherwise(F.concat("parts", F.slice("morphs", 2, 1 << 20)))
        out = durable(out.join(more, same, "left").select("form", "pos", joined.alias("morphs"), "open"), "morphs")
    found = pairs.join(out.select(F.col("form").alias("low"), "pos", "morphs"), ["low", "pos"], "left").select("form", "pos", "morphs")
    return tokens.join(found, ["form", "pos"], "left")
