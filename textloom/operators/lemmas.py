"""English lemmas of (form, tag) rows: abbreviations, exceptions, suffix rules over a lexicon of bases, number words.

All steps are joins over the distinct pairs of form and tag, so their cost follows the vocabulary and not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import doubled_consonant_lemma

# Fixed values: (lexicon, tags, suffix, replacements, also without a doubled consonant), tried in this order.
SUFFIXES = [
    ("VB", "VBZ", "ies", ["y"], False),
    ("VB", "VBZ", "es", [""], False),
    ("VB", "VBZ", "s", [""], False),
    ("VB", "VBG", "ying", ["ie"], False),
    ("VB", "VBG", "ing", ["", "e"], True),
    ("VB", "VBD|VBN", "ied", ["y"], False),
    ("VB", "VBD|VBN", "ed", [""], True),
    ("VB", "VBD|VBN", "d", [""], False),
    ("VB", "VBD|VBN", "n", [""], False),
    ("VB", "VBD|VBN", "ung", ["ing"], False),
    ("NN", "NNS|NNPS", "ies", ["y"], False),
    ("NN", "NNS|NNPS", "es", [""], False),
    ("NN", "NNS|NNPS", "s", [""], False),
    ("NN", "NNS|NNPS", "men", ["man"], False),
    ("NN", "NNS|NNPS", "ae", ["a"], False),
    ("NN", "NNS|NNPS", "i", ["us"], False),
    ("NN", "NNS|NNPS", "a", ["um"], False),
    ("JJ", "JJR", "ier", ["y"], False),
    ("JJ", "JJR", "er", [""], True),
    ("JJ", "JJR", "er", ["e"], False),
    ("JJ", "JJS", "iest", ["y"], False),
    ("JJ", "JJS", "est", [""], True),
    ("JJ", "JJS", "est", ["e"], False),
    ("RB", "RBR", "ier", ["y"], False),
    ("RB", "RBR", "er", ["", "e"], False),
    ("RB", "RBS", "iest", ["y"], False),
    ("RB", "RBS", "est", ["", "e"], False),
]
# What stands for cardinal and ordinal numbers.
CARDINAL, ORDINAL = "#crd#", "#ord#"


def inflections(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """``form, pos, base`` of the pairs that a rule takes to one of ``bases`` (lexicon, base); the first rule wins. A tag passes
    a rule if it is part of the rule's tags."""
    from .morphology import first_match, rules

    table = rules(pairs.sparkSession, [(lexicon, "", suffix, replacements, [tags], double) for lexicon, tags, suffix, replacements, double in SUFFIXES])
    own = pairs.select(F.lower("form").alias("form"), "pos", F.substring("pos", 1, 2).alias("lexicon")).distinct()
    found = first_match(own, table, bases, F.contains(F.col("tags")[0], F.col("pos")), doubled_consonant_lemma)
    low = found.select(F.col("form").alias("low"), "pos", F.col("lemma").alias("base"))
    return pairs.select("form", "pos", F.lower("form").alias("low")).join(low, ["low", "pos"]).select("form", "pos", "base")


def lemmas(tokens: DataFrame, bases: DataFrame, exceptions: DataFrame | None = None, abbreviations: DataFrame | None = None, cardinals=(), ordinals=()) -> DataFrame:
    """Adds ``lemma`` to ``form, pos`` rows; nulls keep a null lemma.

    The lower-cased form is looked up in ``abbreviations`` (form, pos, lemma), then in ``exceptions`` (lexicon, form,
    lemma), then the suffix rules are tried; else it stands for itself. Number words become their class last.
    """
    pairs = tokens.select("form", "pos").where("form is not null and pos is not null").distinct()
    out = pairs.join(inflections(pairs, bases), ["form", "pos"], "left").withColumns({"low": F.lower("form"), "lexicon": F.substring("pos", 1, 2)})
    steps = []
    if abbreviations is not None:
        out = out.join(abbreviations.select(F.col("form").alias("low"), "pos", F.col("lemma").alias("abbreviation")), ["low", "pos"], "left")
        steps.append("abbreviation")
    if exceptions is not None:
        out = out.join(exceptions.select("lexicon", F.col("form").alias("low"), F.col("lemma").alias("exception")), ["lexicon", "low"], "left")
        steps.append("exception")
    lemma = F.coalesce(*steps, "base", "low")
    number = F.when(lemma.isin(*cardinals), CARDINAL).when(lemma.isin(*ordinals), ORDINAL).otherwise(lemma)
    return tokens.join(out.select("form", "pos", number.alias("lemma")), ["form", "pos"], "left")


# Penn Treebank tags and the coarse tags of lemmas; any other tag is XX.
COARSE = {
    "AFX": "GW", "CC": "CC", "CD": "CD", "DT": "DT", "EX": "EX", "FW": "FW", "GW": "GW", "IN": "IN", "JJ": "JJ", "JJR": "JJ", "JJS": "JJ", "LS": "LS", "MD": "MD",
    "NN": "NN", "NNS": "NN", "NNP": "NN", "NNPS": "NN", "PDT": "DT", "POS": "IN", "PRP": "PR", "PRP$": "PR", "RB": "RB", "RBR": "RB", "RBS": "RB", "RP": "IN", "TO": "IN", "UH": "UH",
    "VB": "VB", "VBD": "VB", "VBG": "VB", "VBN": "VB", "VBP": "VB", "VBZ": "VB", "WDT": "DT", "WP": "PR", "WP$": "PR", "WRB": "RB",
    "$": "PU", ":": "PU", ",": "PU", ".": "PU", "``": "PU", "''": "PU", "-LRB-": "PU", "-RRB-": "PU", "HYPH": "PU", "NFP": "PU", "SYM": "PU", "PUNC": "PU",
}


def coarse(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COARSE.items() for x in pair])
    return F.coalesce(F.element_at(table, tag), F.lit("XX"))
