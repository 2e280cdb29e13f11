"""Spacing of tokens, text from tokens, and small string rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import CLASSES

# Tokens that take no blank before them.
CLOSING = (".", ":", ",", ";", ")", "n't", "!", "?")


def infer_spaces(t: DataFrame) -> DataFrame:
    """Adds ``space_after`` to rows sid, tid, tok: none before closing marks and apostrophes, none after ``(``, and quotes hug
    what is between an odd one and the next."""
    w = Window.partitionBy("sid").orderBy("tid")
    quotes = F.sum(F.when(F.col("tok") == '"', 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = t.withColumn("__quotes", quotes)
    after, after_quotes = F.lead("tok").over(w), F.lead("__quotes").over(w)
    opens = (F.col("tok") == "(") | ((F.col("tok") == '"') & (F.col("__quotes") % 2 == 1))
    closes = after.isin(*CLOSING) | F.startswith(after, F.lit("'")) | ((after == '"') & (after_quotes % 2 == 0))
    return marked.withColumn("space_after", ~(opens | F.coalesce(closes, F.lit(False)))).drop("__quotes")


def plain_text(t: DataFrame) -> DataFrame:
    """``sid, plain`` of rows sid, tid, tok, space_after: no blank at the end."""
    one = F.concat("tok", F.when(F.col("space_after"), F.lit(" ")).otherwise(F.lit("")))
    g = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", one.alias("x")))).alias("t"))
    return g.select("sid", F.rtrim(F.array_join(F.col("t.x"), "")).alias("plain"))


def spaced_text(toks: Column) -> Column:
    """The text of an array of tokens, as ``infer_spaces`` and ``plain_text`` give it, where the array lies: no token may hold a blank or a line
    feed. Tokens are joined by blanks; a blank that goes becomes a line feed first, so that tokens keep their ends until quotes are paired."""
    joined = F.regexp_replace(F.array_join(toks, " "), r"(?<= \(|^\() | (?=(?:[.:,;)!?]|n't)(?![^ ])|')", "\n")
    parts = F.transform(F.split(joined, r'(?<![^ \n])"(?![^ \n])', -1), lambda p, i: F.when(i % 2 == 1, F.trim(p, F.lit(" \n"))).otherwise(p))
    return F.rtrim(F.translate(F.array_join(parts, '"'), "\n", ""))


def tagged_text(t: DataFrame, *tags: str) -> DataFrame:
    """``sid, tagged``: tokens, each followed by its tags as ``<a/b>``; empty tags and O are left out."""
    some = F.filter(F.array(*tags), lambda x: x.isNotNull() & (x != "") & (x != "O"))
    one = F.concat("tok", F.when(F.size(some) > 0, F.concat(F.lit(" <"), F.array_join(some, "/"), F.lit(">"))).otherwise(F.lit("")))
    g = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tid", one.alias("x")))).alias("t"))
    return g.select("sid", F.array_join(F.col("t.x"), " ").alias("tagged"))


ALONE = "\uffff"  # no character: stands for a digit without a digit beside it


def collapse_digits(c: Column) -> Column:
    """Numbers as zeros: signs that belong to a number go, a percent sign after it too, and a single digit after a zero.

    Four replacements, each of which reads a text once, whatever its length. Single digits are marked first, as what is alone and what
    belongs to a number depends on the neighbours in the text as it was.
    """
    digit = f"[0-9{ALONE}]"
    signs = f"[{CLASSES['currency']}.+#-](?={digit})|(?<={digit})[{CLASSES['hyphen']},:/=](?={digit})|(?<={digit})%(?!{digit})"
    marked = F.regexp_replace(c, "(?<![0-9])[0-9](?![0-9])", ALONE)
    joined = F.regexp_replace(F.regexp_replace(marked, signs, ""), f"(?<={digit}){ALONE}", "")
    return F.regexp_replace(joined, digit, "0")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)), n)


def suffix_difference(form: Column, base: Column) -> Column:
    """How a form's ending departs from its base: ``+x`` added, ``-x`` taken away, with another sign where an ending stays."""
    i = common_prefix(form, base)
    head = F.substr(form, F.lit(1), i + 1)
    a, b = F.right(head, F.lit(1)), F.substr(head, F.length(head) - 1, F.lit(1))
    twice = (i < F.length(form)) & (F.length(head) >= 4) & ((a == b) | (a.isin("c", "k") & b.isin("c", "k")))
    own = F.substr(form, F.when(twice, i + 2).otherwise(i + 1), F.length(form))
    other = F.substr(base, i + 1, F.length(base))
    j = common_prefix(F.reverse(own), F.reverse(other))
    cut = lambda x: F.substr(x, F.lit(1), F.length(x) - j)
    apart = F.when(own == "", F.concat(F.lit("-"), other)).otherwise(F.concat(F.lit("+"), own))
    inside = F.when(cut(own) == "", F.concat(F.lit("-"), cut(other), F.lit("-"))).otherwise(F.concat(F.lit("+"), cut(own), F.lit("+")))
    return F.when(i == 0, F.lit("")).when(j == 0, apart).otherwise(inside)


def random_case(c: Column, key: Column, seed: int, share: float = 0.01) -> Column:
    """A share of the texts in lower case and as many in upper case, by seed and row key, so that a repeated task gives the same."""
    r = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    return F.when(r < share, F.lower(c)).when(r >= 1 - share, F.upper(c)).otherwise(c)
