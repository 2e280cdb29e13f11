"""Character predicates as columns, and small string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of each class, as the inside of a regular expression's brackets.
CLASSES = {
    "single_quote": r"'`\x{2018}-\x{201B}",
    "double_quote": r'"\x{201C}-\x{201F}',
    "left_bracket": r"({\[<",
    "right_bracket": r")}\]>",
    "bracket": r"({\[<)}\]>",
    "hyphen": r"\-\x{2010}-\x{2014}",
    "arrow": r"\x{2190}-\x{21FF}\x{27F0}-\x{27FF}\x{2900}-\x{297F}",
    "currency": r"$\x{00A2}-\x{00A5}\x{20A0}-\x{20CF}",
    "final_mark": r".?!\x{203C}\x{2047}-\x{2049}",
    "punct": r"!-/:-@\[-`{-~",
}


def is_class(c: Column, name: str) -> Column:
    """Whether the text is one or more characters of the class; ``punct`` also holds for an empty text."""
    return F.rlike(c, F.lit(f"^[{CLASSES[name]}]{'*' if name == 'punct' else '+'}$"))


def count_class(c: Column, name: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{CLASSES[name]}]"))


def is_range(c: Column, begin: str, end: str) -> Column:
    return c.between(begin, end)


def doubled_consonant_morph(c: Column) -> Column:
    """Four or more characters that end in two equal ones, or in two of c and k."""
    a, b = F.substring(c, -1, 1), F.substring(c, -2, 1)
    return (F.length(c) >= 4) & ((a == b) | (a.isin("c", "k") & b.isin("c", "k")))


def doubled_consonant_lemma(c: Column) -> Column:
    return (F.length(c) >= 2) & (F.substring(c, -1, 1) == F.substring(c, -2, 1))


def collapse_key(c: Column) -> list[Column]:
    """Lookup keys from exact to loose: as is, lower case, digits as #, digits as 0."""
    low = F.lower(c)
    return [c, low, F.regexp_replace(low, r"[0-9]", "#"), F.regexp_replace(low, r"[0-9]", "0")]
