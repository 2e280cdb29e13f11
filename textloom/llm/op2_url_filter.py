"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the candidate rules, and only
those run their regular expressions.

Native: one map-only pass over the URLs, with no shuffle, while the index has at most ``INLINE_RULES`` rules; a larger
rule set is joined by token. The index costs one counting pass that returns a number for each literal token of a rule.

Cases: a null URL, or one without ``://``, has an empty host and path and gets the default verdict; repeated rows are
judged each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

INLINE_RULES = 256
SEPARATOR = r"([^A-Za-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported. ``pattern``: ``||`` anchors at a host or one of its parent domains, ``^`` is a separator or
    the end, ``*`` is anything, ``|`` at the end is the end; all else is literal. Higher ``tier`` wins, then length."""

    name: str
    pattern: str
    verdict: str
    tier: int = 0

    def regex(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            out, body = r"^([^/]*\.)?", body[2:]
        end = ""
        if body.endswith("|"):
            body, end = body[:-1], "$"
        for ch in body:
            out += {"*": ".*", "^": SEPARATOR}.get(ch, re.sub(r"([^A-Za-z0-9/])", r"\\\1", ch))
        return out + end

    def tokens(self) -> list[str]:
        """Literal runs that must be whole tokens of any URL that fits: bounded by an anchor, a separator or a literal
        that isn't a letter or digit."""
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        found = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0].lower())
        return found


def site_rule(verdict: str, rule: str) -> Rule:
    """A ``host/path`` rule: fits that host and its subdomains where the path starts with the rule's path."""
    return Rule(rule, f"||{rule}", verdict, tier=1)


SITE_RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
PATTERN_RULES = (
    Rule("spam-farm", "||spam-farm.", "block"),
    Rule("cheap-pills", "||cheap-pills.", "block"),
    Rule("casino", "||casino.", "block"),
    Rule("free-download", "/free-download/", "block"),
    Rule("wp-login", "/wp-login.php^", "block"),
    Rule("doorway", "/doorway/*/go^", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Each rule under its rarest literal token, by counts over all URLs; rules without one under ``''``."""
    words = sorted({t for r in rules for t in r.tokens()})
    counts: dict[str, int] = {}
    if words:  # as many rows as the rules have tokens
        seen = urls.select(F.explode(F.array_intersect(tokens_of("target"), F.array(*map(F.lit, words)))).alias("t"))
        counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        best = min(r.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(best, []).append(r)
    return index


def _entry(r: Rule) -> Column:
    return F.struct(
        F.lit(r.tier).alias("tier"), F.lit(len(r.pattern)).alias("size"), F.lit(r.name).alias("name"),
        F.lit(r.verdict).alias("verdict"), F.lit(r.regex()).alias("regex"),
    )


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path`` and ``fit`` (the winning rule as tier, size, name, verdict, regex; null if none fits)."""
    df = df.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))})
    df = df.withColumn("target", F.concat("host", "path"))
    index = rule_index(df.select("target"), rules)
    if len(rules) <= INLINE_RULES:
        always = F.array(*map(_entry, index.get("", []))) if "" in index else None
        fetch = F.create_map(*[x for t, rs in index.items() if t for x in (F.lit(t), F.array(*map(_entry, rs)))])
        hit = F.array_intersect(tokens_of("target"), F.array(*[F.lit(t) for t in index if t]))
        candidates = F.flatten(F.transform(hit, lambda t: fetch[t]))
        if always is not None:
            candidates = F.concat(candidates, always)
        fits = F.filter(candidates, lambda r: F.rlike(F.col("target"), r["regex"]))
        return df.withColumn("fit", F.array_max(fits)).drop("target")
    spark = df.sparkSession
    rows = [(t, r.tier, len(r.pattern), r.name, r.verdict, r.regex()) for t, rs in index.items() for r in rs]
    lookup = spark.createDataFrame(rows, "token string, tier int, size int, name string, verdict string, regex string")
    targets = df.select("target").distinct()
    fetched = targets.select("target", F.explode(F.array_union(tokens_of("target"), F.array(F.lit("")))).alias("token"))
    best = (
        fetched.join(lookup, "token").where(F.rlike("target", F.col("regex")))
        .groupBy("target").agg(F.max(F.struct("tier", "size", "name", "verdict", "regex")).alias("fit"))
    )
    return df.join(best, "target", "left").drop("target")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select(
        "page_id", "host", "path",
        F.when(F.col("fit.tier") == 1, F.col("fit.name")).alias("rule"),
        F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"),
    )


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills|casino)\.') THEN 'block'
    WHEN regexp_matches(host || path, '/free-download/|/wp-login\.php([^A-Za-z0-9_.%-]|$)|/doorway/.*/go([^A-Za-z0-9_.%-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM f
"""
