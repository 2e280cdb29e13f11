"""Secret scans: an incremental blob ledger.

Every version of every path is addressed by its content. Blobs that the ledger has not seen under a rule's version are
scanned once under the rules that they lack, whatever number of paths hold them, and findings are joined back to all paths. Native: hashes and ids
travel first; then texts are shuffled by (blob, path) to find the one that is scanned of each unseen blob; findings return by content hash.

Spans are code points, end exclusive. They come from the pieces between a rule's matches, so each text is split once for
each kind that occurs in it at all.

Cases: null text is an empty text, which is a blob like any other; repeated rows of a path share a blob and each get its
findings; an empty table gives no rows and leaves the ledger as it is; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in Java's syntax; a match is kept if ``value`` (a group, 0: all) has ``least`` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1


#: The base kinds come first, in the order in which ties of begin and kind are told.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),  # each run that is long enough, as AKIA[A-Z0-9]+ of 18 or more
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
ADDED_RULES = (
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = "array<struct<begin:int,kind_no:int,end:int>>"


def spans_of(text: Column, no: int, rule: SecretRule) -> Column:
    """Leftmost matches that don't overlap, failing ones dropped."""
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)) if rule.value else found
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.array(F.struct(begin.alias("begin"), F.lit(no).alias("kind_no"), end.alias("end")))
        keep = F.length(x["value"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(rows, zero, step, lambda a: a["spans"])).otherwise(
        F.expr(f"cast(array() as {SPAN})")
    )


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``blob, kind_no, spans`` for each rule; ``blobs`` has ``blob`` and ``text``, and may have ``missing``, the numbers of
    the only rules to look for."""
    some = "missing" in blobs.columns

    def spans(i: int, r: SecretRule) -> Column:
        own = spans_of(F.col("text"), i, r)
        return F.when(F.array_contains("missing", i), own).otherwise(F.expr(f"cast(array() as {SPAN})")) if some else own

    found = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(r.version).alias("version"), spans(i, r).alias("spans")) for i, r in enumerate(rules)])
    return blobs.select("blob", F.inline(found))


def address(paths: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return paths.select(F.col(path).alias("path"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("blob"), body.alias("text"))


def scan(paths: DataFrame, path: str = "path", text: str = "text", ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings by path (``path, blob, spans``; no row is lost) and the ledger after the scan.

    The ledger has a row for each blob and rule version scanned: ``blob, kind, version, spans``.
    """
    all_paths = address(paths, path, text)
    light = all_paths.select("path", "blob")
    one = light.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), F.col("path"))).alias("p"))
    names, versions = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    todo = one.select("blob", F.col("p.path").alias("rep"))
    numbers = F.array(*[F.lit(i) for i in range(len(rules))])
    if ledger is not None:
        known = ledger.join(F.broadcast(_rule_rows(ledger.sparkSession, rules)), ["kind", "version"])
        done = known.groupBy("blob").agg(F.collect_set("no").alias("done"))
        missing = F.when(F.col("done").isNull(), numbers).otherwise(F.array_except(numbers, "done"))
        todo = todo.join(done, "blob", "left").select("blob", "rep", missing.alias("missing")).where(F.size("missing") > 0)
    if ledger is None:
        same = (all_paths["blob"] == todo["blob"]) & all_paths["path"].eqNullSafe(todo["rep"])
        unseen = all_paths.join(todo.hint("shuffle_hash"), same, "left_semi").select("blob", "text")
    else:
        lacking = todo.withColumnRenamed("blob", "of")
        same = (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("rep"))
        unseen = all_paths.join(lacking.hint("shuffle_hash"), same).select("blob", "text", "missing")
    fresh = scan_blobs(unseen, rules).where(F.size("spans") > 0)
    per_blob = fresh.groupBy("blob", "kind_no", "version").agg(F.first("spans").alias("spans"))
    new = per_blob.select("blob", names[F.col("kind_no")].alias("kind"), "version", "spans")
    if ledger is not None:
        new = ledger.select("blob", "kind", "version", "spans").unionByName(new)
    # blobs without a finding are noted too, or they would be scanned again
    wanted = F.transform("missing" if ledger is not None else numbers, lambda i: F.struct(names[i].alias("kind"), versions[i].alias("version")))
    noted = todo.select("blob", F.inline(wanted)).join(new.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    after = new.unionByName(noted.withColumn("spans", F.expr(f"cast(array() as {SPAN})")))
    current = new.where(F.size("spans") > 0).join(F.broadcast(_rule_rows(paths.sparkSession, rules)), ["kind", "version"])
    if ledger is not None:  # its numbers are those of the rules of that time
        numbered = F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), F.col("no").alias("kind_no"), x["end"].alias("end")))
        current = current.withColumn("spans", numbered)
    all_spans = current.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = light.join(all_spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))
    return found, after


def _rule_rows(spark: SparkSession, rules: tuple[SecretRule, ...]) -> DataFrame:
    """As many rows as there are rules."""
    return spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, no int")


def told(spans: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_no"]], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are merged. ``spans`` is sorted by begin."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["begin"] - acc["at"])
        joined = F.when(s["begin"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), joined.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    )


def redact_all(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced; only texts that hold one are joined with findings.

    Findings are kept by content hash, so copies share one; null text stays null.
    """
    mine = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    distinct = mine.groupBy("__blob").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("p"))
    reps = distinct.select(F.col("__blob").alias("__of"), F.col("p.doc_id").alias("__rep"))
    unseen = mine.join(reps.hint("shuffle_hash"), (F.col("__blob") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    found = scan_blobs(unseen.select(F.col("__blob").alias("blob"), F.col(text).alias("text"))).where(F.size("spans") > 0)
    per_kind = found.groupBy("blob", "kind_no").agg(F.first("spans").alias("spans"))
    spans = save(per_kind.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__spans")), "secrets")
    out = mine.join(spans.withColumnRenamed("blob", "__blob"), "__blob", "left")
    clean = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col("__spans")))
    return out.withColumn(text, clean).select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = scan(docs, "doc_id")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    return found.select(
        F.col("path").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


def _spans_sql(no: int, rule: SecretRule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT id, {no} AS no, '{rule.kind}' AS kind, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY id ORDER BY i) AS "end" FROM
        (SELECT id, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(v) AS val, unnest(g[1:len(h)]) AS gap FROM (SELECT id, regexp_extract_all(t, '{p}') AS h,
            regexp_extract_all(t, '{p}', {rule.value}) AS v, string_split_regex(t, '{p}') AS g FROM docs WHERE regexp_matches(t, '{p}')))"""


#: The same rules by another engine: gaps between matches give the places.
SQL = f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(f"SELECT * FROM ({_spans_sql(i, r)}) WHERE length(val) >= {r.least}" for i, r in enumerate(RULES))}),
    told AS (SELECT id, no, "end" - length(hit) AS "begin", kind || ':' || CAST("end" - length(hit) AS BIGINT) || ':' || CAST("end" AS BIGINT) AS span, "end" FROM found),
    per AS (SELECT id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c,
        coalesce(string_agg(span, ',' ORDER BY "begin", no, "end") FILTER (no < {len(BASE_RULES)}), '') AS base, string_agg(span, ',' ORDER BY "begin", no, "end") AS spans FROM told GROUP BY id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (id)"""
