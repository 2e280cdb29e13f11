"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import op11_merkle, op12_licenses, op13_runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, base):
    """Levels from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + base]) for i in range(0, len(out[-1]), base)])
    return out


def plain_manifest(rows, base):
    def leaf(r, more=0):
        return h(*map(cell, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "+" + r[2], []).append(r)
    trees, order = {}, sorted(groups, key=str.encode)
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], base)
    top, out = tree([trees[g][-1][0] for g in order], base), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            up, proof = leaf(r, int(hit)), []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run, j = level[at // base * base : at // base * base + base], at % base
                    proof += run[:j] + run[j + 1 :]
                    up, at = h(*run[:j], up, *run[j + 1 :]), at // base
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*proof), up, up == root))
    return sorted(out, key=str)


def run_manifest(spark, rows, base=2):
    docs = spark.createDataFrame(rows, DOC)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    nodes, proofs = op11_merkle.manifest(docs, base=base, altered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return nodes, sorted(map(tuple, proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("n", "base"), [(1, 2), (45, 2), (700, 2), (53, 3)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, base):
    monkeypatch.setattr(op11_merkle, "BLOCK", 8)  # several storeys
    random.seed(n)
    langs = ["en"] * 8 + ["de", None, "", "é"]
    rows = [(i * 3, random.choice(["", "a b", "ü" * 9, None]), random.choice(langs), random.choice([None, "web"]), random.choice([None, 5])) for i in range(n)]
    rows += [(None, "x", "en", "s", 1), (None, None, None, None, None), (9, "t", "de", "s", 3), (9, "t", "de", "s", 3)]
    nodes, got = run_manifest(spark, rows, base)
    assert got == plain_manifest(rows, base)
    sizes = {}
    for r in rows:
        g = "" if r[2] is None else "+" + r[2]
        sizes[g] = sizes.get(g, 0) + 1
    want = {(g, level, i) for g, m in sizes.items() for level in range(1, 12) for i in range(-(-m // base**level)) if -(-m // base ** (level - 1)) > 1}
    found = [tuple(x) for x in nodes.select("g", "level", "idx").collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_manifest_of_nothing(spark):
    assert run_manifest(spark, [])[1] == []


def windows(w, templates, num, den):
    out = set()
    for label, t in templates:
        words = t.split()
        own, n = set(words), len(words)
        for b in range(0, max(len(w), 1), n):
            if den * len(own & set(w[b : b + 2 * n])) >= num * len(own):
                out.add((label, b // n))
    return out


def test_licence_scan_finds_every_block(spark):
    random.seed(3)
    templates = (("one", "a b c d e f g h"), ("two", "c d e x y"), ("three", "a a b b c c d"), ("rare", "q"))
    alphabet = list("abcdefghxyz") + ["über", "the"]
    rows = [(i, " ".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))) for i in range(300)]
    rows += [(1, "A-B_c d.e\nf"), (2, None), (3, ""), (4, "-- ??"), (5, "q"), (5, "q"), (None, "c d e x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = op12_licenses.order(docs, templates)
    assert sorted(ranks) == op12_licenses.vocabulary(templates)
    for num, den in ((80, 100), (100, 100), (1, 3)):
        got = op12_licenses.scan(docs.withColumn("__h0", F.lit(1)), ranks, templates=templates, num=num, den=den).collect()
        assert len(got) == len(rows)
        for r in got:
            low = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
            w = "".join(c if c.isalnum() or not c.isascii() else " " for c in low).split()
            assert r["licenses"]["n_words"] == len(w)
            assert {(m["label"], m["block"]) for m in r["licenses"]["matches"]} == windows(w, templates, num, den), (w, num)
    empty = op12_licenses.scan(docs.limit(0), ranks, templates=templates)
    assert empty.count() == 0 and op12_licenses.order(docs.limit(0), templates) == op12_licenses.vocabulary(templates)


def test_licence_phrases(spark):
    text = "Under the MIT license; under the mit-license, CC BY-NC. mit license under the mit"
    docs = spark.createDataFrame([(1, text), (2, "under the mit license"), (3, "cc by nc" + " x" * 50_000 + " apache license VERSION 2")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in op12_licenses.scan(docs, op12_licenses.vocabulary()).collect()}
    assert [tuple(x) for x in got[1]["found"]] == [("mit", 0), ("mit", 4), ("cc-by-nc", 8)]
    assert got[2]["found"] == [] and got[2]["n_words"] == 3  # a no-break space is part of a word
    assert [tuple(x) for x in got[3]["found"]] == [("apache-2", 50_003), ("cc-by-nc", 0)]


def plain_runs(x, least):
    every = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                every.add((i, j - i + q, q))
            i = max(j, i + 1)
    return {(s, m, q) for s, m, q in every if m >= least and not any(p < q and t <= s and t + k >= s + m for t, k, p in every)}


def test_runs_equal_plain_search():
    random.seed(5)
    for turn in range(1500):
        k, n = random.choice([1, 2, 2, 3, 5]), random.randint(0, 60)
        x = [random.randrange(k) for _ in range(n)]
        if turn % 2:
            unit = [random.randrange(k) for _ in range(random.randint(1, 9))]
            x = (unit * 60)[:n]
            for _ in range(random.randint(0, 2) if x else 0):
                x[random.randrange(n)] = random.randrange(k)
        for least in (1, 12):
            assert op13_runs.runs_of(x, least) == plain_runs(x, least), (x, least)


def test_runs_take_linear_time(monkeypatch):
    """Words compared with each other, one more for each comparison: a fixed number a word, at four times the length as well."""
    steps = 0

    class Counted(op13_runs.Sequence):
        def ahead(self, i, j, k):
            nonlocal steps
            got = super().ahead(i, j, k)
            steps += got - k + 1
            return got

        def back(self, i, j, k, most):
            nonlocal steps
            got = super().back(i, j, k, most)
            steps += got - k + 1
            return got

    def words(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        random.seed(2)
        unit = [random.randrange(2) for _ in range(50)]
        yield from (b[:n], [0] * n, [0, 1] * (n // 2), [random.randrange(2) for _ in range(n)], (unit * n)[:n], (([0] * 50 + [1]) * n)[:n], [i.bit_count() % 2 for i in range(n)])

    monkeypatch.setattr(op13_runs, "Sequence", Counted)
    per = []
    for n in (5_000, 20_000):
        per.append([])
        for x in words(n):
            steps = 0
            op13_runs.runs_of(x)
            per[-1].append(steps / n)
    for few, many in zip(*per, strict=True):
        assert many < 8 and many < few * 1.1 + 0.1, per


def test_find_runs_rows(spark):
    random.seed(8)
    texts = ["", None, "one two", "a b " * 40 + "c", " ".join(random.choice("ab") for _ in range(400)), "x\t\ny " * 3000, "é ü " * 9]
    texts += [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 90))) for _ in range(60)] + ["a b " * 40 + "c"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long")
    got = op13_runs.find_runs(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        w = (texts[r["doc_id"]] or "").split()
        want = sorted(plain_runs(w, 12), key=lambda x: (x[0], x[2]))
        assert [tuple(x) for x in r["runs"]] == want and r["start"] == r["doc_id"]
        drop = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert op13_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="name result columns"):
        op13_runs.find_runs(docs, runs="start")


def test_planted_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(200)] + [(None, "a b"), (3, None)], "doc_id long, text string")
    for r in op13_runs.planted(docs).where("doc_id is not null and text is not null").collect():
        o, c = [f"w{k}" for k in range(r["doc_id"] % 50)], zlib.crc32(str(r["doc_id"]).encode())
        if c % 10 == 0 and o:
            g, n = c // 10, len(o)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            o = [o[i] if i < a else o[a + (i - a) % p] for i in range(n)]
        assert r["text"].split() == o


def test_texts_under_one_id(spark):
    """Near-duplicate stage and Jaccard join where ids are shared or rows repeat: each text is judged by itself."""
    import corpus_pipeline
    from textloom.llm import op6_jaccard

    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    x, y, z = words("x"), words("y"), words("z")
    rows = [(1, x), (5, x), (5, y), (5, z), (7, y + " more"), (7, ""), (7, None), (9, z), (9, z), (None, x), (5, z + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str)
    one_of_z = [p for p in kept if p[1] and p[1].startswith(z)]
    assert len(one_of_z) == 1 and one_of_z[0][0] == 5
    assert sorted([p for p in kept if p not in one_of_z], key=str) == sorted([(1, x), (5, y), (7, ""), (7, None), (None, x)], key=str)
    comp = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op6_jaccard.jaccard_components(docs.select("doc_id", "text"), 5, 80).collect()], key=str)
    assert comp == sorted([(1, 26, 1), (5, 26, 1), (5, 26, 5), (5, 26, 5), (7, 27, 5), (7, 0, 7), (7, 0, 7), (9, 26, 5), (9, 26, 5), (None, 26, None), (5, 27, 5)], key=str)
