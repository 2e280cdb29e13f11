"""Morphology over small lexicons."""

import json

from textloom.operators import morphology as M

BASES = [("VB", x) for x in "study take run panic fill write enable little".split()] + [("NN", x) for x in "study happiness fire formula man agency power person".split()]
BASES += [("JJ", x) for x in "happy big able red little personal".split()] + [("RB", "soon")]
DERIVE = [("NN", "N_NESS", "iness", ["y"], [], False, "JJ"), ("JJ", "J_AL", "al", [""], [], False, "NN"), ("NN", "N_ITY", "ity", [""], [], False, "JJ"), ("JJ", "J_FUL", "ful", [""], [], False, "NN")]


def told(df):
    return {(r.form, r.pos): [tuple(m) for m in r.morphs] if r.morphs is not None else None for r in df.collect()}


def test_analysis(spark):
    b = spark.createDataFrame(BASES, "lexicon string, base string")
    pairs = [
        ("Studies", "NNS"), ("studies", "VBZ"), ("running", "VBG"), ("panicking", "VBG"), ("taken", "VBN"), ("women", "NNS"), ("formulae", "NNS"), ("bigger", "JJR"), ("sooner", "RBR"),
        ("happiness", "NN"), ("personality", "NN"), ("unhappy", "JJ"), ("rebelittle", "VB"), ("filled", "JJ"), ("the", "DT"), ("xyzs", "NNS"), ("is", "VBZ"), (None, "NN"), ("alien", "NN"),
    ]
    df = spark.createDataFrame(pairs, "form string, pos string")
    look = spark.createDataFrame([("is", "VBZ", [("be", "VB"), ("", "I_3PS")])], f"form string, pos string, morphs {M.MORPHS}")
    pre = spark.createDataFrame([("un", "P"), ("re", "P"), ("be", "P")], "prefix string, tag string")
    got = told(M.analyze(df, b, M.rules(spark, DERIVE), pre, lookup=look))
    assert got["Studies", "NNS"] == [("study", "NN"), ("+ies", "I_PLR")]
    assert got["studies", "VBZ"] == [("study", "VB"), ("+ies", "I_3PS")]
    assert got["running", "VBG"] == [("run", "VB"), ("+ing", "I_GRD")]
    assert got["panicking", "VBG"] == [("panic", "VB"), ("+ing", "I_GRD")]
    assert got["taken", "VBN"] == [("take", "VB"), ("+en", "I_PST")]
    assert got["women", "NNS"] == [("women", "NN")]
    assert got["formulae", "NNS"] == [("formula", "NN"), ("+ae", "I_PLR")]
    assert got["bigger", "JJR"] == [("big", "JJ"), ("+er", "I_COM")]
    assert got["sooner", "RBR"] == [("soon", "RB"), ("+er", "I_COM")]
    assert got["happiness", "NN"] == [("happy", "JJ"), ("+iness", "N_NESS")]
    assert got["personality", "NN"] == [("person", "NN"), ("+al", "J_AL"), ("+ity", "N_ITY")]
    assert got["unhappy", "JJ"] == [("happy", "JJ"), ("un+", "P")]
    assert got["filled", "JJ"] == [("fill", "VB"), ("+ed", "J_ED")]
    assert got["the", "DT"] == [("the", "DT")] and got["xyzs", "NNS"] == [("xyzs", "NN")] and got["is", "VBZ"] == [("be", "VB"), ("", "I_3PS")]
    assert got[None, "NN"] is None
    assert M.analyze(df.limit(0), b).count() == 0


def test_prefixes_repeat_and_choose(spark):
    b = spark.createDataFrame([*BASES, ("VB", "belittle"), ("VB", "able")], "lexicon string, base string")
    pre = spark.createDataFrame([("re", "P"), ("be", "P"), ("en", "P"), ("reen", "P")], "prefix string, tag string")
    df = spark.createDataFrame([("re-belittle", "VB"), ("reenable", "VB")], "form string, tag string")
    got = {r.form: [tuple(m) for m in r.morphs] for r in M.strip_prefixes(df, b, pre).collect()}
    assert got["re-belittle"] == [("little", "VB"), ("re+", "P"), ("be+", "P")]
    assert got["reenable"] == [("able", "VB"), ("re+", "P"), ("en+", "P")]
    assert [tuple(m) for m in M.strip_prefixes(df.where("form = 'reenable'"), b, pre, longest=True).first().morphs] == [("able", "VB"), ("reen+", "P")]


def test_rules_round_trip(spark, tmp_path):
    table = M.rules(spark, M.INFLECTIONS)
    (tmp_path / "r.json").write_text(M.write_rules(table))
    back = M.read_rules(spark, str(tmp_path / "r.json"))
    assert sorted(map(str, json.loads(M.write_rules(back)).items())) == sorted(map(str, json.loads(M.write_rules(table)).items()))
    assert len(M.MORPH_TAGS) == len(set(M.MORPH_TAGS)) == 48 and {r[1] for r in M.INFLECTIONS} <= set(M.MORPH_TAGS)
