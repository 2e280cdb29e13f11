"""Queries over a whole table against brute force, or by what they get right on rows that they did not learn from."""

import numpy as np
import pandas as pd
import pytest
import regex

from textloom.llm import op4_toxicity, op7_decontaminate, op10_language

SF = "/root/testdata/sf0.01"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def plain_leaks(texts, items, window=13, allowed=2):
    """Ids of the items whose words lie over a text's, on some diagonal, with enough of some stretch alike."""
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w])
    coded, out = [(i, code(t)) for i, t in items], []
    for text in texts:
        words, found = code(text), []
        for i, item in coded:
            need = min(window, len(item))
            least = need - (allowed if need == window else 0)
            if len(words) < need or np.isin(words, item).sum() < least:
                continue
            same = (words[:, None] == item[None, :]).astype(np.int32)
            sums = np.zeros((len(words) - need + 1, len(item) - need + 1), np.int32)
            for k in range(need):
                sums += same[k : k + sums.shape[0], k : k + sums.shape[1]]
            if sums.max() >= least:
                found.append(i)
        out.append(",".join(map(str, sorted(found))))
    return out


def test_decontamination_of_the_whole_table(spark):
    docs, bench = read("documents"), read("benchmark")
    want = dict(zip(docs.doc_id, plain_leaks(docs.text, list(zip(bench.item_id, bench.text, strict=True))), strict=True))
    got = {r.doc_id: r["items"] for r in op7_decontaminate.op7_decontaminate(spark, SF).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_language_of_held_out_documents(spark):
    lang = dict(read("documents")[["doc_id", "lang"]].itertuples(index=False))
    got = op10_language.op10_language(spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_toxicity_of_held_out_documents(spark):
    toxic = dict(read("labels")[["doc_id", "toxic"]].itertuples(index=False))
    got = op4_toxicity.op4_toxicity(spark, SF).collect()
    assert len(got) == len(read("documents")) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    bad, good = ([r.score for r in got if r.held_out and toxic.get(r.doc_id) == k] for k in (1, 0))
    if len(bad) < 3:
        pytest.skip("too few toxic rows are held out")
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert auc >= 0.85, auc
