import math
import re

import llm_cases as C
import numpy as np

from ragtab.llm import quality as X


def counts(t):
    t = t or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, at = {}, set()
    for k in range(len(ws) - 7):
        seen.setdefault(tuple(ws[k:k + 8]), []).append(k)
    for ks in seen.values():
        if len(ks) > 1:
            at |= {k + d for k in ks for d in range(8)}
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)


def em(every, fitted, rounds):
    """Plain EM over the fitted documents, posteriors of every document."""
    votes = every[fitted]
    prior, good, bad = 0.8, np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.7)
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + (votes == 1) @ np.log(good / (1 - bad)) + (votes == -1) @ np.log((1 - good) / bad)
        q = 1 / (1 + np.exp(-odds))
        prior = np.clip(q.mean(), 0.001, 0.999)
        cast = votes != 0
        good = np.clip((q @ (votes == 1) + 0.8) / (q @ cast + 1), 0.5, 0.999)
        bad = np.clip(((1 - q) @ (votes == -1) + 0.7) / ((1 - q) @ cast + 1), 0.5, 0.999)
    odds = math.log(prior / (1 - prior)) + (every == 1) @ np.log(good / (1 - bad)) + (every == -1) @ np.log((1 - good) / bad)
    return 1 / (1 + np.exp(-odds))


def rows():
    rep = "one two three four five six seven eight nine "
    return [*C.odd_rows(), (501, rep * 3 + "x " + rep, "", "", 0), (502, "a b c d e f g h " * 2, "", "", 0), (503, "#*$%&|<> ## x" * 9, "", "", 0),
            (504, "l1 a\nl2\n l1 a\nl1 a\n\n \n\nl2", "", "", 0), (505, "same " * 30, "", "", 0)]


def test_base_counts(spark):
    data = rows()
    got = sorted((tuple(r) for r in X.quality(C.frame(spark, data, clash=True)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    want = []
    for i, t, *_ in data:
        n = counts(t)
        want.append((i, *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(want, key=repr)


def test_posterior_against_plain_em(spark):
    got = X.quality(C.frame(spark, rows())).toPandas()
    votes = got[[f"v_{r}" for r in X.RULES]].to_numpy()
    assert np.abs(em(votes, ~got["base_failed"].to_numpy(), X.ROUNDS) - got["posterior"]).max() < 1e-2
    assert (got["kept"] == (~got["base_failed"] & (got["posterior"] >= 0.5))).all()


def test_rules_can_be_outvoted(spark):
    got = X.quality(C.frame(spark, rows())).toPandas()
    votes = got[[f"v_{r}" for r in X.RULES]].to_numpy()
    assert ((votes == -1).any(1) & got["kept"].to_numpy()).any()


def test_empty_table_and_no_python(spark):
    df = X.quality(C.frame(spark, []))
    assert df.count() == 0
    plan = X.votes(X.features(C.frame(spark, rows())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_stage_keeps_columns(spark):
    docs = C.frame(spark, rows(), clash=True)
    out = X.quality_stage(docs)
    assert out.columns == docs.columns
    assert 0 < out.count() < docs.count()


def test_clean_documents_stay_and_marked_ones_go(spark):
    from conftest import SF_MID

    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = X.quality(docs).join(labels, "doc_id").toPandas()
    left = got[~got["base_failed"]]
    assert left[left["quality"] == 1]["kept"].mean() > 0.98
    assert left[left["quality"] == 0]["kept"].mean() < 0.5
