"""Language ID and toxicity: held-out accuracy on the driver's tables, odd rows, probabilities."""

import math
import random
from collections import Counter

import llm_cases as C
import numpy as np
import pytest
from conftest import SF_MID

from ragtab.llm import langid, toxicity


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet")


def test_langid_held_out(spark, documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_langid_odd_rows(spark):
    rows = C.odd_rows()
    got = langid.identify(C.frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == langid.UND}
    assert und == {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == langid.UND)


def test_langid_without_labels(spark):
    rows = [(i, "some text", None, "s", 9) for i in range(5)]
    assert {r["lang_pred"] for r in langid.identify(C.frame(spark, rows)).collect()} == {langid.UND}
    assert langid.identify(C.frame(spark, [])).count() == 0


def test_langid_stage(spark, documents):
    docs = documents.union(spark.createDataFrame([(-1, "12345 ...", "en", "s", 9), (-2, None, "en", "s", None)], documents.schema))
    out = langid.langid_stage(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").exceptAll(out.select("doc_id")).collect()} == {-1, -2}


def test_columns_are_ngrams():
    rng = random.Random(1)
    a, b = C.prose(rng, 30), "der die das und " * 5
    x, y = langid.columns(a), langid.columns(b)
    shared = len(np.intersect1d(x, y))
    grams = lambda t: {(n, bs[k:k + n]) for n, _ in langid.SPECTRUM for bs in [(" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " ").encode()]  # noqa: E731, E501
                       for k in range(len(bs) - n + 1)}
    assert abs(len(x) - len(grams(a))) <= 3 and abs(shared - len(grams(a) & grams(b))) <= 3  # hashing apart


def test_folded_weights_are_kernel_ridge_regression(spark):
    """With every fitted text a landmark, the folded product is plain (weighted) kernel ridge regression."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
    text = lambda letters: " ".join(word(letters) for _ in range(25))
    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = [(i, text(kinds[lang]), lang, "", 0) for i, lang in enumerate(["aa"] * 12 + ["bb"] * 7 + ["cc"] * 5)]
    model = langid.fit(C.frame(spark, rows), per_class=50, landmarks=50, ridge=0.05)

    sets = lambda ts: [set(langid.columns(t).tolist()) for t in ts]
    kernel = lambda xs, ys: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in ys] for x in xs])
    known, langs = sets([r[1] for r in rows]), [r[2] for r in rows]
    y = np.array([[1.0 if lang == other else -1.0 for other in sorted(kinds)] for lang in langs])
    alpha = np.linalg.solve(kernel(known, known) + 0.05 * np.diag([langs.count(lang) for lang in langs]), y)
    new = [text(x) for x in kinds.values() for _ in range(4)] + [text("abcxyz"), text("qrstuv")]
    want = kernel(sets(new), known) @ alpha
    lang, _, decision, n_grams = model.score(new)
    assert model.languages == sorted(kinds) and lang == [sorted(kinds)[k] for k in want.argmax(1)]
    assert np.abs(decision - want.max(1)).max() < 1e-3
    assert n_grams.tolist() == [len(x) for x in sets(new)]


def test_langid_stage_rejects_letters_of_no_language(spark, documents):
    rng = random.Random(4)
    noise = [(-k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150 * k)), None, "s", 9)
             for k in range(1, 31)]
    out = {r["doc_id"] for r in langid.langid_stage(documents.union(spark.createDataFrame(noise, documents.schema))).select("doc_id").collect()}
    assert not any(i < 0 for i in out)
    assert out == {r["doc_id"] for r in documents.select("doc_id").collect()}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    marked = got[got["held_out"] & got["toxic"].notna()]
    good = marked[marked["toxic"] == 1]["score"].to_numpy()
    rest = marked[marked["toxic"] == 0]["score"].to_numpy()
    assert (good[:, None] > rest[None, :]).mean() > 0.9
    assert (rest >= 0.5).mean() < 0.05


def test_toxicity_odd_rows(spark):
    rows = C.odd_rows()
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2, "x") for i in range(40)] + [(3, 1, "x"), (None, 1, "x")], "doc_id long, toxic long, t string")
    got = toxicity.toxicity(C.frame(spark, rows, clash=True), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = toxicity.toxicity(C.frame(spark, rows), labels.filter("toxic = 1")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(C.frame(spark, []), labels).count() == 0


def test_kneser_ney_sums_to_one():
    """After every context, and whatever shared distribution is below, the letters' probabilities sum to one."""
    rng = random.Random(3)
    toxic, ordinary = Counter(), Counter()
    for _ in range(300):
        for c in (toxic, ordinary):
            c.update(toxicity.grams("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))))
    letters = "abcd\x03"
    lower = {}
    for g in {*toxic, *ordinary}:
        raw = [rng.random() for _ in letters]
        lower.setdefault(g[1:-1], {c: x / sum(raw) for c, x in zip(letters, raw, strict=True)})
    for counts in (toxic, ordinary):
        tables = toxicity.with_contexts(counts)
        for h in {g[:-1] for g in {*toxic, *ordinary}}:
            assert sum(toxicity.probability(h + c, lower[h[1:]][c], *tables) for c in letters) == pytest.approx(1)
    m = toxicity.kneser_ney(toxic, ordinary, {g[1:]: lower[g[1:-1]][g[-1]] for g in {*toxic, *ordinary}})
    assert all(math.isfinite(x) for x in [*m.table.values(), *m.default.values()])
    g = max(toxic, key=toxic.get)
    ratio = toxicity.probability(g, lower[g[1:-1]][g[-1]], *toxicity.with_contexts(toxic)) \
        / toxicity.probability(g, lower[g[1:-1]][g[-1]], *toxicity.with_contexts(ordinary))
    assert m.table[g] == pytest.approx(math.log(ratio))


def test_backoff_counts_do_not_depend_on_what_a_task_remembers(spark, monkeypatch):
    rng = random.Random(8)
    docs = C.frame(spark, [(i, C.prose(rng, 40), "", "", 0) for i in range(60)])
    tables = lambda: [sorted(map(tuple, t.collect())) for t in toxicity.backoff_counts(docs)]
    whole = tables()
    monkeypatch.setattr(toxicity, "MOST_SEEN", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert tables() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rare_forms_share_their_parts(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = C.prose(rng, 60).replace("w", "word").split()
        if bad:
            ws[rng.randrange(60)] = "nasty" + rng.choice("bcdfghjk") + rng.choice("aeiou")
        rows.append((i, " ".join(ws), "", "", 0))
        labels.append((i, int(bad)))
    rows += [(1000, "word word nastyzu word", "", "", 0), (1001, "word word word", "", "", 0)]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(C.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic long")).collect()}
    assert got[1000] > 0.5 > got[1001]


def test_backoff_counts_cover_all_documents(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word("abcé" if i < 40 else "abcdefgh") for _ in range(30)), "", "", 0) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic long")  # the others are outside the sample
    seen, real = [], toxicity.kneser_ney
    monkeypatch.setattr(toxicity, "kneser_ney", lambda *a: seen.append(a) or real(*a))
    model = toxicity.fit(C.frame(spark, rows), labels)
    toxic, ordinary = seen[0][:2]

    found = {g[k:] for _, t, *_ in rows for w in toxicity.words(t) for g in toxicity.grams(w) for k in range(toxicity.ORDER - 1)}
    n = Counter(g[1:] for g in found)
    d, total, kinds = toxicity.DISCOUNT, Counter(), Counter()
    for g, c in n.items():
        total[g[:-1]] += c
        kinds[g[:-1]] += 1

    def shared(g):
        if not g:
            return 1 / (kinds[""] + 1)
        h = g[:-1]
        return max(n[g] - d, 0) / total[h] + d * kinds[h] / total[h] * shared(g[1:])

    assert sum(map(shared, [h + c for h in ["abc"] for c in kinds_of(n)])) == pytest.approx(1, abs=0.01)
    want = {}
    for g in {*toxic, *ordinary}:
        p = []
        for counts in (toxic, ordinary):
            of = [c for x, c in counts.items() if x[:-1] == g[:-1]]
            p.append((max(counts.get(g, 0) - d, 0) + d * len(of) * shared(g[1:])) / sum(of) if of else shared(g[1:]))
        want[g] = math.log(p[0]) - math.log(p[1])
    assert model.table == pytest.approx(want)


def kinds_of(n):
    return [g for g in n if len(g) == 1]
