import hashlib
import random

import llm_cases as C
import numpy as np
import pytest

from ragtab.llm import suffix_dedup as X


def brute(rows):
    texts = {}
    for i, t, *_ in rows:
        texts[i] = (t or "").encode()
    seen, out = set(), []
    for i in sorted(texts):
        b, gone = texts[i], bytearray(len(texts[i]))
        for p in range(len(b) - X.MATCH + 1):
            w = b[p:p + X.MATCH]
            if w in seen:
                gone[p:p + X.MATCH] = b"\1" * X.MATCH
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted({tuple(r) for r in df.filter("doc_id is not null").collect()})


@pytest.mark.parametrize("clash", [False, True])
def test_brute_force_on_odd_rows(spark, clash):
    rows = C.odd_rows()
    df = X.suffix_dedup(C.frame(spark, rows, clash))
    assert df.count() == len(rows)
    assert result(df) == brute([r for r in rows if r[0] is not None])


@pytest.mark.parametrize("seed", range(3))
def test_brute_force_on_passages(spark, seed):
    rng = random.Random(seed)
    parts = [C.prose(rng, rng.randrange(3, 60)) for _ in range(15)]
    rows = []
    for i in range(60):
        t = rng.choice(["", " ", "é"]).join(rng.choice(parts)[rng.randrange(20):] for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.2:
            t += "ab" * rng.randrange(40, 200)
        if rng.random() < 0.1:
            t += "\0" * rng.randrange(90, 130)
        rows.append((rng.randrange(1000) * 60 + i, t, "", "", 0))
    assert result(X.suffix_dedup(C.frame(spark, rows))) == brute(rows)


def test_every_string_holds_its_anchor():
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab ") for _ in range(3000)) + b"a" * 300
    _, at, _ = X.anchors([(0, text)])
    assert all(((at >= p) & (at <= p + X.LEFT)).any() for p in range(len(text) - X.MATCH + 1))


def test_pieces_hold_every_string(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 150)
    text = bytes(range(256)) * 3
    for p in range(len(text) - X.MATCH + 1):
        assert any(s <= p and p + X.MATCH <= s + len(b) for s, b in X.cut(text))


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_loser_tree(runs):
    rng = random.Random(runs)
    strings = [bytes(rng.choice(b"ab") for _ in range(k)).ljust(X.MATCH, rng.choice([b"a", b"b"])) for k in range(60) for _ in range(3)]
    parts = [sorted(strings[k::runs]) for k in range(runs)]
    coded = []
    for p in parts:
        same, _ = X.front_code(np.frombuffer(b"".join(p), np.uint8).reshape(-1, X.MATCH))
        coded.append((same.tolist(), p))
    which, index, same = X.merge_runs(coded)
    merged = [parts[r][i] for r, i in zip(which, index, strict=True)]
    assert merged == sorted(strings)
    for a, b, n in zip(merged, merged[1:], same[1:], strict=False):
        assert a[:n] == b[:n] and (n == X.MATCH or a[n] != b[n])


def test_empty_table(spark):
    assert X.suffix_dedup(C.frame(spark, [])).count() == 0


def test_stage_cuts_texts(spark):
    rng = random.Random(8)
    passage = C.prose(rng, 40)
    rows = [(1, "first. " + passage + " end", "en", "s", 5), (2, passage, "en", "s", 5), (3, "own words é" + passage + "é too", "en", "s", 5),
            (4, "clean", "en", "s", 5), (5, None, "en", "s", None), (6, "own words é" + passage + "é too", "en", "s", 5)]
    docs = C.frame(spark, rows, clash=True)
    out = X.suffix_stage(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: rows[0][1], 3: "own words éé too", 4: "clean", 5: None}


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(4)
    passage = C.prose(rng, 40)
    first, second = (1, "first. " + passage + " end", "en", "s", 5), (2, "own words " + passage + " too", "en", "s", 5)
    rows = [first, first, second, first, second]
    docs = C.frame(spark, rows, parts=4)
    got = X.suffix_dedup(docs).collect()
    assert len(got) == len(rows) and sorted({tuple(r) for r in got}) == brute(rows)
    assert {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}
    texts = [r["text"] for r in X.suffix_stage(docs).collect()]
    assert len(texts) == len(rows) and texts.count(first[1]) == 3


@pytest.mark.parametrize("length", [60, 250])
def test_no_bucket_grows_with_a_common_passage(spark, monkeypatch, length):
    """A line shorter than a string, and a passage's edges, in documents that differ around it."""
    monkeypatch.setattr(X, "BUCKET", 30)
    sizes, real = [], X.merged_repeats

    def merged(runs):
        n = {}
        for r in runs.select("bucket", "run").collect():
            n[r["bucket"]] = n.get(r["bucket"], 0) + len(X.unpack_run(r["run"])[0])
        sizes.append(max(n.values()))
        return real(runs)

    monkeypatch.setattr(X, "merged_repeats", merged)
    rng = random.Random(length)
    passage = C.prose(rng, 100)[:length]
    rows = [(i, C.prose(rng, 30, 10**6) + passage + C.prose(rng, 30, 10**6) + (passage[-90:] if i % 3 else ""), "", "", 0) for i in range(300)]
    assert result(X.suffix_dedup(C.frame(spark, rows))) == brute(rows)
    assert sizes[0] <= 4 * X.BUCKET
