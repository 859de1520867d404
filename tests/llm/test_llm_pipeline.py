import random

import llm_cases as C
import pytest
from test_llm_ngram_join import brute as components
from test_llm_suffix_dedup import X as suffix

import corpus_pipeline as P
from ragtab.llm import langid


def documents(spark, rows, path):
    C.frame(spark, rows, clash=True).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def cut(rows):
    """Brute force of the fourth stage."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - suffix.MATCH + 1):
            if b[p:p + suffix.MATCH] in seen:
                gone[p:p + suffix.MATCH] = b"\1" * suffix.MATCH
            seen.add(b[p:p + suffix.MATCH])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        if not any(gone) or kept.split():
            out[i] = kept
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passage = C.prose(rng, 60)
    rows = [r for r in C.odd_rows() if r[0] is not None]
    rows += [(700 + k, C.prose(rng, 50) + " " + passage + " " + C.prose(rng, 50), "en", "s", 9) for k in range(5)]
    return [*rows, rows[0]]


def test_stages_against_brute_force(spark, rows, tmp_path):
    docs = documents(spark, rows, tmp_path)
    want = {i: t for i, t, *_ in rows}
    kept = {r["doc_id"] for r in langid.identify(docs).filter(f"lang_pred <> 'und' and score >= {langid.MIN_SCORE}").collect()}
    expect = [{i: t for i, t in want.items() if i in kept}]
    by = {}
    for i, t in expect[-1].items():
        by.setdefault("".join(t.encode().translate(None, b" \t\n\x0b\x0c\r").decode()), []).append((-len(t), i))
    expect.append({i: want[i] for _, i in map(min, by.values())})
    low = {i: c for i, _, c in components([(i, t) for i, t in expect[-1].items()])}
    expect.append({i: t for i, t in expect[-1].items() if low[i] == i})
    expect.append(cut(expect[-1]))
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == expect[k], P.STAGES[k][0]
    pieces = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(expect[-1])


def test_empty_table(spark, tmp_path):
    documents(spark, [], tmp_path)
    assert P.run(spark, str(tmp_path)).count() == 0
