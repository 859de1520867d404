"""The weighted sparse embedder: fit, embed and search against plain dictionaries."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd

from ragtab.operators import embed as E
from ragtab.operators import topk


def bag(text):
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return Counter(int(hashlib.md5(w.encode()).hexdigest()[:3], 16) for w in words)


DOCS = ["the red cat", "the blue cat the cat", "a dog", "", None, "the", "the dog and the bird", "Ünï ß the cat", "word " * 3000]
ASKED = ["red cat", "the", "zebra", "", None, "the dog", "bird bird"]


def frames(spark):
    d = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, question string").repartition(3)
    return spark.createDataFrame(list(enumerate(ASKED)), "id long, question string"), d


def test_fit_embed_search(spark):
    q, d = frames(spark)
    idf = E.fit_idf(d)
    df = Counter(b for t in DOCS for b in bag(t))
    want = np.array([math.log((len(DOCS) + 1) / (df[b] + 1)) for b in range(E.BUCKETS)])
    assert np.allclose(idf, want, atol=1e-15)

    def unit(text):
        w = {b: c * want[b] for b, c in bag(text).items() if want[b] > 0}
        n = math.sqrt(sum(x * x for x in w.values()))
        return {b: x / n for b, x in sorted(w.items())}

    got = {r["doc_id"]: {p["index"]: p["weight"] for p in r["embedding"]} for r in E.embed(d, idf).collect()}
    for i, t in enumerate(DOCS):
        assert list(got[i]) == list(unit(t)) and np.allclose(list(got[i].values()), list(unit(t).values()), atol=1e-15)
    hits = []
    for i, t in enumerate(ASKED):
        scores = sorted((-round(sum(x * unit(e).get(b, 0) for b, x in unit(t).items()), 6), j) for j, e in enumerate(DOCS))
        hits += [(i, j, -s, r) for r, (s, j) in enumerate([x for x in scores if x[0] < 0][:3], 1)]
    for kw in ({}, {"broadcast_bytes": 50}):
        found = E.sparse_topk(E.embed(q, idf), E.embed(d, idf), 3, **kw).select("query_id", "doc_id", "score", "rank").collect()
        assert sorted(map(tuple, found)) == sorted(hits)


def test_any_batch_function_gives_dense_vectors(spark):
    q, d = frames(spark)

    def lengths(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [float(len(t)), 1.0])

    hits = topk.dense_topk(E.embed_batch(q, lengths), E.embed_batch(d, lengths), 1).collect()
    assert len(hits) == len(ASKED)
