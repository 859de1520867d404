"""Pluggable model slots (X1, X2): text embedder and pair scorer.

No neural weights are bundled. The default embedder is a hashed bag of words weighted by IDF:
a text's words fall into ``BUCKETS`` buckets, a bucket's weight is its count times
``ln((n + 1) / (df + 1))`` over the corpus, and a text's weights have unit length. It stays sparse
(index, weight) from fit to score. Any Arrow batch function gives dense vectors instead
(``embed_batch``, then ``topk.dense_topk``). The pair scorer slot takes a column function;
``pandas_jaccard`` is an Arrow-batched example that equals the native default."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ragtab.functions.text import hashed_tokens, tokens
from ragtab.operators.topk import DEFAULT_BROADCAST_BYTES, WeightedKernel, _blocked_topk, _id, _public, list_slices, term_counts

#: Buckets of the hashed embedder (three hexadecimal digits of a word's MD5).
BUCKETS = 4096
SPARSE = "array<struct<index:int,weight:double>>"


def fit_idf(corpus: DataFrame, text: str = "question") -> np.ndarray:
    """The IDF of every bucket over the corpus, texts without words included: one aggregate; BUCKETS rows reach the driver."""
    per_text = corpus.select(F.array_distinct(hashed_tokens(text)).alias("b"))
    seen = per_text.select(F.explode("b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(BUCKETS)
    for r in seen:
        df[int(r["b"], 16)] = r["df"]
    return np.log((corpus.count() + 1.0) / (df + 1.0))


def embed(df: DataFrame, idf: np.ndarray, text: str = "question", out: str = "embedding") -> DataFrame:
    """Adds ``out``, the text's (index, weight) pairs by index, of unit length; empty where no word has weight."""
    shared = df.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers

    @F.arrow_udf(SPARSE)
    def weigh(words: pa.Array) -> pa.Array:
        parts = [weigh_slice(words.slice(lo, hi - lo)) for lo, hi in list_slices(words)]
        return pa.concat_arrays(parts) if parts else weigh_slice(words)

    def weigh_slice(words: pa.Array) -> pa.Array:
        row, code, count, names = term_counts(words)
        index = np.array([int(x, 16) for x in names.to_pylist()], np.int32)[code] if len(names) else np.empty(0, np.int32)
        weight = count * shared.value[index]
        row, index, weight = row[weight > 0], index[weight > 0], weight[weight > 0]
        order = np.lexsort((index, row))
        row, index, weight = row[order], index[order], weight[order]
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(words)))
        ends = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(index), pa.array(weight / norm[row])], ["index", "weight"]))

    return df.withColumn(out, weigh(hashed_tokens(text)))


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "id", query_vec: str = "embedding",
                doc_id: str = "doc_id", doc_vec: str = "embedding", exclude_self: bool = False,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, raw: bool = False) -> DataFrame:
    """Best k corpus rows per query by cosine of sparse (index, weight) vectors; rows that share no index are no hits.
    Output: query_id, doc_id, score, rank, and with ``raw`` the unrounded score."""
    side = lambda df, i, v, name: df.where(F.col(v).isNotNull()).select(
        _id(df, i).alias(name), F.col(v).alias("payload"), (F.size(v) * F.lit(12) + F.lit(16)).alias("_bytes"))
    q, d = side(queries, query_id, query_vec, "qid"), side(corpus, doc_id, doc_vec, "did")
    return _public(_blocked_topk(q, d, k, WeightedKernel(), F.col("_bytes"), exclude_self, broadcast_bytes, None), raw)


def embed_batch(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "question",
                out: str = "embedding") -> DataFrame:
    """X1 with an Arrow batch function ``texts -> vectors`` (e.g. a local model): dense vectors."""
    udf = F.pandas_udf(fn, "array<double>")
    return df.withColumn(out, udf(F.col(text)))


@F.pandas_udf(DoubleType())
def pandas_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """X2 example: Jaccard of two token columns on whole Arrow batches, without a loop
    over rows."""
    n = len(a)
    rows = [pd.Series(x.to_numpy(), index=np.arange(n)).explode().dropna() for x in (a, b)]
    codes, _ = pd.factorize(pd.concat([r.astype(str) for r in rows], ignore_index=True))
    row = np.concatenate([r.index.to_numpy(np.int64) for r in rows])
    side = np.repeat([1, 2], [len(r) for r in rows])
    seen = pd.DataFrame({"row": row, "code": codes, "side": side}).drop_duplicates().groupby(["row", "code"])["side"].sum().reset_index()
    union = np.bincount(seen["row"], minlength=n)
    both = np.bincount(seen["row"][seen["side"] == 3], minlength=n)
    return pd.Series(np.where(union > 0, both / np.maximum(union, 1), 0.0))


def pandas_pair_score(query_text: Column, doc_text: Column) -> Column:
    return pandas_jaccard(tokens(query_text), tokens(doc_text))
