"""Retrieval (G2): first-stage top-k, optional rerank, threshold, field unpack and
context assembly, in the order of the reference: top-k -> rerank -> top-3 ->
threshold on the first-stage score."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtab.functions.text import token_jaccard, tokens
from ragtab.operators.lexical_index import LexicalIndex
from ragtab.operators.topk import dense_topk, id_type, lexical_topk
from ragtab.session import ensure_checkpoint_dir, sized_broadcast

# Candidate widening of the advanced mode and the context header.
ADVANCED_CANDIDATES = 10
ADVANCED_KEEP = 3
CONTEXT_HEADER = "Use the following information to generate your answer:\n"

# hit rows (ids, score, rank: ~40 bytes) under this count are broadcast
MAX_BROADCAST_HITS = 2_000_000


def _require(df: DataFrame, cols, what: str):
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")


def jaccard_pair_score(query_text: Column, doc_text: Column) -> Column:
    """Default rerank pair score: token Jaccard of (query, candidate question)."""
    return token_jaccard(tokens(query_text), tokens(doc_text))


def first_stage(queries: DataFrame, corpus: DataFrame, k: int, *, method: str = "lexical",
                query_id: str = "id", query_col: str = "question", doc_id: str = "doc_id",
                doc_col: str = "question", **kw) -> DataFrame:
    if isinstance(corpus, LexicalIndex):  # stored postings: no text of the corpus is read
        if method != "lexical" or (doc_id, doc_col) != (corpus.doc_id, corpus.text) or kw.get("embedder", corpus.embedder) != corpus.embedder:
            raise ValueError("the index was made for another search")
        return corpus.topk(queries, k, query_id=query_id, query_text=query_col, exclude_self=kw.get("exclude_self", False), raw=kw.get("raw", False),
                           floor=kw.get("floor"))
    if method == "lexical":
        return lexical_topk(queries, corpus, k, query_id=query_id, query_text=query_col,
                            doc_id=doc_id, doc_text=doc_col, **kw)
    if method in ("cosine", "l2_relevance"):
        return dense_topk(queries, corpus, k, metric=method, query_id=query_id, query_vec=query_col,
                          doc_id=doc_id, doc_vec=doc_col, **{k: v for k, v in kw.items() if k != "embedder"})
    raise ValueError(f"unknown retrieval method {method!r}")


def candidates(queries: DataFrame, corpus: DataFrame, k: int, *, key: str = "response", method: str = "lexical",
               query_id: str = "id", query_text: str = "question", doc_id: str = "doc_id", doc_text: str = "question",
               query_vec: str | None = None, doc_vec: str | None = None, with_text: bool = True, checkpoint: bool = True,
               dedupe_questions: bool = False, **kw) -> DataFrame:
    """First-stage hits with their values: query_id, rank, doc_id, score, raw, value and, ``with_text``, doc_text.

    One search serves every setting with the same corpus and embedder: see ``cut``. ``corpus`` is a table, or a
    ``LexicalIndex``: then only the values of the hits are read from its documents."""
    _require(corpus, [doc_id, doc_text, key], "corpus")
    _require(queries, [query_id, query_text], "queries")
    stored = isinstance(corpus, LexicalIndex)
    if stored:
        if dedupe_questions:
            raise ValueError("an index has no search without repeated questions; ingest one document of each")
        corpus = corpus.snapshot()
    if dedupe_questions:
        # off by default: the reference keeps one document per record, so top-k
        # may repeat a question; on, the lowest doc_id of each question text stays
        first = corpus.groupBy(doc_text).agg(F.min(doc_id).alias("_keep"))
        corpus = corpus.join(first.select(F.col("_keep").alias(doc_id)), doc_id, "left_semi")
    hits = first_stage(queries, corpus, k, method=method, query_id=query_id,
                       query_col=query_vec or query_text, doc_id=doc_id, doc_col=doc_vec or doc_text, raw=True, **kw)
    n_q = getattr(hits, "query_rows", None)
    # Hits are at most |queries| x k rows; broadcast them only under that
    # proven bound, so the corpus is read once and never shuffled.
    if n_q is None:
        n_q = queries.select(query_id).count()
    hb = F.broadcast(hits) if n_q * k <= MAX_BROADCAST_HITS else hits
    if stored:
        corpus = corpus.documents()
    need = [_id(corpus, doc_id).alias("doc_id"), F.col(key).alias("value")]
    if with_text:
        need.append(F.col(doc_text).alias("doc_text"))
    out = corpus.select(*need).join(hb, "doc_id").select("query_id", "rank", "doc_id", "score", "raw", "value", *(["doc_text"] if with_text else []))
    if checkpoint:
        # Cut the lineage of the expensive search, values included: size checks and
        # joins reread the few hits from the shared checkpoint folder, never the corpus,
        # and a lost executor does not redo the search.
        ensure_checkpoint_dir(out.sparkSession)
        out = out.checkpoint(eager=True)
    return out


def _id(df: DataFrame, name: str) -> Column:
    return F.col(name).cast(id_type(df.schema[name].dataType))


def cut(found: DataFrame, queries: DataFrame, *, k: int = 4, advanced: bool = False, threshold: float | None = None,
        query_id: str = "id", query_text: str = "question",
        pair_score: Callable[[Column, Column], Column] = jaccard_pair_score) -> DataFrame:
    """The surviving hits of a setting from candidates of a search with at least its k (10 if ``advanced``)."""
    if advanced:
        out = found.where(F.col("rank") <= ADVANCED_CANDIDATES).drop("rank")
        out = out.join(queries.select(_id(queries, query_id).alias("query_id"), F.col(query_text).alias("query_text")), "query_id")
        out = out.withColumn("rerank_score", F.round(pair_score(F.col("query_text"), F.col("doc_text")), 6))
        w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("doc_id"))
        out = out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= ADVANCED_KEEP)
    else:
        out = found.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    if threshold is not None:
        out = out.where(F.col("raw") > F.lit(float(threshold)))  # the score before rounding
    return out.select("query_id", "rank", "doc_id", "score", "rerank_score", "value")


def retrieve_hits(queries: DataFrame, corpus: DataFrame, *, k: int = 4, advanced: bool = False, threshold: float | None = None,
                  query_id: str = "id", query_text: str = "question",
                  pair_score: Callable[[Column, Column], Column] = jaccard_pair_score, checkpoint: bool = True, **kw) -> DataFrame:
    """Surviving hits: query_id, rank, doc_id, score, rerank_score, value.

    ``advanced`` widens the candidates to 10, reranks them by ``pair_score`` and
    keeps 3 (the caller's k is ignored, as in the reference). ``threshold`` keeps
    ``score > threshold`` and acts last, on the first-stage score. ``corpus`` is a
    table or a ``LexicalIndex``."""
    # without a rerank the threshold cuts the end of a query's ranks, so the search need not look below it
    floor = None if advanced or threshold is None else float(threshold)
    found = candidates(queries, corpus, ADVANCED_CANDIDATES if advanced else k, query_id=query_id, query_text=query_text,
                       with_text=advanced, checkpoint=checkpoint, floor=floor, **kw)
    return cut(found, queries, k=k, advanced=advanced, threshold=threshold, query_id=query_id, query_text=query_text, pair_score=pair_score)


def assemble_context(queries: DataFrame, hits: DataFrame, *, query_id: str = "id",
                     header: str = CONTEXT_HEADER, keep_columns: bool = False) -> DataFrame:
    """G1: one row per query: header then ``- value`` lines in rank order, or ''
    when no hit survived. Groups hold at most k hits. With ``keep_columns`` every
    query column is kept (one join instead of joining the contexts back)."""
    per_q = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("h"))
    lines = F.transform(F.col("h"), lambda x: F.concat(F.lit("- "), F.coalesce(x["value"].cast("string"), F.lit("")), F.lit("\n")))
    per_q = per_q.select(F.col("query_id").alias("_qid"), F.concat(F.lit(header), F.array_join(lines, "")).alias("_ctx"))
    # one context row per query with hits: broadcast under a checked row and byte bound
    per_q = sized_broadcast(per_q, MAX_BROADCAST_HITS, row_bytes=F.octet_length("_ctx") + F.lit(16))
    q = queries if keep_columns else queries.select(query_id)
    out = q.join(per_q, F.col(query_id).cast(id_type(q.schema[query_id].dataType)) == F.col("_qid"), "left")
    out = out.withColumn("context", F.coalesce("_ctx", F.lit(""))).drop("_qid", "_ctx")
    return out if keep_columns else out.select(query_id, "context")


def retrieve(queries: DataFrame, corpus: DataFrame, *, k: int = 4, key: str = "response",
             as_prompt: bool = False, advanced: bool = False, threshold: float | None = None,
             query_id: str = "id", **kw) -> DataFrame:
    """The reference's ``retrieve`` for a whole table of questions: hits in long
    form, or with ``as_prompt`` one context string per question."""
    hits = retrieve_hits(queries, corpus, k=k, key=key, advanced=advanced, threshold=threshold,
                         query_id=query_id, **kw)
    if not as_prompt:
        return hits
    return assemble_context(queries, hits, query_id=query_id)
