"""A stored index for lexical search (S8, J2): postings of segments of documents, with score bounds.

**Index.** Documents are dealt to segments of a bounded number of documents and tokens, those of
similar length together. A segment has a row for each of its terms: the documents' places in the
segment, their counts, and the largest weight (count over document norm) that any of them has; and
one row with the documents' ids and norms. The rows stand in batches (``sources.batches``): a batch
can be appended, or run again. The index knows how texts become terms, so it can be opened by path
and searched without the corpus.

**Search.** A block of queries (bounded in bytes) is broadcast, and the rows of their terms go to tasks by segment. A task
takes a segment's documents from its postings and scores them with the kernel of ``topk.lexical_topk``, so both return the
same rows: tiles of like queries and documents, in which only queries are scored whose bound reaches what they have to reach
(the sum of count x largest weight over the terms, and by Cauchy-Schwarz the norm of the query's terms that the tile has).
That is the threshold, or their k-th best score in the segments that the task has seen.

With ``report`` queries are searched one by one, to count cells. For a query and a segment, the sum of count x bound over the
query's terms, or the norm of its terms there, is at least the cosine of any of its documents.
First each query visits the segment with the highest bound; its k-th best score there is what
every other candidate has to reach. Then only the segments whose bound reaches it are visited. In a
segment the query's terms are taken from the rarest on; a document stays a candidate only while its
partial score and the bound of the terms not seen yet can reach the k-th best score. Documents that
have none of the terms seen so far share one such bound, and once that is too low no new document is
looked at.

No pair of query and document is a Spark row except the best k of a segment; a term that every
document has is a row in each segment, not a hot key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragtab.functions.text import EMBEDDERS
from ragtab.operators.topk import LexicalKernel, _TopK, id_type, round6, term_counts
from ragtab.session import ensure_checkpoint_dir
from ragtab.sources.batches import BatchTables, one_row_per_key

#: A segment's documents and tokens, about; a document of more tokens is a segment's only large one.
SEGMENT_DOCS, SEGMENT_TOKENS = 4096, 2_000_000
#: Bytes of a block of queries.
BLOCK_BYTES = 32 << 20
#: Scores are rounded to 6 digits: what a bound may miss the k-th best score by.
SLACK = 2e-6


class LexicalIndex:
    """Documents (all columns) and postings under a path."""

    def __init__(self, store: BatchTables):
        self.store, self.spark = store, store.spark
        info = json.loads(store.info)
        self.doc_id, self.text, self.embedder = info["doc_id"], info["text"], info["embedder"]
        self.schema = StructType.fromJson(info["schema"])
        self.id_type = id_type(self.schema[self.doc_id].dataType)
        self.postings_schema = (f"segment long, term string, at array<int>, counts array<int>, bound double, "
                                f"ids array<{self.id_type}>, norms array<double>")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, *, doc_id: str = "doc_id", text: str = "question",
               embedder: str = "lexical") -> LexicalIndex:
        info = {"doc_id": doc_id, "text": text, "embedder": embedder, "schema": json.loads(schema.json())}
        return cls(BatchTables.create(spark, path, json.dumps(info)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(BatchTables.open(spark, path))

    def snapshot(self) -> LexicalIndex:
        """The index as of now: a search and the values of its hits see the same documents."""
        return LexicalIndex(self.store.snapshot())

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def documents(self) -> DataFrame:
        return self.store.read("documents", self.schema)

    def version(self) -> int:
        return self.store.version()

    def append(self, docs: DataFrame, batch: str) -> None:
        """Adds the documents whose id no other batch holds, one row an id. Run again, a batch replaces its own rows."""
        docs = one_row_per_key(docs.select(*self.schema.names), self.doc_id)
        known = self.store.read("documents", self.schema, but=batch).select(F.col(self.doc_id).alias("_known"))
        docs = docs.join(known, docs[self.doc_id].eqNullSafe(known["_known"]), "left_anti")
        ensure_checkpoint_dir(self.spark)
        docs = docs.checkpoint(eager=True)  # both tables of the batch are made from the same rows
        first = 1 + max((json.loads(r["info"])["last"] for r in self.store.batches().values()), default=-1)
        postings, segments = self._postings(docs, first)
        self.store.put(batch, {"documents": docs, "postings": postings}, json.dumps({"last": first + segments - 1}))

    def _postings(self, docs: DataFrame, first: int) -> tuple[DataFrame, int]:
        rows = docs.select(F.col(self.doc_id).cast(self.id_type).alias("id"), EMBEDDERS[self.embedder](self.text).alias("tokens"))
        rows = rows.where(F.size("tokens") > 0).withColumn("size", F.floor(F.log2(F.size("tokens").cast("double")) * 2).cast("int"))
        sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens")).collect()  # two a power of two
        start, many, total = {}, {}, 0
        for r in sorted(sizes, key=lambda r: r["size"]):
            start[r["size"]], many[r["size"]] = total, max(-(-r["n"] // SEGMENT_DOCS), -(-r["tokens"] // SEGMENT_TOKENS))
            total += many[r["size"]]
        top = max(start, default=0)
        pick = lambda d, other: F.array(*(F.lit(d.get(k, other)) for k in range(top + 1)))[F.col("size")]
        rows = rows.withColumn("segment", (first + pick(start, 0) + F.pmod(F.xxhash64("id"), pick(many, 1))).cast("long"))
        schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
                            ("bound", pa.float64()), ("ids", pa.list_(pa.string() if self.id_type == "string" else pa.int64())),
                            ("norms", pa.list_(pa.float64()))])

        def build(t: pa.Table) -> pa.Table:
            row, term, count, names = term_counts(t["tokens"])
            norms = np.sqrt(np.bincount(row, weights=count * count, minlength=t.num_rows))
            order = np.lexsort((row, term))
            row, term, count = row[order], term[order], count[order]
            ends = np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))
            bound = np.maximum.reduceat(count / norms[row], ends[:-1])
            segment, n = t["segment"][0].as_py(), len(names)
            terms = pa.table([pa.array([segment] * n, pa.int64()), names, lists(row), lists(count), pa.array(bound), pa.nulls(n, schema.field("ids").type),
                              pa.nulls(n, schema.field("norms").type)], schema=schema).sort_by("term")
            head = pa.table({"segment": [segment], "term": [None], "at": [None], "counts": [None], "bound": [None],
                             "ids": [t["id"].to_pylist()], "norms": [norms.tolist()]}, schema=schema)
            return pa.concat_tables([head, terms])

        parts = max(1, min(total, 4 * self.spark.sparkContext.defaultParallelism + total // 8))
        grouped = rows.select("segment", "id", "tokens").repartition(parts, "segment").groupBy("segment")
        return grouped.applyInArrow(build, self.postings_schema), total

    def topk(self, queries: DataFrame, k: int, *, query_id: str = "id", query_text: str = "question", exclude_self: bool = False,
             report: bool = False, raw: bool = False, block_bytes: int = BLOCK_BYTES, floor: float | None = None):
        """query_id, doc_id, score, rank (and raw): the rows of ``topk.lexical_topk`` over all documents. ``floor``: hits with a
        lower score (both to 6 decimals) are not looked for. With ``report`` also a table query_id, sharing (documents that
        have a term of the query), looked_at (of these, in how many a term was counted) and scored (in how many all terms
        were), of a search query by query."""
        if self.store.pinned is None:
            return self.snapshot().topk(queries, k, query_id=query_id, query_text=query_text, exclude_self=exclude_self, report=report, raw=raw,
                                        block_bytes=block_bytes, floor=floor)
        q_type = id_type(queries.schema[query_id].dataType)
        schema = f"query_id {q_type}, doc_id {self.id_type}, score double, raw double, rank long"
        empty = self.spark.createDataFrame([], schema)
        ensure_checkpoint_dir(self.spark)
        if report or (exclude_self and q_type != self.id_type):
            hits, cells = self._reported(queries, k, query_id, query_text, q_type, exclude_self, raw, block_bytes, empty)
            return (hits, cells) if report else hits
        # questions with one id are one query, with the terms of all
        words = F.array_join(F.flatten(F.collect_list(EMBEDDERS[self.embedder](query_text))), " ")
        asked = queries.groupBy(F.col(query_id).cast(q_type).alias("qid")).agg(words.alias("payload")).where("payload <> ''").checkpoint(eager=True)
        rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("payload") + 64), F.lit(0))).first()
        blocks = -(-size // block_bytes)
        part = lambda b: asked.where(F.pmod(F.xxhash64("qid", "payload"), F.lit(blocks)) == b)
        found = [self._scan(part(b), k, q_type, exclude_self, floor) for b in range(blocks)]
        hits = empty if not found else reduce(DataFrame.union, found)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select(*empty.columns)
        hits = hits if raw else hits.drop("raw")
        hits.query_rows = rows
        return hits

    def _scan(self, asked: DataFrame, k: int, q_type: str, exclude_self: bool, floor: float | None) -> DataFrame:
        """The best k of every task for a block of queries, which are bounded in bytes. A task reads segment after segment."""
        spark = self.spark
        table = asked.toArrow()  # BLOCK_BYTES at most
        if table.num_rows == 0:
            return spark.createDataFrame([], f"query_id {q_type}, doc_id {self.id_type}, score double, raw double")
        shared = spark.sparkContext.broadcast((_ids(table["qid"], 0)[0], table.column("payload").combine_chunks()))
        no_id = bool(table["qid"].null_count)
        call, d_type = uuid.uuid4().hex, self.id_type
        postings = self.store.read("postings", self.postings_schema)
        names = asked.select(F.explode(F.split("payload", " ")).alias("term")).distinct()
        wanted = postings.where("term is not null").join(F.broadcast(names), "term", "left_semi").unionByName(postings.where("term is null"))
        segments = 1 + max((json.loads(r["info"])["last"] for r in self.store.batches().values()), default=0)
        parts = max(1, min(segments, 4 * spark.sparkContext.defaultParallelism + segments // 8))
        wanted = wanted.select("segment", "term", "at", "counts", "ids", "norms").repartition(parts, "segment").sortWithinPartitions("segment")

        def scan(batches):
            kernel = _prepared(call, lambda: shared.value)
            acc = _TopK(k, q_type, d_type, floor)
            nulls = [_score_segment(kernel, acc, rows, exclude_self) for rows in _segments(batches)]
            q, d, s, r = acc._final()
            yield pa.RecordBatch.from_arrays([_with_nulls(q, 0, no_id), _with_nulls(d, 1, any(nulls)), pa.array(s), pa.array(r)],
                                             ["query_id", "doc_id", "score", "raw"])

        return wanted.mapInArrow(scan, f"query_id {q_type}, doc_id {self.id_type}, score double, raw double")

    def _reported(self, queries: DataFrame, k: int, query_id: str, query_text: str, q_type: str, exclude_self: bool, raw: bool,
                  block_bytes: int, empty: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The search query by query, that counts the cells it looks at."""
        terms = queries.select(F.col(query_id).cast(q_type).alias("qid"), F.explode(EMBEDDERS[self.embedder](query_text)).alias("term"))
        terms = terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("c")).checkpoint(eager=True)
        rows, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()
        blocks = -(-size // block_bytes)
        found = [self._block(terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k, q_type, exclude_self) for b in range(blocks)]
        hits, cells = empty, self.spark.createDataFrame([], f"query_id {q_type}, sharing long, looked_at long, scored long")
        for at, (h, c) in enumerate(found):
            hits, cells = (h, c) if at == 0 else (hits.union(h), cells.union(c))
        hits = hits if raw else hits.drop("raw")
        hits.query_rows = terms.select("qid").distinct().count() if rows else 0
        return hits, cells

    def _block(self, terms: DataFrame, k: int, q_type: str, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
        """Hits and counts of cells for a block of queries whose terms are bounded in bytes."""
        spark = self.spark
        norms = terms.groupBy(F.col("qid").alias("of")).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("qn"))
        terms = terms.join(norms, F.col("qid").eqNullSafe(F.col("of"))).select("qid", "term", "c", "qn")
        names = F.broadcast(terms.select("term").distinct())  # of the block: bounded by its bytes
        postings = self.store.read("postings", self.postings_schema)
        weight = F.col("c") / F.col("qn")
        bounds = (postings.where("term is not null").select("segment", "term", "bound").join(F.broadcast(terms), "term")
                  .groupBy("qid", F.col("segment").alias("segment")).agg(F.least(F.sum(weight * F.col("bound")), F.sqrt(F.sum(weight * weight))).alias("bound")))
        bounds = bounds.checkpoint(eager=True)
        asked: dict = {}
        for r in terms.toArrow().to_pylist():  # BLOCK_BYTES at most
            asked.setdefault(r["qid"], ({}, r["qn"]))[0][r["term"]] = r["c"]
        shared = spark.sparkContext.broadcast(asked)
        out_schema = (f"query_id {q_type}, doc_id {self.id_type}, score double, raw double, sharing long, looked_at long, scored long")
        fields = pa.schema([("query_id", pa.string() if q_type == "string" else pa.int64()),
                            ("doc_id", pa.string() if self.id_type == "string" else pa.int64()), ("score", pa.float64()),
                            ("raw", pa.float64()), ("sharing", pa.int64()), ("looked_at", pa.int64()), ("scored", pa.int64())])

        def visit(asks: pa.Table, rows: pa.Table) -> pa.Table:
            segment = _Segment(rows) if asks.num_rows else None
            out: list[tuple] = []
            for qid, least in zip(asks["qid"].to_pylist(), asks["least"].to_pylist(), strict=True):
                counts, qn = shared.value[qid]
                out += segment.best(qid, counts, qn, k, least, exclude_self)
            return pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in out], schema=fields)

        def run(visits: DataFrame) -> DataFrame:
            wanted = postings.join(names, "term", "left_semi").unionByName(postings.where("term is null"))
            wanted = wanted.join(visits.select("visited").distinct(), F.col("segment") == F.col("visited"), "left_semi")
            met = visits.groupBy("visited").cogroup(wanted.groupBy("segment")).applyInArrow(visit, out_schema)
            return met.checkpoint(eager=True)

        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment")
        ranked = bounds.withColumn("turn", F.row_number().over(order)).withColumnRenamed("segment", "visited")
        first = run(ranked.where("turn = 1").select("visited", "qid", F.lit(0.0).alias("least")))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        kth = (first.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
               .select(F.col("query_id").alias("of"), F.col("score").alias("kth")))
        open_ = ranked.where("turn > 1").join(kth, F.col("qid").eqNullSafe(F.col("of")), "left").select(
            "visited", "qid", "bound", F.coalesce("kth", F.lit(0.0)).alias("least")).where(F.col("bound") >= F.col("least") - SLACK)
        both = first.unionByName(run(open_.select("visited", "qid", "least")))
        hits = both.where("score is not null").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
        cells = both.where("score is null").groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("sharing", "looked_at", "scored")))
        return hits.select("query_id", "doc_id", "score", "raw", "rank"), cells


#: The kernel of a search in this worker process: its tasks prepare the queries once.
_KERNEL: dict = {}


def _prepared(call: str, queries) -> LexicalKernel:
    if call not in _KERNEL:
        _KERNEL.clear()
        _KERNEL[call] = LexicalKernel().prepare(*queries())
    return _KERNEL[call]


#: What stands for a null id of a query and of a document while ids are NumPy arrays.
_NULL_IDS = {"i": (-1 << 63, (1 << 63) - 1), "U": ("\U0010fffe", "\U0010ffff")}


def _ids(ids: pa.Array | pa.ChunkedArray, side: int) -> tuple[np.ndarray, bool]:
    """Ids as NumPy, and whether any is null."""
    text = not pa.types.is_integer(ids.type)
    known = pc.fill_null(ids, _NULL_IDS["U" if text else "i"][side]).to_numpy(**({} if isinstance(ids, pa.ChunkedArray) else {"zero_copy_only": False}))
    return known.astype(str) if text else known, bool(ids.null_count)


def _with_nulls(ids: np.ndarray, side: int, any_null: bool) -> pa.Array:
    return pa.array(ids, mask=ids == _NULL_IDS[ids.dtype.kind][side] if any_null else None)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one segment after another, from batches sorted by segment."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        number = b.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1, len(number)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi > lo:
                if held and held[0].column(0)[0].as_py() != int(number[lo]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _score_segment(kernel: LexicalKernel, acc: _TopK, rows: pa.Table, exclude_self: bool) -> bool:
    """Scores a segment's documents against the queries whose bound there reaches what they have to reach. True if a document
    has no id."""
    rows = rows.combine_chunks()
    head = np.flatnonzero(pc.is_null(rows["term"]).to_numpy())
    at = pc.drop_null(rows["at"])
    if len(head) == 0 or len(at) == 0:
        return False
    first = int(head[0])
    (ids, null), norms = _ids(rows["ids"][first].values, 1), rows["norms"][first].values.to_numpy()
    code = np.repeat(kernel.codes(pc.drop_null(rows["term"]).combine_chunks()), pc.list_value_length(at).to_numpy())
    r, count = (pc.list_flatten(x).to_numpy().astype(np.int64) for x in (at, pc.drop_null(rows["counts"])))
    kernel.score_laid_out(acc, *kernel.laid_out(ids, norms, r, code, count.astype(np.float64)), exclude_self)
    return null


class _Segment:
    """The rows of a segment that a block of queries needs."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        term = rows["term"].to_pylist()
        head = [i for i, t in enumerate(term) if t is None]
        self.terms: dict = {}
        if not head:
            self.n = 0
            return
        self.ids, self.norms = rows["ids"][head[0]].values, rows["norms"][head[0]].values.to_numpy()
        key = self.ids.to_numpy(zero_copy_only=False)
        self.key = key if key.dtype != object else key.astype(str)
        self.n = len(self.norms)
        for i, t in enumerate(term):
            if t is not None:
                self.terms[t] = (rows["at"][i].values.to_numpy(), rows["counts"][i].values.to_numpy(), rows["bound"][i].as_py())

    def best(self, qid, counts: dict, qn: float, k: int, least: float, exclude_self: bool) -> list[tuple]:
        """The k best documents of the segment whose score is at least ``least``, and a row with the numbers of cells."""
        found = sorted((t for t in counts if t in self.terms), key=lambda t: (len(self.terms[t][0]), t))
        m = len(found)
        w = np.array([counts[t] / qn for t in found])
        sums = np.append(np.cumsum((w * [self.terms[t][2] for t in found])[::-1])[::-1], 0.0)  # of the terms from here on
        lengths = np.append(np.sqrt(np.cumsum((w * w)[::-1])[::-1]), 0.0)
        dots, mass = np.zeros(self.n), np.zeros(self.n)
        seen, alive = np.zeros(self.n, bool), np.ones(self.n, bool)
        if exclude_self:
            alive &= self.key != (str(qid) if self.key.dtype.kind == "U" else qid)
        sharing = np.zeros(self.n, bool)
        floor = least - SLACK
        for i, t in enumerate(found):
            at, tf, _ = self.terms[t]
            sharing[at] = True
            fresh = min(sums[i], lengths[i]) >= floor  # may a document without any term so far still get there?
            take = alive[at] & (seen[at] | fresh)
            at, tf = at[take], tf[take].astype(np.float64)
            dots[at] += counts[t] * tf
            mass[at] += tf * tf
            seen[at] = True
            if 2 * (i + 1) >= m or i % 4 == 3:
                live = np.flatnonzero(seen & alive)
                part = dots[live] / (qn * self.norms[live])
                if len(live) > k:  # partial scores only grow
                    floor = max(floor, float(np.partition(part, len(part) - k)[len(part) - k]) - SLACK)
                rest = np.minimum(sums[i + 1], lengths[i + 1] * np.sqrt(np.maximum(1.0 - mass[live] / self.norms[live] ** 2, 0.0)))
                alive[live[part + rest < floor]] = False
        live = np.flatnonzero(seen & alive)
        exact = dots[live] / (qn * self.norms[live])
        good = (dots[live] > 0) & (exact >= least - SLACK)
        live, exact = live[good], exact[good]
        score = round6(exact)
        top = np.lexsort((self.key[live], -score))[:k]
        rows = [(qid, self.ids[int(live[j])].as_py(), float(score[j]), float(exact[j]), None, None, None) for j in top]
        return [*rows, (qid, None, None, None, int(sharing.sum()), int(seen.sum()), len(live))]

