"""Exact top-k nearest neighbours between a query table and a corpus table.

Plan (the same for lexical and dense scoring):

1. Spark prepares both sides column-wise (tokens by ``regexp_extract_all`` in the
   JVM, or embeddings cast to ``ARRAY<DOUBLE>``).
2. Partial top-k: each task scores a block of corpus rows against a block of
   queries with NumPy (sparse postings product for term counts, BLAS matrix
   product for vectors) and emits at most k rows per query. No pair is ever a
   Spark row, and a hot token only costs arithmetic inside one block.
   * Broadcast plan: when the query side is proven small (one aggregate gives its
     byte size), it is broadcast and the corpus is scanned once with
     ``mapInPandas`` -- no corpus shuffle.
   * Grid plan: otherwise both sides are hashed into parts of measured bytes, as large as
     a task may hold (texts: ``TASK_BYTES``); each part of the queries is replicated once
     per part of the corpus and vice versa, ``cogroup`` gives each task one pair of parts,
     and the task scores a corpus block at a time.
3. Final top-k: ``row_number`` over ``(query_id)`` ordered by (score desc,
   doc_id asc) ``<= k`` -- Spark plans it with ``WindowGroupLimit``.

Scores are rounded to 6 decimals (half away from zero, as SQL ``round``) before
ranking, so last-bit differences between summation orders cannot flip ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ragtab.functions.text import EMBEDDERS
from ragtab.session import ensure_parallel, sized_broadcast

HIT_SCHEMA = "query_id long, doc_id long, score double"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024  # of a corpus block in the grid plan, scored at once
TASK_BYTES = 128 * 1024 * 1024  # of the texts' tokens that either side of a task of the grid plan has, if its blocks are smaller
MERGE_BLOCKS = 2_000  # corpus blocks from which on partial lists are merged in two levels
_ID_DTYPES = {"long": np.int64, "string": "U1"}
_CELLS = 4_000_000  # score cells (queries x corpus rows) per NumPy chunk
TILE_ROWS = 2048  # queries of a tile of cells
LEXICAL_CELLS = 1 << 19  # cells of a lexical tile
CHUNK = 16  # documents whose largest cell is looked at first
SLICE_ITEMS = 1_000_000  # list items (tokens) of a batch that are counted at once


def id_type(t: DataType) -> str:
    """How ids of this type are carried: text stays text, numbers are longs."""
    return "string" if isinstance(t, StringType) else "long"


def round6(x: np.ndarray) -> np.ndarray:
    y = x * 1e6
    return np.sign(y) * np.floor(np.abs(y) + 0.5) / 1e6


class _TopK:
    """Running top-k per query under the order (score desc, doc_id asc). Ids are numbers or text.

    Queries come in tiles of rows; each tile keeps its own best k, and the k-th score and id of a full row, which
    every later candidate of the row has to beat. Scores below ``floor`` (both to 6 decimals) are not kept."""

    def __init__(self, k: int, q_type: str = "long", d_type: str = "long", floor: float | None = None):
        self.k, self.q_type, self.d_type = k, q_type, d_type
        self.floor = -np.inf if floor is None else float(round6(np.float64(floor)))
        self.qids = None
        self.kept: dict[int, tuple] = {}  # by first row of a tile: row, doc_id, score, raw
        self.last: dict[int, np.ndarray] = {}  # by first row of a tile: the k-th doc_id of its full rows

    def start(self, qids):
        """The queries, by row."""
        if self.qids is None:
            self.qids, self.least = np.asarray(qids), np.full(len(qids), -np.inf)  # least: the k-th score of a full row

    def offer(self, a: int, b: int, row, d, raw):
        """Candidates of the tile of rows a to b; the best k of each row stay."""
        s = round6(raw)
        least = self.least[row]
        keep = s >= np.maximum(least, self.floor)
        if a in self.last:
            keep &= (s > least) | ~np.isfinite(least) | (d < self.last[a][row - a])
        if not keep.any():
            return
        new, rest = (row[keep], d[keep], s[keep], raw[keep]), None
        if a in self.kept:  # rows without a new candidate stay as they are
            changed = np.zeros(b - a, bool)
            changed[new[0] - a] = True
            again = changed[self.kept[a][0] - a]
            rest = [x[~again] for x in self.kept[a]]
            new = [np.concatenate((x[again], y)) for x, y in zip(self.kept[a], new, strict=True)]
        row, d, s, raw, pos = _best(*new, self.k)
        self.kept[a] = (row, d, s, raw) if rest is None else tuple(np.concatenate(x) for x in zip(rest, (row, d, s, raw), strict=True))
        full = pos == self.k - 1
        self.least[row[full]] = s[full]
        last = self.last.get(a, np.zeros(b - a, d.dtype))
        self.last[a] = last.astype(np.promote_types(last.dtype, d.dtype), copy=False)
        self.last[a][row[full] - a] = d[full]

    def _final(self) -> tuple:
        if not self.kept:
            return (np.empty(0, _ID_DTYPES[self.q_type]), np.empty(0, _ID_DTYPES[self.d_type]), np.empty(0), np.empty(0))
        row, d, s, raw = (np.concatenate(x) for x in zip(*self.kept.values(), strict=True))
        return _best(self.qids[row], d, s, raw, self.k)[:4]  # rows may share an id

    q, d, s = (property(lambda self, i=i: self._final()[i]) for i in range(3))

    def frame(self, raw: bool = True) -> pd.DataFrame:
        q, d, s, r = self._final()
        out = pd.DataFrame({"query_id": q, "doc_id": d, "score": s})
        return out.assign(raw=r) if raw else out


def _best(q, d, s, raw, k: int) -> tuple:
    """The k best of each q, in order, and their places from 0."""
    order = np.lexsort((d, -s, q))
    q, d, s, raw = q[order], d[order], s[order], raw[order]
    starts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
    pos = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = pos < k
    return q[keep], d[keep], s[keep], raw[keep], pos[keep]


# --------------------------------------------------------------------------------
# scoring kernels
# --------------------------------------------------------------------------------
def _col(t, name: str) -> np.ndarray:
    """A numeric column of an Arrow table or record batch as NumPy."""
    c = t.column(t.schema.get_field_index(name))
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    x = c.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x  # text ids: code point order, as Spark's


def as_list_array(x) -> pa.Array:
    """A list column as one Arrow array (Arrow input, or Python lists from a
    small collected side). Texts are lists of the words between single spaces."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return pc.split_pattern(x, " ") if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x
    return pa.array([None if t is None else list(t) for t in x], type=pa.list_(pa.string()))


def list_slices(arr: pa.Array, most: int | None = None):
    """Ranges of the rows of a list array with at most ``most`` items, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (most or SLICE_ITEMS), side="right")))
        yield lo, hi
        lo = hi


def term_counts(tokens):
    """(row, code, count) of the distinct tokens of each row and the token
    dictionary; all in Arrow/NumPy (no Python object per token)."""
    arr = as_list_array(tokens)
    lens = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(arr)
    if len(flat) == 0:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64),
                pa.array([], type=pa.string()))
    enc = pc.dictionary_encode(flat)
    codes, uniq = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
    v, ends = max(len(uniq), 1), np.r_[0, np.cumsum(lens)]
    parts = []
    for lo, hi in list_slices(arr):
        rows = np.repeat(np.arange(lo, hi, dtype=np.int64), lens[lo:hi])
        key, cnt = np.unique(rows * v + codes[ends[lo]:ends[hi]], return_counts=True)
        parts.append((key // v, key % v, cnt.astype(np.float64)))
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), uniq)


def _matrix(vectors) -> np.ndarray:
    """A list<double> column as a (rows x dim) float64 matrix (zero copy when the
    Arrow values are contiguous)."""
    if isinstance(vectors, np.ndarray):
        return vectors
    arr = _as_vector_array(vectors)
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    dim = int(lens[0])
    if (lens != dim).any():
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)


def _as_vector_array(x) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        return x.combine_chunks()
    if isinstance(x, pa.Array):
        return x
    return pa.array([list(map(float, v)) for v in x], type=pa.list_(pa.float64()))


class _Kernel:
    """Scores documents against the queries in tiles (queries x documents) of at most ``_CELLS`` cells.

    A tile's cells are compared with what its queries have to reach: their k-th score so far, or at first the k-th of the
    tile's first columns. Only cells that may reach it are scored exactly and sorted."""

    def score_into(self, acc: _TopK, dids, payload, exclude_self=False):
        dids = np.asarray(dids)
        n_q = len(self.qids)
        if n_q == 0 or len(dids) == 0:
            return
        acc.start(self.qids)
        rows = max(1, min(n_q, TILE_ROWS, _CELLS))
        width = max(1, _CELLS // rows)
        for ids, docs in self.documents(dids, payload):
            for a in range(0, n_q, rows):
                b = min(n_q, a + rows)
                tile = self.tile(a, b)
                for lo in range(0, len(ids), width):
                    hi = min(len(ids), lo + width)
                    self.block(acc, tile, a, b, docs, ids[lo:hi], lo, hi, exclude_self)

    def first_kth(self, acc: _TopK, row, cells, dids, exclude_self: bool):
        """The k-th largest of ``cells`` (of query rows without a k-th score, and a tile's first columns), -inf if there are fewer."""
        cells = np.where(np.isfinite(cells), cells, -np.inf)
        n = cells.shape[1]
        if n < acc.k:
            return np.full(len(cells), -np.inf)
        if exclude_self:
            cells[self.qids[row][:, None] == dids[None, :n]] = -np.inf
        return np.partition(cells, n - acc.k, axis=1)[:, n - acc.k]

    def take(self, acc: _TopK, a: int, b: int, row, dids, raw, exclude_self: bool):
        good = np.isfinite(raw)
        if exclude_self:
            good &= self.qids[row] != dids
        if good.any():
            acc.offer(a, b, row[good], dids[good], raw[good])


def _first_columns(k: int) -> int:
    return max(256, 4 * k)


class LexicalKernel(_Kernel):
    """Cosine of term-count vectors: ``sum(cq*cd) / (|q| |d|)``, exact in float64.

    Queries and documents are laid out by groups of like rows (mostly of one language), and a tile of cells has queries and
    documents of few groups. A token that many of the tile's queries and documents have is a column of a dense product, any
    other adds its postings. Cells are float32: products of counts, whole numbers that float32 holds exactly while they are
    below ``WHOLE``, or of rounded weights. They select the pairs that may reach a query's k-th score; these are scored in
    float64 from the whole product, or summed again from the weights, so the layout and the split change speed, not results."""

    #: Pairs of a query and a document sharing a token from which on a dense column costs less than postings, as a share of the cells.
    DENSE_SHARE = 1 / 1500
    WHOLE = float(1 << 21)  # products below it survive the division by a document's norm in float32
    LAYOUT_TOKENS, GROUPS, FIT_ROWS = 128, 8, 4096  # the groups are fitted on so many queries; only the layout follows from them

    @staticmethod
    def terms(payload):
        """(row, code, weight) of each row's features, and the features."""
        return term_counts(payload)

    def prepare(self, qids, qtokens):
        row, code, cnt, self.vocab = self.terms(qtokens)  # by row
        n, v = len(qids), len(self.vocab)
        norm = np.sqrt(np.bincount(row, weights=cnt * cnt, minlength=n))
        weight = (cnt / np.where(norm > 0, norm, 1.0)[row]).astype(np.float32)
        often = np.argsort(-np.bincount(code, minlength=v), kind="stable")[:self.LAYOUT_TOKENS]
        self.column = np.full(v, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self._fit(row, code, weight, n)
        order = np.argsort(self._groups(row, code, weight, n), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        row = place[row]
        by_row = np.argsort(row, kind="stable")
        self.qids, self.qnorm = np.asarray(qids)[order], norm[order]
        self.row, self.code, self.cnt = row[by_row].astype(np.int32), code[by_row].astype(np.int32), cnt[by_row].astype(np.float32 if cnt.max(initial=0) < 2 ** 24 and _whole(cnt) else np.float64)
        weight = weight[by_row]
        self.whole = self.cnt.dtype == np.float32
        self.starts = np.searchsorted(self.row, np.arange(n + 1))
        self.tiles, rows = [], max(1, min(TILE_ROWS, _CELLS, LEXICAL_CELLS))
        for a in range(0, n, rows):
            b = min(n, a + rows)
            at = slice(self.starts[a], self.starts[b])
            codes, ptr, q_row, order = _by_code(self.row[at] - a, self.code[at])
            self.tiles.append((a, b, codes, ptr, q_row, weight[at][order], self.cnt[at][order]))
        self.slot = np.full(v, -1, np.int32)
        self.rooms: dict[str, np.ndarray] = {}
        return self

    def _fit(self, row, code, weight, n: int):
        """Directions of the groups: a few rounds of means of the most like ones, from rows far apart."""
        step = max(1, -(-n // self.FIT_ROWS))
        at = row % step == 0
        x = self._dense(row[at] // step, code[at], weight[at], -(-n // step))
        first, like = [0], np.full(len(x), -1.0, np.float32)
        for _ in range(min(self.GROUPS, len(x)) - 1):
            like = np.maximum(like, x @ x[first[-1]])
            first.append(int(np.argmin(like)))
        self.means = x[first] if len(x) else x
        for _ in range(4):
            near = np.argmax(x @ self.means.T, axis=1) if len(x) else np.empty(0, np.int64)
            sums = np.zeros_like(self.means)
            np.add.at(sums, near, x)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.means = np.where(size > 0, sums / np.where(size > 0, size, 1), self.means)

    def _dense(self, row, code, weight, n: int) -> np.ndarray:
        x = np.zeros((n, int((self.column >= 0).sum())), np.float32)
        c = self.column[code]
        x[row[c >= 0], c[c >= 0]] = weight[c >= 0]
        return x

    def _groups(self, row, code, weight, n: int) -> np.ndarray:
        """The group of each row, by its frequent tokens."""
        out, step = np.zeros(n, np.int64), 8192
        if not len(self.means):
            return out
        ends = np.searchsorted(row, np.arange(0, n + step, step))
        for a, lo, hi in zip(range(0, n, step), ends[:-1], ends[1:], strict=False):
            out[a:a + step] = np.argmax(self._dense(row[lo:hi] - a, code[lo:hi], weight[lo:hi], min(step, n - a)) @ self.means.T, axis=1)
        return out

    def documents(self, dids, dtokens):
        """Documents in slices of about ``SLICE_ITEMS`` tokens, laid out: see ``laid_out``."""
        arr = as_list_array(dtokens)
        for lo, hi in list_slices(arr):
            r, c, cnt, uniq = self.terms(arr.slice(lo, hi - lo))
            dnorm = np.sqrt(np.bincount(r, weights=cnt * cnt, minlength=hi - lo))
            yield self.laid_out(dids[lo:hi], dnorm, r, self.codes(uniq)[c], cnt)

    def codes(self, names: pa.Array) -> np.ndarray:
        """The queries' codes of features, -1 for those that no query has."""
        if len(names) == 0:
            return np.empty(0, np.int32)
        return pc.fill_null(pc.index_in(names, value_set=self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int32)

    def laid_out(self, ids, dnorm, r, code, cnt):
        """Documents by groups: ids, and norms, the entries of the tokens that queries have (key, count, row, code, weight),
        by row. ``r``, ``code``, ``cnt``: a document's place, a token's code or -1, and the count."""
        m = code >= 0
        r, code, cnt = r[m], code[m], cnt[m]
        w = (cnt / dnorm[r]).astype(np.float32)
        by_row = np.argsort(r, kind="stable")
        group = self._groups(r[by_row], code[by_row], w[by_row], len(ids))
        order = np.argsort(group, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        key = place[r] * len(self.vocab) + code
        by_key = np.argsort(key, kind="stable")
        return ids[order], (dnorm[order], key[by_key], cnt[by_key], place[r][by_key], code[by_key], w[by_key])

    def score_into(self, acc: _TopK, dids, payload, exclude_self=False):
        dids = np.asarray(dids)
        if len(self.qids) == 0 or len(dids) == 0:
            return
        for ids, docs in self.documents(dids, payload):
            self.score_laid_out(acc, ids, docs, exclude_self)

    def score_laid_out(self, acc: _TopK, ids, docs, exclude_self=False):
        acc.start(self.qids)
        most = min(_CELLS, LEXICAL_CELLS)
        width = max(1, most // max(1, min(len(self.qids), TILE_ROWS, most)))
        dnorm, _, cnt, r, code, w = docs
        whole = self.whole and _whole(cnt) and self.qnorm.max(initial=0) * dnorm.max(initial=0) < self.WHOLE
        parts = []
        for lo in range(0, len(ids), width):
            hi = min(len(ids), lo + width)
            s, e = np.searchsorted(r, [lo, hi])
            codes, ptr, row, order = _by_code(r[s:e] - lo, code[s:e])
            weight = w[s:e][order]
            largest = np.maximum.reduceat(weight, ptr[:-1]) if len(codes) else weight
            parts.append((lo, hi, (codes, ptr, row, cnt[s:e][order].astype(np.float32) if whole else weight, largest)))
        for tile in self.tiles:
            self.slot[tile[2]] = np.arange(len(tile[2]))
            for lo, hi, part in parts:
                self.block(acc, tile, docs, ids, lo, hi, part, whole, exclude_self)
            self.slot[tile[2]] = -1

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """A matrix whose memory is used again by the next tile."""
        if name not in self.rooms or len(self.rooms[name]) < rows * columns:
            self.rooms[name] = np.empty(rows * columns, np.float32)
        return self.rooms[name][:rows * columns].reshape(rows, columns)

    def reach(self, tile, part, n_q: int) -> np.ndarray:
        """What a query's score in these documents is at most (rounded): its weights times the documents' largest ones, and
        the length of its weights of tokens that any of them has."""
        q_codes, q_ptr, q_row, q_w = tile
        at = self.slot[part[0]]
        both = at >= 0
        most = np.zeros(len(q_codes), np.float32)
        most[at[both]] = part[4][both]
        most = np.repeat(most, np.diff(q_ptr))
        length = np.sqrt(np.bincount(q_row, weights=(most > 0) * q_w * q_w, minlength=n_q))
        return np.minimum(np.bincount(q_row, weights=most * q_w, minlength=n_q), length * (1 + 1e-6))

    def cells(self, tile, part, n_q: int, n_d: int) -> np.ndarray:
        """Products (documents x queries) of a tile; documents are filled up to whole chunks."""
        q_codes, q_ptr, q_row, q_w = tile
        codes, ptr, d_row, d_w = part[:4]
        at = self.slot[codes]
        both = np.flatnonzero(at >= 0)
        at = at[both]
        df_q, df_d = q_ptr[at + 1] - q_ptr[at], ptr[both + 1] - ptr[both]
        dense = df_q * df_d >= max(2.0, n_q * n_d * self.DENSE_SHARE)
        q, d = at[dense], both[dense]
        x, y = self._room("x", n_d, len(q)), self._room("y", n_q, len(q))
        x[:], y[:] = 0, 0
        e, c = _ranges(q_ptr[q], df_q[dense])
        y[q_row[e], c] = q_w[e]
        e, c = _ranges(ptr[d], df_d[dense])
        x[d_row[e], c] = d_w[e]
        out = np.matmul(x, y.T, out=self._room("out", n_d, n_q)).ravel()
        q, d, df_q, df_d = at[~dense], both[~dense], df_q[~dense], df_d[~dense]
        cum, s = np.cumsum(df_q * df_d), 0
        while s < len(q):  # postings of the other tokens, in slices so the temporary arrays stay bounded
            t = max(s + 1, int(np.searchsorted(cum, (cum[s - 1] if s else 0) + _CELLS, side="right")))
            e, c = _ranges(ptr[d[s:t]], df_d[s:t])
            lens = df_q[s:t][c]
            p = np.repeat(q_ptr[q[s:t]][c] - (np.cumsum(lens) - lens), lens)
            p += np.arange(len(p))
            np.add.at(out, np.repeat(d_row[e].astype(np.int64) * n_q, lens) + q_row[p], np.repeat(d_w[e], lens) * q_w[p])
            s = t
        return out.reshape(n_d, n_q)

    def block(self, acc, tile, docs, ids, lo, hi, part, whole, exclude_self):
        a, b, codes, ptr, row, weight, count = tile
        n_q, n_d = b - a, hi - lo
        floor = _cell_limit(np.maximum(acc.least[a:b], acc.floor))
        rows = np.flatnonzero(self.reach((codes, ptr, row, weight), part, n_q) >= floor)
        if len(rows) == 0:
            return
        w = count if whole else weight
        if len(rows) < 0.9 * n_q:  # without the queries that no document here can serve
            place = np.full(n_q, -1, np.int32)
            place[rows] = np.arange(len(rows))
            at = place[row] >= 0
            ptr, row, w = np.r_[0, np.cumsum(at)][ptr], place[row[at]], w[at]
        else:
            rows = np.arange(n_q)
        n_q, floor = len(rows), floor[rows]
        chunks = -(-n_d // CHUNK)
        cells = self.cells((codes, ptr, row, w), part, n_q, chunks * CHUNK)
        dnorm = docs[0][lo:hi]
        scale = np.float32(1)  # of a cell to its score: with counts, the query's norm
        if whole:
            qnorm = self.qnorm[a + rows]
            scale = np.where(qnorm > 0, qnorm, 1).astype(np.float32)
            cells[:n_d] *= np.where(dnorm > 0, 1 / np.where(dnorm > 0, dnorm, 1), 0).astype(np.float32)[:, None]
        if exclude_self:
            order = np.argsort(ids[lo:hi], kind="stable")
            own = ids[lo:hi][order]
            first, last = (np.searchsorted(own, self.qids[a + rows], side=s) for s in ("left", "right"))
            e, qi = _ranges(first, last - first)
            cells[order[e], qi] = 0
        limit = floor * scale
        new = np.flatnonzero(~np.isfinite(np.maximum(acc.least[a + rows], acc.floor)))
        if n_d >= acc.k > 1 and len(new):  # the k-th of all cells, while nothing else is known
            kth = np.partition(cells[:n_d, new], n_d - acc.k, axis=0)[n_d - acc.k]
            limit[new] = np.maximum(limit[new], _cell_limit(kth / _at(scale, new)) * _at(scale, new))
        cells = cells.reshape(chunks, CHUNK, n_q)
        most = cells.max(axis=1)
        if chunks >= acc.k:  # the k-th of the chunks' largest cells: so many documents reach it
            kth = most.max(axis=0) if acc.k == 1 else np.partition(most, chunks - acc.k, axis=0)[chunks - acc.k]
            limit = np.maximum(limit, _cell_limit(kth / scale) * scale)
        at = np.flatnonzero(most >= limit)
        step = max(1, _CELLS // CHUNK)
        for i in range(0, len(at), step):
            ci, qi = at[i:i + step] // n_q, at[i:i + step] % n_q
            found = cells[ci, :, qi]
            hit, c = np.nonzero(found >= limit[qi][:, None])
            qi, di = qi[hit], ci[hit] * CHUNK + c
            if whole:
                dots = np.rint(found[hit, c] * dnorm[di])
                some = dots > 0
                qi, di, dots = qi[some], di[some], dots[some]
                self.take(acc, a, b, a + rows[qi], ids[lo + di], dots / (qnorm[qi] * dnorm[di]), exclude_self)
            else:
                self.exact(acc, a, b, a + rows[qi], lo + di, docs, ids, exclude_self)

    def exact(self, acc, a, b, row, di, docs, ids, exclude_self):
        """Offers pairs of query rows and documents with their exact scores."""
        dnorm, key, cnt = docs[:3]
        lens = self.starts[row + 1] - self.starts[row]
        cum, s = np.cumsum(lens), 0
        while s < len(row):
            t = max(s + 1, int(np.searchsorted(cum, (cum[s - 1] if s else 0) + _CELLS, side="right")))
            e, i = _ranges(self.starts[row[s:t]], lens[s:t])
            want = di[s:t][i] * len(self.vocab) + self.code[e]
            at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            found = key[at] == want
            dots = np.bincount(i[found], weights=cnt[at[found]] * self.cnt[e[found]], minlength=t - s)
            raw = dots / (self.qnorm[row[s:t]] * dnorm[di[s:t]])
            some = dots > 0
            self.take(acc, a, b, row[s:t][some], ids[di[s:t][some]], raw[some], exclude_self)
            s = t


def _cell_limit(score) -> np.ndarray:
    """What a rounded cell reaches if its exact score, to 6 decimals, reaches ``score``; above 0, as a hit shares a token."""
    return np.maximum(np.where(np.isfinite(score), score * (1 - 1e-4) - 4e-6, 0.0), 1e-30).astype(np.float32)


def _by_code(row, code) -> tuple:
    """The distinct codes, where each one's entries start, the entries' rows, and their order."""
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    return codes, np.r_[first, len(code)], row[order].astype(np.int32), order


def _whole(x) -> bool:
    return bool((x == np.floor(x)).all())


def _at(x, at):
    return x[at] if np.ndim(x) else x


def _ranges(start, length) -> tuple:
    """The places of the ranges, one after another, and the number of the range of each."""
    number = np.repeat(np.arange(len(start)), length)
    return np.arange(len(number)) + (start - (np.cumsum(length) - length))[number], number


class WeightedKernel(LexicalKernel):
    """Cosine of sparse vectors given as (index, weight) pairs, an index at most once a row; weights above 0."""

    @staticmethod
    def terms(payload):
        arr = payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload
        lens = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(arr)
        index, weight = pc.struct_field(flat, "index"), pc.struct_field(flat, "weight").to_numpy(zero_copy_only=False)
        enc = pc.dictionary_encode(index)
        return (np.repeat(np.arange(len(arr), dtype=np.int64), lens), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                weight.astype(np.float64), enc.dictionary)


class DenseKernel(_Kernel):
    """Cosine, or the relevance ``1 - d/sqrt(2)`` of the squared L2 distance d."""

    def __init__(self, metric: str = "cosine"):
        if metric not in ("cosine", "l2_relevance"):
            raise ValueError(f"unknown metric {metric!r}")
        self.metric = metric

    def prepare(self, qids, qvecs):
        self.qids = np.asarray(qids)
        self.Q = _matrix(qvecs)
        self.qsq = (self.Q * self.Q).sum(axis=1)
        return self

    def documents(self, dids, dvecs):
        D = _matrix(dvecs)
        known = np.isfinite(D).all(axis=1)  # NaN/inf components never rank (Spark orders NaN first)
        if not known.all():
            dids, D = dids[known], D[known]
        yield dids, (D, (D * D).sum(axis=1))

    def tile(self, a: int, b: int):
        return self.Q[a:b], self.qsq[a:b], np.arange(a, b)

    def block(self, acc, tile, a, b, docs, dids, lo, hi, exclude_self):
        with np.errstate(all="ignore"):
            (self._cosine if self.metric == "cosine" else self._l2)(acc, *tile, a, b, docs[0][lo:hi], docs[1][lo:hi], dids, exclude_self)

    def _cosine(self, acc, Q, qsq, row, a, b, D, dsq, dids, exclude_self):
        qn, dn = np.sqrt(qsq), np.sqrt(dsq)
        unit = D * np.where(dn > 0, 1.0 / dn, np.nan)[:, None]  # a vector of zeros has no score
        if np.abs(Q).max(initial=0.0) < 1e30 and not (np.abs(Q).max(axis=1) < 1e-30).any():
            # rounded cells only select candidates: they are off by less than 2e-5 of the query's norm
            part, error = Q.astype(np.float32) @ unit.astype(np.float32).T, 2e-5 + 2e-7 * Q.shape[1]
        else:
            part, error = Q @ unit.T, 1e-6  # score x query norm
        least = acc.least[row]
        new = np.flatnonzero(~np.isfinite(least))
        if len(new):
            least[new] = self.first_kth(acc, row[new], part[new, :_first_columns(acc.k)] / qn[new, None], dids, exclude_self) - error
        least = np.maximum(least, acc.floor)
        limit = np.where(qn > 0, np.where(np.isfinite(qn) & np.isfinite(least), (least - 2e-6 - error) * qn, -np.inf), np.inf)
        at = np.flatnonzero(part >= limit.astype(part.dtype)[:, None])
        step = max(1, _CELLS // max(1, Q.shape[1]))
        for i in range(0, len(at), step):
            qi, di = at[i:i + step] // len(dids), at[i:i + step] % len(dids)
            self.take(acc, a, b, row[qi], dids[di], np.einsum("ij,ij->i", Q[qi], D[di]) / (qn[qi] * dn[di]), exclude_self)

    def _l2(self, acc, Q, qsq, row, a, b, D, dsq, dids, exclude_self):
        # the expanded square cancels for long vectors: it only selects candidates, within its error bound
        error = 1e-14 * (Q.shape[1] + 8)
        part = (-2.0 * Q) @ D.T
        part += (dsq * (1.0 - error))[None]  # at most the squared distance, less the query's share
        far = (1.0 - acc.least[row]) * math.sqrt(2.0)
        new = np.flatnonzero(~np.isfinite(far))
        if len(new):
            n = _first_columns(acc.k)
            most = part[new, :n] + (2.0 * error * dsq[:n])[None] + ((1.0 + error) * qsq[new])[:, None]
            far[new] = -self.first_kth(acc, row[new], -most, dids, exclude_self)
        far = np.minimum(far, (1.0 - acc.floor) * math.sqrt(2.0))
        at = np.flatnonzero(part <= (far + 4e-6 - qsq * (1.0 - error))[:, None])
        step = max(1, _CELLS // max(1, Q.shape[1]))
        for i in range(0, len(at), step):
            qi, di = at[i:i + step] // len(dids), at[i:i + step] % len(dids)
            exact = ((Q[qi] - D[di]) ** 2).sum(axis=1)
            self.take(acc, a, b, row[qi], dids[di], 1.0 - exact / math.sqrt(2.0), exclude_self)

    def score_visits(self, acc: _TopK, visited: np.ndarray, ids: list, vectors: list, exclude_self=False):
        """``visited`` (queries x lists) says which queries visit a list; ``ids`` and ``vectors`` have the lists' documents."""
        acc.start(self.qids)
        whole = next(iter(self.documents(np.concatenate(ids), np.concatenate(vectors))))
        lists = [next(iter(self.documents(i, v))) for i, v in zip(ids, vectors, strict=True)]
        rows = max(1, min(len(self.qids), TILE_ROWS, _CELLS))
        for a in range(0, len(self.qids), rows):
            b = min(len(self.qids), a + rows)
            Q, qsq, row = self.tile(a, b)
            if visited[a:b].all():
                todo = [(whole, slice(None))]
            else:
                todo = [(docs, np.flatnonzero(visited[a:b, j])) for j, docs in enumerate(lists) if visited[a:b, j].any()]
            for (dids, docs), at in todo:
                width = max(1, _CELLS // len(row[at]))
                for lo in range(0, len(dids), width):
                    hi = min(len(dids), lo + width)
                    self.block(acc, (Q[at], qsq[at], row[at]), a, b, docs, dids[lo:hi], lo, hi, exclude_self)


# --------------------------------------------------------------------------------
# plans
# --------------------------------------------------------------------------------
def with_byte_blocks(df: DataFrame, key: str, size, most: int, name: str, least_blocks: int = 1) -> tuple[DataFrame, int]:
    """``df`` with a block number ``name``, and the number of blocks: a block has at most ``most`` bytes (of ``size``).

    One light aggregate measures the bytes, rows go to ranges of the key's hash that hold half the bound on average, a
    second measures the ranges. A range over the bound is dealt by a second hash to as many blocks of its own as its bytes
    ask for; then a block exceeds the bound only where it holds a row that does, or many copies of one row."""
    spark = df.sparkSession
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(least_blocks, -(-2 * total // most), 1)
    ranged = df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)))
    over = ranged.groupBy(name).agg(F.sum(size).cast("long").alias("bytes")).where(F.col("bytes") > most).orderBy(name).collect()
    if not over:
        return ranged, n
    rows = []
    for r in over:  # ranges with very long rows, or with many rows of one key
        parts = -(-4 * r["bytes"] // most)
        rows.append((r[name], n, parts))
        n += parts
    split = spark.createDataFrame(rows, f"{name} long, _first long, _parts long")
    deal = F.col("_first") + F.pmod(F.xxhash64(F.lit(1), key, "payload"), F.col("_parts"))
    dealt = ranged.join(sized_broadcast(split, 100_000), name, "left").withColumn(name, F.coalesce(deal, F.col(name)))
    return dealt.drop("_first", "_parts"), n


def _blocked_topk(q: DataFrame, d: DataFrame, k: int, kernel, size_col, exclude_self: bool,
                  broadcast_bytes: int, corpus_blocks: int | None, block_bytes: int = BLOCK_BYTES, task_bytes: int = 0,
                  floor: float | None = None) -> DataFrame:
    """q: (qid, payload); d: (did, payload). Returns (query_id, doc_id, score, raw, rank); raw is the score before
    rounding, which thresholds are compared with. With a ``floor`` hits with a lower score (both to
    6 decimals) are not looked for."""
    spark = q.sparkSession
    q_type, d_type = id_type(q.schema["qid"].dataType), id_type(d.schema["did"].dataType)
    hit_schema = f"query_id {q_type}, doc_id {d_type}, score double, raw double"
    q_rows, q_bytes = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(size_col), F.lit(0))).first()
    if q_rows == 0:
        empty = spark.createDataFrame([], hit_schema + ", rank long")
        empty.query_rows = 0
        return empty

    if q_bytes <= broadcast_bytes:
        qt = q.select("qid", "payload").toArrow()  # proven bounded by broadcast_bytes
        bc = spark.sparkContext.broadcast((_col(qt, "qid"), qt.column("payload").combine_chunks()))

        def scan(batches):
            qids, payload = bc.value
            kern = kernel.prepare(qids, payload)
            acc = _TopK(k, q_type, d_type, floor)
            for b in batches:
                kern.score_into(acc, _col(b, "did"), b.column(b.schema.get_field_index("payload")), exclude_self)
            yield pa.RecordBatch.from_pandas(acc.frame(), preserve_index=False)

        partial = ensure_parallel(d.select("did", "payload")).mapInArrow(scan, hit_schema)
    else:
        # blocks of both sides are bounded by their measured bytes
        qb, bq = with_byte_blocks(q, "qid", size_col, max(broadcast_bytes, task_bytes), "qb")
        cores = spark.sparkContext.defaultParallelism
        db, bd = with_byte_blocks(d, "did", size_col, max(block_bytes, task_bytes), "db", corpus_blocks or -(-2 * cores // bq))
        qb = qb.select("qid", "payload", "qb").withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(bd - 1)).cast("array<long>")))
        db = db.select("did", "payload", "db").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)).cast("array<long>")))

        def block(qt: pa.Table, dt: pa.Table) -> pa.Table:
            acc = _TopK(k, q_type, d_type, floor)
            if qt.num_rows and dt.num_rows:
                kern = kernel.prepare(_col(qt, "qid"), qt.column("payload"))
                rows = max(1, dt.num_rows * block_bytes // max(1, dt.nbytes))  # a block of the corpus at a time
                for at in range(0, dt.num_rows, rows):
                    part = dt.slice(at, rows)
                    kern.score_into(acc, _col(part, "did"), part.column("payload"), exclude_self)
            return pa.Table.from_pandas(acc.frame(), preserve_index=False)

        partial = (qb.groupBy("qb", "db").cogroup(db.groupBy("qb", "db"))
                   .applyInArrow(block, hit_schema))

    order = (F.col("score").desc(), F.col("doc_id"))
    if d.rdd.getNumPartitions() > MERGE_BLOCKS:  # two levels, so a query's lists from very many blocks don't meet in one task
        partial = partial.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        first = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))
        partial = partial.withColumn("_r", first).where(F.col("_r") <= k).drop("_part", "_r")
    w = Window.partitionBy("query_id").orderBy(*order)
    out = partial.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    out.query_rows = q_rows  # known bound for callers: at most query_rows * k hits
    return out


def _public(hits: DataFrame, raw: bool) -> DataFrame:
    out = hits if raw else hits.drop("raw")
    out.query_rows = hits.query_rows
    return out


def _id(df: DataFrame, name: str):
    return F.col(name).cast(id_type(df.schema[name].dataType))


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "id",
                 query_text: str = "question", doc_id: str = "doc_id", doc_text: str = "question",
                 exclude_self: bool = False, broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                 corpus_blocks: int | None = None, embedder: str = "lexical", raw: bool = False,
                 block_bytes: int = BLOCK_BYTES, floor: float | None = None) -> DataFrame:
    """Best k corpus rows per query by cosine of the texts' feature counts (terms, or
    hash buckets with ``embedder="hashed"``; only rows sharing at least one feature are
    hits). Output: query_id, doc_id, score, rank, and with ``raw`` the unrounded score.
    ``floor``: hits with a lower score (both to 6 decimals) are not looked for."""
    def words(text: str):
        """The tokens as one text, which has no spaces otherwise: a fraction of the bytes that an array of them has as a row."""
        return F.nullif(F.array_join(EMBEDDERS[embedder](text), " "), F.lit(""))

    q = queries.select(_id(queries, query_id).alias("qid"), words(query_text).alias("payload"),
                       F.coalesce(F.octet_length(query_text), F.lit(0)).alias("_bytes"))
    d = corpus.select(_id(corpus, doc_id).alias("did"), F.col(doc_text).alias("_text"), F.coalesce(F.octet_length(doc_text), F.lit(0)).alias("_bytes"))
    # a corpus of very few splits is dealt out as texts, so that every core makes words
    d = ensure_parallel(d).select("did", words("_text").alias("payload"), "_bytes")
    # Upper bound of the size of a row's words without tokenizing: lower case grows UTF-8 by at most 1.5x, and a word
    # with the space after it takes the place of itself and a separator (hash buckets: three digits); plus the id.
    factor = 3 if embedder == "lexical" else 4
    size = F.floor(F.col("_bytes") * F.lit(factor) / F.lit(2)) + F.lit(16)
    return _public(_blocked_topk(q, d, k, LexicalKernel(), size, exclude_self, broadcast_bytes, corpus_blocks, block_bytes, TASK_BYTES, floor), raw)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "cosine",
               query_id: str = "id", query_vec: str = "embedding", doc_id: str = "doc_id",
               doc_vec: str = "embedding", exclude_self: bool = False,
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
               corpus_blocks: int | None = None, raw: bool = False, block_bytes: int = BLOCK_BYTES,
               floor: float | None = None) -> DataFrame:
    """Best k corpus vectors per query vector. Rows with a NULL vector are not
    searched. Output: query_id, doc_id, score, rank, and with ``raw`` the unrounded score.
    ``floor``: hits with a lower score (both to 6 decimals) are not looked for."""
    q = queries.where(F.col(query_vec).isNotNull()).select(
        _id(queries, query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("payload"))
    d = corpus.where(F.col(doc_vec).isNotNull()).select(
        _id(corpus, doc_id).alias("did"), F.col(doc_vec).cast("array<double>").alias("payload"))
    size = F.size("payload") * F.lit(8) + F.lit(16)
    return _public(_blocked_topk(q, d, k, DenseKernel(metric), size, exclude_self, broadcast_bytes, corpus_blocks, block_bytes, floor=floor), raw)
