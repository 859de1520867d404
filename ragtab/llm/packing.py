"""Hierarchical packing of token sequences into context windows of several sizes.

Each task tokenizes its documents and packs them in blocks of bounded size, so nothing is
shuffled and no document's ids are made twice. Within a block every piece belongs to the tier of
the smallest context size that holds it. Windows are opened from the longest tier down, each by
the longest piece left; its gap is filled with the longest shorter-tier pieces that fit, and the
last bit of it with the head of a piece that is cut. A window is full when it is given out, so a
sequence's length is its tier, a power of two, and needs no padding. A window that a block can't
fill goes on into the next block; what is left at a task's end is cut into powers of two.

Windows are dealt to step groups (``step_tokens`` each) in falling order of size; as all sizes
are powers of two, a group is filled exactly, so training steps hold equal numbers of tokens.

Defined cases: a null text counts as the empty text, whose only id is the end id; longer documents
than the longest tier are cut into whole windows first; repeated rows are documents of their own;
an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import LAST_MARK, REMEMBER, slices
from .common import LOWER

TIERS = (256, 512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
#: A block ends at this many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 4096
END_ID = 2

PIECES = ("start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, "
          "step_group long, ids binary")


class WordEncoder:
    """Ids by a ``tokenizers`` file whose pre-tokenizer drops white space. Texts are cut at ASCII white space,
    which never lies within a pre-token; the library encodes each piece once while it is remembered."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        b = text.encode()
        if b"<|" not in b:  # else a special token might be written there, which is not lower-cased
            b = LAST_MARK.sub(b" ", b.translate(LOWER))
        words, known = b.split(), self.pieces
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > REMEMBER:
                known.clear()
                new = list(set(words))
            for w, e in zip(new, self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                ids = e.ids
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, words))


_MADE: dict[str, WordEncoder] = {}


def _of(source: str) -> WordEncoder:
    if source not in _MADE:
        _MADE.clear()
        _MADE[source] = WordEncoder(source)
    return _MADE[source]


class Packer:
    """Packs the documents of a task. A piece is (length, number, document, start)."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step, self.pool, self.docs = sorted(tiers), step_tokens, [], {}
        self.n_docs = self.n_pieces = self.n_windows = self.n_groups = self.held = 0
        self.open: list[list[int]] = []  # step groups with room: [room, number]

    def add(self, key, ids: bytes) -> None:
        d, n, top = self.n_docs, len(ids) // 4, self.tiers[-1]
        self.n_docs += 1
        self.held += n
        self.docs[d] = [key, ids, n]
        for start in range(0, n, top):
            self._put(min(top, n - start), d, start)

    def _put(self, length: int, doc: int, start: int) -> None:
        self.n_pieces += 1
        insort(self.pool, (length, self.n_pieces, doc, start))

    def _windows(self) -> Iterator[tuple[int, list]]:
        """Full windows; pieces of a window that can't be filled go back to the pool."""
        pool, rest = self.pool, []
        while pool:
            first = pool.pop()
            size = next(t for t in self.tiers if t >= first[0])
            window, gap = [first], size - first[0]
            while gap and pool:
                k = bisect_right(pool, (gap, 1 << 62)) - 1
                if k >= 0:
                    piece = pool.pop(k)
                else:  # all are longer: cut the shortest
                    length, number, doc, start = pool.pop(0)
                    piece = (gap, number, doc, start)
                    self._put(length - gap, doc, start + gap)
                window.append(piece)
                gap -= piece[0]
            if gap:
                rest += window
            else:
                yield size, window
        for length, _, doc, start in rest:
            self._put(length, doc, start)

    def _tail(self) -> Iterator[tuple[int, list]]:
        """What is left, cut into powers of two, the largest first."""
        left, total = self.pool[::-1], sum(p[0] for p in self.pool)
        self.pool = []
        while total:
            size = min(1 << total.bit_length() - 1, self.tiers[-1])
            window, gap = [], size
            while gap:
                length, number, doc, start = left.pop(0)
                if length > gap:
                    left.insert(0, (length - gap, number, doc, start + gap))
                    length = gap
                window.append((length, number, doc, start))
                gap -= length
            total -= size
            yield size, window

    def _group(self, size: int) -> int:
        for g in self.open:
            if g[0] >= size:
                g[0] -= size
                self.open = [g for g in self.open if g[0]]
                return g[1]
        self.n_groups += 1
        if self.step > size:
            self.open.append([self.step - size, self.n_groups - 1])
        return self.n_groups - 1

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Rows of the windows that are full; with ``last`` of everything."""
        done = list(self._windows())
        if last:
            done += self._tail()
        for size, window in sorted(done, key=lambda w: -w[0]):
            group, offset = self._group(size), 0
            for length, _, doc, start in window:
                key, ids, n = self.docs[doc]
                yield key, start, length, n, self.n_windows, offset, size, group, ids[4 * start:4 * (start + length)]
                offset += length
            self.n_windows += 1
        still = {p[2] for p in self.pool}
        self.docs = {d: x for d, x in self.docs.items() if d in still}
        self.held = sum(p[0] for p in self.pool)


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, step_group, ids
    (binary: little-endian unsigned 32-bit integers)."""
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    end = np.uint32(end_id).astype("<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", *(c.split()[0] for c in PIECES.split(", "))]
    types = [to_arrow_type(id_type), *[pa.int64()] * 7, pa.binary()]

    def run(batches):
        enc, packer, top = _of(source.value), Packer(tiers, step_tokens), TaskContext.get().partitionId() << 40

        def rows():
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    packer.add(k, enc.encode(t.as_py()) + end)
                    if packer.held >= BLOCK_IDS or len(packer.docs) >= BLOCK_DOCS:
                        yield from packer.flush()
            yield from packer.flush(last=True)

        numbered = ((*r[:4], top + r[4], *r[5:7], top + r[7], r[8]) for r in rows())
        yield from slices(numbered, names, types, lambda r: len(r[8]))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")) \
        .mapInArrow(run, f"doc_id {id_type.simpleString()}, {PIECES}")


def packed_pieces(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, vocabulary, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length", "step_group")
