"""Byte-level BPE encoding and decoding of whole texts, with the ids of a ``tokenizers`` JSON file.

A pre-token's merges run on a segment tree over the ranks of adjacent pairs: the root holds the
lowest rank, the walk down from it finds the leftmost pair of that rank, and a merge updates the
three leaves it touches in logarithmic time, until no pair can be merged. So a pre-token of n
bytes costs O(n log n), whatever it holds.

Texts are cut where the pre-tokenizer always cuts (before a space that follows another character,
around a line end, before the marks that end a word), and the ids of such pieces are
remembered in a bounded table of each Python worker. The vocabulary file is read on the driver and broadcast (1.5 MB, of fixed size).

Defined cases: a null text counts as the empty text and has no ids; the strings of the file's
special tokens become their ids, as in the library's default; rows may repeat; other columns pass
through ``encode`` only if named in ``keep``.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 30
#: Pieces that a worker remembers (some 200 bytes each); a full table is emptied.
REMEMBER = 700_000
#: White space beyond ASCII, in UTF-8.
WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
DOUBLE_SPACE = re.compile(rb"[\x09-\x0d\x20]{2}")
#: Where marks (but apostrophes) lie between an a-z letter and white space: the pre-tokenizer cuts before them.
LAST_MARK = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~]+(?:[\x09-\x0d\x20]|\Z))")
#: Fixed value: the pattern of byte-level pre-tokenizers, white space by its Unicode property.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes of Latin-1 for
    themselves, the others by the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Remembered(dict):
    """``make(key)`` by key; emptied when it holds ``limit`` keys."""

    def __init__(self, make, limit: int = REMEMBER):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def merge_all(ids: list[int], rank: dict[int, int], merged: list[int]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none has a rank. rank: by first id << 16 | second id;
    merged: the id that a rank's pair becomes."""
    n = len(ids)
    if n < 2:
        return ids
    get = rank.get
    leaves = 1 << (n - 2).bit_length()
    tree = [NONE] * leaves + [get(a << 16 | b, NONE) for a, b in pairwise(ids)] + [NONE] * (leaves - n + 1)
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    if tree[1] == NONE:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != NONE:
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] != best:
                i += 1
        p = i - leaves
        gone = after[p]
        q = after[p] = after[gone]
        ids[p], ids[gone] = new, _ = merged[best], -1
        # the pair that begins at p is another now, the one at gone is none, and so is the one before p
        at = leaves + p
        if q < n:
            before[q] = p
            tree[at] = get(new << 16 | ids[q], NONE)
            tree[leaves + gone] = NONE
            touched = [at, leaves + gone]
        else:
            tree[at] = NONE
            touched = [at]
        if (o := before[p]) >= 0:
            tree[leaves + o] = get(ids[o] << 16 | new, NONE)
            touched.append(leaves + o)
        for i in touched:
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                if b < a:
                    a = b
                if tree[i] == a:
                    break
                tree[i] = a
    return [i for i in ids if i >= 0]


class ByteBpe:
    """Encoder and decoder of one vocabulary (the text of its JSON file)."""

    def __init__(self, source: str):
        j = json.loads(source)
        vocab, letters = j["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        self.rank = {vocab[a] << 16 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.first = [vocab[c] for c in letters]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for word, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.pieces = Remembered(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        first, ids = self.first, []
        for word in PRE_TOKEN.findall(piece.decode()):
            ids += merge_all([first[b] for b in word.encode()], self.rank, self.merged)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        b = text.encode()
        if DOUBLE_SPACE.search(b) or WIDE_SPACE.search(b) or b"\0" in b:
            return self._piece(b)
        # no white space meets other white space: each space begins a pre-token and each line end is one
        b = LAST_MARK.sub(b"\0", b).replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")
        return b"".join(map(self.pieces.__getitem__, b.split(b"\0")))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<" not in text or not self.cut.search(text):
            return self._plain(text)
        return b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special else self._plain(p)
                        for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_MADE: dict[str, ByteBpe] = {}


def _of(source) -> ByteBpe:
    """The worker's encoder; kept from task to task with what it remembers."""
    if source.value not in _MADE:
        _MADE.clear()
        _MADE[source.value] = ByteBpe(source.value)
    return _MADE[source.value]


def slices(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sizes add up to about ``limit``."""
    held: list[tuple] = []
    total = 0
    for r in rows:
        held.append(r)
        total += size(r) + 64
        if total >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) of every row."""
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches):
        bpe = _of(source)
        for b in batches:
            rows = ((k, bpe.encode(t.as_py())) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            yield from slices(rows, [key, "ids"], [b.schema.field(0).type, pa.binary()], lambda r: len(r[1]))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key, ids, decoded of every row of ``key, ids``."""
    source = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches):
        bpe = _of(source)
        for b in batches:
            rows = ((k, i := ids.as_py(), bpe.decode(i)) for k, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            yield from slices(rows, [key, "ids", "decoded"], [b.schema.field(0).type, pa.binary(), pa.string()],
                              lambda r: len(r[1]) + len(r[2]))

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def roundtrip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    done = decode(encode(docs, vocabulary), vocabulary)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
