"""Removal of repeated passages: every byte that lies in a string of ``MATCH`` bytes which also
starts earlier (in a document with a smaller id, or earlier in the same document).

Texts are compared by suffixes at anchors. The anchor of a 100-byte string is the place of its
smallest 32-byte hash (a minimizer), so equal strings have it at the same offset. An anchor whose
32 bytes occur nowhere else can't lie in a repeated string; those are dropped after one shuffle of
hashes. The suffixes of the others are sorted: each task sorts its suffixes by what follows the
anchor and writes front-coded runs (length of the prefix shared with the suffix before, and the
rest), the runs are exchanged by the hash of their 32 bytes, and a loser tree merges them; its
players carry the length of the prefix they share with the last winner, so that no known prefix is
compared again. From the merged order's common prefixes, and the bytes before the anchors, follow
the strings that are equal, and of these the earliest stays.

Texts that are equal as a whole are one text: only the smallest id's goes through the sort, the
copies are removed entirely. Of suffixes with equal surroundings in one task, only the earliest is
exchanged. Where a bucket still has over 2 x ``BUCKET`` suffixes (a passage's edges, or a line
shorter than a string, with other surroundings in every document), its suffixes are dealt anew: the
strings around an anchor are split by its offset in them into ranges of ``NARROWER`` offsets, and a
range goes by the hash of the bytes that all its strings share. Bytes outside its strings don't
count, so suffixes with equal strings collapse in the task. With one offset the key is the whole
string, of which a run has one suffix: no key has more suffixes than there are runs.

Defined cases: a null text counts as empty; texts under 100 bytes lose nothing; a document that is
left empty has the digest of the empty string; a null id comes after all ids; rows that repeat an
id and a text are one document, different texts under one id come in the order of their digests; an
empty table gives no rows; other columns are not looked at (the stage keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Bytes of a repeated string, and of the hashed strings that anchors are chosen by.
MATCH, K = 100, 32
SHIFTS = MATCH - K + 1  # where in a string its anchor may be
LEFT = SHIFTS - 1  # bytes before an anchor that a string around it may have
WIDTH = LEFT + MATCH
#: Long texts are taken in pieces of this many bytes when anchors are chosen; suffixes of a run; suffixes of a bucket, on average.
PIECE, RUN, BUCKET = 1 << 20, 100_000, 50_000
NARROWER = (18, 6, 1)  # each divides the one before
_POSITION = 22
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
LAST = (1 << 63) - 1


def _hash(h: np.ndarray, axis: int = 0) -> np.ndarray:
    """64-bit hashes of the K bytes from each place on, by doubling."""
    h, m = h.astype(np.uint64) + np.uint64(1), 1
    for odd in _ODD:
        n = h.shape[axis] - m
        a, b = (h[:n], h[m:]) if axis == 0 else (h[:, :n], h[:, m:])
        h = a * np.uint64(odd) + b
        h ^= h >> np.uint64(29)
        m *= 2
    return h * np.uint64(_ODD[0])


def anchors(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece number, place in the piece, hash) of the anchors of all MATCH-byte strings of the pieces."""
    empty = np.zeros(0, np.int64)
    lengths = np.array([len(b) for _, b in pieces], np.int64)
    if not len(lengths) or lengths.max() < MATCH:
        return empty, empty, empty
    ends = np.cumsum(lengths)
    buf = np.frombuffer(b"".join(b for _, b in pieces), np.uint8)
    hashes = _hash(buf)
    low = (hashes & ~np.uint64((1 << _POSITION) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    m, span = low, 1
    while 2 * span <= SHIFTS:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < SHIFTS:
        m = np.minimum(m[:len(m) - (SHIFTS - span)], m[SHIFTS - span:])
    start = np.arange(len(m))
    owner = np.searchsorted(ends, start, side="right")
    inside = start + MATCH <= ends[owner]
    at = np.unique((m[inside] & np.uint64((1 << _POSITION) - 1)).astype(np.int64))
    owner = np.searchsorted(ends, at, side="right")
    return owner, at - (ends - lengths)[owner], hashes[at].view(np.int64)


def cut(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text such that every MATCH-byte string lies in one."""
    for start in range(0, max(1, len(text) - MATCH + 1), PIECE):
        yield start, text[start:start + PIECE + MATCH - 1]


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(hash, known, text key, place) of the anchors of all texts. Where a task sees a hash at several places, these are
    known to be repeated: they get a key of their own instead of the hash, so that they're dealt evenly, and one of
    them stands for them under the hash."""

    def settle(h, key, place) -> pa.RecordBatch:
        by = np.lexsort((place, key, h))
        h, key, place = h[by], key[by], place[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])])  # copies of a text
        h, key, place = h[new], key[new], place[new]
        same = h[1:] == h[:-1]
        known = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        own = (h ^ (key * 2654435761) ^ (place * 40503 << 20)) * -7046029254386353131
        rows = [np.concatenate([x[first], y[known]]) for x, y in ((h, own), (np.zeros(len(h), bool), known), (key, key), (place, place))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["hash", "known", "text_key", "place"])

    def run(batches):
        for b in batches:
            found, held, keys, starts, size = [], [], [], [], 0

            def done():
                owner, place, h = anchors(held)
                if len(owner):
                    found.append((h, np.array(keys, np.int64)[owner], place + np.array(starts, np.int64)[owner]))

            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for start, part in cut(t.as_py()):
                    if held and size + len(part) > PIECE + MATCH:
                        done()
                        held.clear(), keys.clear(), starts.clear()
                        size = 0
                    held.append((start, part))
                    keys.append(key)
                    starts.append(start)
                    size += len(part)
            done()
            if found:
                yield settle(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return texts.select("text_key", "t").mapInArrow(run, "hash long, known boolean, text_key long, place long")


def repeated(rows: DataFrame) -> DataFrame:
    """(text_key, place) of the anchors whose hash is also elsewhere."""

    def run(batches):
        held = None  # the last row, and whether it has been given out
        for b in batches:
            if not b.num_rows:
                continue
            h, known, key, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if held is not None:
                h, known, key, place = (np.concatenate([[x], y]) for x, y in zip(held[0], (h, known, key, place), strict=True))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (known[1:] != known[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
            h, known, key, place = h[new], known[new], key[new], place[new]
            same = (h[1:] == h[:-1]) & ~known[1:] & ~known[:-1]
            good = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | known
            before = held is not None and held[1]
            after = bool(good[-1]) or (len(h) == 1 and before)
            if before:
                good[0] = False
            held = ((h[-1], known[-1], key[-1], place[-1]), after)
            yield pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(place[good])], ["text_key", "place"])

    return rows.repartition("hash").sortWithinPartitions("hash", "known", "text_key", "place").mapInArrow(run, "text_key long, place long")


def surroundings(text: bytes, places: np.ndarray) -> np.ndarray:
    """WIDTH bytes around each place, LEFT of them before it, zeros beyond the text."""
    buf = np.zeros(len(text) + WIDTH, np.uint8)
    buf[LEFT:LEFT + len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, WIDTH)[places]


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted suffixes (rows): the length of the prefix shared with the row before, and the rests."""
    same = np.zeros(len(suffixes), np.uint8)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        same[1:] = np.where(differ.any(1), differ.argmax(1), suffixes.shape[1])
    rest = np.arange(suffixes.shape[1])[None, :] >= same[:, None]
    return same, suffixes[rest].tobytes()


#: Columns of a run after the front-coded suffixes.
_RUN = (("order", "<i8"), ("text_key", "<i8"), ("place", "<i8"), ("low", "u1"), ("high", "u1"))


def pack_run(around: np.ndarray, info: dict[str, np.ndarray]) -> bytes:
    same, rest = front_code(around[:, LEFT:])
    parts = [np.int64(len(around)).tobytes(), same.tobytes(), around[:, :LEFT].tobytes(), *(info[c].astype(t).tobytes() for c, t in _RUN), rest]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_run(blob: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, dict[str, np.ndarray]]:
    """Shared prefix lengths, suffixes, bytes before the anchors, the other columns."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    same = np.frombuffer(raw, np.uint8, n, 8)
    left = np.frombuffer(raw, np.uint8, n * LEFT, 8 + n).reshape(n, LEFT)
    at, info = 8 + n + n * LEFT, {}
    for c, t in _RUN:
        info[c] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    suffixes, last = [], b""
    for k in same.tolist():
        last = last[:k] + raw[at:at + MATCH - k]
        at += MATCH - k
        suffixes.append(last)
    return same, suffixes, left, info


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of MATCH bytes of which ``known`` bytes are known to be equal."""
    low, high = known, MATCH
    if a[low:] == b[low:]:
        return high
    while high - low > 1:  # a and b agree before low and not before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs (shared prefix lengths, suffixes) by a loser tree: run and index of each suffix in
    order, and the prefix it shares with the one before."""
    n = len(runs)
    leaves = 1 << max(0, n - 1).bit_length()
    at = [0] * leaves
    head: list[bytes | None] = [runs[r][1][0] if r < n and runs[r][1] else None for r in range(leaves)]
    same = [0] * leaves  # with the last winner
    loser = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's ``same`` becomes its prefix with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = same[a], same[b]
        if p != q:  # who shares more with the last winner is smaller, and the other shares no more with it
            return (a, b) if p > q else (b, a)
        k = shared_prefix(x, y, p)
        won = (a, b) if k == MATCH and a < b or k < MATCH and x[k] < y[k] else (b, a)
        same[won[1]] = k
        return won

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    top = build(1)
    out_run, out_index, out_same = [], [], []
    while head[top] is not None:
        i = at[top]
        out_run.append(top)
        out_index.append(i)
        out_same.append(same[top])
        lengths, suffixes = runs[top]
        i += 1
        at[top] = i
        if i < len(suffixes):
            head[top], same[top] = suffixes[i], lengths[i]
        else:
            head[top] = None
        node = (top + leaves) >> 1
        while node:
            other = loser[node]
            # the quick cases of play()
            if head[other] is not None and (head[top] is None or same[other] >= same[top]):
                if head[top] is None or same[other] > same[top]:
                    loser[node], top = top, other
                else:
                    top, loser[node] = play(top, other)
            node >>= 1
    return out_run, out_index, out_same


def repeats(same: np.ndarray, left: np.ndarray, info: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes in sorted order: the index, first and last byte after of what each anchor's repeated strings
    cover. same: prefix shared with the suffix before; low and high: the offsets at which a string around the
    anchor lies within its text."""
    near = same >= K
    near = near | np.concatenate([near[1:], [False]])
    rows = np.flatnonzero(near)
    if not len(rows):
        return rows, rows, rows
    rank = np.lexsort((info["place"][rows], info["text_key"][rows], info["order"][rows]))
    rows = rows[rank]  # earliest first
    bytes_left, low, high = left[rows], info["low"][rows], info["high"][rows]
    first, last = np.full(len(rows), 255), np.full(len(rows), -1)
    before = np.zeros(len(rows), np.uint64)
    for shift in range(SHIFTS):
        if shift:
            before = before * np.uint64(_ODD[1]) + bytes_left[:, LEFT - shift] + np.uint64(1)
            before ^= before >> np.uint64(31)
        group = np.cumsum(same < MATCH - shift)[rows].astype(np.uint64)  # equal from the anchor on
        valid = np.flatnonzero((low <= shift) & (shift <= high))
        if len(valid) < 2:
            continue
        key = group[valid] * np.uint64(_ODD[0]) ^ before[valid] * np.uint64(_ODD[2])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        again = valid[order[1:][sorted_key[1:] == sorted_key[:-1]]]
        first[again] = np.minimum(first[again], shift)
        last[again] = shift
    hit = last >= 0
    place = info["place"][rows[hit]]
    return rows[hit], place - last[hit], place - first[hit] + MATCH


_RUNS = "bucket int, n int, run binary, text_key long, `order` long, first long, after long"


def _batch(bucket=None, n=None, run=None, text_key=None, order=None, first=None, after=None) -> pa.RecordBatch:
    rows = len(run if run is not None else text_key)
    cols = [(bucket, pa.int32()), (n, pa.int32()), (run, pa.binary()), (text_key, pa.int64()), (order, pa.int64()),
            (first, pa.int64()), (after, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else pa.array(c, t) for c, t in cols],
                                      ["bucket", "n", "run", "text_key", "order", "first", "after"])


def _flush(held: list, buckets: int, base: int = 0, width: int = SHIFTS) -> Iterator[pa.RecordBatch]:
    """Runs and repeats of (surroundings, columns) pairs, for each range of ``width`` offsets; buckets count from ``base``."""
    all_around = np.concatenate([h[0] for h in held])
    all_info = {c: np.concatenate([h[1][c] for h in held]) for c, _ in _RUN}
    for a in range(0, SHIFTS, width):
        z = min(a + width, SHIFTS) - 1  # strings that have the anchor at offsets a to z
        around, info = all_around, all_info
        if width < SHIFTS:
            there = (info["low"] <= z) & (info["high"] >= a)
            if not there.any():
                continue
            around, info = around[there], {c: x[there] for c, x in info.items()}
            around[:, :LEFT - z] = 0
            around[:, WIDTH - a:] = 0
            info["low"], info["high"] = np.maximum(info["low"], a), np.minimum(info["high"], z)
        by = np.lexsort((info["place"], info["text_key"], info["order"]))
        by = by[np.argsort(around[by].view(f"S{WIDTH}").ravel(), kind="stable")]
        around, info = around[by], {c: x[by] for c, x in info.items()}
        # equal surroundings: a later one is repeated as far as they and its own text reach
        equal = np.concatenate([[False], (around[1:] == around[:-1]).all(1) & (info["low"][1:] == info["low"][:-1]) & (info["high"][1:] == info["high"][:-1])])
        gone = {c: x[equal] for c, x in info.items()}
        if equal.any():
            yield _batch(text_key=gone["text_key"], order=gone["order"], first=gone["place"] - gone["high"], after=gone["place"] - gone["low"] + MATCH)
        around, info = around[~equal], {c: x[~equal] for c, x in info.items()}
        if width < SHIFTS:
            key = np.zeros(len(around), np.uint64)
            for column in around[:, LEFT - a:LEFT + MATCH - z].T:  # what all the strings share
                key = (key + column + np.uint64(1)) * np.uint64(_ODD[0])
                key ^= key >> np.uint64(29)
        else:
            key = _hash(around[:, LEFT:LEFT + K], 1)[:, 0]
        bucket = (key >> np.uint64(11)) % np.uint64(buckets)
        by = np.lexsort((np.argsort(np.argsort(np.ascontiguousarray(around[:, LEFT:]).view(f"S{MATCH}").ravel(), kind="stable")), bucket))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by].astype(np.int64)) != 0]))
        for x, y in zip(starts, [*starts[1:], len(by)], strict=True):
            rows = by[x:y]
            yield _batch(bucket=[base + int(bucket[rows[0]])], n=[len(rows)], run=[pack_run(around[rows], {c: v[rows] for c, v in info.items()})])


def sorted_runs(candidates: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, run) rows of n suffixes, and (text_key, order, first, after) rows of repeats that a task has found by
    itself, of (text_key, order, t, places)."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for key, order, t, places in zip(*b.columns, strict=True):
                text, places = t.as_py(), np.unique(places.values.to_numpy())
                n = len(text)
                places = places[places + K <= n]  # of another text, were its key the same
                for at in range(0, len(places), RUN):
                    p = places[at:at + RUN]
                    # a string at place - shift must lie within the text
                    held.append((surroundings(text, p), {
                        "order": np.full(len(p), order.as_py()), "text_key": np.full(len(p), key.as_py()), "place": p,
                        "low": np.clip(p + MATCH - n, 0, 255), "high": np.minimum(p, LEFT)}))
                    size += len(p)
                    if size >= RUN:
                        yield from _flush(held, buckets)
                        held, size = [], 0
        if held:
            yield from _flush(held, buckets)

    return candidates.select("text_key", "order", "t", "places").mapInArrow(run, _RUNS)


def narrowed(runs: DataFrame, buckets: int, base: int, width: int) -> DataFrame:
    """The suffixes of ``runs`` (run) in runs by ranges of ``width`` offsets."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                _, suffixes, left, info = unpack_run(x.as_py())
                right = np.frombuffer(b"".join(suffixes), np.uint8).reshape(-1, MATCH)
                held.append((np.concatenate([left, right], 1), info))
                size += len(suffixes)
                if size >= RUN:
                    yield from _flush(held, buckets, base, width)
                    held, size = [], 0
        if held:
            yield from _flush(held, buckets, base, width)

    return runs.select("run").mapInArrow(run, _RUNS)


def split_buckets(runs: DataFrame, buckets: int) -> DataFrame:
    """``runs`` with the buckets of over 2 x BUCKET suffixes dealt anew, until there are none or a key is a whole string."""
    least, base, done = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0, []
    for width in NARROWER:
        large = stored(runs.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * BUCKET), "large-buckets", rows=1)
        n = large.agg(F.sum("n")).first()[0]
        if not n:
            break
        large = F.broadcast(large.select("bucket"))  # at most one for each 2 x BUCKET suffixes
        done.append(runs.join(large, "bucket", "left_anti"))
        base, buckets = base + buckets, max(least, 4 * n // BUCKET)  # a suffix may go to several ranges
        runs = stored(narrowed(runs.join(large, "bucket", "left_semi"), buckets, base, width), f"runs-{width}")
    for part in done:
        runs = runs.union(part.select(runs.columns))
    return runs


def merged_repeats(runs: DataFrame) -> DataFrame:
    """(text_key, order, first, after) of the repeats among the runs of each bucket."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack_run(x.as_py()) for x in table.column("run")]
        which, index, same = merge_runs([(p[0].tolist(), p[1]) for p in parts])
        starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        at = starts[np.array(which)] + np.array(index)
        info = {c: np.concatenate([p[3][c] for p in parts])[at] for c, _ in _RUN}
        rows, first, after = repeats(np.array(same), np.concatenate([p[2] for p in parts])[at], info)
        return pa.table({"text_key": info["text_key"][rows], "order": info["order"][rows], "first": first, "after": after})

    return runs.groupBy("bucket").applyInArrow(merge, "text_key long, `order` long, first long, after long")


def spans(firsts: np.ndarray, afters: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts.tolist(), afters.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _llm_sha, _llm_key (60 bits of it) and _llm_order (the id, nulls last)."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.withColumn("_llm_sha", sha).withColumn("_llm_key", F.conv(F.substring("_llm_sha", 1, 15), 16, 10).cast("long")) \
        .withColumn("_llm_order", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))


def removals(docs: DataFrame, texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables. Rows: doc_id, order, sha, n_bytes of every row of ``docs``. Firsts: sha, text_key, first_order (the
    row whose text is looked at) of every different text. Changed: text_key, order, n_removed, n_spans, kept_sha256 and,
    with ``texts``, kept (without bytes of a character that is cut apart) of the texts that lose a part."""
    with scratch(docs.sparkSession) as keep:
        return _removals(docs, texts, keep)


def _removals(docs: DataFrame, texts: bool, keep_table) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.col("_llm_sha").alias("sha"),
        F.col("_llm_key").alias("text_key"), F.col("_llm_order").alias("order"))
    rows = keep_table(keyed.select("doc_id", "order", "sha", "text_key", F.octet_length("t").cast("long").alias("n_bytes")), "texts")
    firsts = keep_table(rows.groupBy("sha", "text_key").agg(F.min("order").alias("first_order")), "first-texts")
    found = repeated(anchor_rows(keyed.filter(F.octet_length("t") >= MATCH)))
    wanted = stored(found.groupBy("text_key").agg(F.collect_set("place").alias("places"))
                    .join(firsts.select("text_key", F.col("first_order").alias("order")), "text_key"), "anchor-places", free=True)
    # one row of those that repeat an id and a text, or each would be a repeat of the other; only candidates are looked at
    candidates = stored(keyed.select("order", "text_key", "t").join(wanted, ["text_key", "order"]).dropDuplicates(["text_key", "order"]), "candidates", free=True)
    n = wanted.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET)
    runs = split_buckets(stored(sorted_runs(candidates, buckets), "runs", free=True), buckets)
    covered = merged_repeats(runs.filter("run is not null").select("bucket", "run")) \
        .union(runs.filter("run is null").select("text_key", "order", "first", "after"))
    by_text = stored(covered.groupBy("text_key", "order").agg(F.collect_list(F.struct("first", "after")).alias("covered")), "covered", free=True)

    def keep(batches):
        for b in batches:
            out = []
            for key, order, t, c in zip(*b.columns, strict=True):
                text, c = t.as_py(), c.values
                s = spans(c.field("first").to_numpy(), c.field("after").to_numpy())
                kept = b"".join(text[a:z] for a, z in zip([0, *(e for _, e in s)], [*(f for f, _ in s), len(text)], strict=True))
                out.append((key.as_py(), order.as_py(), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(),
                            kept.decode(errors="ignore") if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out, strict=True), [*[pa.int64()] * 4, pa.string(), pa.string()], strict=True)],
                ["text_key", "order", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = candidates.join(by_text, ["text_key", "order"]).select("text_key", "order", "t", "covered") \
        .mapInArrow(keep, "text_key long, `order` long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return rows, firsts, keep_table(changed, "changed")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    rows, firsts, changed = removals(docs)
    of_text = stored(firsts.join(changed.drop("kept").withColumnRenamed("order", "first_order"), ["text_key", "first_order"], "left"), "first-changes")
    copy = (F.col("order") != F.col("first_order")) & (F.col("n_bytes") >= MATCH)
    return rows.join(of_text.drop("text_key"), "sha").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def suffix_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (and ``n_chars``, where there, counted anew in texts that
    changed). Rows that have lost their last word go; columns are unchanged."""
    _, firsts, changed = removals(docs, texts=True)
    info = stored(firsts.join(changed.select("text_key", F.col("order").alias("first_order"), "kept"), ["text_key", "first_order"], "left")
                  .select(F.col("sha").alias("_llm_sha"), F.col("first_order").alias("_llm_first"), F.col("kept").alias("_llm_kept")), "kept-texts")
    d = _keyed(docs).join(info, "_llm_sha")
    copy = (F.col("_llm_order") != F.col("_llm_first")) & (F.octet_length("text") >= MATCH)
    d = d.filter(~F.coalesce(copy, F.lit(False)) & (F.col("_llm_kept").isNull() | F.col("_llm_kept").rlike(r"[^\x20\x09-\x0D]")))
    out = {"text": F.coalesce("_llm_kept", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_llm_kept").isNotNull(), F.length("_llm_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
           SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
             SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM again)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS f, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS t FROM runs
         UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN sums.doc_id IS NULL THEN d.h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
