"""Exact similarity join of shingle sets (Jaccard at least 0.8) by token-combination prefixes.

A set's shingles have one global order: rare ones by hash, then frequent ones by level (how frequent)
and hash. Two linked sets differ by at most n // 5 shingles of either (n its size), so they agree within
prefixes that cover n // 5 + 1 shingles. A rare shingle covers one and is a key of the index by itself.
The frequent ones are dealt by hash into classes whose number follows the set's size class; there,
combinations of k shingles are the keys, where k is the level of the rarest of them (2, 3 or 4: the more
frequent, the longer). Shingles of a class that two sets share without sharing a combination are at most
one fewer than the class's highest level, so a class with c shingles covers that many fewer than c, and
the prefix is extended until it covers enough. If two linked sets shared no key, they'd miss more shingles
than they may. Any choice of "frequent" gives whole results; it is made from counts over all texts, of
which the largest ``MAX_FREQUENT`` are broadcast.

Sets that are equal are one node (with an id of its own, no document's), so copies cost nothing. Candidates
of a key are first compared to one member of it, twice; links are joined into components. What is left are
keys whose members lie in several components: documents just short of the similarity to a large group, say.
Keys of a few members have those of different components compared as pairs. A larger key's members outside
its largest component are compared with that whole component, and with each other, in blocks of bounded
bytes in tasks, by signatures: a few bits a shingle that bound from below how much two sets differ. Each gets
the few most alike ones verified as pairs by whole texts. One that is not linked by them though signatures
leave more has all of those verified in tasks, where only links come out, and none between components that
are linked already. So no group is expanded into pairs, and no candidate is left out.

Defined cases: a null or empty text has an empty set and is linked with nothing; with one to four words the
word sequence is the only shingle; rows with equal sets get the smallest of their ids, a null id never (a
document without an id carries links like others; components without any id have a null component_id);
repeated rows are given each; texts are taken whole, of any length; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, keep_documents, release, scratch, stored, text_key, work_folder
from .components import components

#: Words of a shingle; similarity of a link in per cent.
WORDS, PERCENT = 5, 80
#: A shingle in this many documents is frequent, if it is among the MAX_FREQUENT most frequent (2 MB).
FREQUENT, MAX_FREQUENT = 32, 1 << 18
#: Shingles that are counted at a time in a task.
BLOCK = 2 << 20
#: Counts from which a frequent shingle's combinations have three and four shingles.
LEVELS = (1 << 10, 1 << 15)
#: A key with this many members at most has those of different components compared as pairs.
SMALL_KEY = 16
#: Of a node of a larger key: candidates of a component that are verified before all are, the most alike ones.
TRIED = 8
#: Bytes of one side that a task compares at a time.
SIDE_BYTES = 8 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ np.uint64(salt)) * _ODD[0]
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text in UTF-8."""
    ws = (text or b"").translate(LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        total += h[k:k + n] * _ODD[k + 1]
    return np.unique(mixed(total))


def size_classes(limit: int = 1 << 40) -> list[int]:
    """Smallest sizes of the size classes: linked sets are in the same class or in neighbouring ones."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 5 // 4 + 1)
    return out


CLASSES = np.array(size_classes())


def prefix_length(part: np.ndarray, level: np.ndarray, need: int) -> int:
    """How many of the frequent shingles (classes ``part``, levels rising) cover ``need``: a class's number of shingles less
    one fewer than its highest level, at least none."""
    size: dict[int, int] = {}
    covered: dict[int, int] = {}
    total = 0
    for k, (p, lev) in enumerate(zip(part.tolist(), level.tolist(), strict=True), 1):
        size[p] = size.get(p, 0) + 1
        now = max(0, size[p] - lev + 1)
        total += now - covered.get(p, 0)
        covered[p] = now
        if total >= need:
            return k
    return len(part)


def keys_of(s: np.ndarray, frequent: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The index keys of a set (sorted hashes): single shingles and combinations of frequent ones."""
    n = len(s)
    if n <= 3:  # linked with equal sets only
        return np.zeros(0, np.uint64)
    need = n * (100 - PERCENT) // 100 + 1
    level = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        level = np.where(frequent[at] == s, levels[at], 0)
    rare = s[level == 0]
    if len(rare) >= need:
        return mixed(rare[:need], 1)
    order = np.argsort(level, kind="stable")[len(rare):]
    rest, level = s[order], level[order]
    out = [mixed(rare, 1)]
    own = int(np.searchsorted(CLASSES, n, side="right")) - 1
    for size_class in (own, own + 1):
        n_classes = max(1, int(CLASSES[size_class - 1]) * 13 // 100)
        part = (rest * _ODD[2] >> np.uint64(32)) % np.uint64(n_classes)
        take = prefix_length(part, level, need - len(rare))
        members: dict[int, list[int]] = {}
        for k, p in enumerate(part[:take].tolist()):
            members.setdefault(p, []).append(k)
        for at_class in members.values():  # in order of level: a combination's first shingle is its rarest
            for k in sorted(set(level[at_class].tolist())):
                combos = np.array([(a, *b) for j, a in enumerate(at_class) if level[a] == k
                                   for b in itertools.combinations(at_class[j + 1:], int(k) - 1)], np.int64).reshape(-1, int(k))
                if len(combos):
                    h = np.full(len(combos), k, np.uint64)
                    for column in np.sort(rest[combos], axis=1).T:
                        h = mixed(h, 2) + column
                    out.append(mixed(h, size_class + 3))
    return np.unique(np.concatenate(out))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def signature(s: np.ndarray) -> bytes:
    """Two to four bits for each shingle: whether a bit's number of shingles is odd. The signatures' difference is
    that of the sets' symmetric difference, so its ones are at most that one's size."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_link(n_x: int, x: bytes, n_y: int, y: bytes) -> bool:
    """False only where the signatures show that sets of these sizes differ by too much: linked sets differ by a ninth
    of their sizes' sum at most."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)  # a bit's place in the shorter one is its place modulo that one's length
    return (100 + PERCENT) * int(np.bitwise_count(a ^ b).sum()) <= (100 - PERCENT) * (n_x + n_y)


def _column(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)]))


def frequent_shingles(texts: DataFrame, least: int = FREQUENT, most: int = MAX_FREQUENT, steps: tuple = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many documents, at most ``most``, sorted, and their levels (2 to 4). Counted in blocks of documents over all
    texts; a shingle that a block has once doesn't count there."""

    def count(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def done():
            if held:
                s, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                s, n = s[n > 1], n[n > 1]
                for at in range(0, len(s), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(s[at:at + 100_000].view(np.int64)), pa.array(n[at:at + 100_000])], ["s", "n"])

        total = 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py()))
                total += len(held[-1])
                if total >= BLOCK:
                    yield from done()
                    total = 0
        yield from done()

    found = texts.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "s").limit(most).toPandas()
    s, n = rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], 2 + np.searchsorted(np.array(steps), n[order], side="right")


def with_keys(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_key, bytes, n, d1, d2 (a digest of the set), signature, keys."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column(3)]
                sums = [np.array([mixed(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (11, 12)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums),
                                                  pa.array([signature(s) for s in sets], pa.binary()), _column([keys_of(s, *often) for s in sets])],
                                                 ["doc_id", "text_key", "bytes", "n", "d1", "d2", "signature", "keys"])

    rows = docs.select("doc_id", "text_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, bytes long, n long, d1 long, d2 long, signature binary, keys array<long>")


def shared_keys(index: DataFrame) -> DataFrame:
    """The rows (key, node, n) of keys that several nodes have, with the key's smallest node as ``hub``."""

    def run(batches):
        held = None  # the last row, and the hub of its key
        for b in batches:
            if not b.num_rows:
                continue
            key, node, n = (c.to_numpy() for c in b.columns)
            if held is not None:
                key, node, n = (np.concatenate([[x], y]) for x, y in zip(held[0], (key, node, n), strict=True))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            hub = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(key)]])))
            hubs, hubs_n = node[starts][hub], n[starts][hub]
            if held is not None:
                hubs[hub == 0], hubs_n[hub == 0] = held[1]
            more = hubs != node  # a key's first row is its hub: only the others say that there are several
            if held is not None:
                more[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (key, node, n, hubs, hubs_n)], ["key", "node", "n", "hub", "hub_n"])
            held = ((key[-1], node[-1], n[-1]), (hubs[-1], hubs_n[-1]))

    rows = index.select("key", "node", "n").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "key long, node long, n long, hub long, hub_n long")


def _sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def near_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the signatures can't rule out."""
    side = lambda c: signatures.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("signature").alias(f"{c}_s"))

    def run(batches):
        for b in batches:
            good = pa.array([may_link(*(x.as_py() for x in row)) for row in zip(*b.columns[2:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(good)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_s", "b_n", "b_s")
    return both.mapInArrow(run, "a long, b long")


def linked_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by their whole texts."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))

    def run(batches):
        for b in batches:
            known = functools.lru_cache(64)(shingles)  # a hub's rows follow each other
            good = pa.array([linked(known(x.as_py()), known(y.as_py())) for x, y in zip(*b.columns[2:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(good)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long")


def bucketed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, rep), stored in buckets by node: joined again and again, but shuffled once."""
    spark = docs.sparkSession
    name = f"shingle_texts_{uuid.uuid4().hex[:16]}"
    of = nodes.select("node", F.col("rep.no_id").alias("no_id"), F.coalesce("rep.doc_id", F.lit(0)).alias("id"), F.col("rep.text_key").alias("text_key"))
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key", "text")
    # a row that repeats gives its node one text: all of them are the same
    rows = rows.hint("merge").join(of.hint("merge"), ["no_id", "id", "text_key"]).dropDuplicates(["no_id", "id", "text_key"]).select("node", "text")
    rows.write.option("compression", "zstd").option("path", work_folder(spark, "shingle-texts")) \
        .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").saveAsTable(name)
    return spark.table(name)


class _Side:
    """One side of a block: nodes with size, component and signature (and text, if given), by size."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.node, self.n, self.component = (table[c].to_numpy() for c in ("node", "n", "component"))
        self.signatures = [x.as_py() for x in table["signature"]]
        self.lengths = np.array([len(x) for x in self.signatures])
        self.shingles = functools.lru_cache(4096)(lambda k: shingles(table["text"][k].as_py()))
        self.folded: dict[int, np.ndarray] = {}

    def fold(self, width: int) -> np.ndarray:
        """All signatures folded to ``width`` bytes (shorter ones, whose rows are not used at this width, are zeros)."""
        if width not in self.folded:
            out = np.zeros((len(self.n), width), np.uint8)
            for k, x in enumerate(self.signatures):
                if len(x) >= width:
                    out[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0)
            self.folded[width] = out
        return self.folded[width]

    def near(self, n: int, signature: bytes, of: np.ndarray) -> np.ndarray:
        """Those of the nodes ``of`` that the signatures can't rule out as linked with a set, the most alike first."""
        width, found, by = np.minimum(len(signature), self.lengths[of]), [of[:0]], [of[:0]]
        for w in sorted(set(width.tolist())):  # sizes within a quarter: few widths
            part = of[width == w]
            folded = np.bitwise_xor.reduce(np.frombuffer(signature, np.uint8).reshape(-1, w), axis=0)
            differ = np.bitwise_count(self.fold(w)[part] ^ folded).sum(axis=1, dtype=np.int64)
            good = (100 + PERCENT) * differ <= (100 - PERCENT) * (n + self.n[part])
            found.append(part[good])
            by.append(differ[good])
        return np.concatenate(found)[np.argsort(np.concatenate(by), kind="stable")]

    def sizes_fit(self, n: int) -> np.ndarray:
        low, high = np.searchsorted(self.n, [-(-PERCENT * n // 100), 100 * n // PERCENT + 1])
        return np.arange(low, high)


def alike(x: _Side, y: _Side, tried: int) -> list[tuple[int, int | None]]:
    """Pairs (x's node, y's node) of different components that the signatures can't rule out: of each x the most alike ones,
    ``tried`` of a component and four times that in all; if there are more, also (x's node, None)."""
    out: list[tuple[int, int | None]] = []
    for k in range(len(x.n)):
        of = y.sizes_fit(int(x.n[k]))
        near = y.near(int(x.n[k]), x.signatures[k], of[y.component[of] != x.component[k]])
        counts: dict[int, int] = {}
        taken = []
        for j in near.tolist():
            c = int(y.component[j])
            counts[c] = counts.get(c, 0) + 1
            if counts[c] <= tried and len(taken) < 4 * tried:
                taken.append(j)
        out += [(int(x.node[k]), int(y.node[j])) for j in taken]
        if len(taken) < len(near):
            out.append((int(x.node[k]), None))
    return out


def new_links(x: _Side, y: _Side) -> list[tuple[int, int]]:
    """Links between components of x and of y that no link found before joins already, by texts."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    roots = y.component.copy()  # of each y's component, as far as links were found here
    for k in range(len(x.n)):
        own, of = root(int(x.component[k])), y.sizes_fit(int(x.n[k]))
        for j in y.near(int(x.n[k]), x.signatures[k], of[roots[of] != own]).tolist():
            if roots[j] != own and linked(x.shingles(k), y.shingles(j)):
                out.append((int(x.node[k]), int(y.node[j])))
                other = int(roots[j])
                up[own] = other
                roots[roots == own] = other
                own = other
    return out


def groups_of(open_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has to be compared for the members (key, node, component) of keys. Against: (node, of), a member outside its key's
    largest component, and that component. Among: (g, node), groups of such members of a key."""
    sizes = open_keys.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", F.col("component").alias("of"))).alias("m")).select("key", "m.of")
    rest = stored(open_keys.join(largest, "key").filter("component <> of"), "open-rest")
    # keys whose remaining members are the same are compared once
    lists = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"))
    once = lists.filter("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key")
    return rest.select("node", "of").distinct(), rest.join(once, "key").select(F.col("key").alias("g"), "node")


def blocks(against: DataFrame, among: DataFrame, linked_nodes: DataFrame, nodes: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparisons, in blocks (kind, g, i, j) of bounded bytes: the nodes' size, component and signature,
    and with ``texts`` their text. Among: (g, node, asks), all members of a group and which of them are the left side."""
    against = against.select(F.lit(0).alias("kind"), F.col("of").alias("g"), "node")
    groups = against.select("kind", "g").distinct()
    whole = groups.join(linked_nodes.withColumnRenamed("component", "g"), "g").select("kind", "g", "node")
    alone = groups.join(linked_nodes.select(F.col("component").alias("g")).distinct(), "g", "left_anti").select("kind", "g", F.col("g").alias("node"))
    among = among.select(F.lit(1).alias("kind"), "g", "node", "asks")
    bytes_of = (F.col("bytes") if texts is not None else F.octet_length("signature")) + 64

    def side(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.join(nodes.select("node", "n", "bytes", "signature"), "node").join(linked_nodes, "node", "left")
        rows = stored(rows.withColumn("component", F.coalesce("component", "node")), f"open-{name}")
        return rows, rows.groupBy("kind", "g").agg(F.ceil(F.sum(bytes_of) / SIDE_BYTES).alias(f"n_{name}"))

    left, n_left = side(against.union(among.filter("asks").drop("asks")), "left")
    right, n_right = side(whole.union(alone).union(among.drop("asks")), "right")
    numbers = stored(n_left.join(n_right, ["kind", "g"]), "open-blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), n)
    columns = ["kind", "g", "i", "j", "node", "n", "component", "signature", *(["text"] if texts is not None else [])]

    def dealt(rows: DataFrame, at: str, n_at: str, other: str, n_other: str) -> DataFrame:
        rows = rows.join(numbers, ["kind", "g"]).withColumn(at, mine(F.col(n_at))).withColumn(other, spread(F.col(n_other)))
        rows = rows if texts is None else rows.join(texts, "node")
        return rows.select(*(F.col(c).alias(c) for c in columns))

    return dealt(left, "i", "n_left", "j", "n_right"), dealt(right, "j", "n_right", "i", "n_left")


def compared(sides: tuple[DataFrame, DataFrame], how) -> DataFrame:
    """(kind, g, a, b) of what ``how`` finds in each block."""

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        pairs = how(_Side(x), _Side(y)) if x.num_rows and y.num_rows else []
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        kind, g = (x["kind"][0].as_py(), x["g"][0].as_py()) if pairs else (0, 0)
        return pa.table({"kind": pa.array([kind] * len(a), pa.int32()), "g": pa.array([g] * len(a), pa.int64()),
                         "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ["kind", "g", "i", "j"]
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(compare, "kind int, g long, a long, b long")


def settle(open_keys: DataFrame, linked_nodes: DataFrame, nodes: DataFrame, texts: DataFrame, verified, tried: int) -> DataFrame:
    """Links (a, b) that are missing between the components of the members (key, node, component) of keys. A node's candidates
    that are most alike by signature are verified as pairs; a node that has more of them and is not linked by those has all
    compared by texts, in the tasks."""
    against, among = groups_of(open_keys)
    found = stored(compared(blocks(against, among.withColumn("asks", F.lit(True)), linked_nodes, nodes, None), functools.partial(alike, tried=tried)), "alike")
    links = stored(verified(found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "links")
    more = stored(found.filter("b is null").select("kind", "g", F.col("a").alias("node")).distinct(), "more-alike")
    if more.isEmpty():
        return links
    # components as the new links make them; a node that they join with its group's component has nothing left to find there
    now = with_smallest(components(links.union(linked_nodes))) if not links.isEmpty() else linked_nodes
    of = now.select(F.col("node").alias("g"), F.col("component").alias("of"))
    asks = more.filter("kind = 0").select("node", "g").join(of, "g", "left").select("node", F.coalesce("of", "g").alias("of"))
    asks = asks.join(now, "node", "left").filter(F.coalesce("component", "node") != F.col("of")).select("node", "of").distinct()
    groups = more.filter("kind = 1").select("g", "node")
    members = among.join(groups.select("g").distinct(), "g").join(groups.withColumn("asks", F.lit(True)), ["g", "node"], "left")
    members = members.select("g", "node", F.coalesce("asks", F.lit(False)).alias("asks"))
    return links.union(compared(blocks(asks, members, now, nodes, texts), new_links).select("a", "b"))


def similarity_join(docs: DataFrame, tried: int = TRIED) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); also text_key (a hash of the text) and group (the
    component's number, null for an empty set)."""
    with scratch(docs.sparkSession) as keep:
        return keep(_joined(docs, tried), "shingle-components")


def _joined(docs: DataFrame, tried: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    frequent = frequent_shingles(docs.filter("text is not null"))
    wide = stored(with_keys(docs, frequent), "shingle-keys")
    same = ["n", "d1", "d2"]
    rows = stored(wide.select("doc_id", "text_key", *same), "shingle-sets")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "bytes"))
    sets = wide.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("smallest"), rep.alias("rep"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()).withColumn("bytes", F.col("rep.bytes")), "shingle-nodes", free=True)
    release(wide)
    hubs = stored(shared_keys(nodes.select(F.explode("keys").alias("key"), "node", "n")), "shared-keys", free=True)

    # every member of a key that several nodes have, hubs included
    members = stored(hubs.select("key", "node", "n").union(hubs.select("key", "hub", "hub_n").distinct()), "shared-members", free=True)
    pairs = hubs.select(F.col("hub").alias("a"), F.col("node").alias("b")).filter(_sizes_fit("hub_n", "n"))
    needed = members.select("node").distinct()
    wanted = stored(nodes.drop("keys").join(needed, "node", "left_semi"), "shared-nodes")
    texts = bucketed_texts(docs, wanted)
    seen = stored(pairs.distinct(), "pairs")
    release(hubs)
    found = components(linked_pairs(stored(near_pairs(seen, wanted), "near-pairs"), texts))

    def verified(pairs: DataFrame) -> DataFrame:
        return linked_pairs(stored(near_pairs(pairs.distinct().join(seen, ["a", "b"], "left_anti"), wanted), "near-pairs"), texts)

    for last in (False, True):
        marked = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        # the two members of a key have been compared already
        open_keys = marked.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"),
            F.min(F.struct(F.xxhash64("key", "node"), "node", "n", "component")).alias("hub")).filter("low < high and size > 2")
        open_keys = open_keys.select("key", "size", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component"))
        live = stored(marked.join(open_keys, "key"), "open-members")
        if live.isEmpty():
            break
        if last:
            x, y = (live.filter(F.col("size") <= SMALL_KEY).select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "component"))) for k in "xy")
            pairs = x.join(y, "key").filter("component_x < component_y").filter(_sizes_fit("n_x", "n_y")).select(
                F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
            large = live.filter(F.col("size") > SMALL_KEY).select("key", "node", "component")
            links = stored(verified(pairs), "links").union(stored(settle(large, with_smallest(found), wanted, texts, verified, tried), "links"))
        else:  # another member against those of other components
            pairs = live.filter("component <> hub_component").filter(_sizes_fit("n", "hub_n")).select(
                F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            links = stored(verified(pairs), "links")
            members = live.select("key", "node", "n")
        if not links.isEmpty():
            found = components(links.union(found.select("node", "component")))
    # a component's id is the smallest of its documents'; a node alone in its component has its own
    linked_nodes = with_smallest(found)
    low = stored(nodes.select("node", "smallest").join(linked_nodes, "node").groupBy("component").agg(F.min("smallest").alias("low")), "component-ids")
    of_node = linked_nodes.join(low, "component")
    of_set = stored(nodes.select(*same, "node", "smallest").join(of_node, "node", "left").select(
        *same, F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("smallest")).otherwise(F.col("low")).alias("component_id")),
        "set-components")
    return rows.join(of_set, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key", "group")


def with_smallest(found: DataFrame) -> DataFrame:
    """(node, component) of every node of a link, the smallest ones of their components too."""
    return stored(found.select("node", "component").union(found.select("component", "component").distinct()), "linked-nodes")


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id (null ids last), columns unchanged. Rows with an empty
    set stay; of rows that repeat an id and a text one stays."""
    joined = similarity_join(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = joined.filter("group is not null").groupBy("group").agg(first.alias("r")).select("r.doc_id", "r.text_key")
    return keep_documents(docs, kept.union(joined.filter("group is null").select("doc_id", "text_key")), once=True)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                               ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
