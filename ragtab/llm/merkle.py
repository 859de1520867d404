"""Merkle manifest of a table of documents: leaves, roots, proofs and their verification.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a source, by doc_id,
are a tree whose nodes are the SHA-256 of up to three consecutive nodes below; the sources' roots,
by source, are a tree of the same kind.

Leaves get dense positions (range partitions, counts of partitions), and ``RUN ** LEVELS`` consecutive
ones of a tree are a superblock. A superblock is reduced to its top node by itself; the tops are nodes of
the next round, until each tree has one. Then proofs go down again: in each round nodes and the one
row of outer nodes that their superblock needs (the siblings on the way from its top to the root)
are cogrouped by superblock, and ``applyInPandas`` redoes the local reduction, joins local and outer
siblings and, for leaves, folds them. So no task sees more nodes than that and one path,
whatever a source's size, and each round's table is smaller by that factor.

Defined cases: a null field is ``-``; a null doc_id comes first in its source and is never tampered
with; rows of one doc_id are ordered by leaf; equal rows are leaves each, next to each other; the
null source is a tree like others; an empty table gives no rows; texts are hashed whole, of any
length; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, stored

#: Nodes of a run, levels of a superblock (3^7 = 2,187 leaves).
RUN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node's superblock needs from outside: place and siblings of each node on the way up, the roots.
OUTER = "tree long, block long, places array<int>, others array<string>, subroot string, root string"
NODE = "tree long, pos long, n long, digest string"


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's fields, with another text if given."""
    cols = [(text if text is not None and c == "text" else F.col(c)).cast("string") for c in FIELDS]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in cols]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def node(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def levels_of(n: int, most: int) -> int:
    """Levels above the nodes of a superblock in a tree of n nodes."""
    k = 0
    while k < most and RUN ** k < n:
        k += 1
    return k


def reduce_block(digests: list[str], n: int, most: int) -> list[list[str]]:
    """All levels of a superblock, its nodes first, its top last."""
    out = [digests]
    for _ in range(levels_of(n, most)):
        d = out[-1]
        out.append([node("".join(d[k:k + RUN])) for k in range(0, len(d), RUN)])
    return out


def local_path(levels: list[list[str]], k: int) -> tuple[list[int], list[str]]:
    """The place in its run, and the run's other nodes, of node k and of each of its ancestors below the top."""
    places, others = [], []
    for d in levels[:-1]:
        place, start = k % RUN, k - k % RUN
        places.append(place)
        others.append("".join(d[start:k] + d[k + 1:start + RUN]))
        k //= RUN
    return places, others


def fold(digest: str, places: list[int], others: list[str]) -> str:
    for place, rest in zip(places, others, strict=True):
        digest = node(rest[:64 * place] + digest + rest[64 * place:])
    return digest


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in the order of all rows, ``at``, from 0 and dense."""
    spark = rows.sparkSession
    serial = F.monotonically_increasing_id()  # of a partition's first row its number times 2^33
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("serial", serial), "merkle-placed")
    part = F.shiftright("serial", 33)
    starts, total = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], total - (r["part"] << 33)))
        total += r["n"]
    starts = spark.createDataFrame(starts, "part long, start long")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("at", F.col("serial") + F.col("start")).drop("serial", "part", "start")


def tops(nodes: DataFrame, most: int) -> DataFrame:
    """The top nodes of the superblocks, as nodes of the next round."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        levels = reduce_block(block.sort_values("pos")["digest"].tolist(), n, most)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // RUN ** most)], "digest": [levels[-1][0]]})

    rows = nodes.select("tree", _block(most).alias("block"), "pos", "n", "digest")
    return rows.groupBy("tree", "block").applyInPandas(run, NODE)


def _block(most: int) -> Column:
    return F.expr(f"pos div {RUN ** most}")


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of nodes, from ``nodes`` to one node a tree."""
    rounds = [nodes]
    while rounds[-1].agg(F.max("n")).first()[0] > 1:
        rounds.append(stored(tops(rounds[-1], most), "merkle-tops"))
    return rounds


def descend(nodes: DataFrame, outer: DataFrame, schema: str, finish: Callable, most: int) -> DataFrame:
    """Cogroups nodes with their superblock's outer nodes. ``finish(block, paths, outer row)`` makes the result's
    columns from the nodes by position and their paths to the root."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, up = block.sort_values("pos"), above.iloc[0]
        levels = reduce_block(block["digest"].tolist(), int(block["n"].iloc[0]), most)
        places, others = list(up["places"]), list(up["others"])
        paths = [(p + places, o + others) for p, o in (local_path(levels, k) for k in range(len(block)))]
        return finish(block, paths, up)

    rows = nodes.withColumn("block", _block(most))
    return rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def proofs_of_sources(block: pd.DataFrame, paths: list, up: pd.Series) -> pd.DataFrame:
    """A source's root is the only top node of its tree: its path is what the tree needs from outside."""
    return pd.DataFrame({"tree": block["pos"], "block": 0, "places": [p for p, _ in paths], "others": [o for _, o in paths],
                         "subroot": block["digest"], "root": up["root"]})


def proofs_of_tops(block: pd.DataFrame, paths: list, up: pd.Series) -> pd.DataFrame:
    """A top node's path is what its superblock needs from outside."""
    return pd.DataFrame({"tree": block["tree"], "block": block["pos"], "places": [p for p, _ in paths], "others": [o for _, o in paths],
                         "subroot": up["subroot"], "root": up["root"]})


def verified(block: pd.DataFrame, paths: list, up: pd.Series) -> pd.DataFrame:
    """Proofs of leaves, and the root that the presented leaves fold to."""
    shown = block["shown"].where(block["shown"].notna(), block["digest"])
    folded = [fold(d, *path) for d, path in zip(shown, paths, strict=True)]
    return pd.DataFrame({"doc_id": block["doc_id"].astype("Int64"), "leaf": block["digest"], "subroot": up["subroot"], "root": up["root"],
                         "proof_sha256": [node("".join(others)) for _, others in paths], "folded_root": folded,
                         "verified": [f == up["root"] for f in folded], "proof_nodes": [sum(map(len, others)) // 64 for _, others in paths]})


RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
          "proof_nodes int")


def verify(docs: DataFrame, shown: Column, most: int = LEVELS) -> DataFrame:
    """Manifest of ``docs`` (the columns ``FIELDS``), and for every row whether the leaf ``shown`` (null: its own)
    folds with its proof to the root. ``most``: levels of a superblock. Columns: ``RESULT``."""
    spark = docs.sparkSession
    light = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("digest"),
                               shown.alias("shown"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    placed = positions(light, "source", "doc_id", "digest", "tie").drop("tie")
    trees = stored(placed.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    if trees.isEmpty():
        return spark.createDataFrame([], RESULT)
    trees = stored(positions(trees, "first").withColumnRenamed("at", "tree").withColumnRenamed("source", "of"), "merkle-trees")
    leaves = placed.join(trees, placed["source"].eqNullSafe(trees["of"])).select(
        "tree", (F.col("at") - F.col("first")).alias("pos"), "n", "digest", "shown", "doc_id")
    within = climb(stored(leaves, "merkle-nodes"), most)
    n_trees = trees.count()
    across = climb(stored(within[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest"),
                          "merkle-subroots"), most)
    outer = across[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<int>").alias("places"),
                              F.array().cast("array<string>").alias("others"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in [*reversed(across[1:-1])]:
        outer = stored(descend(nodes, outer, OUTER, proofs_of_tops, most), "merkle-outer")
    outer = stored(descend(across[0], outer, OUTER, proofs_of_sources, most), "merkle-outer")
    for nodes in [*reversed(within[1:-1])]:
        outer = stored(descend(nodes, outer, OUTER, proofs_of_tops, most), "merkle-outer")
    return descend(within[0], outer, RESULT, verified, most)


def tampered_leaf() -> Column:
    """Where 2 divides the crc32 of the id, the leaf of the row without its text's line ends, else null."""
    odd_one = F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), 2) == 0)
    return F.when(odd_one, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def merkle_manifest(docs: DataFrame, most: int = LEVELS) -> DataFrame:
    return verify(docs, tampered_leaf(), most)


def _sql_leaf(text: str) -> str:
    cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen({c}) AS VARCHAR) || ':' || {c} END" for c in cols) + ")"


ORACLE = f"""
WITH RECURSIVE b AS (
  SELECT *, list_reduce([4294967295]::BIGINT[] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda ch: list_transform(range(8), lambda k: CAST((ascii(ch) >> CAST(k AS INTEGER)) & 1 AS BIGINT)))),
      lambda c, bit: xor(c >> 1, CASE WHEN xor(c & 1, bit) = 1 THEN 3988292384 ELSE 0 END)) & 1 AS last FROM documents),
l AS (SELECT doc_id, source, {_sql_leaf("text")} AS leaf, CASE WHEN last = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS shown FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
a AS (SELECT 0 AS lvl, source, pos, leaf AS h, n FROM r
      UNION ALL SELECT lvl + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
t AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s
      UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY lvl, pos // 3, n),
ra AS (SELECT lvl, source, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM a WHERE n > 1 GROUP BY ALL),
rt AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL),
f AS (SELECT rid, source, 0 AS lvl, pos, coalesce(shown, leaf) AS h, '' AS rest FROM r
      UNION ALL SELECT f.rid, f.source, f.lvl + 1, f.pos // 3,
                       sha256(array_to_string(hs[:f.pos % 3] || [f.h] || hs[f.pos % 3 + 2:], '')), rest || array_to_string(hs[:f.pos % 3] || hs[f.pos % 3 + 2:], '')
                FROM f JOIN ra ON ra.lvl = f.lvl AND ra.run = f.pos // 3 AND ra.source IS NOT DISTINCT FROM f.source),
u AS (SELECT rid, arg_max(h, lvl) AS h, arg_max(rest, lvl) AS rest FROM f GROUP BY rid),
g AS (SELECT u.rid, 0 AS lvl, s.pos, u.h, u.rest FROM u JOIN r USING (rid) JOIN s ON s.source IS NOT DISTINCT FROM r.source
      UNION ALL SELECT g.rid, g.lvl + 1, g.pos // 3, sha256(array_to_string(hs[:g.pos % 3] || [g.h] || hs[g.pos % 3 + 2:], '')),
                       rest || array_to_string(hs[:g.pos % 3] || hs[g.pos % 3 + 2:], '')
                FROM g JOIN rt ON rt.lvl = g.lvl AND rt.run = g.pos // 3),
v AS (SELECT rid, arg_max(h, lvl) AS h, arg_max(rest, lvl) AS rest FROM g GROUP BY rid)
SELECT r.doc_id, r.leaf, s.subroot, t.h AS root, sha256(v.rest) AS proof_sha256, v.h AS folded_root, v.h = t.h AS verified,
       CAST(length(v.rest) // 64 AS INTEGER) AS proof_nodes
FROM r JOIN v USING (rid) JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN t ON t.n = 1
"""
