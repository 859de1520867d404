"""Splittable CSV with quoted newlines (S1, S3): one large file is read by many tasks.

A line break ends a record only outside quotes, that is where the number of quotes before it is even
(a doubled quote counts twice). Spark's text source cuts files at line breaks; so

1. each split counts its quotes, and the counts of a file are summed in order: this gives every split
   whether it starts inside a quoted cell, and in which split the record that is open there started
   (a row for each split, no text);
2. each split joins its lines to records. The lines before its first record start, and those of a
   record that it doesn't end, are pieces of a record that crosses splits;
3. the pieces of such a record are brought together by the split where it starts, in order;
4. records are parsed by ``from_csv`` with the given schema; the first record of a file is its header.

Rows equal those of Spark's ``multiLine`` reader, which reads a file in one task. A quote that is never
closed makes the rest of its file one record, as there."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPTIONS = {"quote": '"', "escape": '"'}
#: A record; or a piece, in split ``split``, of the record that starts in split ``start``.
PIECES = "path string, split long, start long, header boolean, record string"
_PIECES = pa.schema([("path", pa.string()), ("split", pa.int64()), ("start", pa.int64()), ("header", pa.bool_()), ("record", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of batches (value, path, split), in order, in runs of one split."""
    for b in batches:
        paths, splits = b.column(1).dictionary_encode(), b.column(2).to_numpy()
        of = paths.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (splits[1:] != splits[:-1])]) if b.num_rows else []
        for at, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield (paths.dictionary[int(of[at])].as_py(), int(splits[at])), b.column(0).slice(int(at), int(end - at))


def _odd(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2


def _counted(batches: Iterator[pa.RecordBatch]):
    """A row for each split: whether its quotes are odd in number, and whether they are at the end of any of its lines."""
    seen: dict = {}
    for key, lines in _runs(batches):
        total, ever = seen.get(key, (0, False))
        after = (np.cumsum(_odd(lines)) + total) % 2
        seen[key] = (int(after[-1]), ever or bool(after.any()))
    rows = [(*key, bool(total), ever) for key, (total, ever) in seen.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "split", "odd", "ever"])


def _open_splits(lines: DataFrame) -> dict[tuple[str, int], int]:
    """The splits that start inside quotes: (path, split) -> the split where the record that is open there starts."""
    rows = lines.mapInArrow(_counted, "path string, split long, odd boolean, ever boolean").orderBy("path", "split").collect()  # one a split
    out, path, start, inside = {}, None, 0, False
    for r in rows:
        if r["path"] != path:
            path, inside = r["path"], False
        if inside:
            out[(path, r["split"])] = start
            if r["ever"]:  # an even number before some line's end: a record starts in this split
                start = r["split"]
        else:
            start = r["split"]
        inside ^= r["odd"]
    return out


#: Splits that a task reads at least, one after another, where there are very many.
TASK_SPLITS = 256


def records(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """``path`` (of the file) and ``record`` for every record, header records left out. ``only``: a condition on
    ``_metadata.file_path``; other files are not read."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = (lines if only is None else lines.where(only)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    splits, tasks = lines.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    if splits > tasks:  # small splits: a task and its Python worker for each would cost more than reading them
        lines = lines.coalesce(max(tasks, splits // TASK_SPLITS))
    shared = spark.sparkContext.broadcast(_open_splits(lines))  # a number for each split that starts inside quotes

    def join(batches: Iterator[pa.RecordBatch]):
        key, held, start, header, inside = None, [], None, False, 0

        def rest():
            """The piece that is left at a split's end."""
            if held:
                yield _batch([(*key, key[1] if start is None else start, header, "\n".join(held))])

        for now, lines in _runs(batches):
            if now != key:
                yield from rest()
                key, held, start = now, [], shared.value.get(now)
                inside, header = int(start is not None), now[1] == 0
            after = (np.cumsum(_odd(lines)) + inside) % 2
            text, low, out = lines.to_pylist(), 0, []
            for stop in np.flatnonzero(after == 0).tolist():
                record = "\n".join([*held, *text[low:stop + 1]]) if held or stop > low else text[stop]
                if start is not None or not header:
                    out.append((*key, start, False, record))
                if start is None:
                    header = False
                held, start, low = [], None, stop + 1
            held += text[low:]
            inside = int(after[-1])
            if out:
                yield _batch(out)
        yield from rest()

    pieces = lines.mapInArrow(join, PIECES)
    # one piece a split, so a record that stays in quotes over many splits is put together in one task, as it has to be
    crossing = pieces.where("start IS NOT NULL").groupBy("path", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "record"))), lambda p: p["record"]), "\n").alias("record"),
        F.bool_or("header").alias("header"))
    both = pieces.where("start IS NULL").select("path", "record").unionByName(crossing.where("NOT header").select("path", "record"))
    return both.select("path", F.regexp_replace("record", "\r$", "").alias("record")).where(F.col("record") != "")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str, with_path: bool = False, only: Column | None = None) -> DataFrame:
    """Header CSV whose cells may hold commas, doubled quotes and newlines; explicit schema. Columns that folders named
    ``name=value`` give are added, as by other readers. ``with_path`` adds the file's path as ``file_path``.
    ``only``: see ``records``."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = records(spark, path, only).select(F.from_csv("record", ddl, OPTIONS).alias("r"), F.col("path").alias("file_path"))
    folders = [f for f in spark.read.text(path).schema if f.name != "value" and f.name not in schema.names]
    decoded = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    # the folder's name encodes the value, and the path, which is a URI, the name
    value = lambda f: decoded(decoded(F.regexp_extract("file_path", f"/{re.escape(f.name)}=([^/]*)/", 1)))
    given = [F.when(value(f) != "__HIVE_DEFAULT_PARTITION__", value(f)).cast(f.dataType).alias(f.name) for f in folders]
    return rows.select("r.*", *given, *(["file_path"] if with_path else []))
