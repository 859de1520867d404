"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtab.session import work_path

#: ASCII white space of the contracts, as a regular expression for Spark and DuckDB.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters as bytes.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
ROWS_A_FILE = 200_000
#: A-Z to a-z on bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Folders written inside the ``scratch`` blocks that are open, innermost last.
_OPEN: list[list[str]] = []


def _delete(spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark):
    """Tables stored inside the block are deleted at its end, when what was made of them is written: return that through the
    function that the block gets, which stores it for the caller."""
    mine: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        held = _OPEN.pop()
        try:
            return stored(df, name)
        finally:
            _OPEN.append(held)

    _OPEN.append(mine)
    try:
        yield keep
    finally:
        _OPEN.pop()
        for path in mine:
            _delete(spark, path)
        spark.sparkContext._jvm.System.gc()


def work_folder(spark, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted with the innermost ``scratch`` block."""
    path = work_path(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def release(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.stored_at)


def stored(df: DataFrame, name: str, rows: int | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into a fresh folder below ``spark.checkpoint.dir`` and read it
    back: later steps start from files that survive a lost executor. ``rows``, an upper bound
    of a narrow table's rows, gives fewer files (a task for every ROWS_A_FILE). ``free`` asks the driver
    to collect its garbage, so that the executors drop the shuffle files that led to the table."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    df.write.option("compression", "zstd").parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def text_key(text: Column) -> Column:
    """A hash of a text; with the id it tells rows apart that a decision was made on."""
    return F.xxhash64(text.isNull(), text)


def keep_documents(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are those of a row of ``keys`` (doc_id, text_key), nulls included, columns
    unchanged; with ``once`` one of the rows that repeat both."""
    by = ["_llm_none", "_llm_id", "_llm_text"]
    marks = lambda key: {"_llm_none": F.col("doc_id").isNull(), "_llm_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_llm_text": key}
    k = keys.withColumns(marks(F.col("text_key"))).select(*by).distinct()
    kept = docs.withColumns(marks(text_key(F.col("text")))).join(k, by, "left_semi")
    return (kept.dropDuplicates(by) if once else kept).drop(*by)


def sample_by_hash(rows: DataFrame, by: str, most: dict) -> DataFrame:
    """At most ``most[value]`` rows of each value of ``by``, with their rank (by a hash of doc_id). Only rows whose
    hash is low enough for about twice as many are ranked, so no value's rows meet in one task."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == value, min(1.0, (2 * most[value] + 100) / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    limit = F.lit(0)
    for value in counts:
        limit = F.when(F.col(by) == value, most[value]).otherwise(limit)
    return rows.filter(drawn).withColumn("rank", rank).filter(F.col("rank") <= limit)
