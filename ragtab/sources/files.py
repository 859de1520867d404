"""Sources and sinks (S1-S8): CSV with quoted newlines, partitioned result trees,
JSON answer lines and the vector index table.

Experiment, verifier and model are partition *values* (Spark escapes ``:`` and
other characters in them), never file names."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragtab.functions.vectors import norm
from ragtab.sources.quoted_csv import read_quoted_csv

RESULT_KEYS = ("experiment", "verifier", "model")


def read_qa_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV whose cells may hold commas, doubled quotes and newlines;
    explicit schema, never inferred. A large file is read by many tasks."""
    return read_quoted_csv(spark, path, schema)


def write_qa_csv(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    """S5 (CSV export): same dialect as ``read_qa_csv``. Rows of a partition value are
    brought together (a large one is split by size): few files per folder."""
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_results(df: DataFrame, root: str, keys=RESULT_KEYS, mode: str = "overwrite") -> None:
    """One partitioned Parquet tree; ``mode='overwrite'`` with dynamic
    partition overwrite replaces only the partitions being written (re-running a
    task is idempotent)."""
    by = [k for k in keys if k in df.columns]
    # rows of a partition value are brought together (a large one is split by size): few files per folder
    (df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root))


def read_results(spark: SparkSession, root: str, verifiers=None, models=None) -> DataFrame:
    """The results tree with allow-lists on verifier and model; the filters
    become partition filters, so pruned folders are never listed or read."""
    df = spark.read.parquet(root)
    if verifiers is not None:
        df = df.where(F.col("verifier").isin(list(verifiers)))
    if models is not None:
        df = df.where(F.col("model").isin(list(models)))
    return df


def read_results_csv(spark: SparkSession, root: str, schema: StructType | str, verifiers=None,
                     models=None) -> DataFrame:
    """S2 for a tree of CSV files ``<root>/<verifier>/<model>.csv``: verifier is the
    folder name, model the file stem without the last suffix (``llama3.1.csv`` ->
    ``llama3.1``), both percent-decoded; allow-lists filter both."""
    from ragtab.functions.text import file_stem

    def named(path) -> dict:
        return {"verifier": F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)), "model": F.url_decode(file_stem(path))}

    path = F.col("_metadata.file_path")
    only = ~F.contains(path, F.lit(".ipynb"))  # P9
    for name, allowed in (("verifier", verifiers), ("model", models)):
        if allowed is not None:
            only &= named(path)[name].isin(list(allowed))
    df = read_quoted_csv(spark, f"{root.rstrip('/')}/*/*.csv", schema, with_path=True, only=only)
    return df.withColumns(named(F.col("file_path"))).drop("file_path")


def write_results_csv(df: DataFrame, root: str) -> None:
    """The results as a tree of CSV files ``<root>/<verifier>/<model>.csv``, one file each, for tools that read this layout
    (``write_results`` is the layout for large tables). Names are percent-encoded where they hold ``/`` or ``%``."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(r) -> None:
        verifier, model = (r[c].replace("%", "%25").replace("/", "%2F") for c in ("verifier", "model"))
        part = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
        own = df.where((F.col("verifier") == r["verifier"]) & (F.col("model") == r["model"])).drop("verifier", "model")
        write_qa_csv(own.coalesce(1), part)
        target = fs_path(f"{root.rstrip('/')}/{verifier}")
        fs.mkdirs(target)
        for f in fs.globStatus(fs_path(f"{part}/part-*.csv")):
            fs.rename(f.getPath(), fs_path(target, f"{model}.csv"))
        fs.delete(fs_path(part), True)

    grid = df.select("verifier", "model").distinct().collect()  # of verifiers and models
    with ThreadPoolExecutor(min(16, spark.sparkContext.defaultParallelism)) as pool:  # a file is written by one task, so files side by side
        list(pool.map(write, grid))


def list_models(results: DataFrame) -> DataFrame:
    """Distinct model names of a results tree (a partition column)."""
    return results.select("model").distinct()


def read_experiments(spark: SparkSession, root: str, schema: StructType | str,
                     pattern: str = "*/*/*.csv") -> DataFrame:
    """S3: CSV answer files laid out as ``<experiment>/<model>/<file>.csv`` (or
    ``experiment=<..>/model=<..>/``); the two folder names become columns
    (percent-decoded), and folders whose name contains ``.ipynb`` are skipped (P9)."""
    df = read_quoted_csv(spark, f"{root.rstrip('/')}/{pattern}", schema, with_path=True)
    seg = r"([^/]+)/([^/]+)/[^/]+$"
    exp = F.url_decode(F.regexp_replace(F.regexp_extract("file_path", seg, 1), r"^[^=]+=", ""))
    mod = F.url_decode(F.regexp_replace(F.regexp_extract("file_path", seg, 2), r"^[^=]+=", ""))
    df = df.withColumn("experiment", exp).withColumn("model", mod)
    return df.where(~F.col("file_path").contains(".ipynb")).drop("file_path")


def write_answer_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per answer (JSON lines, ``id`` a field), partitioned
    by model -- not one file per answer."""
    df.hint("rebalance", "model").write.mode(mode).partitionBy("model").json(path)


def read_answer_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_index(df: DataFrame, path: str, vec: str = "embedding", mode: str = "overwrite") -> None:
    """Persist an embedded corpus with its norms (computed once, JVM-side)."""
    df.withColumn("norm", norm(vec)).write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
