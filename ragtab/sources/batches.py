"""Tables that grow by batches, with a manifest of which files belong to which batch.

A batch is written to folders of its own under a fresh name; then one manifest row names them.
Readers see the folders of each batch's last manifest row and nothing else. So a batch that fails
midway leaves nothing that a reader sees, and a batch that is run again replaces its own rows.
There is one writer at a time; readers need no lock. The manifest has a row for each run of a
batch and is small by itself; the rows of the tables never leave Spark."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "version long, batch string, folder string, tables string, info string"


class BatchTables:
    """Named tables under one path, each a union of the live batches' folders."""

    def __init__(self, spark: SparkSession, path: str, rows: list | None = None):
        self.spark, self.path, self.pinned = spark, path.rstrip("/"), rows

    @classmethod
    def create(cls, spark: SparkSession, path: str, info: str = "") -> BatchTables:
        """An empty store; ``info`` is kept with it."""
        t = cls(spark, path)
        if t._rows() is not None:
            raise ValueError(f"{path} holds tables already")
        t._commit(0, None, "", [], info)
        return t

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BatchTables:
        t = cls(spark, path)
        if t._rows() is None:
            raise ValueError(f"{path} holds no tables")
        return t

    def snapshot(self) -> BatchTables:
        """The tables as of now; later batches don't change what it reads."""
        return BatchTables(self.spark, self.path, self._rows())

    def _rows(self) -> list | None:
        if self.pinned is not None:
            return self.pinned
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect()  # a row a batch run
        except AnalysisException:
            return None
        return sorted(rows, key=lambda r: (r["version"], r["folder"])) or None

    def _commit(self, version: int, batch: str | None, folder: str, tables: list[str], info: str) -> None:
        row = (version, batch, folder, ",".join(tables), info)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    @property
    def info(self) -> str:
        return self._rows()[0]["info"]

    def version(self) -> int:
        """Grows with every batch run."""
        return self._rows()[-1]["version"]

    def batches(self) -> dict[str, dict]:
        """The last run of each batch."""
        return {r["batch"]: r.asDict() for r in self._rows() if r["batch"] is not None}

    def put(self, batch: str, tables: dict[str, DataFrame], info: str = "") -> None:
        """Writes the tables of a batch; they replace what the batch held before."""
        if self.pinned is not None:
            raise ValueError("a snapshot is read only")
        folder = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{folder}")
        self._commit(self.version() + 1, batch, folder, list(tables), info)

    def folders(self, name: str, but: str | None = None) -> list[str]:
        return [f"{self.path}/{name}/{r['folder']}" for b, r in sorted(self.batches().items())
                if b != but and name in r["tables"].split(",")]

    def read(self, name: str, schema, but: str | None = None) -> DataFrame:
        """All rows of the live batches, of ``but`` none."""
        folders = self.folders(name, but)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Of rows with the same key one stays (any of them, whole)."""
    return df.dropDuplicates([key])


def append_batch(store: BatchTables, name: str, rows: DataFrame, batch: str, key: str) -> None:
    """Ingest: rows whose key no other batch holds, one row a key. Running a batch again replaces its own rows, so a
    repeated or failed run changes nothing else and loses nothing. Null keys are keys like others."""
    known = store.read(name, rows.schema, but=batch).select(key).distinct()
    new = one_row_per_key(rows, key)
    store.put(batch, {name: new.join(known, new[key].eqNullSafe(known[key]), "left_anti")})
