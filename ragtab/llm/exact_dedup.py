"""Exact deduplication against a persistent digest index (bucketed and sorted by digest).

A text's key is the SHA-256 of the text without the characters of ``[\\x20\\x09-\\x0D]``. The
index is a Parquet table of one row per known key, bucketed and sorted by the key, in a folder from
which any later session opens it. A batch is first reduced to one row per key (partial aggregation
before the shuffle, so a key held by a third of the rows sends one row per task), its new keys are
found by a sort-merge anti-join with the index and appended to it, under the batch's id. Rows then
look up their key with a plain equi-join of two stored tables, whose skewed partitions adaptive
execution can split. A batch that is run again (its job failed after the append, say) finds its own
keys under its id and decides as before.

Defined cases: a null text counts as the empty text (all empty texts are one group); ties in
length go to the smallest doc_id, null ids last, then to any row; of rows that repeat a doc_id and
a text one is kept; texts are hashed whole, of any length; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtab.session import work_path

from .common import SPACE, keep_documents, stored, text_key


class DigestIndex:
    """A table ``digest, keep_id, batch`` bucketed and sorted by digest in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, id_type: str, buckets: int):
        self.spark, self.path, self.id_type, self.buckets = spark, path, id_type, buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:16]}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/rows'")

    @classmethod
    def create(cls, spark: SparkSession, id_type: str = "bigint", path: str | None = None,
               buckets: int | None = None) -> DigestIndex:
        """An empty index. ``path`` defaults to a folder below ``spark.checkpoint.dir``; the
        number of buckets to the session's shuffle partitions."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = (path or work_path(spark, "digest-index")).rstrip("/")
        spark.createDataFrame([(id_type, n)], "id_type string, buckets int").coalesce(1).write.parquet(f"{path}/info")
        return cls(spark, path, id_type, n)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index that another session left at ``path``."""
        info = spark.read.parquet(f"{path.rstrip('/')}/info").first()
        return cls(spark, path.rstrip("/"), info["id_type"], info["buckets"])

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)  # batches of other sessions, too
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Append the keys of ``groups`` that the index lacks. Both sides are partitioned by the
        bucket hash of the digest, so the index itself isn't shuffled, and each bucket gets one
        new file. The files of a job that fails are never committed, and a job that is run again
        finds nothing new."""
        known = self.rows().select("digest")
        new = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        rows = new.select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"), F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


def normalized(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def batch_id(groups: DataFrame) -> str:
    """The same for the same keys with the same rows that stay, whatever their order."""
    h = F.xxhash64("digest", "keep_id", "group_size").cast("decimal(38,0)")
    n, s = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return f"{n}-{s}"


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key (a hash of the original text).

    Without ``index`` a new one is made. A text that an earlier batch has put into the index
    is kept in no later batch: its ``keep_id`` is the earlier row's. ``batch`` is the batch's id
    (default: a digest of its keys); run again under its id, a batch gets the same decisions."""
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex.create(spark, docs.schema["doc_id"].dataType.simpleString())
    light = stored(docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_code_points"), text_key(F.col("text")).alias("text_key"),
        F.monotonically_increasing_id().alias("serial"),
        F.unhex(F.sha2(normalized(F.col("text")).cast("binary"), 256)).alias("digest")), "digests")
    best = F.max(F.struct("n_code_points", F.col("doc_id").isNotNull().alias("has_id"),
                          (-F.col("doc_id")).alias("order"), "doc_id", "serial"))
    groups = stored(light.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
                    .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.serial").alias("keep_serial"), "group_size"), "digest-groups")
    batch = batch or batch_id(groups)
    index.append_new(groups, batch)
    known = index.rows().select("digest", F.col("keep_id").alias("known_id"), "batch")
    found = stored(groups.join(known, "digest").select(
        "digest", F.col("known_id").alias("keep_id"), "keep_serial", "group_size",
        (F.col("batch") == batch).alias("is_new")), "digest-found")
    return light.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("is_new") & (F.col("serial") == F.col("keep_serial"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "text_key")


def dedup_stage(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    return keep_documents(docs, exact_dedup(docs, index, batch).filter("kept"), once=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents),
     g AS (SELECT s, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
           FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept, s AS text_sha256
FROM d JOIN g USING (s)
"""
