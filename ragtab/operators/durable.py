"""Answers that outlive a failed job (G6, G8): pending calls are drained as committed micro-batches.

A distinct (system, prompt, model) is one call, keyed by its digest. Calls without an answer in the
store are queued as files; a stream with the ``availableNow`` trigger takes a few files at a time,
scores them and commits their answers as one batch of the store (``sources.batches``). A job that
dies midway, whatever kills it, keeps every batch that it has committed; the next run queues the
rest only. A micro-batch that is retried replaces its own answers. Calls that raise are kept with
their error and are tried again by the next run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtab.functions.text import words_per_second
from ragtab.operators.answer import GEN_KEYS, GEN_SCHEMA, context_echo_scorer, score_calls
from ragtab.session import ensure_checkpoint_dir, work_path
from ragtab.sources.batches import BatchTables

ANSWERS = "call string, " + GEN_SCHEMA
#: Calls of a queue file at least, and files of a micro-batch for each core of the cluster.
FILE_CALLS, FILES_A_CORE = 64, 1
#: Micro-batches of a run about, however many calls: each costs a few jobs and a commit, and is what a dead job loses at most.
BATCHES = 32


def call_key():
    """The digest of a call; a null prompt differs from an empty one."""
    parts = [F.coalesce(F.concat(F.octet_length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-")) for k in GEN_KEYS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def answer_store(spark: SparkSession, path: str) -> BatchTables:
    """The store at ``path``; a new one if there is none."""
    try:
        return BatchTables.open(spark, path)
    except ValueError:
        return BatchTables.create(spark, path)


def stored_answers(store: BatchTables) -> DataFrame:
    """The last answer of each call, errors only where no run got an answer."""
    rows = store.read("answers", ANSWERS)
    best = rows.groupBy("call").agg(F.max_by(F.struct(*GEN_KEYS, "llm_response", "elapsed", "error"), F.col("error").isNull()).alias("r"))
    return best.select("call", "r.*")


def pending_calls(df: DataFrame, store: BatchTables) -> DataFrame:
    """The distinct calls of ``df`` without an answer."""
    done = stored_answers(store).where("error IS NULL").select("call")
    return df.select(*GEN_KEYS).distinct().withColumn("call", call_key()).join(done, "call", "left_anti")


def drain(df: DataFrame, store: BatchTables, scorer: Callable = context_echo_scorer, *, options: dict | None = None,
          setup: Callable | None = None, files_a_batch: int | None = None, file_calls: int | None = None) -> None:
    """Runs the pending calls of ``df`` and commits their answers, micro-batch by micro-batch. Without ``file_calls`` the queue
    files grow with the calls, so that there are about ``BATCHES`` micro-batches at most."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    queue, name = work_path(spark, "calls"), work_path(spark, "calls-progress")
    ensure_checkpoint_dir(spark)
    pending = pending_calls(df, store).checkpoint(eager=True)  # counted and queued
    if file_calls is None:
        file_calls = max(FILE_CALLS, -(-pending.count() // (cores * FILES_A_CORE * BATCHES)))
    (pending.repartition(cores, "call").write.option("maxRecordsPerFile", file_calls).parquet(queue))
    run = queue.rstrip("/").rsplit("/", 1)[-1]

    def each(batch: DataFrame, batch_id: int) -> None:
        here = BatchTables(batch.sparkSession, store.path)
        scored = score_calls(batch.select(*GEN_KEYS), scorer, options, setup).withColumn("call", call_key())
        here.put(f"{run}-{batch_id}", {"answers": scored.select("call", *[c.split()[0] for c in GEN_SCHEMA.split(", ")])})

    stream = spark.readStream.schema(pending.schema).option("maxFilesPerTrigger", files_a_batch or FILES_A_CORE * cores).parquet(queue)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", name).trigger(availableNow=True).start().awaitTermination()


def generate_durably(df: DataFrame, path: str, scorer: Callable = context_echo_scorer, **how) -> DataFrame:
    """``answer.generate`` with a store at ``path`` that keeps every committed answer: df's columns, llm_response, time, tps, error."""
    store = answer_store(df.sparkSession, path)
    drain(df, store, scorer, **how)
    answers = stored_answers(store.snapshot()).select("call", "llm_response", F.col("elapsed").alias("time"), "error")
    out = df.withColumn("call", call_key()).join(answers, "call", "left").drop("call")
    return out.withColumn("tps", words_per_second("llm_response", "time"))
