"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from . import (bpe, exact_dedup, langid, license_scan, merkle, mtree, ngram_join, packing, quality, suffix_dedup, toxicity, warc,
               whitening)


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark, sf_dir):
    found = license_scan.license_scan(license_scan.document_files(_read(spark, sf_dir, "documents")))
    return found.withColumnRenamed("key", "doc_id")


def op2_warc(spark, sf_dir):
    return warc.warc_roundtrip(_read(spark, sf_dir, "pages"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.similarity_join(_read(spark, sf_dir, "documents")).drop("text_key", "group")


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).drop("text_key")


def op6_bpe(spark, sf_dir):
    return bpe.roundtrip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark, sf_dir):
    return packing.packed_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark, sf_dir):
    return quality.quality(_read(spark, sf_dir, "documents")).drop("text_key")


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op10_langid(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents")).drop("text_key")


def op11_mtree_topk(spark, sf_dir):
    return mtree.exact_top_k(_read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.merkle_manifest(_read(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc, op3_ngram_join, op4_toxicity, op5_exact_dedup, op6_bpe, op7_packing, op8_quality,
                                  op9_suffix_dedup, op10_langid, op11_mtree_topk, op12_merkle_manifest, op13_whitening)}
ORACLE = {"op2_warc": warc.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE,
          "op9_suffix_dedup": suffix_dedup.ORACLE, "op11_mtree_topk": mtree.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
