"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import bpe, fm, jpeg, mixing, pii, quality, secrets, simhash, toxicity, vectors, warc
from tessellon.session import table

BPE_FILE = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the decoded bytes."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of personal data, the digest of the base spans, and all spans."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a JPEG, and figures of the bytes and the thumbnail read back from it."""
    return jpeg.read_texts(jpeg.store_texts(table(spark, sf_dir, "documents")))


def _scored(spark: SparkSession, sf_dir: str, model, parts: int, held: int) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = model.learn(docs, labels, fm.remainder(F.col("doc_id"), parts) != held)
    scores = model.score(docs, machine)
    return scores.select("doc_id", (fm.remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of the held-out third are never learned from."""
    return _scored(spark, sf_dir, quality, 3, 1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document that it reaches by links."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of the held-out fifth are never learned from."""
    return _scored(spark, sf_dir, toxicity, 5, 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives that the legacy records were converted to."""
    return warc.convert(table(spark, sf_dir, "pages"), version=2)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 or more and the smallest vector that it reaches by them."""
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, with the forest's score and verdict."""
    words = public_tokenizers.path(BPE_FILE)
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.trained(secrets.labelled_findings(), words), words)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    found = (op1_bpe, op2_pii, op3_jpeg, op4_quality, op5_simhash, op6_toxicity, op7_warc, op8_vectors, op9_secrets, op10_mix)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op7_warc": warc.ORACLE, "op10_mix": mixing.ORACLE}
