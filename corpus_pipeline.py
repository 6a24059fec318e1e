"""From raw documents to token ids: five stages, each by one operator of ``tessellon.llm``.

Each stage takes the documents that the one before it kept and returns the documents it
keeps, with the same columns; the last returns token ids. Null and empty texts are
documents like any other: they score as such, fold into one group, hold no personal
data, have size 0 and no tokens. An empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import bpe, fm, mixing, near_copies, pii, toxicity
from tessellon.llm.queries import BPE_FILE
from tessellon.session import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject; it learns from the labels outside the held-out fold."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), fm.remainder(F.col("doc_id"), 5) != 0)
    return toxicity.kept(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by SimHash fingerprints and a check on five-word shingles."""
    return near_copies.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with their count and the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Models, component search and merging by rank have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
