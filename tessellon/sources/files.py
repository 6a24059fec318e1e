"""File sources and sinks. Paths are opened by Spark alone."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the two forms of stored chunks.
CHUNK = ("document_id", "content", "tokens", "type", "is_processed")
POSITIONED = (*CHUNK, "start", "end")
REFERENCES = "array<struct<content:string,start_index:int,end_index:int>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(corpus_id, path, content): each text file of a folder whole, named by its stem."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("corpus_id"), F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, references, corpus_id) from CSV; an empty typed table where there is no file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"question string, references {REFERENCES}, corpus_id string")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="question string, references string, corpus_id string")
    return raw.withColumn("references", F.from_json("references", REFERENCES))


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, content) of binary files by a pluggable parser that gives text or markup."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: parse(bytes(b)))

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("content"))


_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")


def html_to_text(raw: bytes | str) -> str:
    """Visible text of a web page, a line for each block."""
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub("", text))))
    return "\n".join(line for x in text.split("\n") if (line := " ".join(x.split())))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """A Parquet table; writing again overwrites, so a run repeated gives the same table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_chunks(df: DataFrame, path: str, positioned: bool = True, mode: str = "append") -> None:
    """Chunks in their five or seven columns, by type; one whose state is not given counts as not processed."""
    rows = df if "is_processed" in df.columns else df.withColumn("is_processed", F.lit(False))
    write_table(rows.select(*(POSITIONED if positioned else CHUNK)), path, ("type",), mode)


def write_documents(df: DataFrame, path: str, first: int = 1, key: str = "path") -> DataFrame:
    """Documents with ids that go on from ``first`` in the order of a natural key, stored and read again with them."""
    from tessellon.operators.tables import numbered

    write_table(numbered(df, [key], "document_id", first), path, mode="append")
    return df.sparkSession.read.parquet(path).where(F.col("document_id") >= first)


def read_database(spark: SparkSession, url: str, name: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database over JDBC, in ``parts`` ranges of a number column where one is named. The driver's jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Results as CSV with a header, or as JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError("reports are csv or json")
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def document_mapping(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Distinct documents over data sets (document, dataset, item_id), first data set first, and the count of each."""
    from tessellon.operators.tables import first_seen

    tagged = [d.select("document", F.lit(name).alias("dataset"), "item_id") for name, d in parts.items()]
    unique = first_seen(tagged, "document")
    return unique, unique.groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"))
