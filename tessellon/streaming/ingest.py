"""An extension, not part of the batch engine's parity: documents chunked as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessellon.operators.chunking import token_chunks


def arriving_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest_chunks(documents: DataFrame, table: str, checkpoint: str, size: int = 400, overlap: int = 200) -> StreamingQuery:
    """Write the token chunks of documents as they come. Each micro-batch overwrites a folder of its own, so a repeated one changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        token_chunks(batch, size, overlap).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
