"""Incremental chunking: a file stream of documents, chunked and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_corpus
from ..sources.keyed import KeyedTable

DOCUMENT = "source_id string, instrument_type string, jurisdiction string, full_text string"
#: Batches that a chunk table gathers before it is compacted.
MOST = 16


def chunk_table(spark: SparkSession, path: str) -> KeyedTable:
    """Chunks, replaced document by document."""
    return KeyedTable(spark, path, ["source_id"])


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet documents as they arrive and keep a chunk table.

    A batch replaces all chunks of the documents it brings (of a document that
    comes twice in a batch the greatest row counts); a document whose text is
    null or empty loses its chunks.  A batch writes its own chunks only, and one
    that runs again after a failure changes nothing more.
    """
    table = chunk_table(spark, target)

    def merge(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "source_id"]
        docs = batch.groupBy("source_id").agg(F.max(F.struct(*rest)).alias("d")).select("source_id", "d.*")
        table.merge(chunk_corpus(docs), number, gone=docs)
        if table.pending() > MOST:
            table.compact()

    return spark.readStream.schema(DOCUMENT).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
