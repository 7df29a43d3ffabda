"""Incremental indexing as a stream: new text rows are chunked and appended to a lexical index.

An extension beyond batch indexing: a file source feeds ``foreachBatch``, each batch is written under its id, so a
batch that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import chunking, lexical


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def index_batch(batch: DataFrame, batch_id: int, where: str) -> None:
    """Chunk a batch and write its postings and lengths."""
    chunks = chunking.line_windows(batch.select("doc_id", F.col("text").alias("content")))
    chunks = chunks.withColumn("chunk_id", F.col("doc_id") * 100_000 + F.floor((F.col("start_line") - 1) / (chunking.WINDOW - chunking.OVERLAP)))
    index = lexical.Index.build(chunks, "chunk_id", {"content": F.col("content")})
    index.postings.write.mode("overwrite").parquet(f"{where}/postings/batch={batch_id}")
    index.lengths.write.mode("overwrite").parquet(f"{where}/lengths/batch={batch_id}")


def start(stream: DataFrame, where: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, i: index_batch(df, i, where)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, where: str) -> lexical.Index:
    return lexical.Index(spark.read.parquet(f"{where}/postings").drop("batch"), spark.read.parquet(f"{where}/lengths").drop("batch"))
