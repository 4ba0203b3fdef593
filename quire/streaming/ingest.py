"""Documents that keep arriving: the row-wise transforms run unchanged on a stream, the rest by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import chunks, correction
from quire.sources import layout

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_at_once: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def chunked(docs: DataFrame, max_tokens: int = chunks.MAX_TOKENS, overlap: int = chunks.OVERLAP) -> DataFrame:
    """Fixed-size chunks of each document as it arrives: no state, no shuffle."""
    return chunks.fixed_size(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), max_tokens, overlap)


def scored(docs: DataFrame) -> DataFrame:
    return correction.quality(docs)


def pages(docs: DataFrame) -> DataFrame:
    return layout.pages(docs)


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once, until no more files are there."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to any batch plan, such as a conversion or the merge of learned words."""
    return stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_learned(old: DataFrame, new: DataFrame) -> DataFrame:
    """word, occurrences, confidence, contexts: occurrences add up, and each further one makes a word surer."""
    both = old.unionByName(new)
    return both.groupBy("word").agg(
        F.sum("occurrences").alias("occurrences"), F.least(F.lit(1.0), F.max("confidence") + 0.1 * (F.sum("occurrences") - F.max("occurrences"))).alias("confidence"), F.max("contexts").alias("contexts")
    )
