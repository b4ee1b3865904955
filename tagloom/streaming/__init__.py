"""Decoding and scoring of sentence streams with the batch operators; ``lines`` makes sentences of raw lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import features as fx
from tagloom.operators.decode import MAX_BROADCAST_WEIGHTS, decode, output_schema
from tagloom.operators.evaluate import BOUNDARY, chunk_counts
from tagloom.runtime import scratch_path


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream a Parquet table, which may be one file or a directory of files."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    # A stream takes a plain path for a directory; a pattern may match a file as well.
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_decode(sentences: DataFrame, weights: DataFrame, families: tuple[str, ...] = fx.DECODER_FAMILIES) -> DataFrame:
    """Decode each sentence of a stream as it arrives; the model is static, there is no state.

    Only for models small enough to broadcast; ``decode_to`` takes any.
    """
    return decode(sentences, weights, families)


def decode_batch(weights: DataFrame, path: str, families: tuple[str, ...], max_broadcast: int) -> Callable[[DataFrame, int], None]:
    """The work of ``decode_to`` on one micro-batch."""

    def run(batch: DataFrame, number: int) -> None:
        # The joined decoder reads its sentences more than once; a stateful stream must run once per batch.
        batch.persist()
        found = decode(batch, weights, families, max_broadcast=max_broadcast)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return run


def decode_to(
    sentences: DataFrame, weights: DataFrame, path: str, progress: str | None = None,
    families: tuple[str, ...] = fx.DECODER_FAMILIES, max_broadcast: int = MAX_BROADCAST_WEIGHTS,
) -> StreamingQuery:
    """Decode a stream with a model of any size into the Parquet table ``path``, and return the running query.

    Every micro-batch is a batch job, so a model too large to broadcast is joined by shard. A batch has a folder
    of its own, which a batch that runs again writes anew: with ``progress``, the checkpoint, kept, a
    restart neither loses nor doubles a sentence. The column ``batch`` is the batch's number.
    """
    work = decode_batch(weights, path, families, max_broadcast)
    progress = progress or scratch_path(sentences.sparkSession, "progress")
    writer = sentences.writeStream.option("checkpointLocation", progress).foreachBatch(work)
    return writer.trigger(availableNow=True).start()


def run_decoded(sentences: DataFrame, weights: DataFrame, families: tuple[str, ...] = fx.DECODER_FAMILIES) -> DataFrame:
    """Decode a stream over the data at hand, with a model of any size, and return the decoded sentences."""
    path = scratch_path(sentences.sparkSession, "decoded")
    decode_to(sentences, weights, path, families=families).awaitTermination()
    return sentences.sparkSession.read.schema(output_schema(sentences)).parquet(path)


def stream_counts(sentences: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Running chunk counts per type of a stream of labelled sentences.

    A sentence is counted inside its row, so the state is one row per chunk type.
    """
    return chunk_counts(sentences, boundary)


def run_to_files(stream: DataFrame) -> DataFrame:
    """Run a stream over the data at hand and return the rows it appended."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, "progress"))
    writer.trigger(availableNow=True).outputMode("append").format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out)


def run_counts(stream: DataFrame) -> DataFrame:
    """Run a counting stream over the data at hand and return the final counts.

    The memory sink suits them: a row per chunk type.
    """
    spark = stream.sparkSession
    name = f"counts_{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, "progress"))
    writer.trigger(availableNow=True).outputMode("complete").format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def run_updates(stream: DataFrame) -> DataFrame:
    """Run a stream in update mode over the data at hand and return the rows of all its updates.

    Like ``decode_to``, a batch that runs again replaces its rows.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, "progress")).foreachBatch(keep)
    writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")
