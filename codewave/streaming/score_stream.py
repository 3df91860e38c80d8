"""Scoring of a folder into which new waves arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codewave.operators.score import score_wave
from codewave.operators.train import Classifier
from codewave.plans.code_wave import publish_wave


def score_wave_stream(
    spark: SparkSession,
    model: Classifier,
    folder: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    text_cols: Sequence[str] = ("oficio", "tareas"),
    max_files: int = 100,
) -> StreamingQuery:
    """Score every file not scored yet, then stop; the checkpoint remembers the files.

    Each batch is scored as a wave is and written under its own number, ``batch=<n>``. A batch
    that is run again after a failure replaces what it wrote before.
    """
    waves = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        score_wave(model, batch, text_cols).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = waves.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def code_wave_stream(
    spark: SparkSession,
    model: Classifier,
    folder: str,
    schema: T.StructType,
    catalogue: DataFrame,
    ident: str,
    reviewers: Sequence[str],
    root: str,
    checkpoint: str,
    max_files: int = 1,
    **options,
) -> StreamingQuery:
    """Both sheets of every wave file that has arrived, one published version per batch.

    The version is the number of the batch, so a batch that runs again after its sheets were
    delivered delivers nothing, and one that was stopped between the sheets replaces them.
    """
    waves = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)

    def deliver(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish_wave(model, batch, catalogue, ident, reviewers, root, f"{number:010d}", **options)

    query = waves.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
