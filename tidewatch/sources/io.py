"""Sources and sinks (O-A1, O-A2, O-A5..A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import read_labeled_posts  # noqa: F401  (O-A2)
from ..operators.matching import load_terms

MESSAGE_SCHEMA = ("message_id bigint, guild_id bigint, channel_id bigint, channel_name string, "
                  "author_id bigint, author_name string, content string, created_at timestamp_ntz, "
                  "jump_url string")


def read_messages(spark: SparkSession, path: str, streaming: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """O-A1: the message feed with a fixed schema (no inference), batch or stream."""
    if not streaming:
        return spark.read.schema(MESSAGE_SCHEMA).parquet(path)
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def read_terms(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """O-A5: a term list file (one term per line, or a ``term`` column)."""
    df = spark.read.text(path).withColumnRenamed("value", "term") if fmt == "text" \
        else spark.read.format(fmt).load(path)
    return load_terms(df, "term")


def _append(df: DataFrame, path: str, checkpoint: str | None = None, partition_by=None):
    if df.isStreaming:
        if not checkpoint:
            raise ValueError("a streaming sink needs a checkpoint location in shared storage")
        w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        return w.start(path)
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return None


def write_decisions(df: DataFrame, path: str, checkpoint: str | None = None):
    """O-A6: every evaluated message with score and reason."""
    return _append(df, path, checkpoint)


def write_reports(df: DataFrame, path: str, checkpoint: str | None = None):
    """O-A7: user and automatic reports."""
    return _append(df, path, checkpoint)


def write_notifications(df: DataFrame, path: str, checkpoint: str | None = None):
    """O-A8: notices as rows (recipient, text)."""
    return _append(df, path, checkpoint)


def batch_overwrite(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent micro-batch write: a replayed batch replaces its own slice."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
        f"{path}/batch_id={batch_id}")
