"""Extension: the narrow operators on a stream of files. They keep no state, so there is no watermark to set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import structure
from foliospark.options import EXCLUDED_SECTIONS


def documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(name, text) of each new file of a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def outlines(docs: DataFrame, keywords=EXCLUDED_SECTIONS) -> DataFrame:
    return docs.select("name", structure.outline(structure.remove_sections(F.col("text"), keywords)).alias("outline"))


def start(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and ends; exactly once per file by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
