"""The row-local operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lexmill.operators.feedback import feedback, long_features
from lexmill.operators.variation import variation_basic


def read_texts(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """Parquet files as a stream: a folder, or one file of a folder. files bounds how many each batch takes."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def stream_features(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Closed-form variation indices of each text; no state, so any trigger and output mode append works."""
    return variation_basic(texts, key, text)


def stream_feedback(features: DataFrame, thresholds: DataFrame, names: list[str], by: list[str], key: list[str], size: int) -> DataFrame:
    """Feedback by a join of the stream with static thresholds (size rows)."""
    return feedback(long_features(features, names, [*key, *by]), thresholds, by, size=size)


def write_checkpointed(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; the checkpoint makes each batch count once. Runs through what is there, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
