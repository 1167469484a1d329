"""Unbounded input: a file stream on the left of stateless operators, static tables on the right.

Select, filter, inner and left joins, any/none/all/not-all matches, concat and grouped aggregates work; what needs a whole
input (sort, skip, windows, right and full joins) raises a TypeError.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..stream import RecordStream


def parquet_stream(spark: SparkSession, path: str, like: str, max_files_per_trigger: int | None = None) -> RecordStream:
    """Files as they arrive in ``path``, with the schema of the Parquet data at ``like``."""
    reader = spark.readStream.schema(spark.read.parquet(like).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return RecordStream.of(reader.parquet(path))


def write_parquet(stream: RecordStream, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once; ``available_now`` handles what is there and stops."""
    writer = stream.to_df().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
