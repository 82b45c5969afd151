"""New files to silver, and deduplication of a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltworks.functions.names import free_names, quoted
from siltworks.operators.columns import Processor, run_all


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    max_files: int | None = None,
    **options,
) -> DataFrame:
    """A folder as a stream of its new files.

    ``max_files`` bounds what one step takes on, and with it the state and
    shuffle of that step.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if file_format == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_new(
    stream: DataFrame,
    destination: str,
    checkpoint: str,
    processors: Iterable[Processor] = (),
    file_format: str = "parquet",
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Process everything that has not been processed yet, then stop.

    The checkpoint remembers the files; the file sink commits each step once.
    A second run adds only new files. Steps that learn from data take values
    fitted on a batch (``apply_cleaning`` with stored statistics).
    """
    writer = (
        run_all(stream, processors)
        .writeStream.format(file_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(destination)
    query.awaitTermination()
    return query


def dedupe_stream(
    stream: DataFrame, keys: list[str], event_time: str, delay: str, salts: int = 16
) -> DataFrame:
    """First row of each key within the delay.

    A stream is shuffled by key without combining first, so one hot key would
    send all its rows to one task. Rows are first deduplicated per key and salt,
    which leaves at most ``salts`` rows per key for the step that decides.
    """
    timed = stream.withColumn(event_time, F.col(quoted(event_time)).cast("timestamp")).withWatermark(event_time, delay)
    if salts <= 1:
        return timed.dropDuplicatesWithinWatermark(keys)
    (salt,) = free_names(stream.columns, "_salt")
    salted = timed.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([*keys, salt]).drop(salt).dropDuplicatesWithinWatermark(keys)
