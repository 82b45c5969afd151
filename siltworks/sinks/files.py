"""Write tables to files. Every task writes its own part; nothing is gathered first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted
from siltworks.sinks.audit import AuditEntry
from siltworks.sources.files import UnsupportedFormat

# Layers, output formats and the time stamps in file names.
LAYERS = ("bronze", "silver", "gold", "temp")
FORMATS = ("parquet", "csv", "json")
BRONZE_STAMP = "%Y-%m-%d_%H%M%S"
PROCESSED_STAMP = "%Y%m%d_%H%M%S"
# Spark's own text formats cut times to milliseconds.
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def layer_path(root: str, layer: str, *parts: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}, use one of {LAYERS}")
    return "/".join([root.rstrip("/"), layer, *parts])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats with flat cells."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({n: F.to_json(F.col(quoted(n))) for n in nested}) if nested else df


def write_table(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
    **options,
) -> None:
    """Write Parquet, CSV with a header row, or JSON lines."""
    if file_format not in FORMATS:
        raise UnsupportedFormat(f"cannot write {file_format!r}, use one of {FORMATS}")
    if file_format != "parquet":
        options = {**TEXT_TIMES, **options}
    if file_format == "csv":
        df, options = nested_to_json(df), {"header": True, **options}
    writer = df.write.mode(mode).format(file_format).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def bronze_name(origin: str, framework: str, run_time: datetime) -> str:
    return f"{origin}_{framework}_{run_time.strftime(BRONZE_STAMP)}"


def write_bronze(
    df: DataFrame,
    root: str,
    origin: str,
    run_time: datetime,
    framework: str = "spark",
    file_format: str = "csv",
    source_url: str | None = None,
) -> AuditEntry:
    """Write a table to the bronze layer and describe it.

    Rows are counted while they are written, not by a second job.
    """
    path = layer_path(root, "bronze", f"{bronze_name(origin, framework, run_time)}.{file_format}")
    counted = Observation()
    write_table(df.observe(counted, F.count(F.lit(1)).alias("rows")), path, file_format)
    return AuditEntry(
        origin=origin,
        framework=framework,
        timestamp=run_time,
        status="success",
        data_file=path,
        rows=counted.get["rows"],
        columns=len(df.columns),
        columns_types=dict(df.dtypes),
        source_url=source_url,
    )


def processed_name(file_name, run_time: datetime, file_format: str):
    """Column with the output name of a source file: stem, run time, format."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.concat(stem, F.lit(f"_processed_{run_time.strftime(PROCESSED_STAMP)}.{file_format}"))


def write_per_source(
    df: DataFrame, path: str, source_file: str, run_time: datetime, file_format: str = "parquet", mode: str = "append"
) -> None:
    """One output folder per source file, all in one job.

    The rebalance brings rows of a file together so that a folder gets few
    parts, and still splits a file that is much larger than the others.
    """
    if any(c.lower() == "output" for c in df.columns):
        raise ValueError("the column 'output' names the folders: rename it first")
    output = df.withColumn("output", processed_name(F.col(quoted(source_file)), run_time, file_format))
    write_table(output.hint("rebalance", F.col("output")), path, file_format, mode, ["output"])
