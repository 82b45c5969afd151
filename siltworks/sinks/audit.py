"""One audit row per ingest."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "origin string, framework string, timestamp timestamp_ntz, status string, data_file string, "
    "rows bigint, columns int, columns_types map<string,string>, source_url string"
)


@dataclass(frozen=True)
class AuditEntry:
    origin: str
    framework: str
    timestamp: datetime
    status: str
    data_file: str
    rows: int
    columns: int
    columns_types: dict[str, str]
    source_url: str | None = None


def audit_frame(spark: SparkSession, entries: list[AuditEntry]) -> DataFrame:
    rows = [
        (e.origin, e.framework, e.timestamp, e.status, e.data_file, e.rows, e.columns, e.columns_types, e.source_url)
        for e in entries
    ]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def append_audit(spark: SparkSession, root: str, entries: list[AuditEntry]) -> str:
    """Append to ``metadata/year=/month=/day=`` below the root, as JSON lines."""
    path = f"{root.rstrip('/')}/metadata"
    dated = audit_frame(spark, entries).withColumns({
        "year": F.date_format("timestamp", "yyyy"),
        "month": F.date_format("timestamp", "MM"),
        "day": F.date_format("timestamp", "dd"),
    })
    dated.write.mode("append").partitionBy("year", "month", "day").json(path)
    return path


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    schema = f"{AUDIT_SCHEMA}, year string, month string, day string"
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/metadata")
