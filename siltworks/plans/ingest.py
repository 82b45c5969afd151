"""From a read source to bronze, through its contract, with an audit row."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from siltworks.contracts.model import Contract
from siltworks.contracts.validate import accepted, annotate, enforce, rejected
from siltworks.session import materialize
from siltworks.sinks.audit import AuditEntry, append_audit
from siltworks.sinks.files import bronze_name, write_bronze, write_table

MODES = ("fail", "quarantine", "drop")


@dataclass(frozen=True)
class Ingested:
    entry: AuditEntry
    rejects_path: str | None = None


def ingest(
    df: DataFrame,
    contract: Contract,
    root: str,
    origin: str,
    run_time: datetime,
    mode: str = "fail",
    strict: bool = True,
    framework: str = "spark",
    file_format: str = "csv",
    source_url: str | None = None,
) -> Ingested:
    """Write the rows that keep the contract to bronze.

    ``fail`` writes nothing if any row breaks it, ``quarantine`` writes the
    broken rows with their errors beside the others, ``drop`` leaves them out.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, use one of {MODES}")
    if mode == "fail":
        rows, rejects_path = enforce(df, contract, strict), None
    else:
        checked = annotate(df, contract, strict)
        if mode == "quarantine":
            # Two outputs: the source is read and checked once, both come from the written copy.
            checked = materialize(checked, "checked")
        rows, rejects_path = accepted(checked), None
        if mode == "quarantine":
            rejects_path = f"{root.rstrip('/')}/quarantine/{bronze_name(origin, framework, run_time)}.json"
            write_table(rejected(checked), rejects_path, "json")
    entry = write_bronze(rows, root, origin, run_time, framework, file_format, source_url)
    append_audit(df.sparkSession, root, [entry])
    return Ingested(entry, rejects_path)
