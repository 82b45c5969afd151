"""Check a table against a contract, as one projection and no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.contracts.model import Contract
from siltworks.functions.coercion import coerce
from siltworks.functions.names import quoted

TYPED = "_typed"
ERRORS = "_errors"
OK = "_ok"


class ContractError(ValueError):
    """The table does not have the columns its contract asks for."""


def check_columns(df: DataFrame, contract: Contract, strict: bool = True) -> None:
    missing = sorted(set(contract.columns) - set(df.columns))
    extra = sorted(set(df.columns) - set(contract.columns))
    if missing:
        raise ContractError(f"{contract.name}: required columns missing: {missing}")
    if strict and extra:
        raise ContractError(f"{contract.name}: unexpected columns: {extra}")


def annotate(df: DataFrame, contract: Contract, strict: bool = True) -> DataFrame:
    """The input columns plus ``_typed`` (the coerced row), ``_errors`` and ``_ok``.

    ``_errors`` is an array of ``field`` and ``error``; the error is ``null``,
    ``type`` or the name of a check. ``_ok`` says the same as an empty array but
    is cheap to filter by: errors are worked out for refused rows only.
    """
    check_columns(df, contract, strict)
    types = {f.name: f.dataType for f in df.schema.fields}
    values, errors, ok = [], [], F.lit(True)
    for field in contract.fields:
        raw = F.col(quoted(field.name))
        value = coerce(raw, types[field.name], field.kind)
        values.append(value.alias(field.name))
        if field.nullable:
            errors.append(F.when(raw.isNotNull() & value.isNull(), _error(field.name, "type")))
            ok &= raw.isNull() | value.isNotNull()
        else:
            errors.append(F.when(raw.isNull(), _error(field.name, "null")).when(value.isNull(), _error(field.name, "type")))
            ok &= value.isNotNull()
    found = {TYPED: F.struct(*values), ERRORS: F.array_compact(F.array(*errors)), OK: ok}
    result = df.withColumns(found)
    return _with_check_errors(result, contract) if contract.checks else result


def _error(field: str, error: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(error).alias("error"))


def _with_check_errors(annotated: DataFrame, contract: Contract) -> DataFrame:
    """Add the failed checks; their predicates see the typed columns by name."""
    packed = annotated.select(F.struct("*").alias("_row"), f"{TYPED}.*")
    failed = [F.when(~F.expr(check.predicate), _error("*", check.name)) for check in contract.checks]
    passed = F.lit(True)
    for check in contract.checks:
        passed &= F.coalesce(F.expr(check.predicate), F.lit(True))
    found = packed.select("_row", F.array_compact(F.array(*failed)).alias("_failed"), passed.alias("_passed"))
    return found.select("_row.*", "_failed", "_passed").select(
        *[F.col(quoted(c)) for c in annotated.columns if c not in (ERRORS, OK)],
        F.concat(ERRORS, "_failed").alias(ERRORS),
        (F.col(OK) & F.col("_passed")).alias(OK),
    )


def accepted(annotated: DataFrame) -> DataFrame:
    """The typed rows without errors, in contract order."""
    return annotated.filter(OK).select(f"{TYPED}.*")


def rejected(annotated: DataFrame) -> DataFrame:
    """The rows with errors exactly as they came in, plus ``_errors``."""
    return annotated.filter(~F.col(OK)).drop(TYPED, OK)


def error_counts(annotated: DataFrame) -> DataFrame:
    """Number of rows per field and kind of error."""
    return (
        annotated.filter(~F.col(OK))
        .select(F.explode(ERRORS).alias("e"))
        .groupBy(F.col("e.field").alias("field"), F.col("e.error").alias("error"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def enforce(df: DataFrame, contract: Contract, strict: bool = True) -> DataFrame:
    """All or nothing: the job that reads the result fails on the first bad row.

    The check rides in a filter of that same job, so the input is read once and
    an uncommitted write leaves nothing behind.
    """
    checked = annotate(df, contract, strict)
    message = F.concat(F.lit(f"{contract.name}: row refused: "), F.to_json(ERRORS))
    passes = F.when(F.col(OK), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(passes).select(f"{TYPED}.*")
