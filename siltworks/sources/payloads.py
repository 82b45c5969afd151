"""Landed API responses: JSON documents and XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted

# The field of a JSON object that holds the rows, and the node of one XML record.
RESULTS_FIELD = "results"
RECORD_NODE = "Record"


def _schema_text(row: T.StructType) -> tuple[str, str]:
    array = T.ArrayType(row)
    document = T.StructType([T.StructField(RESULTS_FIELD, array)])
    return array.simpleString(), document.simpleString()


def payload_rows(payloads: DataFrame, column: str, row: T.StructType) -> DataFrame:
    """Rows held by a column of response bodies.

    A list is the rows; an object gives the list under ``results``, or nothing
    when it has none; any other body stops the job.
    """
    body = F.trim(F.col(quoted(column)))
    as_list, as_object = _schema_text(row)
    start = F.substring(body, 1, 1)
    problem = F.raise_error(F.lit("payload is neither a JSON list nor a JSON object"))
    rows = (
        F.when(body.isNull(), F.lit(None))
        .when(start == "[", F.from_json(body, as_list, {"mode": "FAILFAST"}))
        .when(start == "{", F.from_json(body, as_object, {"mode": "FAILFAST"})[RESULTS_FIELD])
        .otherwise(problem.cast(as_list))
    )
    return payloads.select(F.inline(rows))


def read_json_payloads(spark: SparkSession, path: str | list[str], row: T.StructType) -> DataFrame:
    """Rows of landed JSON responses, one response per file.

    A response is one page of an API, so a file is a unit that one task can hold.
    """
    return payload_rows(spark.read.text(path, wholetext=True), "value", row)


def _array_leaves(tag: str, c: Column, dtype: T.DataType) -> list[tuple[str, Column]]:
    if isinstance(dtype, T.ArrayType):
        return _array_leaves(tag, F.try_element_at(c, F.lit(-1)), dtype.elementType)
    if isinstance(dtype, T.StructType):
        found = []
        for field in dtype.fields:
            name = tag if field.name == "_VALUE" else field.name
            found += _array_leaves(name, c.getField(field.name), field.dataType)
        return found
    return [(tag, c)]


def flatten_leaves(df: DataFrame) -> DataFrame:
    """One column per leaf tag of nested records; of equal tags the last wins."""
    leaves: dict[str, Column] = {}
    for field in df.schema.fields:
        for tag, value in _array_leaves(field.name, F.col(quoted(field.name)), field.dataType):
            earlier = leaves.get(tag)
            leaves[tag] = value if earlier is None else F.coalesce(value, earlier)
    return df.select(*[c.alias(tag) for tag, c in leaves.items()])


def read_xml_records(
    spark: SparkSession,
    path: str | list[str],
    row_tag: str = RECORD_NODE,
    schema: T.StructType | None = None,
    infer_types: bool = False,
) -> DataFrame:
    """One row per record node, one column per descendant tag, as text unless told otherwise.

    Records may span lines, so a file is read by one task: large ones are landed in parts.
    """
    reader = spark.read.format("xml").options(rowTag=row_tag, inferSchema=infer_types, excludeAttribute=True)
    return flatten_leaves((reader.schema(schema) if schema is not None else reader).load(path))
