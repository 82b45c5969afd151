import json
import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.contracts import Check, Contract, ContractError, Field, accepted, annotate, enforce, error_counts, rejected
from siltworks.contracts.catalog import CATALOG, PRODUCT_CSV
from siltworks.functions.coercion import KINDS, coerce

TEXTS = {
    "int": [
        "12", " 12 ", "1.0", "1.", "+5", "-3", "1_000", "1__0", "1.5", "1e3", "", "\t7\n", "0012", "-0", "1.000",
        "_1", "1_", "1.0_0", "+ 5", "\xa05", "abc", "9223372036854775807",
    ],
    "float": [
        "1.5", "nan", "inf", "-Infinity", "1e5", " 1.5 ", "1_0.5", "1.5d", ".5", "5.", "", "0x10", "1._5", "+nan",
        "1e1_0", "_1", "abc", "1__0", "-.5e-3",
    ],
    "bool": [
        "true", "T", "Yes", "Y", "on", "1", "off", "N", "2", " true ", "1.0", "TRUE", "", "f", "0", "no", "False",
    ],
    "str": ["a", "", " x "],
    "datetime": [
        "2024-01-02", "2024-01-02T03:04", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z",
        "2024-01-02T03:04:05.123456789", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05-0300",
        "2024-01-02t03:04:05z", "2024-01-02_03:04", "01/02/2024", "2024", "1700000000", "1700000000.5",
        "1700000000000", " 2024-01-02 ", "2024-1-2", "2024-02-30", "20240102", "2024-01-02T24:00", "2024-01-02T03",
        "2e10", "-1", "+1", "2024-01-02T03:04:05 +02:00", "2024-01-02T03:04:05,123", "2024-01-02 03:04:60", "nan",
        "1e5", "2024-01-02T03:04:05+02", "0001-01-01", ".5", "5.", "2024-01-02T03:04Z ", "2024-01-02T03:04:05.", "",
        "2024-01-02\n", "17\n",
    ],
}
NUMBERS = {
    "int": [1.0, 1.5, -3.0, 1e18, math.nan, math.inf, 0.0],
    "float": [1.5, math.nan, math.inf],
    "bool": [0.0, 1.0, 2.0, 0.5],
    "str": [1.0],
    "datetime": [0.0, 1.5e9, 2e10, 20000000001.0, -20000000001.0, 1e12, math.nan, -62135596800.0],
}
PYTHON = {"int": int, "float": float, "bool": bool, "str": str, "datetime": datetime}


def _pydantic(kind, value):
    adapter = pytest.importorskip("pydantic").TypeAdapter(PYTHON[kind])
    try:
        found = adapter.validate_python(value)
    except ValueError:
        return None
    if kind == "datetime":
        return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")
    return found


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("source", ["string", "double"])
def test_coercion_equals_pydantic(spark, kind, source):
    values = (TEXTS if source == "string" else NUMBERS)[kind]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {source}")
    value = coerce(F.col("v"), frame.schema["v"].dataType, kind)
    if kind == "datetime":
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    found = dict(frame.select("i", value).collect())
    expected = {i: _pydantic(kind, v) for i, v in enumerate(values)}
    assert [(values[i], found[i], expected[i]) for i in found if not _same(found[i], expected[i])] == []


def test_coercion_of_other_types(spark):
    frame = spark.sql("select 12 i, true b, cast(1.50 as decimal(5,2)) d, date'2024-01-02' day, 'x' s")
    row = frame.select(
        coerce(F.col("b"), T.BooleanType(), "int").alias("a"),
        coerce(F.col("d"), T.DecimalType(5, 2), "int").alias("b"),
        coerce(F.col("d"), T.DecimalType(5, 2), "float").alias("c"),
        coerce(F.col("day"), T.DateType(), "datetime").cast("string").alias("d"),
        coerce(F.col("i"), T.IntegerType(), "str").alias("e"),
        coerce(F.col("b"), T.BooleanType(), "datetime").alias("f"),
    ).first()
    assert tuple(row) == (1, None, 1.5, "2024-01-02 00:00:00", None, None)


def test_catalog():
    assert len(CATALOG) == 7
    assert PRODUCT_CSV.columns == ["product_id", "product_name", "category", "price", "available"]
    assert [f.nullable for f in PRODUCT_CSV.schema] == [False, False, True, False, False]
    with pytest.raises(ValueError):
        Field("x", "complex")


SMALL = Contract.of("Small", id="int", note="str?", price="float")


def _frame(spark, data, columns="id string, note string, price string"):
    return spark.createDataFrame(data, columns)


def test_column_set(spark):
    with pytest.raises(ContractError, match=r"missing: \['price'\]"):
        annotate(_frame(spark, [("1", "a")], "id string, note string"), SMALL)
    wide = _frame(spark, [("1", "a", "2", "x")], "id string, note string, price string, extra string")
    with pytest.raises(ContractError, match="extra"):
        annotate(wide, SMALL)
    assert accepted(annotate(wide, SMALL, strict=False)).columns == SMALL.columns


def test_split_is_complete(spark, rows):
    frame = _frame(spark, [("1", None, "2.5"), ("x", "a", None), (None, "b", "1"), ("2", "c", "nan")])
    checked = annotate(frame, SMALL)
    good, bad = accepted(checked), rejected(checked)
    assert good.count() + bad.count() == frame.count()
    assert good.schema == T.StructType.fromDDL("id bigint, note string, price double")
    assert bad.columns == ["id", "note", "price", "_errors"]
    assert rows(error_counts(checked)) == [("id", "null", 1), ("id", "type", 1), ("price", "null", 1)]


def test_checks(spark, rows):
    contract = Contract.of("Priced", Check("price_positive", "price > 0"), id="int", price="float")
    frame = _frame(spark, [("1", "5"), ("2", "-5"), ("3", "abc")], "id string, price string")
    checked = annotate(frame, contract)
    assert [r["id"] for r in accepted(checked).collect()] == [1]
    assert rows(error_counts(checked)) == [("*", "price_positive", 1), ("price", "type", 1)]


def test_enforce_is_all_or_nothing(spark, tmp_path):
    good = _frame(spark, [("1", None, "2.5"), ("2", "a", "3")])
    assert enforce(good, SMALL).count() == 2
    bad = good.union(_frame(spark, [("x", "a", "1")]))
    target = str(tmp_path / "out")
    with pytest.raises(Exception, match="Small: row refused"):
        enforce(bad, SMALL).write.parquet(target)
    assert not list((tmp_path / "out").glob("*.parquet"))


def test_errors_are_json_friendly(spark):
    checked = annotate(_frame(spark, [("x", "a", "y")]), SMALL)
    text = rejected(checked).select(F.to_json("_errors")).first()[0]
    assert json.loads(text) == [{"field": "id", "error": "type"}, {"field": "price", "error": "type"}]
