import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import parse_local, spark_pattern
from siltworks.functions.names import standard_name, standard_names
from siltworks.functions.numbers import lenient_cast, money, spark_type
from siltworks.functions.text import clean_unicode


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Order ID", "order_id"),
        ("  Total Price (BRL) ", "total_price_brl"),
        ("__a__b__", "a_b"),
        ("ação", "a_o"),
        ("###", ""),
        ("A1-b2", "a1_b2"),
    ],
)
def test_standard_name(name, expected):
    assert standard_name(name) == expected


def test_standard_names_are_unique():
    assert standard_names(["A b", "a_b", "a_b_1", "", "ção", "#"]) == ["a_b", "a_b_1", "a_b_1_1", "col", "o", "col_1"]


@given(st.lists(st.text(max_size=12), max_size=12))
def test_standard_names_idempotent_and_unique(names):
    once = standard_names(names)
    assert len(set(once)) == len(names)
    assert standard_names(once) == once
    assert all(re.fullmatch("[a-z0-9]+(_[a-z0-9]+)*", n) for n in once)


def test_clean_unicode_equals_python_re(spark):
    """Character by character, for those that any Unicode table in use knows."""
    from unicodedata import ucd_3_2_0

    points = [chr(i) for i in range(1, 0xD800) if ucd_3_2_0.category(chr(i)) != "Cn"]
    texts = [f"a{c}b {c}" for c in points]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = dict(frame.select("i", clean_unicode(F.col("t"))).collect())
    different = [
        hex(ord(points[i]))
        for i, t in enumerate(texts)
        if found[i] != re.sub(r"[^\w\s]", "", t.strip().lower())
    ]
    assert different == []


@pytest.mark.parametrize(
    "given_format, pattern",
    [
        ("DD/MM/YYYY", "d/M/yyyy"),
        ("YYYY-MM-DD", "yyyy-M-d"),
        ("%d/%m/%Y", "d/M/yyyy"),
        ("%Y%m%d", "yyyyMMdd"),
        ("YYYYMMDD", "yyyyMMdd"),
        ("YYYY-MM-DD HH24:MI:SS", "yyyy-M-d H:mm:ss"),
        ("dd.MM.yyyy", "dd.MM.yyyy"),
    ],
)
def test_spark_pattern(given_format, pattern):
    assert spark_pattern(given_format) == pattern


def test_unknown_date_token():
    with pytest.raises(ValueError):
        spark_pattern("%Q")


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_parse_local(spark, session_zone):
    frame = spark.createDataFrame([("03/10/1998",), ("4/11/2018",), ("n/a",), (None,), ("31/02/2020",)], "t string")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        found = frame.select(
            parse_local(F.col("t"), "DD/MM/YYYY", "America/Sao_Paulo").alias("utc"),
            parse_local(F.col("t"), "DD/MM/YYYY", "America/Sao_Paulo", instant=True).alias("instant"),
            parse_local(F.col("t"), "DD/MM/YYYY").alias("plain"),
        ).withColumn("seconds", F.unix_timestamp("instant"))
        rows = found.drop("instant").collect()
        types = dict(found.dtypes)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # 4 November 2018 has no midnight there: clocks went from 24:00 to 01:00.
    assert [str(r["utc"]) for r in rows] == ["1998-10-03 03:00:00", "2018-11-04 03:00:00", "None", "None", "None"]
    assert [r["seconds"] for r in rows] == [907383600, 1541300400, None, None, None]
    assert str(rows[0]["plain"]) == "1998-10-03 00:00:00"
    assert (types["utc"], types["instant"], types["plain"]) == ("timestamp_ntz", "timestamp", "timestamp_ntz")


def test_spark_type_names(spark):
    assert spark_type("INTEGER") == T.IntegerType()
    assert spark_type("varchar") == T.StringType()
    assert spark_type("Timestamp  with time zone") == T.TimestampType()
    assert spark_type("DECIMAL(10,2)") == T.DecimalType(10, 2)


def test_whole_number_rounding(spark):
    frame = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,), (None,)], "d double")
    halves = [r[0] for r in frame.select(lenient_cast(F.col("d"), T.DoubleType(), T.IntegerType())).collect()]
    assert halves == [0, 2, 2, 0, -2, None]
    decimals = frame.select(F.col("d").cast("decimal(5,1)").alias("d"))
    away = [r[0] for r in decimals.select(lenient_cast(F.col("d"), T.DecimalType(5, 1), T.IntegerType())).collect()]
    assert away == [1, 2, 3, -1, -2, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9).map(lambda x: round(x, 3)), min_size=1, max_size=50))
def test_money_from_doubles_equals_duckdb(spark, values):
    import duckdb

    con = duckdb.connect()
    frame = spark.createDataFrame([(v,) for v in values], "d double")
    found = [r[0] for r in frame.select(money(F.col("d"), T.DoubleType(), 2)).collect()]
    assert found == [con.execute("select cast(?::double as decimal(18,2))", [v]).fetchall()[0][0] for v in values]


def test_money_refuses_what_does_not_fit(spark):
    frame = spark.createDataFrame([("12.345",), (None,)], "t string")
    assert [r[0] for r in frame.select(money(F.col("t"), T.StringType(), 2)).collect()] == [Decimal("12.35"), None]
    bad = spark.createDataFrame([("1,50",)], "t string")
    with pytest.raises(Exception, match="cannot convert"):
        bad.select(money(F.col("t"), T.StringType(), 2)).collect()
