import glob
import math
import os
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from siltworks.operators import categories, columns, dedupe, joins, nulls, outliers, quality, text, types
from siltworks.operators import statistics as st

NUMBERS = hs.lists(hs.one_of(hs.none(), hs.floats(-1e6, 1e6), hs.sampled_from([0.0, 1.0, 7.0])), max_size=80)


# --------------------------------------------------------------------------
# Statistics


@pytest.mark.parametrize("limit", [1, 5, 1_000])
@settings(max_examples=12, deadline=None)
@given(NUMBERS)
def test_exact_quantiles_equal_numpy(spark, limit, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = st.exact_quantiles(frame, {"v": [0.0, 0.25, 0.5, 0.9, 1.0]}, limit)["v"]
    present = [v for v in values if v is not None]
    if not present:
        assert found == [None] * 5
    else:
        assert found == pytest.approx(np.quantile(present, [0.0, 0.25, 0.5, 0.9, 1.0]), rel=1e-12, abs=1e-9)


def test_exact_quantiles_narrow_on_a_long_column(spark):
    """100,000 rows, a third of them one value, and a limit that forces narrowing."""
    frame = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(500.0)).otherwise((F.col("id") * 7919 % 100_003) / 7.0).alias("v"),
        (F.col("id") * 31 % 99_991).alias("w"),
    )
    pdf = frame.toPandas()
    found = st.exact_quantiles(frame, {"v": [0.25, 0.5, 0.75], "w": [0.01, 0.999]}, limit=50)
    assert found["v"] == pytest.approx(pdf["v"].quantile([0.25, 0.5, 0.75]).tolist(), rel=1e-14)
    assert found["w"] == pytest.approx(pdf["w"].quantile([0.01, 0.999]).tolist(), rel=1e-14)


def test_narrowing_recovers_from_a_wrong_sketch(spark, monkeypatch):
    """Proposals that miss the rank on either side still end at the right value."""
    frame = spark.range(2_000).select(F.col("id").cast("double").alias("v"))
    real = st._propose
    calls = []

    def wrong_first(work, groups):
        calls.append(len(groups))
        if len(calls) <= 2:
            shift = 300.5 if len(calls) == 1 else -899.5
            return {g: (g[-1] + shift, g[-1] + shift + 10) for g in groups}
        return real(work, groups)

    monkeypatch.setattr(st, "_propose", wrong_first)
    assert st.exact_quantiles(frame, {"v": [0.5]}, limit=20) == {"v": [999.5]}
    assert len(calls) >= 3


def test_halving_ends_without_any_sketch(spark, monkeypatch):
    monkeypatch.setattr(st, "_propose", lambda work, groups: {g: g[1:3] for g in groups})
    frame = spark.range(500).select((F.col("id") * 37 % 501).alias("i"), F.sqrt("id").alias("d"))
    found = st.exact_quantiles(frame, {"i": [0.5], "d": [0.25]}, limit=8)
    pdf = frame.toPandas()
    assert found == {"i": [pdf["i"].quantile(0.5)], "d": [pytest.approx(pdf["d"].quantile(0.25), rel=1e-14)]}


def test_approximate_quantiles(spark):
    frame = spark.range(10_001).select(F.col("id").alias("v"), F.lit(None).cast("double").alias("n"))
    found = st.approximate_quantiles(frame, {"v": [0.5], "n": [0.5, 0.6]})
    assert found["v"][0] == pytest.approx(5_000, abs=5)
    assert found["n"] == [None, None]


def test_modes_ties_and_empty(spark):
    frame = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    assert st.modes(frame, ["x", "y"]) == {"x": "a", "y": None}


def test_modes_by_hash_first(spark):
    """One leader, two and three on a tie, no repeated value, nothing: the smallest of the most frequent."""
    rows = [("b", "z", "c", "q", None), ("b", "z", "c", "p", None), ("a", "y", "b", "r", None), (None, "y", "b", None, None), ("c", "x", "a", "s", None), ("d", None, "a", "t", None)]
    frame = spark.createDataFrame(rows, "one string, `two.ties` string, three string, `unique` string, none string")
    wanted = {"one": "b", "two.ties": "y", "three": "a", "unique": "p", "none": None}
    assert st.modes(frame, frame.columns) == wanted
    assert st.modes(frame.limit(0), frame.columns) == dict.fromkeys(frame.columns)


def test_modes_where_values_share_a_hash(spark, monkeypatch):
    """The count by value shows it, and the column is then counted in full."""
    frame = spark.createDataFrame([(x,) for x in ["aa", "aa", "ab", "ab", "c", "c", "c"]], "x string")
    monkeypatch.setattr(st.F, "xxhash64", lambda c: st.F.ascii(c).cast("bigint"))
    assert st.modes(frame, ["x"]) == {"x": "c"}


def test_types_are_found_beyond_the_first_rows(spark):
    """A column is judged by all its values, wherever the odd one stands."""
    frame = spark.range(2000).select(
        F.when(F.col("id") == 1999, F.lit("x")).otherwise(F.col("id").cast("string")).alias("late_text"),
        F.when(F.col("id") == 1999, F.lit("1.5")).otherwise(F.lit(" 7 ")).alias("late_fraction"),
        F.lit("2024-01-31").alias("day"),
        F.lit("20240131").alias("compact"),
    )
    found = types.fit_text_types(frame, formats=("yyyy-MM-dd", "yyyyMMdd"))
    assert (found.numbers, found.dates) == ({"late_fraction": "double", "compact": "bigint"}, {"day": "yyyy-MM-dd"})
    dates = types.fit_text_types(frame, numbers=False, formats=("yyyy-MM-dd", "yyyyMMdd")).dates
    assert dates == {"day": "yyyy-MM-dd", "compact": "yyyyMMdd"}


def test_frequent_values_counts_null_rows(spark):
    data = [("a",)] * 5 + [("b",)] * 2 + [("c",)] + [(None,)] * 2
    frame = spark.createDataFrame(data, "x string")
    assert st.frequent_values(frame, ["x"], 0.2) == {"x": ["a", "b"]}
    assert st.frequent_values(frame.limit(0), ["x"], 0.2) == {"x": []}


# --------------------------------------------------------------------------
# Columns


def test_drop_all_null_rows_takes_nan_as_missing(spark):
    frame = spark.createDataFrame([(None, None), (math.nan, None), (1.0, None), (None, "")], "x double, y string")
    assert columns.drop_all_null_rows(frame).count() == 2


def test_sparse_threshold_is_strict(spark):
    frame = spark.createDataFrame([(1, None if i < 7 else 1, None if i < 8 else 1) for i in range(10)], "a int, b int, c int")
    assert columns.drop_sparse_columns(frame, 0.7).columns == ["a", "b"]
    kept = [len(columns.drop_sparse_columns(frame, t).columns) for t in (0.0, 0.5, 0.75, 0.9)]
    assert kept == sorted(kept)
    assert columns.drop_sparse_columns(frame.limit(0)).columns == ["a", "b", "c"]


def test_add_metadata_is_one_time_for_all_rows(spark):
    aware = datetime(2024, 1, 1, 12, tzinfo=UTC)
    frame = columns.add_metadata(spark.range(3), aware, "files")
    assert frame.select("processed_at", "source_system").distinct().collect() == [(datetime(2024, 1, 1, 12), "files")]


def test_row_index_spans_ranges(spark):
    frame = spark.range(1_000).select((F.col("id") * 7 % 13).alias("k"), "id")
    found = columns.row_index(frame, ["k", "id"], partitions=7).orderBy("index").collect()
    assert [r["index"] for r in found] == list(range(1_000))
    assert [(r["k"], r["id"]) for r in found] == sorted((i * 7 % 13, i) for i in range(1_000))


def test_row_index_with_one_hot_value_and_equal_rows(spark):
    frame = spark.range(600).select(F.lit(1).alias("k"))
    numbered = columns.row_index(frame, ["k"], partitions=4)
    assert sorted(r["index"] for r in numbered.collect()) == list(range(600))


def test_row_index_within_groups(spark, rows):
    frame = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", 2), ("a", 2), (None, 4)], "g string, v int")
    found = columns.row_index(frame, ["v"], within=["g"])
    assert rows(found) == sorted(
        [(0, None, 4), (1, None, 5), (0, "a", 1), (1, "a", 2), (2, "a", 3), (0, "b", 2)], key=repr
    )


def test_row_index_of_nothing(spark):
    assert columns.row_index(spark.range(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        columns.row_index(spark.range(1), [])


# --------------------------------------------------------------------------
# Nulls, outliers, types, text, categories


def test_fill_median_types(spark):
    frame = spark.createDataFrame(
        [(1, 1, 1.0, None), (2, 3, math.nan, None), (None, None, 5.0, None)], "half int, whole int, d double, n double"
    )
    filled = nulls.fill_median(frame)
    assert dict(filled.dtypes) == {"half": "double", "whole": "int", "d": "double", "n": "double"}
    assert [tuple(r) for r in filled.collect()] == [(1.0, 1, 1.0, None), (2.0, 3, 3.0, None), (1.5, 2, 5.0, None)]


def test_fill_mode_unknown(spark):
    frame = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    assert [tuple(r) for r in nulls.fill_mode(frame).collect()] == [("b", "Unknown"), ("a", "Unknown"), ("a", "Unknown")]


def test_fill_zero_unknown(spark):
    frame = spark.createDataFrame([(None, math.nan, None, None)], "i int, d double, s string, b boolean")
    assert tuple(nulls.fill_zero_unknown(frame).first()) == (0, 0.0, "Unknown", None)


def test_cap_equals_pandas_clip(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    series = pd.Series(values)
    q1, q3 = series.quantile(0.25), series.quantile(0.75)
    expected = series.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    capped = outliers.cap_outliers(frame, exclude=("i",))
    found = [r["v"] for r in capped.orderBy("i").collect()]
    assert found[:-1] == pytest.approx(expected.tolist()[:-1])
    assert found[-1] is None
    assert capped.count() == frame.count()


def test_text_types(spark):
    frame = spark.createDataFrame(
        [(" 1", "1.5", "2024-01-02", "x", None, "20240102"), ("2", "-2e3", "2024-02-03", "1", None, "20240203")],
        "i string, d string, day string, mixed string, empty string, n string",
    )
    found = types.fit_text_types(frame)
    assert found.numbers == {"i": "bigint", "d": "double", "n": "bigint"}
    assert found.dates == {"day": "yyyy-MM-dd"}
    converted = types.infer_datetime(types.infer_numeric(frame))
    assert dict(converted.dtypes) == {
        "i": "bigint", "d": "double", "day": "timestamp_ntz", "mixed": "string", "empty": "string", "n": "bigint"
    }


def test_a_late_value_still_counts(spark):
    """The first rows only rule formats out; every row decides."""
    rows = [(i, str(i), "2024-01-02") for i in range(2_000)]
    frame = spark.createDataFrame(rows + [(2_000, "x", "2024-13-02")], "id int, n string, day string")
    assert types.fit_text_types(frame.orderBy("id")) == types.TextTypes({}, {})
    frame = spark.createDataFrame(rows + [(2_000, "\u2003-1.5e3\n", "2024-12-31")], "id int, n string, day string")
    assert types.fit_text_types(frame.orderBy("id")) == types.TextTypes({"n": "double"}, {"day": "yyyy-MM-dd"})


def test_named_dates_all_or_nothing(spark):
    frame = spark.createDataFrame([("2024-01-02", "2024-01-02", "x"), (None, "soon", "y")], "Created string, update_time string, day string")
    assert dict(types.name_hinted_dates(frame).dtypes) == {"Created": "timestamp_ntz", "update_time": "string", "day": "string"}


def test_cast_errors(spark):
    frame = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="v: cannot convert x"):
        types.cast_types(frame, {"v": "INTEGER"}).collect()
    assert [r["v"] for r in types.cast_types(frame, {"v": "INTEGER"}, on_error="null").collect()] == [1, None]
    with pytest.raises(ValueError):
        types.cast_types(frame, {"v": "INTEGER"}, on_error="ignore")


def test_clean_text_keeps_null(spark):
    frame = spark.createDataFrame([("  Olá, MUNDO!\t",), (None,)], "t string")
    assert [r["t"] for r in text.clean_text(frame).collect()] == ["olá mundo", None]


@pytest.mark.parametrize("size", [3, 5000])
@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_map_categories(spark, monkeypatch, size, limit):
    """Broadcast or joined by a shuffle, which is the same to the result."""
    monkeypatch.setattr(categories, "BROADCAST_BYTES", limit)
    mapping = {f"old{i}": f"new'{i}" for i in range(size)} | {"gone": None}
    values = ["old0", "old2", "kept", None, "gone", None, None]
    frame = spark.createDataFrame([(v, 1, 2) for v in values], "c string, _key int, _spread int")
    found = categories.map_categories(frame, "c", mapping)
    assert found.columns == frame.columns
    assert sorted([r["c"] for r in found.collect()], key=repr) == sorted(["new'0", "new'2", "kept", *[None] * 4], key=repr)


def test_map_categories_gives_text_for_any_mapping(spark):
    numbers = spark.range(3)
    for mapping, expected in (({}, ["0", "1", "2"]), ({1: "one"}, ["0", "2", "one"])):
        found = categories.map_categories(numbers, "id", mapping)
        assert found.dtypes == [("id", "string")] and sorted(r["id"] for r in found.collect()) == expected


def test_cheap_tests_let_every_number_and_date_through(spark):
    from siltworks.functions.dates import fixed_form, may_fit, shape
    from siltworks.functions.numbers import NUMBER_SHAPE, WHOLE_SHAPE, may_be_number, number_class, spaced, text_to_bigint
    from siltworks.operators.types import DATE_FORMATS

    texts = ["1", " 12 ", "-3.5", "+4e5", ".5", "5.", "nan", "+Inf", "-infinity", "\t7\n", "\xa08", "\u30009", "9" * 18, "9" * 19, "9" * 25, " 9223372036854775807",
             "1d", "x1", "", " ", "-", "e5", "1 2", "2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024/01/02", "2024-01-02 03:04:05.123456",
             "2024-13-02", "24-1-2", "2024-01-0a", "١٢٣", None]
    df, c = spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")
    number = c.rlike(spaced(NUMBER_SHAPE))
    plain = F.when(number, F.when(c.rlike(spaced(WHOLE_SHAPE)) & text_to_bigint(c).isNotNull(), 2).otherwise(1))
    assert df.filter(~plain.eqNullSafe(number_class(c))).count() == 0
    assert df.filter(number & ~may_be_number(c)).count() == 0
    for fmt in DATE_FORMATS:
        assert df.filter(c.rlike(rf"^{shape(fmt)}\z") & ~may_fit(c, fmt)).count() == 0
        assert df.filter(may_fit(c, fmt)).count() < 4
    assert fixed_form("yyyy-MM-dd HH:mm") == (16, {5: "-", 8: "-", 11: " ", 14: ":"})
    assert fixed_form("d/M/yyyy") is None and fixed_form("dd MMM yyyy") is None and fixed_form("hh:mm a") is None


@pytest.mark.parametrize("share", [0.2, 0.0005])
def test_rare_to_other(spark, share):
    """Both forms, the literal one and the join one, against a plain count."""
    size = 10 if share > 0.1 else 4_000
    values = ["hot"] * (size // 2) + ["warm"] * 2 + ["cold"] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "c string")
    counts = pd.Series(values).value_counts()
    expected = [v if v is None or counts[v] / len(values) >= share else "Other" for v in values]
    found = [r["c"] for r in categories.rare_to_other(frame, share=share).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


# --------------------------------------------------------------------------
# Duplicates and joins


def test_dedupe_strategies(spark, rows):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "w"), ("b", 5, "v")], "k string, n int, v string")
    assert rows(dedupe.dedupe(frame, ["k"], "keep_first", ["n"])) == sorted([("a", 1, "x"), (None, 3, "z"), ("b", 5, "v")], key=repr)
    assert rows(dedupe.dedupe(frame, ["k"], "keep_last", ["n"])) == sorted([("a", 2, "y"), (None, 4, "w"), ("b", 5, "v")], key=repr)
    assert rows(dedupe.dedupe(frame, ["k"], "keep_none")) == [("b", 5, "v")]
    assert rows(dedupe.dedupe(frame.select("k"), ["k"], "keep_none")) == [("b",)]
    once = dedupe.dedupe(frame, ["k"], "keep_first", ["n"])
    assert rows(dedupe.dedupe(once, ["k"], "keep_first", ["n"])) == rows(once)
    with pytest.raises(ValueError, match="unknown strategy"):
        dedupe.dedupe(frame, ["k"], "keep_some")
    with pytest.raises(ValueError, match="order_by"):
        dedupe.dedupe(frame, ["k"], "keep_first")


def test_distinct_refuses_maps(spark):
    with pytest.raises(TypeError):
        dedupe.distinct_rows(spark.sql("select map('a', 1) m"))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_enrich_equals_plain_join(spark, rows, how):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "id int, v string")
    r = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (4, "w")], "id int, v string")
    plain = t.alias("t").join(r.alias("r"), F.col("t.id") == F.col("r.id"), how).toDF("id", "v", "r_id", "r_v")
    for on in ("id", [("id", "id")], F.col("t.id") == F.col("r.id")):
        found = joins.enrich(t, r, on, how)
        assert found.columns == ["id", "v", "r_id", "r_v"]
        assert rows(found) == rows(plain)


def test_enrich_condition_without_equality(spark, rows):
    t = spark.createDataFrame([(1,), (5,)], "a int")
    r = spark.createDataFrame([(2,), (6,)], "b int")
    assert rows(joins.enrich(t, r, F.expr("t.a < r.b"), "inner", all_pairs=True)) == [(1, 2), (1, 6), (5, 6)]
    with pytest.raises(ValueError):
        joins.enrich(t, r, "a", "sideways")


BOUND = hs.one_of(
    hs.floats(-1e4, 1e4), hs.sampled_from([0.0, 1.0, -1.0, math.inf, -math.inf, 1e300]), hs.none()
)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("inclusive", [True, False])
@settings(max_examples=12, deadline=None)
@given(hs.lists(BOUND, max_size=25), hs.lists(hs.tuples(BOUND, BOUND), max_size=12))
def test_enrich_band_equals_brute_force(spark, how, inclusive, values, bands):
    t = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    r = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(bands)], "j int, lo double, hi double")
    found = joins.enrich_band(t, r, "v", "lo", "hi", how, high_inclusive=inclusive)
    expected = []
    for i, v in enumerate(values):
        inside = [
            j for j, (a, b) in enumerate(bands)
            if None not in (v, a, b) and a <= v and (v <= b if inclusive else v < b)
        ]
        expected += [(i, j) for j in inside] or ([(i, None)] if how == "left" else [])
    assert sorted(((x["i"], x["j"]) for x in found.collect()), key=repr) == sorted(expected, key=repr)


# --------------------------------------------------------------------------
# Quality


def test_range_checks_bounds(spark, rows):
    frame = spark.createDataFrame([(0,), (5,), (10,), (11,), (None,)], "v int")
    assert rows(quality.range_checks(frame, {"v": {"min": 0, "max": 10}})) == [("v", "max", "10", 1), ("v", "min", "0", 0)]
    with pytest.raises(ValueError):
        quality.range_checks(frame, {"v": {"mean": 1}})


def test_orphans_count_null_keys(spark, rows):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    assert rows(quality.orphan_rows(child, "k", parent, "id")) == [(2,), (None,)]
    assert quality.orphan_count(child, "k", parent, "id").collect() == [("k", 2)]
    with pytest.raises(ValueError):
        quality.integrity_checks(child, {"primary_key": {}}, {})


def test_profile(spark, rows):
    frame = spark.createDataFrame([(1.0, "a"), (math.nan, "a"), (None, None)], "x double, y string")
    expected = [("x", "double", 3, 2, 1), ("y", "string", 3, 1, 1)]
    assert rows(quality.profile(frame)) == expected
    assert rows(quality.profile(frame, batch=1)) == expected
    assert rows(quality.profile(frame.limit(0))) == [("x", "double", 0, 0, 0), ("y", "string", 0, 0, 0)]


RESERVED = ["_id", "_rank", "_row", "_count", "_kept", "_tie", "_place", "_first", "_g0", "_old", "_new"]


def test_columns_with_names_of_helpers_survive(spark):
    from siltworks.operators.categories import map_categories, rare_to_other
    from siltworks.operators.columns import row_index
    from siltworks.operators.dedupe import dedupe

    rows = [(i, *[f"{c}{i}" for c in RESERVED]) for i in range(6)]
    df = spark.createDataFrame(rows, ["k", *RESERVED])
    expected = sorted(rows)
    forms = [
        row_index(df, ["k"]).drop("index"),
        row_index(df, ["k"], within=["_id"]).drop("index"),
        dedupe(df, ["k"], "keep_first", ["k"]),
        dedupe(df, ["k"], "keep_last", ["k"]),
        dedupe(df, ["k"], "keep_none"),
        map_categories(df, "_old", {"nothing": "new"}),
        rare_to_other(df, ["_new"], share=0.0001),
    ]
    for found in forms:
        assert sorted(tuple(r) for r in found.select("k", *RESERVED).collect()) == expected


def test_keep_last_refuses_ordered_columns(spark):
    from pyspark.sql import functions as F

    from siltworks.operators.dedupe import dedupe

    with pytest.raises(ValueError):
        dedupe(spark.range(3), ["id"], "keep_last", [F.col("id").desc()])


def test_rounding_does_not_depend_on_the_width(spark):
    from siltworks.operators.types import cast_types

    values = spark.createDataFrame([(2083.095, "0.49999999995"), (1.005, "0.5"), (0.145, "-0.5")], "x double, t string")
    found = [cast_types(values, {"x": f"decimal({p},2)", "t": "int"}).collect() for p in (18, 20, 38)]
    assert [[(str(r.x), r.t) for r in rows] for rows in found[1:]] == [[(str(r.x), r.t) for r in found[0]]] * 2
    assert [r.t for r in found[0]] == [0, 1, -1]


def test_conditions_without_equality_are_refused(spark):
    t, r = spark.range(3).toDF("a"), spark.range(3).toDF("b")
    with pytest.raises(ValueError, match="enrich_band"):
        joins.enrich(t, r, F.expr("t.a < r.b"), "inner")
    assert joins.enrich(t, r, F.expr("t.a = r.b and t.a < 2"), "inner").count() == 2


def test_joins_keep_columns_with_helper_names(spark):
    names = ["_k0", "_spot", "_level", "_cell", "_row"]
    t = spark.createDataFrame([(1.0, 1, 2, 3, 4, 5), (9.0, 1, 2, 3, 4, 5)], ["v", *names])
    bands = spark.createDataFrame([(0.0, 2.0, "low"), (0.0, 5.0, "wide")], ["lo", "hi", "band"])
    joined = joins.enrich_band(t, bands, "v", "lo", "hi", "left")
    assert sorted((tuple(r[n] for n in names), r["band"] or "") for r in joined.collect()) == [
        ((1, 2, 3, 4, 5), ""), ((1, 2, 3, 4, 5), "low"), ((1, 2, 3, 4, 5), "wide")
    ]
    full = joins.enrich(bands, t, [("lo", "v")], "full")
    assert [(r["_k0"], r["_row"]) for r in full.filter("v is not null").collect()] == [(1, 5)] * 2


KEY = hs.one_of(hs.none(), hs.sampled_from([0, 1, 1, 1, 2, 5]))


@pytest.mark.parametrize("how", ["right", "full"])
@pytest.mark.parametrize("size", [0, 1 << 20])
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(KEY, KEY), max_size=30), hs.lists(hs.tuples(KEY, KEY), max_size=30))
def test_outer_joins_equal_plain_ones(spark, rows, how, size, left, right):
    """Hot keys of either side or of both, missing keys, keys of different widths; broadcast and spread."""
    t = spark.createDataFrame([(*k, i) for i, k in enumerate(left)], "a int, b string, _spread int")
    r = spark.createDataFrame([(*k, i) for i, k in enumerate(right)], "x bigint, y string, _again int")
    plain = t.join(r, (t.a == r.x) & (t.b == r.y), how)
    assert rows(joins.enrich(t, r, [("a", "x"), ("b", "y")], how, broadcast_bytes=size)) == rows(plain)
    one = t.join(r, t.a == r.x, how)
    assert rows(joins.enrich(t, r, [("a", "x")], how, broadcast_bytes=size)) == rows(one)


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_outer_joins_read_each_input_once(spark, size):
    """Inputs that differ from run to run would lose or double rows if they were read twice."""
    t = spark.range(2000).select(F.col("id").alias("i"), F.floor(F.rand() * 40).alias("k"))
    r = spark.range(40).select(F.col("id").alias("j"), F.floor(F.rand() * 40).alias("m"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = joins.enrich(t.mapInArrow(counted, t.schema), r, [("k", "m")], "full", broadcast_bytes=size)
    got = found.collect()
    assert {x.i for x in got if x.i is not None} == set(range(2000)) and {x.j for x in got if x.j is not None} == set(range(40))
    assert seen.value == 2000
    keys = {x.k for x in got if x.j is not None and x.i is not None}
    assert all(x.j is not None or x.k not in keys for x in got)


def test_a_hot_key_is_spread(spark):
    t = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    r = spark.range(20_000).toDF("m")
    found = joins.enrich(t, r, [("k", "m")], "full", broadcast_bytes=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "Broadcast" not in plan.split("SortMergeJoin")[0]
    parts = found.filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(x["count"] for x in parts) == 10_001 and max(x["count"] for x in parts) < 5_000
    assert found.filter("m = 7").count() == 10_001 and found.filter("k is null and m = 7").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("ops", [("<", ">"), (">=", "<="), (">", ">="), ("<=",)])
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(BOUND, KEY), max_size=30), hs.lists(hs.tuples(BOUND, KEY), max_size=30))
def test_enrich_bounds_equals_brute_force(spark, rows, how, ops, left, right):
    t = spark.createDataFrame([(i, a, k) for i, (a, k) in enumerate(left)], "_piece int, v double, k int")
    r = spark.createDataFrame([(i, a, k) for i, (a, k) in enumerate(right)], "v int, w double, m bigint").withColumnRenamed("v", "tn")
    bounds = [("v", ops[0], "w"), *[("k", op, "m") for op in ops[1:]]]
    condition = " and ".join(f"{a} {op} {b}" for a, op, b in bounds)
    found = joins.enrich_bounds(t, r, bounds, how, block_rows=3)
    assert rows(found) == rows(t.join(r, F.expr(condition), how))


def test_enrich_bounds_compares_blocks(spark, rows):
    """One pair of values with a third of all rows is cut into blocks; dates are ordered too; text is refused."""
    t = spark.range(900).selectExpr("id", "date_add(date'2024-01-01', cast(if(id % 3 = 0, 5, id) as int)) as a", "if(id % 3 = 0, 5, id) as b")
    r = spark.range(60).selectExpr("id as j", "date_add(date'2024-01-01', cast(id as int)) as c", "id - 1 as d")
    bounds = [("a", "<=", "c"), ("b", ">", "d")]
    found = joins.enrich_bounds(t, r, bounds, block_rows=10)
    assert not any(name in found._jdf.queryExecution().executedPlan().toString() for name in joins.ALL_PAIRS)
    assert rows(found) == rows(t.join(r, F.expr("a <= c and b > d")))
    with pytest.raises(ValueError, match="neither"):
        joins.enrich_bounds(t.withColumn("s", F.lit("x")), r, [("s", "<", "d")])
    with pytest.raises(ValueError, match="different types"):
        joins.enrich_bounds(t, r, [("a", "<", "d")])


@pytest.mark.parametrize("ops", [("<", ">="), (">", "<"), ("<=",)])
@pytest.mark.parametrize("pairs_per_row", [0, 8])
def test_enrich_bounds_refines_places(spark, rows, monkeypatch, ops, pairs_per_row):
    """Grids of any fineness give the same rows, those without a partner too."""
    monkeypatch.setattr(joins, "PAIRS_PER_ROW", pairs_per_row)
    t = spark.range(300).selectExpr("id", "if(id % 50 = 0, null, if(id % 7 = 0, double('NaN'), double(id * 37 % 101))) as a", "id % 25 as b")
    r = spark.range(90).selectExpr("id as j", "cast(id * 11 % 97 as double) as c", "if(id % 30 = 0, null, id % 13 + 4) as d")
    bounds = [("a", ops[0], "c"), *[("b", op, "d") for op in ops[1:]]]
    condition = F.expr(" and ".join(f"{a} {op} {b}" for a, op, b in bounds))
    found = joins.enrich_bounds(t, r, bounds, "left", block_rows=16)
    assert rows(found.fillna(-1)) == rows(t.join(r, condition, "left").fillna(-1))


def test_enrich_bounds_sends_few_rows(spark):
    """Pairs fulfilled by a quarter of all rows: each row is sent to few places, and no side is broadcast."""
    t = spark.range(20000).selectExpr("id", "id * 7919 % 20011 as a", "id % 25 as b")
    r = spark.range(4000).selectExpr("id as j", "id * 4177 % 20011 as c", "id % 25 as d")
    found = joins.enrich_bounds(t, r, [("a", ">", "c"), ("b", "<", "d")], "left", block_rows=64)
    assert found.count() == t.join(r, F.expr("a > c and b < d"), "left").count()
    root = spark.conf.get("spark.checkpoint.dir")
    places = max(glob.glob(f"{root}/siltworks/*/bounds-places-*"), key=os.path.getmtime)
    met = spark.read.parquet(places)
    # A pair of places stands for tn * rn pairs of blocks of up to 64 rows each.
    assert met.agg(F.sum(F.col("tn") * F.col("rn"))).first()[0] <= (20000 // 64 + 1) * (4000 // 64 + 1)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_enrich_bounds_compares_runs(spark, rows, monkeypatch, how):
    """Runs cut rows that are alike; ties, nulls, three conditions, odd names and maps change nothing."""
    monkeypatch.setattr(joins, "RUN_ROWS", {"t": 2, "r": 3})
    t = spark.range(60).selectExpr("id div 2 as id", "if(id % 9 = 0, null, id * 7 % 13) as `a.x`", "id % 5 as `b y`", "map(id, 'k') as kept")
    r = spark.range(40).selectExpr("id div 2 as j", "if(id % 11 = 0, double('NaN'), double(id * 3 % 17)) as c", "id % 4 as d", "date_add(date'2024-01-01', int(id)) as e")
    bounds = [("a.x", ">", "c"), ("b y", "<=", "d"), ("id", ">=", "j")]
    condition = F.expr("`a.x` > c and `b y` <= d and id >= j")
    plain = lambda df: rows(df.withColumn("kept", F.to_json("kept")).fillna(-1))
    assert plain(joins.enrich_bounds(t, r, bounds, how, block_rows=7)) == plain(t.join(r, condition, how))


def test_enrich_bounds_result_takes_little_space(spark, tmp_path):
    """Pairs lie so that values repeat in a file, and the rows of a block are sent once, to tasks whose number does not hang on their bytes."""
    t = spark.range(3000).selectExpr("id", "id * 7919 % 20011 as a", "id % 25 as b")
    r = spark.range(2000).selectExpr("id as j", "id * 4177 % 20011 as c", "id * 7 % 25 as d")
    found = joins.enrich_bounds(t, r, [("a", ">", "c"), ("b", "<", "d")], "left", block_rows=2048)
    found.write.parquet(f"{tmp_path}/pairs")
    written = spark.read.parquet(f"{tmp_path}/pairs")
    sums = [F.count("*"), F.count("j"), F.sum("id"), F.sum(F.col("id") * F.col("j"))]
    assert written.agg(*sums).first() == t.join(r, F.expr("a > c and b < d"), "left").agg(*sums).first()
    size = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet"))
    assert size < 2 * written.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    blocks = [line for line in plan.splitlines() if "hashpartitioning(" in line and "block" in line]
    assert blocks and all("REPARTITION_BY_NUM" in line for line in blocks)
