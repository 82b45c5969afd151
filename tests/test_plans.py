"""Whole jobs, streams, and the shape of the physical plans."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltworks.contracts import ContractError
from siltworks.contracts.catalog import SALE_CSV
from siltworks.operators import categories, columns, dedupe, joins, quality
from siltworks.operators.nulls import fill_zero_unknown
from siltworks.plans.clean_table import CleaningStats, apply_cleaning, clean_table, fit_cleaning
from siltworks.plans.files_to_silver import files_to_silver, manifest, output_name, published
from siltworks.plans.ingest import ingest
from siltworks.registry import QUERIES
from siltworks.sinks.audit import read_audit
from siltworks.sources.files import read_parquet
from siltworks.streaming.incremental import dedupe_stream, stream_files, write_new

RUN_TIME = datetime(2024, 6, 1, 12, 30, 45)


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


# --------------------------------------------------------------------------
# Cleaning


def _dirty(spark):
    data = [
        (i, None if i % 4 == 0 else f"  Type-{i % 2}! ", str(i % 10), None if i % 10 else "rare", f"2024-01-{i % 28 + 1:02d}")
        for i in range(200)
    ]
    return spark.createDataFrame(data + data[:20], "`Row ID` int, `Kind (x)` string, Amount string, Mostly string, Day string")


def test_clean_table(spark):
    cleaned = clean_table(_dirty(spark))
    assert cleaned.count() == 200
    assert dict(cleaned.dtypes) == {"row_id": "double", "kind_x": "string", "amount": "double", "day": "timestamp_ntz"}
    assert {r[0] for r in cleaned.select("kind_x").distinct().collect()} == {"type0", "type1"}


def test_sparse_stage(spark):
    base = columns.standardize_names(_dirty(spark)).distinct()
    late = fit_cleaning(base, sparse_stage="after_fill")
    assert late.dropped == [] and "mostly" in late.fills
    with pytest.raises(ValueError):
        fit_cleaning(base, sparse_stage="never")


def test_cleaning_stats_travel_as_json(spark, rows):
    base = columns.standardize_names(_dirty(spark)).distinct()
    stats = fit_cleaning(base)
    again = CleaningStats.from_json(stats.to_json())
    assert again == stats
    assert rows(apply_cleaning(base, again)) == rows(apply_cleaning(base, stats))


def test_cleaning_an_empty_table(spark):
    empty = columns.standardize_names(_dirty(spark).limit(0))
    assert clean_table(empty).count() == 0


# --------------------------------------------------------------------------
# Ingest


def _sales(spark, *rows):
    return spark.createDataFrame(list(rows), "sale_id string, product_id string, quantity string, sale_date string, total_value string")


def test_ingest_modes(spark, tmp_path):
    good, bad = ("1", "2", "3", "2024-01-02", "9.5"), ("2", "x", "3", "2024-01-02", "9.5")
    root = str(tmp_path)
    done = ingest(_sales(spark, good), SALE_CSV, root, "csv", datetime(2024, 6, 1, 1, 0, 0))
    assert done.entry.rows == 1
    failing = datetime(2024, 6, 1, 2, 0, 0)
    with pytest.raises(Exception, match="SaleCSV: row refused"):
        ingest(_sales(spark, good, bad), SALE_CSV, root, "csv", failing)
    assert read_audit(spark, root).count() == 1
    split = ingest(_sales(spark, good, bad), SALE_CSV, root, "csv", RUN_TIME, mode="quarantine")
    assert split.entry.rows == 1
    (reject,) = spark.read.json(split.rejects_path).collect()
    assert (reject["product_id"], reject["_errors"][0]["field"]) == ("x", "product_id")
    dropped = ingest(_sales(spark, good, bad), SALE_CSV, root, "api", RUN_TIME, mode="drop")
    assert dropped.rejects_path is None and dropped.entry.rows == 1
    with pytest.raises(ContractError):
        ingest(_sales(spark, good).drop("quantity"), SALE_CSV, root, "db", RUN_TIME)
    with pytest.raises(ValueError):
        ingest(_sales(spark, good), SALE_CSV, root, "db", RUN_TIME, mode="maybe")


# --------------------------------------------------------------------------
# Files to silver


def test_files_of_several_shapes(spark, tmp_path, rows):
    source, target = tmp_path / "in", str(tmp_path / "out")
    _put(source / "a.csv", "x,y\n1,a\n1,a\n2,\n")
    _put(source / "deep" / "b.csv", "z,x\n9,5\n")
    _put(source / "c.json", json.dumps([{"x": 7}, {"x": 8}]))
    _put(source / "d.jsonl", '{"x": 10}\n')
    _put(source / "e.txt", "text")
    report = files_to_silver(spark, str(source), target, processors=[fill_zero_unknown], run_time=RUN_TIME)
    found = {r["path"].rsplit("/", 1)[1]: (r["rows"], r["error"]) for r in report.files.collect()}
    assert {k: v for k, v in found.items() if k != "e.txt"} == {
        "a.csv": (3, None), "b.csv": (1, None), "c.json": (2, None), "d.jsonl": (1, None)
    }
    assert "format" in found["e.txt"][1]
    assert report.totals().collect() == [(4, 7, 1)]
    read = lambda name: read_parquet(spark, f"{target}/output={output_name(name, RUN_TIME, 'parquet')}")
    assert rows(read("a.csv").select("x", "y")) == [(1, "a"), (2, "Unknown")]
    assert rows(read("deep/b.csv").select("z", "x")) == [(9, 5)]
    assert rows(read("d.jsonl").select("x", "ingestion_timestamp")) == [(10, RUN_TIME)]


def test_a_bad_file_does_not_stop_the_others(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for name in ("one", "two", "three"):
        spark.range(5).write.parquet(str(source / name))
    (source / "broken.parquet").write_bytes(b"PAR1 this is not parquet")
    report = files_to_silver(spark, str(source), target, ".parquet", run_time=RUN_TIME)
    failed = [r["path"].rsplit("/", 1)[1] for r in report.files.filter("error is not null").collect()]
    assert failed == ["broken.parquet"]
    assert read_parquet(spark, target).count() == 15


def test_a_malformed_line_fails_its_whole_file(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    _put(source / "good.jsonl", '{"x": 1}\n{"x": 2}\n')
    _put(source / "bad.jsonl", '{"x": 3}\n{"x": \n')
    report = files_to_silver(spark, str(source), target, run_time=RUN_TIME)
    (failed,) = report.files.filter("error is not null").collect()
    assert (failed["path"].rsplit("/", 1)[1], failed["error"]) == ("bad.jsonl", "malformed record")
    assert sorted(r["x"] for r in read_parquet(spark, target).collect()) == [1, 2]


def test_files_numbered_and_regrouped(spark, tmp_path, rows):
    source = tmp_path / "in"
    _put(source / "a.csv", "x\n3\n1\n")
    _put(source / "b.csv", "x\n2\n")
    files_to_silver(spark, str(source), str(tmp_path / "n"), run_time=RUN_TIME, index_by=["x"])
    assert rows(read_parquet(spark, str(tmp_path / "n")).select("index", "x")) == [(0, 1), (0, 2), (1, 3)]
    files_to_silver(spark, str(source), str(tmp_path / "d"), run_time=RUN_TIME, processors=[lambda df: df.distinct()])
    assert read_parquet(spark, str(tmp_path / "d")).count() == 3


def _jobs(spark, work):
    """Spark jobs that a call takes."""
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _by_name(report):
    return {r["path"].rsplit("/", 1)[1]: r for r in report.files.collect()}


def test_every_file_keeps_its_columns_and_types(spark, tmp_path, rows):
    source, target = tmp_path / "in", str(tmp_path / "out")
    _put(source / "a.csv", "x,when,flag\n1,2024-01-02,true\n2,2024-01-03 04:05:06,false\n")
    _put(source / "b.csv", "x,when,flag\nabc,,\n")
    _put(source / "a.jsonl", '{"y": 1.5, "x": {"z": [1, 2]}}\n{"y": 2, "s": "t"}\n')
    _put(source / "sub" / "a.csv", 'x,X,\n9999999999,"q, \\"r\\"",1e3\n')
    _put(source / "doc.json", '[{"k": 1}, {"k": "two"}]')
    _put(source / "lines.json", '{"k": 1}\n{"k": 2}\n')
    _put(source / "pretty.json", '{\n "k": 1,\n "l": [\n2]}\n')
    _put(source / "blank.csv", "\n \n")
    _put(source / "titles.csv", "p,q\n")
    _put(source / "short.csv", "p,q\n1,2\n3\n")
    spark.createDataFrame([(1, "mine", "theirs")], "x long, source_path string, output string").coalesce(1).write.parquet(str(source / "p"))
    report = files_to_silver(spark, str(source), target, run_time=RUN_TIME)
    found = report.files.filter("error is null").collect()
    outputs = {r["path"].split("/in/")[1]: r["output"] for r in found}
    (parquet,) = [k for k in outputs if k.startswith("p/")]
    read = {k: read_parquet(spark, f"{target}/output={v}") for k, v in outputs.items() if k not in ("titles.csv", parquet)}
    data = lambda k: {n: t for n, t in read[k].dtypes if n not in ("source_path", "source_file", "ingestion_timestamp")}
    assert data("a.csv") == {"x": "int", "when": "timestamp", "flag": "boolean"}
    assert data("b.csv") == {"x": "string", "when": "string", "flag": "string"}
    assert data("a.jsonl") == {"s": "string", "x": "struct<z:array<bigint>>", "y": "double"}
    assert data("sub/a.csv") == {"x0": "bigint", "X1": "string", "_c2": "double"}
    assert rows(read["sub/a.csv"].select("x0", "X1", "_c2")) == [(9999999999, 'q, "r"', 1000.0)]
    assert rows(read["doc.json"].select("k")) == [("1",), ("two",)]
    assert rows(read["lines.json"].select("k")) == [(1,), (2,)] and rows(read["pretty.json"].select("k", "l")) == [(1, [2])]
    assert outputs["sub/a.csv"].startswith("sub--a.csv_processed_")
    own = read_parquet(spark, f"{target}/output_={outputs[parquet]}") if (tmp_path / "out" / f"output_={outputs[parquet]}").exists() else read_parquet(spark, f"{target}/output={outputs[parquet]}")
    (row,) = own.collect()
    assert row["source_path"] == "mine" and row["source_path_"].endswith(".parquet") and "theirs" in row.asDict().values()
    errors = {k: r["error"] for k, r in _by_name(report).items() if r["error"]}
    assert {k: v for k, v in errors.items() if k.endswith(".csv")} == {"blank.csv": "no columns to read", "short.csv": "malformed record"}
    assert {r["path"].split("/in/")[1]: (r["rows"], r["written"]) for r in published(spark, target).collect()}["a.csv"] == (2, 2)


def test_workbooks_and_csv_of_one_folder(spark, tmp_path):
    import pandas as pd
    from siltworks.registry.scans import _workbook

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "w.xlsx").write_bytes(_workbook(pd.DataFrame({"id": [1, 2], "name": ["one", "two"]})))
    (source / "torn.xlsx").write_bytes(b"PK not a workbook")
    _put(source / "w.csv", "id,name\n1,one\n")
    report = _by_name(files_to_silver(spark, str(source), target, run_time=RUN_TIME))
    assert (report["w.xlsx"]["rows"], report["w.csv"]["rows"]) == (2, 1) and "not a readable workbook" in report["torn.xlsx"]["error"]
    kept = read_parquet(spark, f"{target}/output={report['w.xlsx']['output']}")
    assert dict(kept.dtypes)["id"] == "int" and {r["name"] for r in kept.collect()} == {"one", "two"}


def test_jobs_do_not_grow_with_bad_files(spark, tmp_path):
    counts = []
    for n in (6, 120):
        source = tmp_path / f"in{n}"
        for i in range(n):
            _put(source / f"f{i:04d}.csv", f"x,y\n{i},2\n" + ("3\n" if i % 2 else ""))
        work = lambda s=source, n=n: files_to_silver(spark, str(s), str(tmp_path / f"out{n}"), run_time=RUN_TIME)
        report, jobs = _jobs(spark, work)
        assert report.totals().collect() == [(n // 2, n // 2, n // 2)]
        counts.append(jobs)
    # Beyond 32 folders Spark lists them in jobs of its own.
    assert counts[1] <= counts[0] + 10


def test_a_processor_that_fails_on_one_file(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(6):
        _put(source / f"f{i}.csv", f"x\n{i}\n")
    refuse = lambda df: df.withColumn("y", F.when(F.col("x") == 3, F.raise_error(F.lit("three"))).otherwise(F.lit("ok")))
    report = files_to_silver(spark, str(source), str(tmp_path / "out"), processors=[refuse], run_time=RUN_TIME)
    assert {k for k, r in _by_name(report).items() if r["error"]} == {"f3.csv"}
    assert read_parquet(spark, str(tmp_path / "out")).count() == 5


def test_only_new_and_failed_files_are_read_again(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    _put(source / "a.csv", "x\n1\n")
    _put(source / "b.csv", "x,y\n1\n")
    take = lambda minute: set(_by_name(files_to_silver(spark, str(source), target, run_time=RUN_TIME.replace(minute=minute), only_new=True)))
    assert take(1) == {"a.csv", "b.csv"}
    _put(source / "c.csv", "x\n7\n")
    assert take(2) == {"b.csv", "c.csv"}
    _put(source / "b.csv", "x,y\n1,2\n")
    _put(source / "a.csv", "x\n1\n2\n")
    assert take(3) == {"a.csv", "b.csv"}
    assert take(4) == set()
    assert manifest(spark, target).count() == 6
    assert {r["path"].rsplit("/", 1)[1]: r["rows"] for r in published(spark, target).collect()} == {"a.csv": 2, "b.csv": 1, "c.csv": 1}


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    report = files_to_silver(spark, str(tmp_path / "in"), str(tmp_path / "out"), ".csv")
    assert report.totals().collect() == [(0, 0, 0)]


# --------------------------------------------------------------------------
# Streams


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema

    def run():
        write_new(stream_files(spark, source, schema, max_files=1), target, checkpoint, [lambda df: columns.add_metadata(df, RUN_TIME)])
        return read_parquet(spark, target).count()

    assert run() == 10
    assert run() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert run() == 15


def test_stream_with_frozen_statistics(spark, tmp_path, rows):
    base = columns.standardize_names(_dirty(spark)).distinct()
    stats = fit_cleaning(base)
    source = str(tmp_path / "in")
    base.write.parquet(source)
    write_new(stream_files(spark, source, base.schema), str(tmp_path / "out"), str(tmp_path / "c"), [lambda df: apply_cleaning(df, stats)])
    assert rows(read_parquet(spark, str(tmp_path / "out"))) == rows(apply_cleaning(base, stats))


@pytest.mark.parametrize("salts", [1, 4])
def test_stream_dedupe_with_a_hot_key(spark, tmp_path, salts):
    source = str(tmp_path / "in")
    frame = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("t"),
    )
    frame.repartition(5).write.parquet(source)
    single = dedupe_stream(stream_files(spark, source, frame.schema), ["k"], "t", "1 hour", salts)
    write_new(single, str(tmp_path / "out"), str(tmp_path / "c"))
    assert read_parquet(spark, str(tmp_path / "out")).count() == 601


# --------------------------------------------------------------------------
# Plans


def test_scan_reads_only_what_is_asked(spark, sf_dir, plan):
    text = plan(QUERIES["scan_parquet"](spark, sf_dir))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>" in text
    lines = columns.standardize_names(read_parquet(spark, f"{sf_dir}/lineitem.parquet"))
    assert "GreaterThan(l_quantity,40.0)" in plan(lines.filter("l_quantity > 40").select("l_tax"))


def test_keep_first_limits_each_key_before_the_shuffle(spark, sf_dir, plan):
    text = plan(QUERIES["dedupe_keep_first"](spark, sf_dir))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_keep_none_counts_without_a_window(spark, sf_dir, plan):
    text = plan(QUERIES["dedupe_keep_none"](spark, sf_dir))
    assert "Window" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_no_cross_products_and_no_table_wide_windows(spark, sf_dir, plan, name):
    if name.startswith("stream") or name in ("files_to_silver", "ingest_contract_bronze", "audit_record"):
        pytest.skip("the result is a plain read")
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text or "Window" not in text


def test_values_are_looked_up_without_a_shuffle_of_the_rows(spark, sf_dir, plan):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for found in (categories.rare_to_other(events), categories.map_categories(events, "event_type", {"a": "b"})):
        text = plan(found)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_orphan_count_joins_counted_keys(spark, plan):
    """With a parent too large to broadcast, only one row per key reaches the join."""
    child = spark.range(100).select((F.col("id") % 3).alias("k"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(quality.orphan_count(child, "k", spark.range(10), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    join = text.index("LeftAnti")
    assert text.count("HashAggregate(keys=[_key", join) + text.count("HashAggregate(keys=[k", join) + text.count(
        "HashAggregate(keys=[_groupingexpression", join
    ) == 2


def test_full_join_leaves_the_hot_side_free(spark, plan):
    t, r = spark.range(100).toDF("k"), spark.range(5).toDF("k")
    text = plan(joins.enrich(t, r, "k", "full"))
    assert "FullOuter" not in text and "LeftOuter" in text and "LeftAnti" in text
    text = plan(joins.enrich(t, r, "k", "right"))
    assert "RightOuter" not in text and "Inner" in text


def test_distinct_combines_before_the_shuffle(spark, plan):
    text = plan(dedupe.distinct_rows(spark.range(100).select((F.col("id") % 3).alias("k"))))
    assert text.count("HashAggregate") == 2


def test_contract_read_back(spark, sf_dir):
    frame = QUERIES["ingest_contract_bronze"](spark, sf_dir)
    assert isinstance(frame.first()["price"], float)


def test_large_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file of many rows, each twice: every row once, numbered, in parts that each hold few rows."""
    from siltworks.plans import files_to_silver as plan
    from siltworks.plans import landing

    monkeypatch.setattr(plan, "TASK_ROWS", 500)
    monkeypatch.setattr(landing, "PIECE_BYTES", 1000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n" + "".join(f"{i % 2000},x\n" for i in range(4000)))
    (tmp_path / "in" / "b.csv").write_text("k,v\n7,x\n7,x\n")
    (tmp_path / "in" / "c.jsonl").write_text("".join(f'{{"k": {i % 2000}}}\n' for i in range(4000)))
    files_to_silver(spark, str(tmp_path / "in"), str(tmp_path / "out"), run_time=RUN_TIME, index_by=["k"])
    for name, keys in (("a.csv", 2000), ("b.csv", 1), ("c.jsonl", 2000)):
        out = spark.read.parquet(str(tmp_path / "out" / f"output={output_name(name, RUN_TIME, 'parquet')}"))
        assert sorted(r["index"] for r in out.collect()) == list(range(keys))
        assert out.select("k").distinct().count() == keys
        parts = [r["count"] for r in out.groupBy(F.col("_metadata.file_path")).count().collect()]
        # 4000 rows are eight tasks' and 32 pieces'.
        assert max(parts) < 1000 and (len(parts) > 2) == (keys > 1)
