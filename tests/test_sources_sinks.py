import json
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.registry.scans import _workbook, customer_workbooks
from siltworks.sinks.audit import AuditEntry, append_audit, read_audit
from siltworks.sinks.files import bronze_name, layer_path, write_bronze, write_per_source, write_table
from siltworks.sources import databases, excel, files, html, inventory, payloads

RUN_TIME = datetime(2024, 6, 1, 12, 30, 45)


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


# --------------------------------------------------------------------------
# Files


def test_csv_null_words_and_inference(spark, tmp_path, rows):
    path = _put(tmp_path / "a.csv", "id,price,name,day\n1,NA,x,2024-01-02\n2,2.5,null,2024-01-03\n")
    plain = files.read_csv(spark, path)
    assert dict(plain.dtypes)["price"] == "string"
    clean = files.read_csv(spark, path, null_words=files.NULL_WORDS)
    assert dict(clean.dtypes) == {"id": "bigint", "price": "double", "name": "string", "day": "timestamp_ntz"}
    assert rows(clean.select("id", "price", "name")) == [(1, None, "x"), (2, 2.5, None)]


def test_json_document_list_and_lines(spark, tmp_path, rows):
    many = _put(tmp_path / "a.json", json.dumps([{"a": 1}, {"a": 2}], indent=1))
    lines = _put(tmp_path / "b.jsonl", '{"a": 3}\n{"a": 4}\n')
    assert rows(files.read_file(spark, many)) == [(1,), (2,)]
    assert rows(files.read_file(spark, lines, "auto")) == [(3,), (4,)]


def test_format_dispatch(spark, tmp_path):
    assert files.detect_format("s3a://b/x.PARQUET") == "parquet"
    assert files.detect_format("/x/y.pq") == "parquet"
    for path, file_format in (("x.txt", None), ("x.csv", "yaml"), ("x", "auto")):
        with pytest.raises(files.UnsupportedFormat):
            files.read_file(spark, path, file_format)
    with pytest.raises(files.UnsupportedFormat, match="spark-avro"):
        files.read_file(spark, str(tmp_path / "x.avro"))
    with pytest.raises(files.UnsupportedFormat, match="several formats"):
        files.read_file(spark, ["a.csv", "b.json"])


def test_text_formats_keep_microseconds(spark, tmp_path, rows):
    frame = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.123456' a, timestamp'2024-01-02 03:04:05.654321' b")
    for file_format, read in (("csv", files.read_csv), ("json", files.read_json)):
        path = str(tmp_path / f"t.{file_format}l")
        write_table(frame, path, file_format)
        assert rows(read(spark, path, schema=frame.schema)) == rows(frame)


def test_unknown_output_format(spark, tmp_path):
    with pytest.raises(files.UnsupportedFormat):
        write_table(spark.range(1), str(tmp_path / "x"), "xml")


def test_csv_sink_writes_nested_as_json(spark, tmp_path, rows):
    write_table(spark.sql("select 1 id, array(1, 2) xs"), str(tmp_path / "n"), "csv")
    assert rows(files.read_csv(spark, str(tmp_path / "n"))) == [(1, "[1,2]")]


def test_file_stats_and_inventory(spark, tmp_path, rows):
    _put(tmp_path / "in" / "a.csv", "x\n1\n2\n")
    _put(tmp_path / "in" / "deep" / "b.csv", "x\n3\n")
    _put(tmp_path / "in" / "c.txt", "no")
    frame = files.read_csv(spark, str(tmp_path / "in"), recursiveFileLookup=True, pathGlobFilter="*.csv")
    assert rows(files.file_stats(frame)) == [("a.csv", 2), ("b.csv", 1)]
    found = inventory.object_inventory(spark, str(tmp_path / "in"), ".csv")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.csv", "b.csv"]
    assert inventory.object_inventory(spark, str(tmp_path / "in"), ".orc").count() == 0
    wanted = found.select("path").limit(1).union(spark.createDataFrame([("file:/nowhere",)], "path string"))
    assert inventory.existing(wanted, found).count() == 1
    assert rows(inventory.absent(wanted, found)) == [("file:/nowhere",)]


# --------------------------------------------------------------------------
# Payloads

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_json_payload_shapes(spark, tmp_path, rows):
    _put(tmp_path / "p" / "1.json", json.dumps({"count": 2, "results": [{"id": 1, "name": "a"}, {"id": 2}]}, indent=2))
    _put(tmp_path / "p" / "2.json", json.dumps([{"id": 3, "name": "c", "more": 1}]))
    _put(tmp_path / "p" / "3.json", json.dumps({"detail": "empty"}))
    assert rows(payloads.read_json_payloads(spark, str(tmp_path / "p"), ROW)) == [(1, "a"), (2, None), (3, "c")]


@pytest.mark.parametrize("body", ["42", '"text"', "[1, oops"])
def test_other_payloads_are_errors(spark, body):
    with pytest.raises(Exception):
        payloads.payload_rows(spark.createDataFrame([(body,)], "b string"), "b", ROW).collect()


def test_xml_leaves(spark, tmp_path, rows):
    text = """<All><Record kind="k"><id>1</id><Box><size>5</size><Deep><w>9</w></Deep></Box><tag>x</tag><tag>y</tag></Record>
    <Record><id>2</id></Record></All>"""
    frame = payloads.read_xml_records(spark, _put(tmp_path / "r.xml", text))
    assert sorted(frame.columns) == ["id", "size", "tag", "w"]
    assert rows(frame.select("id", "size", "tag", "w")) == [("1", "5", "y", "9"), ("2", None, None, None)]


# --------------------------------------------------------------------------
# Pages and workbooks

PAGE = """<html><body><p>before</p>
<table><thead><tr><th>id</th><th>title</th></tr></thead>
<tbody><tr><td>1</td><td>A &amp; B<table><tr><td>inner</td></tr></table></td></tr>
<tr><td rowspan=2>2</td><td>x</td></tr><tr><td>y</td></tr><tr><td colspan="2">wide</td></tr></tbody></table>
<table><tr><td>second</td></tr></table>"""


def test_first_html_table(spark, rows):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None), (4, "<table><tr><td>a<td>b")], "k int, html string")
    all_rows = html.html_tables(pages, "k")
    assert rows(all_rows.filter("error is not null").select("k", "error")) == [(2, html.NO_TABLE), (3, html.NO_TABLE)]
    assert all_rows.filter("k = 1").select("table_idx").distinct().count() == 3
    found = html.read_first_tables(pages, "k", ["title", "id", "absent"])
    assert rows(found.filter("k = 1")) == [
        (1, 0, "A & Binner", "1", None), (1, 1, "x", "2", None), (1, 2, "y", "2", None), (1, 3, "wide", "wide", None)
    ]
    assert rows(html.read_first_tables(pages, "k", ["0", "1"]).filter("k = 4")) == [(4, 0, "a", "b")]


def test_html_title(spark, rows):
    pages = spark.createDataFrame([("<TITLE lang='x'> A\nB </TITLE><title>c</title>",), ("<p>",)], "html string")
    assert rows(html.html_titles(pages).select("title")) == [("A\nB",), (None,)]


def test_excel_files(spark, sf_dir, tmp_path, rows):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    half = customer.limit(20).toPandas()
    (tmp_path / "a.xlsx").write_bytes(_workbook(half.iloc[:10]))
    (tmp_path / "b.xlsx").write_bytes(_workbook(half.iloc[10:][list(reversed(half.columns))]))
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip file")
    read = files.read_file(spark, str(tmp_path), "excel", schema=customer.schema, rejects="skip")
    assert rows(read) == rows(spark.createDataFrame(half, customer.schema))
    errors = excel.read_workbooks(spark, str(tmp_path)).filter("error is not null")
    assert [r["path"].rsplit("/", 1)[1] for r in errors.collect()] == ["bad.xlsx"]
    assert customer_workbooks(spark, sf_dir).count() >= 1


def test_excel_cell_kinds():
    """Shared strings, styles and gaps, from parts written by hand."""
    import io
    import zipfile

    main = excel.MAIN.strip("{}")
    relation = excel.RELATION.strip("{}")
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets><sheet r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{excel.PACKAGE.strip("{}")}">'
        '<Relationship Id="r1" Target="/xl/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>day</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/>'
        '<numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/s.xml": f'<worksheet xmlns="{main}"><sheetData>'
        '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row><c r="A2" s="1"><v>45293</v></c><c r="B2" s="2"><v>45293.5</v></c><c r="C2" s="3"><v>2.5</v></c>'
        '<c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="AA2"><v>7</v></c></row>'
        '<row><c r="A3"/></row></sheetData></worksheet>',
    }
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    ((row, header, cells, error),) = excel.workbook_rows(content.getvalue())
    assert (row, header, error) == (0, ["day", "", "rich"], None)
    assert cells[:5] == ["2024-01-02 00:00:00", "2024-01-02 12:00:00", "2.5", "true", None]
    assert cells[26] == "7"


# --------------------------------------------------------------------------
# Databases: options only, as no database may be started here


def test_database_options():
    connection = databases.jdbc_options("postgresql", "db", "shop", "u", "p")
    assert connection["url"] == "jdbc:postgresql://db:5432/shop"
    assert databases.read_options(query="select 1")["query"] == "select 1"
    split = databases.read_options(
        query="select * from t;", partition_column="id", lower_bound=0, upper_bound=100, partitions=4
    )
    assert split["dbtable"] == "(select * from t) q"
    assert split["numPartitions"] == "4" and "query" not in split
    for wrong in ({}, {"query": "q", "table": "t"}, {"table": "t", "partitions": 3}):
        with pytest.raises(ValueError):
            databases.read_options(**wrong)
    with pytest.raises(ValueError):
        databases.jdbc_options("dbase", "h", "d", "u", "p")


# --------------------------------------------------------------------------
# Bronze and audit


def test_bronze_and_audit(spark, tmp_path):
    root = str(tmp_path / "lake")
    entry = write_bronze(spark.range(7).withColumn("n", F.lit("x")), root, "api", RUN_TIME)
    assert entry.data_file.endswith("bronze/api_spark_2024-06-01_123045.csv")
    assert (entry.rows, entry.columns, entry.columns_types) == (7, 2, {"id": "bigint", "n": "string"})
    append_audit(spark, root, [entry])
    append_audit(spark, root, [AuditEntry("csv", "spark", RUN_TIME, "success", "x", 1, 1, {})])
    assert read_audit(spark, root).count() == 2
    assert (tmp_path / "lake/metadata/year=2024/month=06/day=01").is_dir()
    read = read_audit(spark, root).filter("origin = 'api'").first()
    assert (read["rows"], read["columns_types"], read["timestamp"]) == (7, entry.columns_types, RUN_TIME)
    with pytest.raises(Exception):
        write_bronze(spark.range(1), root, "api", RUN_TIME)


def test_names_and_layers():
    assert bronze_name("csv", "spark", RUN_TIME) == "csv_spark_2024-06-01_123045"
    assert layer_path("s3a://lake/", "silver", "orders") == "s3a://lake/silver/orders"
    with pytest.raises(ValueError):
        layer_path("x", "copper")


def test_one_output_per_source(spark, tmp_path, rows):
    frame = spark.range(10).withColumn("source_file", F.concat(F.lit("f"), F.col("id") % 2, F.lit(".csv")))
    write_per_source(frame, str(tmp_path / "out"), "source_file", RUN_TIME)
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == [f"output=f{i}_processed_20240601_123045.parquet" for i in (0, 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_spans_end_at_the_limit_of_the_standard():
    from siltworks.sources.html import page_rows

    for span in ("3000000", "9" * 5000):
        ((_, _, _, cells, _),) = page_rows(f'<table><tr><td colspan="{span}">x</td></tr></table>')
        assert len(cells) == 1000
    ((_, _, _, cells, _),) = page_rows('<table><tr><td colspan="\u00b2">x</td></tr></table>')
    assert cells == ["x"]


def test_a_workbook_that_breaks_half_way_gives_an_error_and_no_rows():
    import io
    import zipfile

    import pandas as pd

    from siltworks.registry.scans import _workbook
    from siltworks.sources.excel import workbook_rows

    whole = _workbook(pd.DataFrame({"a": range(5)}))
    broken = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(broken, "w") as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, data[: len(data) * 2 // 3] if "sheet1" in name else data)
    assert len(list(workbook_rows(whole))) == 5
    ((_, _, _, error),) = workbook_rows(broken.getvalue())
    assert "not a readable workbook" in error


def test_an_unreadable_workbook_fails_the_job_or_is_left_out(spark):
    import pandas as pd

    from siltworks.registry.scans import _workbook
    from siltworks.sources.excel import parse_workbooks, rejected_workbooks, workbook_columns

    good = _workbook(pd.DataFrame({"a": [1, 2]}))
    books = parse_workbooks(spark.createDataFrame([("good", good), ("bad", good[:50])], "path string, content binary"))
    schema = T.StructType.fromDDL("a bigint")
    with pytest.raises(Exception, match="bad"):
        workbook_columns(books, schema).collect()
    assert sorted(r["a"] for r in workbook_columns(books, schema, "skip").collect()) == [1, 2]
    assert [r["path"] for r in rejected_workbooks(books).collect()] == ["bad"]


def test_release_deletes_intermediate_tables(spark):
    import os

    from siltworks.session import materialize, release_scratch, shared_root

    materialize(spark.range(3).toDF("a"), "kept")
    folder = f"{shared_root(spark)}/siltworks/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    release_scratch(spark)
    assert not os.path.exists(folder)


def test_file_rows_of_tables_in_parts(spark, rows, tmp_path):
    """A table in a folder of parts is one entry, by its own name, also where the names are odd."""
    root = tmp_path / "a b%20+c" / "data"
    spark.range(10).repartition(3).write.parquet(f"{root}/parts.parquet")
    spark.range(0).write.parquet(f"{root}/none.parquet")
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/one")
    shutil.copy(next((tmp_path / "one").glob("*.parquet")), root / "single.parquet")
    (root / "notes.txt").write_text("x")
    tables = [spark.read.schema("id long").parquet(f"{root}/{n}.parquet") for n in ("parts", "none", "single")]
    found = inventory.file_rows(inventory.object_inventory(spark, f"{root}/"), tables, f"{root}/", ".parquet")
    assert rows(found) == [("none.parquet", 0), ("parts.parquet", 10), ("single.parquet", 4)]


def test_xml_records_lie_in_files_of_bounded_size(spark, rows, sf_dir, monkeypatch):
    from siltworks.registry import scans

    whole = scans.api_xml_records(spark, sf_dir)
    monkeypatch.setattr(scans, "XML_RECORDS", 40)
    parts = scans.api_xml_records(spark, sf_dir)
    assert len(parts.inputFiles()) >= parts.count() / 40
    assert rows(parts) == rows(whole)
