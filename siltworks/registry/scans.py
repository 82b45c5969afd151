"""Readers and writers, each on a whole table."""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.columns import standardize_names as with_standard_names
from siltworks.registry.base import query, table
from siltworks.registry.dirty import ORDERS_SQL, dirty_orders
from siltworks.session import scratch_path
from siltworks.sinks.files import write_table
from siltworks.sources import files, html, inventory, payloads
from siltworks.sources.excel import parse_workbooks, rejected_workbooks, workbook_columns

# The given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Records of a written XML file.
XML_RECORDS = 1 << 17


@query("""
select l_returnflag, l_linestatus, count(*) as rows, sum(l_quantity) as quantity, max(l_shipdate) as last_shipped
from lineitem group by l_returnflag, l_linestatus
""")
def scan_parquet(spark, sf_dir):
    lines = files.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("l_quantity").alias("quantity"),
        F.max("l_shipdate").alias("last_shipped"),
    )


@query("select * from orders")
def scan_csv_roundtrip(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "orders") + ".csv"
    write_table(orders, path, "csv")
    return files.read_csv(spark, path, schema=orders.schema)


@query("""
select o_orderkey, case when o_orderkey % 5 <> 0 then o_custkey end as o_custkey,
       case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice, o_orderstatus from orders
""")
def scan_csv_inferred(spark, sf_dir):
    """Types found in the text, with two spellings of "no value" among the numbers."""
    key, path = F.col("o_orderkey"), scratch_path(spark, "orders") + ".csv"
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, F.lit("NA")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(key % 7 == 0, F.lit("null")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        "o_orderstatus",
    )
    write_table(orders, path, "csv")
    return files.read_csv(spark, path, null_words=files.NULL_WORDS)


@query("select * from supplier")
def scan_json_document(spark, sf_dir):
    """One array of at most 100 rows to a file."""
    supplier, path = table(spark, sf_dir, "supplier"), scratch_path(spark, "suppliers")
    pages = _pages(supplier, "s_suppkey").select("page", F.to_json("results").alias("value"))
    pages.repartition("page").write.partitionBy("page").option("maxRecordsPerFile", 1).text(path)
    return files.read_json(spark, f"{path}/*", supplier.schema, lines=False)


@query("select * from orders")
def scan_json_lines(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "orders") + ".jsonl"
    write_table(orders, path, "json")
    return files.read_json(spark, path, schema=orders.schema)


@query("select * from lineitem")
def scan_orc_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lineitem") + ".orc"
    table(spark, sf_dir, "lineitem").write.orc(path)
    return files.read_orc(spark, path)


@query("""
select 'csv' as format, c_custkey as key, c_name as name, c_acctbal as amount from customer
union all select 'json', s_suppkey, s_name, s_acctbal from supplier
union all select 'parquet', p_partkey, p_name, p_retailprice from part
""")
def scan_auto_dispatch(spark, sf_dir):
    sources = [
        ("csv", "csv", "customer", "c_custkey", "c_name", "c_acctbal"),
        ("json", "jsonl", "supplier", "s_suppkey", "s_name", "s_acctbal"),
        ("parquet", "parquet", "part", "p_partkey", "p_name", "p_retailprice"),
    ]
    found = []
    for file_format, ending, name, key, label, amount in sources:
        rows = table(spark, sf_dir, name).select(
            F.col(key).alias("key"), F.col(label).alias("name"), F.col(amount).alias("amount")
        )
        path = f"{scratch_path(spark, name)}.{ending}"
        write_table(rows, path, file_format)
        read = files.read_file(spark, path, "auto", rows.schema)
        found.append(read.select(F.lit(file_format).alias("format"), "key", "name", "amount"))
    return reduce(DataFrame.unionByName, found)


@query("select * from events")
def sink_json_roundtrip(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "events")
    write_table(events, path, "json")
    return files.read_json(spark, path, schema=events.schema, lines=True)


@query(f"""
with d as ({ORDERS_SQL})
select "Order ID" as order_id, "Cust.Key" as cust_key, "Order  Date" as order_date,
       "Total Price (BRL)" as total_price_brl, "STATUS" as status, copy_no from d
""")
def parquet_standardized(spark, sf_dir):
    path = scratch_path(spark, "named")
    dirty_orders(spark, sf_dir).write.parquet(path)
    return files.read_parquet_standardized(spark, path)


@query("""
select l_orderkey as order_key, l_partkey as order_key_1, l_suppkey as order_key_2, l_linenumber as col,
       l_quantity as qty, l_extendedprice as a_o, l_discount as col_1 from lineitem
""")
def standardize_names(spark, sf_dir):
    odd = {
        "l_orderkey": "Order Key",
        "l_partkey": "order-key",
        "l_suppkey": "ORDER..KEY",
        "l_linenumber": "###",
        "l_quantity": "_Qty_",
        "l_extendedprice": "açãO",
        "l_discount": "",
    }
    lines = table(spark, sf_dir, "lineitem")
    return with_standard_names(lines.select(*odd).toDF(*odd.values()))


# --------------------------------------------------------------------------
# Landed payloads. A response holds one page of at most 100 rows.

def _pages(rows: DataFrame, key: str) -> DataFrame:
    """Responses with the rows of 100 consecutive keys each."""
    page = F.floor(F.col(key) / 100).alias("page")
    return rows.groupBy(page).agg(F.collect_list(F.struct(*rows.columns)).alias("results"))


@query("select * from customer")
def api_json_results(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    bodies = _pages(customer, "c_custkey").select(F.to_json(F.struct("page", "results")).alias("body"))
    return payloads.payload_rows(bodies, "body", customer.schema)


@query("select * from customer")
def api_json_list(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    bodies = _pages(customer, "c_custkey").select(F.to_json("results").alias("body"))
    return payloads.payload_rows(bodies, "body", customer.schema)


@query("""
select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
       cast(c_acctbal as varchar) as c_acctbal, c_mktsegment from customer
""")
def api_xml_records(spark, sf_dir):
    path = scratch_path(spark, "customers")
    customer = table(spark, sf_dir, "customer")
    nested = customer.select("c_custkey", "c_name", F.struct("c_nationkey", "c_acctbal").alias("Detail"), "c_mktsegment")
    # A file is read by one task, whatever its size.
    nested.write.format("xml").options(rowTag="Record", rootTag="Records", maxRecordsPerFile=XML_RECORDS).save(path)
    text = "c_custkey string, c_name string, Detail struct<c_nationkey: string, c_acctbal: string>, c_mktsegment string"
    return payloads.read_xml_records(spark, path, schema=T.StructType.fromDDL(text))


# --------------------------------------------------------------------------
# Workbooks, pages, inventory


def _workbook(rows: pd.DataFrame) -> bytes:
    """A minimal .xlsx file with one sheet: titles, then the rows."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = [list(rows.columns), *rows.astype(object).itertuples(index=False)]
    body = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets>'
        '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" '
        f'Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return content.getvalue()


def customer_workbooks(spark, sf_dir) -> DataFrame:
    """(path, content): the customer table as workbooks, one per Arrow batch."""

    def build(batches):
        for batch in batches:
            yield pd.DataFrame({"path": [f"{batch.iloc[0, 0]}.xlsx"], "content": [_workbook(batch)]})

    return table(spark, sf_dir, "customer").mapInPandas(build, "path string, content binary")


@query("select * from customer")
def excel_xlsx_rows(spark, sf_dir):
    schema = table(spark, sf_dir, "customer").schema
    return workbook_columns(parse_workbooks(customer_workbooks(spark, sf_dir)), schema)


@query("""
select concat(c_custkey // 500, '.xlsx') as path, case when c_custkey // 500 % 3 = 0 then 0 else count(*) end as rows,
       c_custkey // 500 % 3 = 0 as refused
from customer group by c_custkey // 500
""")
def excel_rejects(spark, sf_dir):
    """A workbook for every 500 customers, every third cut off in the middle."""

    def build(key, rows):
        content = _workbook(rows.drop(columns="book"))
        cut = len(content) // 2 if key[0] % 3 == 0 else len(content)
        return pd.DataFrame({"path": [f"{key[0]}.xlsx"], "content": [content[:cut]]})

    customer = table(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / 500))
    books = parse_workbooks(customer.groupBy("book").applyInPandas(build, "path string, content binary"))
    good = books.filter(F.col("error").isNull()).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    bad = rejected_workbooks(books).select("path", F.lit(0).cast("bigint").alias("rows"), F.lit(True).alias("refused"))
    return good.withColumn("refused", F.lit(False)).unionByName(bad)


@query("""
select page_id, 0 as row_idx, 'url' as field, url as content from pages
union all select page_id, 1, 'length', cast(length(html) as varchar) from pages
""")
def html_table_rows(spark, sf_dir):
    """Every page whole, with a table put behind it, as the pages have none."""
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    top = F.concat(
        F.lit("<table><thead><tr><th>field</th><th>content</th></tr></thead><tbody><tr><td>url</td><td>"),
        url,
        F.lit("</td></tr><tr><td>length</td><td>"),
        F.coalesce(F.length("html").cast("string"), F.lit("")),
        F.lit("</td></tr></table>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), top).alias("html"))
    return html.read_first_tables(pages, "page_id", ["field", "content"])


@query("""
select page_id, url,
       case when regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>')
            then trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) end as title
from pages
""")
def html_title(spark, sf_dir):
    return html.html_titles(table(spark, sf_dir, "pages")).select("page_id", "url", "title")


@query("\nunion all ".join(f"select '{name}.parquet' as file, count(*) as rows from {name}" for name in TABLES))
def inventory_rows(spark, sf_dir):
    """The files below the folder and the rows in each; a table in parts is one."""
    found = inventory.object_inventory(spark, sf_dir)
    return inventory.file_rows(found, [table(spark, sf_dir, name) for name in TABLES], sf_dir, ".parquet")


@query("""
select distinct c_mktsegment as path, true as present from customer
union all select distinct concat('no ', c_mktsegment), false from customer
""")
def files_present_absent(spark, sf_dir):
    """One file folder for each segment, compared with a list that also names folders that are not there."""
    target, customer = scratch_path(spark, "segments"), table(spark, sf_dir, "customer")
    write_table(customer, target, "parquet", partition_by=["c_mktsegment"])
    segment = F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1)
    found = inventory.object_inventory(spark, target, ".parquet").select(segment.alias("path")).distinct()
    names = customer.select(F.explode(F.array("c_mktsegment", F.concat(F.lit("no "), "c_mktsegment"))).alias("path"))
    wanted = names.distinct()
    present = inventory.existing(wanted, found).withColumn("present", F.lit(True))
    return present.unionByName(inventory.absent(wanted, found).withColumn("present", F.lit(False)))


@query("""
select 'events.parquet' as file, count(*) as rows from events
union all select 'lineitem.parquet', count(*) from lineitem
""")
def file_stats(spark, sf_dir):
    read = [files.file_stats(table(spark, sf_dir, name)) for name in ("events", "lineitem")]
    return reduce(DataFrame.unionByName, read)
