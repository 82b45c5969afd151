"""Whole jobs, streams, and the columns they add."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.contracts.catalog import PRODUCT_CSV
from siltworks.operators import columns as ops
from siltworks.operators.nulls import fill_zero_unknown
from siltworks.operators.text import trim_lower
from siltworks.plans import clean_table as cleaning_plan
from siltworks.plans import files_to_silver as files_plan
from siltworks.plans.ingest import ingest
from siltworks.plans.silver import Enrichment, SilverSpec, to_silver
from siltworks.registry.base import RUN_TIME, query, table
from siltworks.registry.dirty import EVENTS_SQL, ORDERS_SQL, PRODUCTS_SQL, dirty_events, dirty_orders, dirty_products
from siltworks.session import scratch_path
from siltworks.sinks.audit import append_audit, read_audit
from siltworks.sinks.files import write_bronze, write_table
from siltworks.sources.files import read_csv, read_json, read_parquet
from siltworks.streaming import incremental

STAMP = f"timestamp '{RUN_TIME}'"


@query(f"""
with d_orders as ({ORDERS_SQL}),
clean as (
  select "Order ID" as order_id, "Cust.Key" as cust_key,
         try_strptime("Order  Date", '%d/%m/%Y') at time zone 'America/Sao_Paulo' at time zone 'UTC' as order_date,
         cast("Total Price (BRL)" as decimal(18,2)) as total_price_brl,
         coalesce(lower(trim("STATUS")), 'unknown') as status, copy_no
  from d_orders),
ranked as (select *, row_number() over (partition by order_id order by copy_no) as rn from clean)
select order_id, cust_key, order_date, total_price_brl, status, c_name, c_mktsegment
from ranked left join customer on cust_key = c_custkey where rn = 1
""")
def silver_orders(spark, sf_dir):
    customer = Enrichment(
        table(spark, sf_dir, "customer"), [("cust_key", "c_custkey")], "left", ["c_custkey", "c_name", "c_mktsegment"]
    )
    spec = SilverSpec(
        dates={"order_date": {"format": "DD/MM/YYYY", "timezone": "America/Sao_Paulo"}},
        currency={"total_price_brl": {"decimal_places": 2}},
        trim=["status"],
        defaults={"status": "unknown"},
        keys=["order_id"],
        order_by=["copy_no"],
        enrichments=[customer],
    )
    return to_silver(dirty_orders(spark, sf_dir), spec).drop("copy_no", "c_custkey")


def _dirty_table(spark, sf_dir):
    """Events with bad names, gaps, numbers and dates as text, and every fourth row twice."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("Event ID"),
        F.when(key % 5 != 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit("! "))).alias("Event-Type"),
        F.when(key % 7 != 0, F.col("value")).alias("Value"),
        F.when(key % 4 == 0, F.col("props")).alias("Sparse"),
        F.col("props").alias("Tag"),
        F.when(key % 6 != 0, F.col("user_id").cast("string")).alias("User (text)"),
        F.when(key % 8 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("Day"),
        F.explode(F.when(key % 4 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("Zero"),
    )


_WORDS = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"


@query(rf"""
with dirty as (
  select event_id,
         case when event_id % 5 <> 0 then concat(' ', upper(event_type), '! ') end as event_type,
         case when event_id % 7 <> 0 then value end as value,
         props as tag,
         case when event_id % 6 <> 0 then cast(user_id as varchar) end as user_text,
         case when event_id % 8 <> 0 then strftime(ts, '%Y-%m-%d') end as day,
         unnest(case when event_id % 4 = 0 then [0, 0] else [0] end) as zero
  from events),
base as (select distinct * from dirty),
filled as (
  select event_id, zero, tag,
         coalesce(event_type, (select event_type from base where event_type is not null
                               group by event_type order by count(*) desc, event_type limit 1)) as event_type,
         coalesce(value, (select median(value) from base)) as value,
         cast(coalesce(user_text, (select user_text from base where user_text is not null
                                   group by user_text order by count(*) desc, user_text limit 1)) as bigint) as user_text,
         cast(coalesce(day, (select day from base where day is not null
                             group by day order by count(*) desc, day limit 1)) as timestamp) as day
  from base),
fences as (
  select quantile_cont(event_id, 0.25) as e1, quantile_cont(event_id, 0.75) as e3,
         quantile_cont(value, 0.25) as v1, quantile_cont(value, 0.75) as v3,
         quantile_cont(user_text, 0.25) as u1, quantile_cont(user_text, 0.75) as u3 from filled),
cleaned as (
  select greatest(least(cast(event_id as double), e3 + 1.5 * (e3 - e1)), e1 - 1.5 * (e3 - e1)) as event_id,
         regexp_replace(lower(trim(event_type)), '{_WORDS}', '', 'g') as event_type,
         greatest(least(value, v3 + 1.5 * (v3 - v1)), v1 - 1.5 * (v3 - v1)) as value,
         regexp_replace(lower(trim(tag)), '{_WORDS}', '', 'g') as tag,
         greatest(least(cast(user_text as double), u3 + 1.5 * (u3 - u1)), u1 - 1.5 * (u3 - u1)) as user_text,
         day, cast(zero as double) as zero
  from filled cross join fences),
total as (select count(*) as n from cleaned),
types as (select event_type as t, count(*) as n from cleaned group by event_type),
tags as (select tag as t, count(*) as n from cleaned group by tag)
select event_id,
       case when types.n / total.n < 0.01 then 'Other' else event_type end as event_type,
       value,
       case when tags.n / total.n < 0.01 then 'Other' else tag end as tag,
       user_text, day, zero
from cleaned join types on event_type = types.t join tags on tag = tags.t cross join total
""")
def clean_table(spark, sf_dir):
    return cleaning_plan.clean_table(_dirty_table(spark, sf_dir))


@query(f"""
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       {STAMP} as processed_at, 'file_ingestion' as source_system, {STAMP} as ingestion_timestamp from orders
""")
def add_metadata(spark, sf_dir):
    tagged = ops.add_metadata(table(spark, sf_dir, "orders"), RUN_TIME, "file_ingestion")
    return ops.add_metadata(tagged, RUN_TIME)


@query("""
select row_number() over (order by o_orderdate, o_orderkey) - 1 as index,
       o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders
""")
def row_index(spark, sf_dir):
    return ops.row_index(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


@query("""
select row_number() over (order by o_orderkey) - 1 as index, o_orderkey, o_custkey as _id, o_orderstatus as _tie,
       o_totalprice as _place from orders
""")
def row_index_reserved_names(spark, sf_dir):
    """Columns named as an operator might name its own."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("_id"), F.col("o_orderstatus").alias("_tie"), F.col("o_totalprice").alias("_place")
    )
    return ops.row_index(orders, ["o_orderkey"])


@query(f"""
with d as ({EVENTS_SQL}),
filled as (
  select event_id, ts, user_id, coalesce(event_type, 'Unknown') as event_type,
         coalesce(value, 0) as value, coalesce(props, 'Unknown') as props from d
  where event_id is not null)
select event_id, ts, user_id, lower(trim(event_type)) as event_type, value, props,
       {STAMP} as processed_at, 'file_ingestion' as source_system
from filled
""")
def custom_processor_chain(spark, sf_dir):
    return ops.run_all(
        dirty_events(spark, sf_dir),
        [
            ops.drop_all_null_rows,
            fill_zero_unknown,
            lambda df: trim_lower(df, ["event_type"]),
            lambda df: ops.add_metadata(df, RUN_TIME, "file_ingestion"),
        ],
    )


# --------------------------------------------------------------------------
# Sources to bronze


@query("""
select 'tables' as origin, 'spark' as framework, 'success' as status, count(*) as rows, 5 as columns,
       'c_acctbal:double,c_custkey:bigint,c_mktsegment:string,c_name:string,c_nationkey:int' as columns_types,
       '2024' as year, '06' as month, '01' as day
from customer
""")
def audit_record(spark, sf_dir):
    root = scratch_path(spark, "audit")
    entry = write_bronze(table(spark, sf_dir, "customer"), root, "tables", RUN_TIME)
    append_audit(spark, root, [entry])
    types = F.transform(
        F.array_sort(F.map_entries("columns_types")), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return read_audit(spark, root).select(
        "origin", "framework", "status", "rows", "columns", F.array_join(types, ",").alias("columns_types"),
        "year", "month", "day",
    )


@query(f"""
with d as ({PRODUCTS_SQL}),
typed as (
  select cast(product_id as bigint) as product_id, product_name, category, try_cast(trim(price) as double) as price,
         case when lower(available) in ('yes', '1', 'on') then true
              when lower(available) in ('off', 'false') then false end as available from d)
select * from typed where product_name is not null and price is not null and available is not null
""")
def ingest_contract_bronze(spark, sf_dir):
    landed = scratch_path(spark, "landed") + "/products.csv"
    write_table(dirty_products(spark, sf_dir), landed, "csv")
    root = scratch_path(spark, "bronze")
    raw = read_csv(spark, landed, schema=PRODUCT_CSV.landing_schema, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    done = ingest(raw, PRODUCT_CSV, root, "csv", RUN_TIME, mode="quarantine")
    return read_csv(spark, done.entry.data_file, schema=PRODUCT_CSV.schema)


@query(f"""
with d as ({PRODUCTS_SQL}),
typed as (
  select *, try_cast(trim(price) as double) as price_value,
         case when lower(available) in ('yes', '1', 'on') then true
              when lower(available) in ('off', 'false') then false end as available_value from d)
select cast(product_id as bigint) as product_id, product_name, category, price_value as price, available_value as available
from typed where product_name is not null and price_value is not null and available_value is not null
""")
def ingest_drop_mode(spark, sf_dir):
    root = scratch_path(spark, "dropped")
    done = ingest(dirty_products(spark, sf_dir), PRODUCT_CSV, root, "products", RUN_TIME, mode="drop")
    return read_csv(spark, done.entry.data_file, schema=PRODUCT_CSV.schema)


# --------------------------------------------------------------------------
# Files to silver


@query("""
select case when p_partkey % 3 = 0 then 'text.parquet' else 'number.parquet' end as source_file,
       cast(p_size as varchar) as size, cast(null as varchar) as error
from part where p_partkey % 3 <> 2
union all select 'refused.parquet', null, 'refused'
""")
def files_to_silver_mixed(spark, sf_dir):
    """Files whose types do not go together and one that a processor refuses: each stands for itself."""
    source, target, key = scratch_path(spark, "mixed"), scratch_path(spark, "silver"), F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    kinds = {"text": (0, "string"), "number": (1, "int"), "refused": (2, "double")}
    for name, (rest, kind) in kinds.items():
        write_table(part.filter(key % 3 == rest).select(key, F.col("p_size").cast(kind).alias("size")), f"{source}/{name}")

    def no_fractions(df):
        if df.schema["size"].dataType.typeName() == "double":
            raise ArithmeticError("sizes are whole")
        return df

    report = files_plan.files_to_silver(spark, source, target, ".parquet", processors=[no_fractions], run_time=RUN_TIME)
    folder = F.concat(F.element_at(F.split("path", "/"), -2), F.lit(".parquet"))
    failed = report.files.filter(F.col("error").isNotNull()).select(folder.alias("source_file")).distinct()
    outputs = report.files.filter(F.col("error").isNull()).select(folder.alias("source_file"), "output").collect()
    paths: dict[str, list[str]] = {}
    for r in outputs:
        paths.setdefault(r["source_file"], []).append(f"{target}/output={r['output']}")
    none = F.lit(None).cast("string")
    read = [
        read_parquet(spark, own).select(F.lit(name).alias("source_file"), F.col("size").cast("string"), none.alias("error"))
        for name, own in paths.items()
    ]
    return reduce(DataFrame.unionByName, read).unionByName(
        failed.select("source_file", F.lit(None).cast("string").alias("size"), F.lit("refused").alias("error"))
    )


@query("""
with rows as (
  select 'customer' as kind, c_custkey as key, c_name as name, c_acctbal as amount from customer
  union all select 'supplier', s_suppkey, s_name, s_acctbal from supplier
  union all select 'part', p_partkey, p_name, p_retailprice from part)
select kind, key, coalesce(name, 'Unknown') as name, amount, timestamp '2024-06-01 12:30:45' as ingestion_timestamp from rows
""")
def files_to_silver(spark, sf_dir):
    """Three folders of files in three formats, one with every row twice, to one silver table."""
    source, target = scratch_path(spark, "files"), scratch_path(spark, "silver")

    def pick(name, key, label, amount):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("kind"), F.col(key).alias("key"), F.col(label).alias("name"), F.col(amount).alias("amount")
        )

    customer = pick("customer", "c_custkey", "c_name", "c_acctbal")
    write_table(customer.select("*", F.explode(F.array(F.lit(0), F.lit(0))).alias("n")).drop("n"), f"{source}/a", "csv")
    write_table(pick("supplier", "s_suppkey", "s_name", "s_acctbal"), f"{source}/b", "json")
    write_table(pick("part", "p_partkey", "p_name", "p_retailprice"), f"{source}/c", "parquet")
    schema = customer.schema
    for folder, ending in (("a", ".csv"), ("b", ".json"), ("c", ".parquet")):
        options = {"lines": True} if ending == ".json" else {}
        files_plan.files_to_silver(
            spark, f"{source}/{folder}", target, ending, processors=[fill_zero_unknown], schema=schema, run_time=RUN_TIME, **options
        )
    # A row twice in one file is one row; the copies of customer lie in the same file.
    return read_parquet(spark, target).select("kind", "key", "name", "amount", "ingestion_timestamp")


@query("""
with kept(source, key, value, kind) as (
  select 'a.csv', cast(c_custkey as varchar), cast(c_nationkey as varchar), 'int' from customer where c_custkey % 2 = 0
  union all select 'b.csv', cast(c_custkey as varchar), c_mktsegment, 'string' from customer where c_custkey % 2 = 1
  union all select 'a.json', cast(s_suppkey as varchar), cast(s_acctbal as varchar), 'double' from supplier
  union all select 'p.parquet', cast(p_partkey as varchar), p_name, 'string' from part)
select source, key, case when kind = 'double' then cast(cast(value as double) as varchar) else value end as value, kind, source = 'p.parquet' as own_path
from kept
union all select 'torn.csv', null, null, 'malformed record', false
""")
def files_to_silver_shapes(spark, sf_dir):
    """One folder: two CSV files of other types, a stem with two endings, Parquet with a column ``source_path``, a torn file."""
    source, target, key = scratch_path(spark, "shapes"), scratch_path(spark, "silver"), F.col("c_custkey")
    customer, named = table(spark, sf_dir, "customer"), {}
    landed = {
        "a.csv": (customer.filter(key % 2 == 0).select(key.alias("key"), F.col("c_nationkey").alias("value")), "csv"),
        "b.csv": (customer.filter(key % 2 == 1).select(key.alias("key"), F.col("c_mktsegment").alias("value")), "csv"),
        "a.json": (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("double").alias("value")), "json"),
        "p.parquet": (table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), F.lit("its own").alias("source_path")), "parquet"),
        "torn.csv": (spark.createDataFrame([("1,2",), ("3",)], "`key,value` string"), "lines"),
    }
    for name, (df, kind) in landed.items():
        # A folder for each file: Spark chooses the names of the files themselves.
        named[name] = f"{source}/{name.replace('.', '_')}"
        if kind == "lines":
            write_table(df.coalesce(1), named[name], "csv", sep="|", quote="")
        else:
            write_table(df, named[name], kind)
    report = files_plan.files_to_silver(spark, source, target, run_time=RUN_TIME).files
    stem = F.element_at(F.split("path", "/"), -2).alias("folder")
    results, names = [], {v.rsplit("/", 1)[1]: k for k, v in named.items()}
    outputs: dict[str, list[str]] = {}
    for r in report.filter("error is null and rows > 0").select(stem, "output").collect():
        outputs.setdefault(r["folder"], []).append(f"{target}/output={r['output']}")
    for folder, own in outputs.items():
        df = read_parquet(spark, own)
        kind = dict(df.dtypes)["value"]
        results.append(df.select(
            F.lit(names[folder]).alias("source"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
            F.lit(kind).alias("kind"), (F.col("source_path") == "its own").alias("own_path"),
        ))
    none = F.lit(None).cast("string")
    failed = report.filter(F.col("error").isNotNull() & F.col("path").contains("torn")).select(
        F.lit("torn.csv").alias("source"), none.alias("key"), none.alias("value"), F.col("error").alias("kind"), F.lit(False).alias("own_path")
    ).distinct()
    return reduce(DataFrame.unionByName, results).unionByName(failed)


# --------------------------------------------------------------------------
# Streams


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return incremental.stream_files(spark, sf_dir, schema, pathGlobFilter="events.parquet")


@query(f"""
with d as ({EVENTS_SQL})
select event_id, ts, user_id, coalesce(event_type, 'Unknown') as event_type, coalesce(value, 0) as value,
       coalesce(props, 'Unknown') as props, {STAMP} as ingestion_timestamp from d
""")
def stream_bronze_to_silver(spark, sf_dir):
    """The event files as a stream; a second run on the same checkpoint adds nothing."""
    work = scratch_path(spark, "stream")
    key = F.col("event_id")
    gaps = {
        "event_type": F.when(key % 5 != 0, F.col("event_type")),
        "value": F.when(key % 7 != 0, F.col("value")),
        "props": F.when(key % 4 == 0, F.col("props")),
    }
    steps = [lambda df: df.withColumns(gaps), fill_zero_unknown, lambda df: ops.add_metadata(df, RUN_TIME)]
    for _ in range(2):
        incremental.write_new(_event_stream(spark, sf_dir), f"{work}/silver", f"{work}/checkpoint", steps)
    return read_parquet(spark, f"{work}/silver")


@query("select event_id, ts, user_id, event_type, value, props from events")
def stream_dedupe_events(spark, sf_dir):
    work = scratch_path(spark, "stream")
    doubled = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    single = incremental.dedupe_stream(doubled, ["event_id"], "ts", "1 hour")
    incremental.write_new(single, f"{work}/out", f"{work}/checkpoint")
    return read_parquet(spark, f"{work}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
