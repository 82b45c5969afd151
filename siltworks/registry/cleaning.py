"""Null handling, typing and value standardisation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from siltworks.operators import categories, columns, nulls, outliers, text, types
from siltworks.registry.base import query, table
from siltworks.registry.dirty import EVENTS_SQL, ORDERS_SQL, dirty_events, dirty_orders

# --------------------------------------------------------------------------
# Missing values


@query("""
select event_type, value from (
  select case when event_id % 3 <> 0 then event_type end as event_type,
         case when event_id % 2 <> 0 then value end as value from events)
where event_type is not null or value is not null
""")
def drop_all_null_rows(spark, sf_dir):
    key = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.when(key % 3 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 2 != 0, F.col("value")).alias("value"),
    )
    return columns.drop_all_null_rows(events)


@query(f"with d as ({EVENTS_SQL}) select event_id, ts, user_id, event_type, value from d")
def drop_sparse_columns(spark, sf_dir):
    return columns.drop_sparse_columns(dirty_events(spark, sf_dir))


@query(f"""
with d as ({EVENTS_SQL})
select 'event_id' as "column", avg(case when event_id is null then 1 else 0 end) as missing from d
union all select 'ts', avg(case when ts is null then 1 else 0 end) from d
union all select 'user_id', avg(case when user_id is null then 1 else 0 end) from d
union all select 'event_type', avg(case when event_type is null then 1 else 0 end) from d
union all select 'value', avg(case when value is null then 1 else 0 end) from d
union all select 'props', avg(case when props is null then 1 else 0 end) from d
""")
def missing_fraction(spark, sf_dir):
    return columns.missing_fraction(dirty_events(spark, sf_dir))


@query(f"""
with d as (select *, case when event_id % 3 <> 0 then user_id end as user_gap from ({EVENTS_SQL}))
select event_id, ts, user_id, event_type, coalesce(value, (select median(value) from d)) as value, props,
       cast(coalesce(user_gap, (select median(user_gap) from d)) as double) as user_gap from d
""")
def fill_median(spark, sf_dir):
    gaps = dirty_events(spark, sf_dir).withColumn("user_gap", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    return nulls.fill_median(gaps).withColumn("user_gap", F.col("user_gap").cast("double"))


@query(f"""
with d as ({EVENTS_SQL})
select event_id, ts, user_id,
       coalesce(event_type, (select event_type from d where event_type is not null
                             group by event_type order by count(*) desc, event_type limit 1)) as event_type,
       value,
       coalesce(props, (select props from d where props is not null
                        group by props order by count(*) desc, props limit 1)) as props
from d
""")
def fill_mode(spark, sf_dir):
    return nulls.fill_mode(dirty_events(spark, sf_dir))


@query(f"""
with d as ({EVENTS_SQL})
select event_id, ts, user_id, coalesce(event_type, 'none') as event_type, coalesce(value, -1) as value,
       coalesce(props, concat('user ', cast(user_id as varchar))) as props from d
""")
def fill_defaults(spark, sf_dir):
    other = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return nulls.fill_defaults(dirty_events(spark, sf_dir), {"event_type": "none", "value": -1, "props": other})


@query(f"""
with d as ({EVENTS_SQL})
select event_id, ts, user_id, coalesce(event_type, 'Unknown') as event_type, coalesce(value, 0) as value,
       coalesce(props, 'Unknown') as props from d
""")
def fill_zero_unknown(spark, sf_dir):
    return nulls.fill_zero_unknown(dirty_events(spark, sf_dir))


# --------------------------------------------------------------------------
# Types


@query("""
select l_orderkey, l_quantity, l_extendedprice,
       case when l_linenumber = 1 then 'n/a' else cast(l_partkey as varchar) end as part_text
from lineitem
""")
def infer_numeric(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("l_orderkey"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        F.when(F.col("l_linenumber") == 1, F.lit("n/a")).otherwise(F.col("l_partkey").cast("string")).alias("part_text"),
    )
    return types.infer_numeric(lines)


@query("""
select o_orderkey, o_orderdate as day, o_orderdate as moment, cast(o_custkey as varchar) as number_text,
       o_orderpriority as other from orders
""")
def infer_datetime(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.col("o_custkey").cast("string").alias("number_text"),
        F.col("o_orderpriority").alias("other"),
    )
    return types.infer_datetime(orders)


@query("""
select o_orderkey, o_orderdate as order_date, strftime(o_orderdate, '%Y-%m-%d') as day,
       case when o_orderkey % 9 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as updated from orders
""")
def name_hinted_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        day.alias("order_date"),
        day.alias("day"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("unknown")).otherwise(day).alias("updated"),
    )
    return types.name_hinted_dates(orders)


@query("""
select cast(l_orderkey as varchar) as l_orderkey, cast(l_quantity as integer) as l_quantity,
       cast(l_extendedprice as bigint) as l_extendedprice, cast(l_discount as decimal(10,1)) as l_discount,
       cast(l_linenumber as double) as l_linenumber, cast(l_shipdate as date) as l_shipdate,
       cast(cast(l_extendedprice as decimal(18,2)) as integer) as price_units from lineitem
""")
def cast_types(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_shipdate",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price_units"),
    )
    return types.cast_types(lines, {
        "l_orderkey": "VARCHAR",
        "l_quantity": "INTEGER",
        "l_extendedprice": "BIGINT",
        "l_discount": "DECIMAL(10,1)",
        "l_linenumber": "DOUBLE",
        "l_shipdate": "DATE",
        "price_units": "INTEGER",
    })


@query("""
select l_orderkey, l_linenumber, cast(l_extendedprice / 8 as decimal(20,2)) as cents,
       cast(l_extendedprice / 8 as decimal(38,4)) as fine, l_linenumber as below_half from lineitem
""")
def cast_types_wide(spark, sf_dir):
    """Wide decimals from doubles, many of them on half a cent; text that only its eleventh decimal keeps from rounding up."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / 8).alias("cents"),
        (F.col("l_extendedprice") / 8).alias("fine"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".49999999995")).alias("below_half"),
    )
    return types.cast_types(lines, {"cents": "DECIMAL(20,2)", "fine": "DECIMAL(38,4)", "below_half": "INTEGER"})


@query("""
select o_orderkey,
       try_strptime(case when o_orderkey % 9 = 0 then 'n/a' else strftime(o_orderdate, '%d/%m/%Y') end, '%d/%m/%Y')
         at time zone 'America/Sao_Paulo' at time zone 'UTC' as bought,
       try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')
         at time zone 'Asia/Tokyo' at time zone 'UTC' as delivered
from orders
""")
def parse_dates_tz(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
        .alias("bought"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("delivered"),
    )
    return types.parse_dates(orders, {
        "bought": {"format": "DD/MM/YYYY", "timezone": "America/Sao_Paulo"},
        "delivered": {"format": "%Y-%m-%d", "timezone": "Asia/Tokyo"},
    })


@query("""
select l_orderkey, l_linenumber, l_partkey,
       round(cast(l_extendedprice * (1 - l_discount) as decimal(18,2)), 2) as net,
       round(cast(cast(l_extendedprice as varchar) as decimal(18,1)), 1) as price_text,
       round(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2)), 2) as tax
from lineitem
""")
def currency_decimal(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.col("l_extendedprice").cast("string").alias("price_text"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
    )
    return types.currency(lines, {
        "net": {"decimal_places": 2, "currency": "BRL"},
        "price_text": {"decimal_places": 1},
        "tax": {},
    })


# --------------------------------------------------------------------------
# Values

_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"


@query(rf"""
select doc_id, source, n_chars,
       regexp_replace(lower(regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')),
                      '[^\p{{L}}\p{{N}}_{_SPACE}]', '', 'g') as text,
       lang from documents
""")
def clean_text_unicode(spark, sf_dir):
    return text.clean_text(table(spark, sf_dir, "documents"))


@query("select doc_id, lower(trim(text)) as text, lower(trim(lang)) as lang, source, n_chars from documents")
def clean_text_trim(spark, sf_dir):
    return text.trim_lower(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("""
select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' when o_orderpriority = '2-HIGH' then 'it''s high'
       else o_orderpriority end as o_orderpriority from orders
""")
def map_categories(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return categories.map_categories(orders, "o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "it's high"})


@query("""
select o_orderkey, case when year(o_orderdate) = 1995 then strftime(o_orderdate, '%Y-%m-%d')
       else strftime(o_orderdate, '%Y') end as day from orders
""")
def map_categories_large(spark, sf_dir):
    """A mapping of some four thousand days to their years."""
    first = date(1990, 1, 1)
    days = [first + timedelta(days=i) for i in range(365 * 12)]
    mapping = {f"{d:%Y-%m-%d}": f"{d:%Y}" for d in days if d.year != 1995}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return categories.map_categories(orders, "day", mapping)


@query("""
with kinds as (select p_type as t, count(*) / (select count(*) from part) as share from part group by p_type)
select p_partkey, case when share < 0.0005 then 'Other' else p_type end as p_type from part join kinds on p_type = t
""")
def rare_categories_small_share(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return categories.rare_to_other(parts, ["p_type"], 0.0005)


@query("""
with shares as (select props as p, count(*) / (select count(*) from events) as share from events group by props),
kinds as (select event_type as t, count(*) / (select count(*) from events) as share from events group by event_type)
select event_id, ts, user_id, case when kinds.share < 0.01 then 'Other' else event_type end as event_type, value,
       case when shares.share < 0.01 then 'Other' else props end as props
from events join shares on props = p join kinds on event_type = t
""")
def rare_categories(spark, sf_dir):
    return categories.rare_to_other(table(spark, sf_dir, "events"))


@query("""
select props as value, count(*) as count, count(*) / (select count(*) from events) as share
from events group by props
""")
def value_share(spark, sf_dir):
    return categories.value_share(table(spark, sf_dir, "events"), "props")


@query("""
with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
select event_id, greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)) as value from events cross join q
""")
def iqr_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.cap_outliers(events, exclude=("event_id",))
