"""The given tables with the faults that the operators repair.

The data itself has no nulls, orphans or bad names. Each view has a Spark form
and the same thing as SQL text for DuckDB. All keep every row of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.registry.base import table

EVENTS_SQL = """
select event_id, ts, user_id,
       case when event_id % 5 = 0 then null else event_type end as event_type,
       case when event_id % 7 = 0 then null else value end as value,
       case when event_id % 4 <> 0 then null else props end as props
from events
"""

ORDERS_SQL = """
select o_orderkey as "Order ID", o_custkey as "Cust.Key",
       case when o_orderkey % 9 = 0 then 'n/a' else strftime(o_orderdate, '%d/%m/%Y') end as "Order  Date",
       cast(cast(o_totalprice as decimal(18,2)) as varchar) as "Total Price (BRL)",
       case when o_orderkey % 6 = 0 then null else concat('  ', upper(o_orderstatus), ' ') end as "STATUS",
       unnest(case when o_orderkey % 5 = 0 then [0, 1] else [0] end) as copy_no
from orders
"""

CUSTOMER_THIN_SQL = "select * from customer where c_custkey % 10 <> 0"

PRODUCTS_SQL = """
select cast(p_partkey as varchar) as product_id,
       case when p_partkey % 11 = 0 then null else p_name end as product_name,
       case when p_partkey % 4 = 0 then null else p_type end as category,
       case when p_partkey % 13 = 0 then 'abc'
            when p_partkey % 17 = 0 then concat(' ', cast(cast(p_retailprice as decimal(18,2)) as varchar), ' ')
            else cast(cast(p_retailprice as decimal(18,2)) as varchar) end as price,
       case p_partkey % 6 when 0 then 'yes' when 1 then 'off' when 2 then '1'
                          when 3 then 'FALSE' when 4 then 'on' else '2' end as available
from part
"""


def _null_where(condition, column: str):
    return F.when(~condition, F.col(column)).alias(column)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in text and number, and a column that is three quarters null."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        _null_where(key % 5 == 0, "event_type"),
        _null_where(key % 7 == 0, "value"),
        _null_where(key % 4 != 0, "props"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad names, bad dates, amounts as text, padded status, some orders twice."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("Order ID"),
        F.col("o_custkey").alias("Cust.Key"),
        F.when(key % 9 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Order  Date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Total Price (BRL)"),
        F.when(key % 6 != 0, F.concat(F.lit("  "), F.upper("o_orderstatus"), F.lit(" "))).alias("STATUS"),
        F.explode(F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy_no"),
    )


def thin_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with gaps, which leaves orders without one."""
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 0)


def dirty_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text, with type errors, null errors and many spellings of yes and no."""
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    spelling = {0: "yes", 1: "off", 2: "1", 3: "FALSE", 4: "on"}
    available = F.lit("2")
    for rest, word in spelling.items():
        available = F.when(key % 6 == rest, F.lit(word)).otherwise(available)
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("product_id"),
        F.when(key % 11 != 0, F.col("p_name")).alias("product_name"),
        F.when(key % 4 != 0, F.col("p_type")).alias("category"),
        F.when(key % 13 == 0, F.lit("abc"))
        .when(key % 17 == 0, F.concat(F.lit(" "), price, F.lit(" ")))
        .otherwise(price)
        .alias("price"),
        available.alias("available"),
    )
