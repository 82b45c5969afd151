"""Duplicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import dedupe, joins
from siltworks.registry.base import query, table
from siltworks.registry.dirty import CUSTOMER_THIN_SQL, ORDERS_SQL, dirty_orders, thin_customers


@query(f'with d as ({ORDERS_SQL}) select distinct "Order ID", "Cust.Key", "Order  Date", "STATUS" from d')
def distinct_rows(spark, sf_dir):
    return dedupe.distinct_rows(
        dirty_orders(spark, sf_dir).select("Order ID", "`Cust.Key`", "Order  Date", "STATUS")
    )


def _ranked(direction: str) -> str:
    return f"""
    select doc_id, text, lang, source, n_chars from (
      select *, row_number() over (partition by text order by doc_id {direction}) as rn from documents) where rn = 1
    """


@query(_ranked("asc"))
def dedupe_keep_first(spark, sf_dir):
    return dedupe.dedupe(table(spark, sf_dir, "documents"), ["text"], "keep_first", ["doc_id"])


@query("""
select o_custkey, min(o_orderkey) as _rank, arg_min(o_orderstatus, o_orderkey) as _count from orders group by o_custkey
""")
def dedupe_reserved_names(spark, sf_dir):
    """Columns named as an operator might name its own."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("_rank"), F.col("o_orderstatus").alias("_count")
    )
    return dedupe.dedupe(orders, ["o_custkey"], "keep_first", ["_rank"])


@query(_ranked("desc"))
def dedupe_keep_last(spark, sf_dir):
    return dedupe.dedupe(table(spark, sf_dir, "documents"), ["text"], "keep_last", ["doc_id"])


@query("""
select * from documents where text in (select text from documents group by text having count(*) = 1)
""")
def dedupe_keep_none(spark, sf_dir):
    return dedupe.dedupe(table(spark, sf_dir, "documents"), ["text"], "keep_none")


@query("""
select l_orderkey, l_linenumber, count(*) as count from lineitem group by l_orderkey, l_linenumber having count(*) > 1
""")
def duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _joined(spark, sf_dir, how: str):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = thin_customers(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment")
    return joins.enrich(orders, customers, [("o_custkey", "c_custkey")], how)


def _join_sql(how: str) -> str:
    return f"""
    with c as ({CUSTOMER_THIN_SQL})
    select o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment
    from orders {how} join c on o_custkey = c_custkey
    """


@query(_join_sql("inner"))
def enrich_inner(spark, sf_dir):
    return _joined(spark, sf_dir, "inner")


@query(_join_sql("left"))
def enrich_left(spark, sf_dir):
    return _joined(spark, sf_dir, "left")


@query(_join_sql("right"))
def enrich_right(spark, sf_dir):
    return _joined(spark, sf_dir, "right")


@query(_join_sql("full"))
def enrich_full(spark, sf_dir):
    return _joined(spark, sf_dir, "full")


@query("""
with bands as (
  select n_name as band, n_nationkey * 20000.0 as low_price, (n_nationkey + 1) * 20000.0 as high_price from nation)
select o_orderkey, o_totalprice, band, cast(low_price as double) as low_price, cast(high_price as double) as high_price
from orders left join bands on o_totalprice >= low_price and o_totalprice < high_price
""")
def enrich_theta_range(spark, sf_dir):
    key = F.col("n_nationkey")
    bands = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("band"), (key * 20000.0).alias("low_price"), ((key + 1) * 20000.0).alias("high_price")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.enrich_band(orders, bands, "o_totalprice", "low_price", "high_price", "left", high_inclusive=False)


@query("""
select l.l_orderkey, l.l_linenumber, l.l_suppkey, l.hot_key, k.part_key
from (select l_orderkey, l_linenumber, l_suppkey, case when l_orderkey % 3 = 0 then 1 else l_suppkey end as hot_key from lineitem) l
full join (select p_partkey as part_key from part where p_partkey % 50 <> 7) k on l.hot_key = k.part_key
""")
def enrich_full_hot_key(spark, sf_dir):
    """A third of the line items have one key, whose rows are spread over the tasks."""
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey")).alias("hot_key")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", key)
    parts = table(spark, sf_dir, "part").filter("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("part_key"))
    return joins.enrich(items, parts, [("hot_key", "part_key")], "full", broadcast_bytes=0)


@query("""
select c_custkey, c_acctbal, c_nationkey, s_suppkey, s_acctbal, s_nationkey
from customer left join supplier on c_acctbal > s_acctbal and c_nationkey < s_nationkey
""")
def enrich_two_bounds(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return joins.enrich_bounds(
        customers, suppliers, [("c_acctbal", ">", "s_acctbal"), ("c_nationkey", "<", "s_nationkey")], "left"
    )
