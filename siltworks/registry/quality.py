"""Checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import quality
from siltworks.registry.base import query, table
from siltworks.registry.dirty import CUSTOMER_THIN_SQL, EVENTS_SQL, dirty_events, thin_customers


@query(f"""
with d as ({EVENTS_SQL})
select 'value' as "column", 'min' as bound, '5.0' as "limit", count(*) as violations from d where value < 5.0
union all select 'value', 'max', '100', count(*) from d where value > 100
union all select 'user_id', 'max', '40', count(*) from d where user_id > 40
""")
def range_checks(spark, sf_dir):
    checks = {"value": {"min": 5.0, "max": 100}, "user_id": {"max": 40}}
    return quality.range_checks(dirty_events(spark, sf_dir), checks)


@query(f"""
with c as ({CUSTOMER_THIN_SQL})
select 'o_custkey' as "column", 'customer.c_custkey' as reference, count(*) as violations
from orders left join c on o_custkey = c_custkey where c_custkey is null
""")
def fk_orphan_count(spark, sf_dir):
    checks = {"foreign_key": {"column": "o_custkey", "reference": "customer.c_custkey"}}
    return quality.integrity_checks(
        table(spark, sf_dir, "orders"), checks, {"customer": thin_customers(spark, sf_dir)}
    )


@query(f"""
with c as ({CUSTOMER_THIN_SQL})
select orders.* from orders left join c on o_custkey = c_custkey where c_custkey is null
""")
def fk_orphan_rows(spark, sf_dir):
    return quality.orphan_rows(
        table(spark, sf_dir, "orders"), "o_custkey", thin_customers(spark, sf_dir), "c_custkey"
    )


_PROFILE_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}


@query(
    f"with d as ({EVENTS_SQL}) "
    + " union all ".join(
        f"""select '{name}' as "column", '{kind}' as type, count(*) as rows,
        count(*) - count({name}) as nulls, count(distinct {name}) as "distinct" from d"""
        for name, kind in _PROFILE_TYPES.items()
    )
)
def profile_table(spark, sf_dir):
    return quality.profile(dirty_events(spark, sf_dir))


@query("select column_name as \"column\", true as within_15_percent from (describe lineitem)")
def profile_distinct_approx(spark, sf_dir):
    """Approximate distinct counts of every column held against the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    about = quality.profile(lines, approx=True).select("column", F.col("distinct").alias("about"))
    exact = quality.profile(lines).select("column", "distinct")
    near = F.abs(F.col("about") - F.col("distinct")) <= 0.15 * F.col("distinct")
    return about.join(exact, "column").select("column", near.alias("within_15_percent"))


@query(f"""
with c as ({CUSTOMER_THIN_SQL})
select 'min' as "check", 'o_totalprice' as subject, count(*) as violations from orders where o_totalprice < 5000
union all select 'max', 'o_totalprice', count(*) from orders where o_totalprice > 450000
union all select 'unique', 'o_custkey', count(*) - count(distinct o_custkey) from orders
union all select 'foreign_key', 'o_custkey', count(*) from orders
  left join c on o_custkey = c_custkey where c_custkey is null
""")
def quality_report(spark, sf_dir):
    return quality.quality_report(
        table(spark, sf_dir, "orders"),
        ranges={"o_totalprice": {"min": 5000, "max": 450000}},
        keys=[["o_custkey"]],
        foreign_keys=[("o_custkey", thin_customers(spark, sf_dir), "c_custkey")],
    )
