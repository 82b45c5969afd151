"""Contract checks on the part table as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.contracts import Check, Contract, accepted, annotate, error_counts, rejected
from siltworks.contracts.catalog import PRODUCT_CSV
from siltworks.registry.base import query, table
from siltworks.registry.dirty import PRODUCTS_SQL, dirty_products

_TYPED = f"""
with d as ({PRODUCTS_SQL}),
typed as (
  select *, try_cast(trim(price) as double) as price_value,
         case when lower(available) in ('yes', '1', 'on') then true
              when lower(available) in ('off', 'false') then false end as available_value from d)
"""


def _annotated(spark, sf_dir):
    return annotate(dirty_products(spark, sf_dir), PRODUCT_CSV)


@query(f"""{_TYPED}
select cast(product_id as bigint) as product_id, product_name, category, price_value as price,
       available_value as available
from typed where product_name is not null and price_value is not null and available_value is not null
""")
def contract_valid_rows(spark, sf_dir):
    return accepted(_annotated(spark, sf_dir))


@query(f"""{_TYPED}
select product_id, product_name, category, price, available,
       concat_ws(',', case when product_name is null then 'product_name:null' end,
                 case when price_value is null then 'price:type' end,
                 case when available_value is null then 'available:type' end) as errors
from typed where product_name is null or price_value is null or available_value is null
""")
def contract_rejects(spark, sf_dir):
    errors = F.transform("_errors", lambda e: F.concat_ws(":", e["field"], e["error"]))
    return rejected(_annotated(spark, sf_dir)).withColumn("errors", F.array_join(errors, ",")).drop("_errors")


@query(f"""{_TYPED}
select 'product_name' as field, 'null' as error, count(*) as rows from typed where product_name is null
union all select 'price', 'type', count(*) from typed where price_value is null
union all select 'available', 'type', count(*) from typed where available_value is null
""")
def contract_error_counts(spark, sf_dir):
    return error_counts(_annotated(spark, sf_dir))


PRICED_PART = Contract.of(
    "PricedPart",
    Check("small", "p_size <= 40"),
    Check("worth_its_size", "p_retailprice >= 10 * p_size + 900"),
    p_partkey="int",
    p_size="int",
    p_retailprice="float",
)


@query("""
with failed as (
  select 'small' as error from part where p_size > 40
  union all select 'worth_its_size' from part where p_retailprice < 10 * p_size + 900)
select '*' as field, error, count(*) as rows from failed group by error
""")
def contract_checks(spark, sf_dir):
    """Rules beyond types, counted by rule."""
    return error_counts(annotate(table(spark, sf_dir, "part").select(*PRICED_PART.columns), PRICED_PART))
