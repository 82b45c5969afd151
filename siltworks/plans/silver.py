"""Cleaning by configuration: dates, amounts, keys, enrichment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from siltworks.operators.columns import standardize_names
from siltworks.operators.dedupe import dedupe
from siltworks.operators.joins import enrich
from siltworks.operators.nulls import fill_defaults
from siltworks.operators.text import trim_lower
from siltworks.operators.types import currency, parse_dates


@dataclass(frozen=True)
class Enrichment:
    table: DataFrame
    on: str | list | Column
    how: str = "left"
    columns: list[str] | None = None


@dataclass(frozen=True)
class SilverSpec:
    """What to do, by standard column name. Empty parts are skipped."""

    dates: dict[str, dict] = field(default_factory=dict)
    currency: dict[str, dict] = field(default_factory=dict)
    trim: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    strategy: str = "keep_first"
    order_by: list[str] = field(default_factory=list)
    enrichments: list[Enrichment] = field(default_factory=list)


def to_silver(df: DataFrame, spec: SilverSpec) -> DataFrame:
    """Names, dates, amounts, text, defaults, one row per key, joins, in this order."""
    result = standardize_names(df)
    if spec.dates:
        result = parse_dates(result, spec.dates)
    if spec.currency:
        result = currency(result, spec.currency)
    if spec.trim:
        result = trim_lower(result, spec.trim)
    if spec.defaults:
        result = fill_defaults(result, spec.defaults)
    if spec.keys:
        result = dedupe(result, spec.keys, spec.strategy, spec.order_by)
    for e in spec.enrichments:
        # Columns the join does not need are gone before its shuffle.
        result = enrich(result, e.table.select(*e.columns) if e.columns else e.table, e.on, e.how)
    return result
