"""General cleaning of one table, with every decision taken from the data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from siltworks.operators import statistics as st
from siltworks.operators.categories import RARE_SHARE, fit_frequent, keep_frequent
from siltworks.operators.columns import sparse_columns, standardize_names
from siltworks.operators.dedupe import distinct_rows
from siltworks.operators.nulls import fill_values, medians, modes
from siltworks.operators.outliers import cap, fit_fences
from siltworks.operators.text import clean_text
from siltworks.operators.types import DATE_FORMATS, TextTypes, apply_text_types, fit_text_types
from siltworks.session import materialize

SPARSE_STAGES = ("before_fill", "after_fill")


@dataclass(frozen=True)
class CleaningStats:
    """What was learned from a table; small, and enough to clean later data alike."""

    dropped: list[str] = field(default_factory=list)
    fills: dict[str, float | str] = field(default_factory=dict)
    numbers: dict[str, str] = field(default_factory=dict)
    dates: dict[str, str] = field(default_factory=dict)
    fences: dict[str, tuple[float, float]] = field(default_factory=dict)
    kept: dict[str, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CleaningStats:
        raw = json.loads(text)
        raw["fences"] = {n: tuple(v) for n, v in raw["fences"].items()}
        return cls(**raw)


def fit_cleaning(
    df: DataFrame,
    sparse_threshold: float = 0.7,
    rare_share: float = RARE_SHARE,
    sparse_stage: str = "before_fill",
    outlier_exclude: tuple[str, ...] = (),
    approx: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
) -> CleaningStats:
    """Learn from a table with standard names and distinct rows.

    Each step sees the table as the steps before it leave it: medians before
    quartiles, quartiles after filling, rare values after text cleaning.
    """
    if sparse_stage not in SPARSE_STAGES:
        raise ValueError(f"sparse_stage must be one of {SPARSE_STAGES}")
    found, spans = st.overview(df)
    dropped = sparse_columns(found, sparse_threshold) if sparse_stage == "before_fill" else []
    left = df.drop(*dropped)
    gaps = {n for n in left.columns if found.counts[n]}
    numeric = [n for n in st.numeric_columns(left) if n in gaps and found.counts[n] < found.rows]
    text = [n for n in st.text_columns(left) if n in gaps]
    fills = {**medians(left, numeric, approx, spans), **modes(left, text)}
    types = fit_text_types(left, formats=formats)
    typed = apply_text_types(fill_values(left, fills), types)
    # A median fill adds values but moves no end; an all-missing column stays as it is.
    filled = {n: replace(s, values=found.rows if s.values else 0) for n, s in spans.items()}
    fences = fit_fences(typed, exclude=outlier_exclude, approx=approx, known=filled)
    if sparse_stage == "after_fill":
        dropped = sparse_columns(st.missing_counts(typed), sparse_threshold)
        fences = {n: f for n, f in fences.items() if n not in dropped}
    kept = fit_frequent(clean_text(typed.drop(*dropped)), share=rare_share, rows=found.rows)
    return CleaningStats(dropped, fills, types.numbers, types.dates, fences, kept)


def apply_cleaning(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """One projection; works on a batch or a stream with the fitted columns."""
    left = df.drop(*stats.dropped)
    fills = {n: v for n, v in stats.fills.items() if n not in stats.dropped}
    types = TextTypes(
        {n: v for n, v in stats.numbers.items() if n not in stats.dropped},
        {n: v for n, v in stats.dates.items() if n not in stats.dropped},
    )
    typed = apply_text_types(fill_values(left, fills), types)
    return keep_frequent(clean_text(cap(typed, stats.fences)), stats.kept)


def clean_table(df: DataFrame, **options) -> DataFrame:
    """Standard names, distinct rows, then everything :func:`fit_cleaning` decides.

    The distinct rows are written once to the shared folder: each later pass
    reads only its own columns, and a lost executor costs no earlier work.
    """
    base = materialize(distinct_rows(standardize_names(df)), "distinct")
    return apply_cleaning(base, fit_cleaning(base, **options))
