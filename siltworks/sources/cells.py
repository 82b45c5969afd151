"""From rows of text cells to named, typed columns; shared by HTML tables and workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import quoted


def cells_to_columns(rows: DataFrame, names: list[str], group: list[str], header: str = "header") -> DataFrame:
    """Rows ``(group..., row_idx, header, cells)`` to one text column per name.

    ``header`` is the list of column titles of the row's own table, so tables
    whose columns come in another order or with extra columns fit as well. A
    title that a table lacks gives null.
    """
    def cell(name: str) -> Column:
        place = F.array_position(F.col(header), F.lit(name))
        return F.when(place > 0, F.try_element_at("cells", place.cast("int")))

    return rows.select(*[F.col(quoted(g)) for g in group], "row_idx", *[cell(n).alias(n) for n in names])
