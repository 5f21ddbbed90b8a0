"""Order within a key, with a hot key spread over many tasks.

A window by key alone puts all rows of a key into one task. Here the rows of a key are cut into
slices along the order, the window runs within (key, slice), and one pre-aggregated row a slice
says what came before it. There are at most ``SLICES`` of these to a key.

A table of at most ``WHOLE_ROWS`` rows is one slice, which comes to the plain window and the same result.

Keys aren't null. The order column may hold ties but they stay within one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256
#: Rows of a table that a single task may order.
WHOLE_ROWS = 1_000_000
#: Cuts of a column whose values lie unevenly.
CUTS = 63
_SLICE, _BEFORE, _FIRST = "__keyloom_slice", "__keyloom_before", "__keyloom_first"


def even_slices(rows: DataFrame, column: str) -> Column | None:
    """The slice of a whole-number column that runs evenly from its least to its greatest value; None for one slice."""
    n, low, high = rows.agg(F.count("*"), F.min(column).cast("double"), F.max(column).cast("double")).first()
    if n <= WHOLE_ROWS or low is None or low == high:
        return None
    place = (F.col(column).cast("double") - low) * (SLICES / (high - low))
    return F.coalesce(F.floor(place).cast("int"), F.lit(-1))


def uneven_slices(rows: DataFrame, column: str) -> Column | None:
    """The slice of a column, cut where about equally many rows lie between: how many cuts are below it."""
    if rows.count() <= WHOLE_ROWS:
        return None
    cuts = rows.agg(F.percentile_approx(column, F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)]), F.lit(1000))).first()[0]
    if not cuts:
        return None
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(column)))


def _earlier():
    return Window.partitionBy("key").orderBy(_SLICE)


def _joined(cut: DataFrame, totals: DataFrame) -> DataFrame:
    return cut.join(totals, ["key", _SLICE])


def numbered(rows: DataFrame, part: Column | None, order: list, name: str) -> DataFrame:
    """``rows`` with their place, from 0, among those of their key; ``part`` never falls along ``order``."""
    if part is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint") - 1)
    cut = rows.withColumn(_SLICE, part)
    sizes = cut.groupBy("key", _SLICE).agg(F.count("*").alias("n"))
    before = F.sum("n").over(_earlier().rowsBetween(Window.unboundedPreceding, -1))
    totals = sizes.select("key", _SLICE, F.coalesce(before, F.lit(0)).alias(_BEFORE))
    placed = cut.withColumn(_FIRST, F.row_number().over(Window.partitionBy("key", _SLICE).orderBy(*order)))
    return _joined(placed, totals).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(_FIRST) + F.col(_BEFORE) - 1).alias(name))


def running_sum(rows: DataFrame, part: Column | None, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those of their key up to them; nulls add nothing."""
    if part is None:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = rows.withColumn(_SLICE, part)
    sums = cut.groupBy("key", _SLICE).agg(F.sum(value).alias("n"))
    totals = sums.select("key", _SLICE, F.sum("n").over(_earlier().rowsBetween(Window.unboundedPreceding, -1)).alias(_BEFORE))
    own = F.sum(value).over(Window.partitionBy("key", _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn(_FIRST, own)
    total = F.when(F.col(_FIRST).isNull(), F.col(_BEFORE)).otherwise(F.col(_FIRST) + F.coalesce(_BEFORE, F.lit(0)))
    return _joined(placed, totals).select(*[F.col(f"`{c}`") for c in rows.columns], total.alias(name))


def previous(rows: DataFrame, part: Column | None, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the ``value`` of the row before them of their key, null for the first."""
    if part is None:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy("key").orderBy(order)))
    cut = rows.withColumn(_SLICE, part)
    lasts = cut.groupBy("key", _SLICE).agg(F.max_by(F.struct(value), F.col(order)).alias("n"))
    totals = lasts.select("key", _SLICE, F.lag("n").over(_earlier()).alias(_BEFORE))
    own = Window.partitionBy("key", _SLICE).orderBy(order)
    placed = cut.withColumn(_FIRST, F.lag(F.struct(value)).over(own))
    return _joined(placed, totals).select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(_FIRST, _BEFORE)[value].alias(name))
