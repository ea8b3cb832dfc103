"""Running sums and carried values along the rows of a key, in tasks of bounded size.

A window over a key sorts all its rows in one task. Here the rows of a key are cut into ranges of ``width``
values of its order column. Each range is summed up (totals, and the last value that is there), the
summaries run along the ranges, and what came before a range is added to the window within it. So a task
sorts the rows of ranges, or one summary for each range of a key: of 10^12 rows, a million.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values of a range.
WIDTH = 1 << 20


def carried(rows: DataFrame, keys: Sequence[str], order: str, *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """rows with new columns, along ``order`` (whole numbers) within the keys: of ``sums`` (whole numbers) the total up to the row, of ``lasts`` the last value up to the row that is not null.

    Rows whose key is null begin anew with each range. Rows with the same key and order have no order among them, as in a window.
    """
    sums, lasts, keys = sums or {}, lasts or {}, list(keys)
    own = {n: f"_own_{n}" for n in (*sums, *lasts)}
    zero = F.lit(0).cast("long")
    here = rows.withColumns({"_range": F.expr(f"CAST(`{order}` DIV {width}L AS LONG)")} | {own[n]: c for n, c in (sums | lasts).items()})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    ranges = here.groupBy(*keys, "_range").agg(*(F.sum(own[n]).cast("long").alias(own[n]) for n in sums), *(last(own[n]).alias(own[n]) for n in lasts))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*keys, "_range", *(F.sum(own[n]).over(earlier).alias(f"_up_{n}") for n in sums), *(F.last(own[n], ignorenulls=True).over(earlier).alias(f"_up_{n}") for n in lasts))
    upto = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = {n: F.sum(own[n]).over(upto).cast("long") + F.coalesce(f"_up_{n}", zero) for n in sums} | {n: F.coalesce(F.last(own[n], ignorenulls=True).over(upto), F.col(f"_up_{n}")) for n in lasts}
    return here.join(before, [*keys, "_range"], "left").select(*(c for c in rows.columns if c not in own), *(c.alias(n) for n, c in value.items()))


def islands(rows: DataFrame, keys: Sequence[str], order: str, own: Column, name: str, *, lasts: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """rows with ``name``, a number that rises along the order within the keys: each row that is ``own`` (never null) is an island of its own, and what lies between two of them is one."""
    counted = carried(rows.withColumn("_mine", own), keys, order, sums={name: F.col("_mine").cast("long")}, lasts=lasts, width=width)
    return counted.withColumn(name, 2 * F.col(name) + (~F.col("_mine")).cast("long")).drop("_mine")


def range_counts(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Rows by range of the order column: a small table, which is worth storing beside a large one."""
    return rows.groupBy(F.expr(f"CAST(floor(`{order}` / {width}D) AS LONG)").alias("range")).agg(F.count(F.lit(1)).alias("n"))


def page_by_rank(rows: DataFrame, order: str, offset: int, limit: int, counts: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Rows number offset to offset + limit - 1 along the order column (whole numbers, without repeats). ``counts`` (of ``range_counts``) tells which ranges these lie in; only rows of those ranges are read, by a filter that reaches the files, and sorted: two ranges, where they are not nearly empty and hold a page. Rows without an order value have no rank."""
    counts = (range_counts(rows, order, width) if counts is None else counts).where("range IS NOT NULL")
    upto = F.sum("n").over(Window.orderBy("range"))
    held = counts.withColumn("upto", upto).where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit))
    low, high, before = held.agg(F.min("range"), F.max("range"), F.min(F.col("upto") - F.col("n"))).first()
    if low is None:
        return rows.limit(0)
    inside = rows.where((F.col(order) >= low * width) & (F.col(order) < (high + 1) * width))
    return inside.orderBy(order).offset(offset - before).limit(limit)
