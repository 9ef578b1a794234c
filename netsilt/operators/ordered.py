"""Ordered computations per key that hold up when one key owns much of the data.

A window partitioned by a device or category puts the whole key into one task. Here
a key is cut into slices of time, so a task gets the rows of one key and slice. What
crosses a slice border, the totals of earlier slices, is one row per key and slice and
is added by a join that keeps the partitioning. Building the plan runs no job. Windows of
the last n rows cut large keys only, as told by a count of rows per key.

A slice is as fine as ``slice_width`` says. Rows of one key and one time stamp stay
together, ordered by the rest of the order (the log's id); a running frame over them
needs no memory for more than one row at a time, beyond what the sort spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_WIDTH = 86_400_000_000   # a day, in microseconds
BLOCK_ROWS = 4096              # rows per block of ``over_previous_rows``
WHOLE_ROWS = 200_000           # rows of a key that ``over_previous_rows`` takes as one window


def _slice(df: DataFrame, column: str, width: int) -> Column:
    time = dict(df.dtypes)[column].startswith("timestamp")
    return F.floor((F.unix_micros(column) if time else F.col(column)) / F.lit(width))


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_k``: the key columns as a struct, which is never null and joins nulls too."""
    return df.withColumn("_k", F.struct(*keys))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], total: dict[str, str] | None = None,
            last: dict[str, str] | None = None, following: dict[str, str] | None = None,
            slice_width: int = SLICE_WIDTH, previous: dict[str, str] | None = None) -> DataFrame:
    """Adds columns (new name: column) over the rows of the key in order, this row included:
    ``total`` the sum up to it, ``last`` the latest value that is not null, ``following``
    the first one from it on. ``previous`` is the latest value that is not null before this row.

    ``order`` must identify a row; its first column, a number or time stamp, makes the slices.
    """
    total, last, following, previous = total or {}, last or {}, following or {}, previous or {}
    carried = {**last, **previous}
    sliced = _keyed(df, keys).withColumn("_slice", _slice(df, order[0], slice_width))
    before, now = Window.unboundedPreceding, Window.currentRow
    by_slice = Window.partitionBy("_k", "_slice")
    forth = by_slice.orderBy(*order).rowsBetween(before, now)
    strictly = by_slice.orderBy(*order).rowsBetween(before, -1)
    back = by_slice.orderBy(*[F.desc(c) for c in order]).rowsBetween(before, now)
    key = Window.partitionBy("_k")
    earlier = key.orderBy("_slice").rowsBetween(before, -1)
    later = key.orderBy(F.desc("_slice")).rowsBetween(before, -1)
    place = lambda v: F.when(F.col(v).isNotNull(), F.struct(*order))
    of_slice = sliced.groupBy("_k", "_slice").agg(
        F.count("*").alias("_rows"), *[F.sum(v).alias(f"_t_{n}") for n, v in total.items()],
        *[F.max_by(v, place(v)).alias(f"_l_{n}") for n, v in carried.items()],
        *[F.min_by(v, place(v)).alias(f"_f_{n}") for n, v in following.items()])
    bases = of_slice.select(
        "_k", "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in total],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in carried],
        *[F.last(f"_f_{n}", ignorenulls=True).over(later).alias(f"_f_{n}") for n in following])
    local = sliced.withColumns({
        **{f"_a_{n}": F.sum(v).over(forth) for n, v in total.items()},
        **{f"_b_{n}": F.last(v, ignorenulls=True).over(forth) for n, v in last.items()},
        **{f"_b_{n}": F.last(v, ignorenulls=True).over(strictly) for n, v in previous.items()},
        **{f"_c_{n}": F.last(v, ignorenulls=True).over(back) for n, v in following.items()}})
    return local.join(bases, ["_k", "_slice"]).select(
        *df.columns, *[(F.col(f"_a_{n}") + F.col(f"_t_{n}")).alias(n) for n in total],
        *[F.coalesce(f"_b_{n}", f"_l_{n}").alias(n) for n in carried],
        *[F.coalesce(f"_c_{n}", f"_f_{n}").alias(n) for n in following])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                  slice_width: int = SLICE_WIDTH) -> DataFrame:
    """Adds ``out``: sum of ``value`` over all rows of the key up to this one."""
    return running(df, keys, order, total={out: value}, slice_width=slice_width)


def over_previous_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, columns: dict[str, Column],
                       slice_width: int = SLICE_WIDTH, block_rows: int = BLOCK_ROWS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds aggregate ``columns`` over the last ``size`` rows of the key, this one included.

    A key of up to ``whole_rows`` rows is one window. Rows of larger ones, of which there are few, are
    numbered per key and dealt into blocks of ``block_rows``; the last rows of a block are also the context
    of the next one.
    """
    block_rows = max(block_rows, size)
    back = size - 1
    large = F.broadcast(df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > whole_rows).select(
        F.struct(*keys).alias("_k")))
    keyed = _keyed(df, keys)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
    small = keyed.join(large, "_k", "left_anti").select(
        *df.columns, *[c.over(whole).alias(name) for name, c in columns.items()])
    cut = keyed.join(large, "_k", "left_semi").drop("_k")
    numbered = running_total(cut.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", "_n", slice_width)
    at = F.col("_n") - 1
    block = F.floor(at / F.lit(block_rows))
    place = lambda shift: F.struct((block + shift).alias("block"), F.lit(shift == 1).alias("context"))
    spread = _keyed(numbered, keys).withColumn("_in", F.explode(
        F.when(at % block_rows >= block_rows - back, F.array(place(0), place(1))).otherwise(F.array(place(0)))))
    w = Window.partitionBy("_k", F.col("_in.block")).orderBy("_n").rowsBetween(-back, 0)
    return small.unionByName(
        spread.withColumns({name: c.over(w) for name, c in columns.items()})
        .filter(~F.col("_in.context")).select(*df.columns, *columns)
    )
