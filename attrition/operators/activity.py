"""Activity measures of event streams per account and month, without a window over an account's events.

* **Latest events.** ``latest_per_group`` keeps the k latest rows of a group.  Spark plans the rank limit
  twice: every task keeps k rows of a group before the shuffle, and k of what is left decide.
  ``running_latest`` merges such lists along the months of an account (a list of
  at most k entries a month, so the window never sees events).
* **Inactive days.** A month's active days are one 31-bit mask, built by ``bit_or`` with
  partial aggregation; the longest run of days without activity is the
  longest run of zero bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, keys: list[str], order: list[str], k: int, fields: list[str],
                     name: str = "latest") -> DataFrame:
    """One row per group: ``name``, the (unordered) array of ``fields`` of the k rows latest in ``order``.

    Nulls in ``order`` count as earliest.  Of rows that agree in all of
    ``order`` any may be kept: include a key to make the choice unique.
    """
    rank = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    kept = df.select(*keys, *dict.fromkeys([*order, *fields])).withColumn("_rank", F.row_number().over(rank))
    return (kept.where(F.col("_rank") <= k).groupBy(*keys)
            .agg(F.collect_list(F.struct(*[F.col(c) for c in fields])).alias(name)))


def running_latest(df: DataFrame, keys: list[str], along: list[str], lists: str, k: int, name: str) -> DataFrame:
    """``df`` with ``name``: the k greatest entries of the lists of this row and of the rows before it.

    Rows are ordered by ``along`` inside ``keys``; the caller's rows are periods (months), few per key.
    Entries are structs that begin with their order.  A null list is an empty one.
    """
    so_far = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = F.flatten(F.collect_list(F.col(lists)).over(so_far))
    return df.withColumn(name, F.slice(F.sort_array(merged, asc=False), 1, k))


def sum_where(entries: str, value: str, condition: str = "true") -> str:
    """SQL: sum of ``value`` (over entries ``x``) where ``condition`` holds; 0 for none."""
    return f"aggregate(filter({entries}, x -> {condition}), 0D, (s, x) -> s + {value})"


def day_mask_sql(day: str, condition: str) -> str:
    """SQL aggregate: bit d - 1 is set if ``condition`` holds on the d-th day of the month for any row."""
    return f"bit_or(CASE WHEN {condition} THEN shiftleft(1, dayofmonth({day}) - 1) ELSE 0 END)"


def longest_gap_sql(mask: str, days: str) -> str:
    """SQL: the longest run of zero bits among the lowest ``days`` bits of ``mask``.

    Up to two set bits, the usual month of an account, need only their places; more are read off the binary text.
    """
    m = f"coalesce({mask}, 0)"
    rest = f"{m} & ({m} - 1)"  # without the lowest set bit
    low, high = f"bit_count(({m} & -{m}) - 1)", f"bit_count(({rest}) - 1)"  # zero bits below a bit
    return (f"CASE WHEN {m} = 0 THEN {days} "
            f"WHEN ({rest}) = 0 THEN greatest({low}, {days} - 1 - {low}) "
            f"WHEN (({rest}) & (({rest}) - 1)) = 0 THEN greatest({low}, {high} - {low} - 1, {days} - 1 - {high}) "
            f"ELSE array_max(transform(split(lpad(bin({m}), {days}, '0'), '1'), x -> length(x))) END")
