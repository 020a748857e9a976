"""Ranks and percentiles over groups of any size, on one lazy path.

A group is never one task: equal values are counted first (combined where they
are read), and the distinct values are scanned in slices (``sequence.scan``), as many as
they need.  Nothing runs before the caller's action, and nothing is written or
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.globals import attach_one_row
from ledgerlens.plans.sequence import ROWS, scan


def ranked_histogram(df: DataFrame, value: str, keys=(), rows: int = ROWS) -> DataFrame:
    """Rows (keys..., value, __c, __lt, __n): the count of ``value`` in its key group, the
    rows strictly before it in ascending order (NULLs first), and the group size."""
    keys = list(keys)
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    return scan(hist, keys, [value], before={"__lt": "__c"}, whole={"__n": "__c"}, rows=rows, weight="__c")


def percent_rank(df: DataFrame, order_col: str, out: str, partition_by=(),
                 descending: bool = False, rows: int = ROWS) -> DataFrame:
    """``df`` plus ``out`` = percent_rank() over (partition by keys order by ``order_col``),
    NULLs first (last, if ``descending``), identical to the window function's result."""
    keys = list(partition_by)
    before = F.col("__n") - F.col("__lt") - F.col("__c") if descending else F.col("__lt")
    share = F.when(F.col("__n") > 1, before / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    ranks = ranked_histogram(df, order_col, keys, rows).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(order_col).alias("__v"), share.alias(out))
    cond = [df[k].eqNullSafe(ranks[f"__k_{k}"]) for k in keys] + [df[order_col].eqNullSafe(ranks["__v"])]
    return df.join(ranks, cond).drop(*[f"__k_{k}" for k in keys], "__v")


def percentiles(df: DataFrame, value: str, probs: dict[str, float], keys=(), rows: int = ROWS) -> DataFrame:
    """(keys..., a column a probability): exact nearest-rank percentiles of ``df.value``, NULLs and
    groups of NULLs left out.  Equal values are counted where they are read, and the counts of a
    group are scanned in slices, so that no task holds a group."""
    hist = ranked_histogram(df.where(F.col(value).isNotNull()), value, keys, rows)
    return hist.groupBy(*keys).agg(*[reached(F.col(value), p).alias(n) for n, p in probs.items()])


def reached(value: Column, p: float) -> Column:
    """Aggregate of a ranked histogram: the value that holds the rank ``p``."""
    rank = F.ceil(F.lit(p) * F.col("__n"))
    return F.max(F.when((F.col("__lt") < rank) & (rank <= F.col("__lt") + F.col("__c")), value))


def with_percentiles(agg: DataFrame, df: DataFrame, value: str, probs: dict[str, float],
                     keys=(), accuracy: int | None = None, rows: int = ROWS) -> DataFrame:
    """Attach per-group nearest-rank percentiles of ``df.value`` to the per-group frame ``agg``.

    They are exact (``percentiles``).  ``accuracy`` asks for a mergeable sketch instead
    (``percentile_approx``; its state a group and task is of that many values)."""
    keys = list(keys)
    if accuracy:
        q = df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()])
    else:
        q = percentiles(df, value, probs, keys, rows)
    if not keys:
        return attach_one_row(agg, q)
    q = q.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *probs)
    cond = [agg[k].eqNullSafe(q[f"__k_{k}"]) for k in keys]
    return agg.join(q, cond, "left").drop(*[f"__k_{k}" for k in keys])


def ntile(df: DataFrame, order_cols, n: int, out: str, rows: int = ROWS) -> DataFrame:
    """``df`` plus ``out`` = ntile(n) over a global ascending order on ``order_cols`` (NULLs first),
    which must be total.  Each row's position comes from one scan, and the bucket follows
    the window's rule (the first N mod n buckets hold one row more)."""
    placed = scan(df.withColumn("__unit", F.lit(1)), [], list(order_cols), before={"__i": "__unit"}, whole={"__n": "__unit"}, rows=rows)
    i, total = F.col("__i") + 1, F.col("__n")
    size, rem = F.floor(total / n), total % n
    big_rows = rem * (size + 1)
    bucket = (F.when(i <= big_rows, F.floor((i - 1) / (size + 1)) + 1)
              .otherwise(rem + F.floor(F.try_divide(i - 1 - big_rows, size)) + 1))
    return placed.withColumn(out, bucket.cast("int")).drop("__unit", "__i", "__n")
