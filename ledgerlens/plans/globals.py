"""Whole-table figures attached to every row, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Put the columns of one-row frames (global aggregates) on every row of
    ``df``.  Each row meets exactly one row: the output has as many rows as
    ``df`` (never a product of two inputs).  Catalyst folds the constant key
    and plans a broadcast nested-loop join against the single broadcast row,
    streaming ``df`` without a shuffle.  A global aggregate has exactly one row
    whatever its input size, so the broadcast is bounded by construction."""
    out = df.withColumn("__one", F.lit(1))
    for r in one_row:
        out = out.join(F.broadcast(r.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


def with_totals(df: DataFrame, **figures: Column) -> DataFrame:
    """Attach one-row aggregates, e.g. ``with_totals(df, grand=F.sum("x"))``.

    Both branches read the same upstream exchange, which Spark reuses instead
    of recomputing.
    """
    totals = df.agg(*[expr.alias(name) for name, expr in figures.items()])
    return attach_one_row(df, totals)


def with_quantiles(df: DataFrame, col: str, names: dict[str, float],
                   accuracy: int = 10000) -> DataFrame:
    """Attach ``percentile_approx`` cut points of ``col`` over the whole table.

    All cut points come from one mergeable sketch (one ``percentile_approx``
    call with an array of probabilities), as a one-row broadcast side.
    """
    probs = list(names.values())
    q = df.agg(F.percentile_approx(col, probs, accuracy).alias("__q"))
    q = q.select(*[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    return attach_one_row(df, q)
