"""Exact distinct counts of ids as bitmaps that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, keys: Sequence[str], id_col: str, out: str, **sums: Column) -> DataFrame:
    """(keys..., out, sums...): the number of distinct ``id_col`` (a whole number; NULLs don't
    count) of every group, and additive aggregates of its rows (counts and sums).

    Ids are set in bitmaps of 32768 places, one for each group and range of ids, built
    where the rows are read and merged, so that a row of a group that has been met costs
    nothing more, and a hot group is spread over its ranges.  For few groups of many ids; a
    group of few ids is better counted as pairs (``F.countDistinct``)."""
    dealt = df.groupBy(*keys, F.bitmap_bucket_number(id_col).alias("__range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("__ids"), *[c.alias(n) for n, c in sums.items()])
    return dealt.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("__ids")), F.lit(0)).alias(out),
                                    *[F.sum(n).alias(n) for n in sums])
