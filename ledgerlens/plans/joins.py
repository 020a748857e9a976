"""Entity profiles: an entity left-joined to pre-aggregated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame


def profile(entity: DataFrame, key, *measures: DataFrame, fill: bool = True) -> DataFrame:
    """``entity`` left-joined to each per-``key`` measure frame, NULL -> 0.

    Every measure frame must already be aggregated to one row per key, so
    each join is one-to-at-most-one and the entity's row count is kept.  The
    fill reaches numeric columns only (dates, strings and booleans keep
    their NULLs), like ``DataFrame.fillna(0)``.
    """
    out = entity
    for m in measures:
        out = out.join(m, key, "left")
    return out.fillna(0) if fill else out
