"""Mixing sources to target weights along a time-varying curriculum.

All native: DataFrame operations only, no Python on the executors.

Targets: sources by code point (null last) have weights repeating ``WEIGHTS``
and share the words of the corpus; a target stops at ``CAP`` times its source's
size, and the excess is shared by weight among the others until none is above.

Order: within a source, documents run in the order of the MD5 of their id.  A
source takes whole passes over its documents and then the first words of one
more.  Its weight over training time t in [0, 1] goes linearly from a start to
an end (``RAMPS``, by weight class); the integral of that schedule, turned
round, gives the time at which the source has asked for so many of its words:
each copy of a document has the position that its own pass asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import WORD, materialise

WEIGHTS = (1, 2, 3)
CAP = 3
#: Relative weight of a source at the begin and end of the training, by class.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def _of_class(values: tuple, rank: Column) -> Column:
    """The value for a rank counted from 1, repeating."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (((rank - 1) % len(values)) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, weight, target) of ``sizes(source, source_size)``,
    one row a source."""
    order = F.col("source").asc_nulls_last()
    spread = materialise(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # Ranks without one task for all sources: each range counts its own, and the
    # few ranges' counts are summed up.
    before = (spread.groupBy("part").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("before")
    ranked = materialise(spread.join(before, "part").withColumn("rank", rank)
                         .withColumn("weight", _of_class(weights, F.col("rank")).cast("long"))
                         .select("source", "source_size", "rank", "weight"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = ranked.agg(F.sum(big("source_size"))).first()[0] or 0
    stopped, share, over, known = F.lit(False), total, None, -1
    while True:
        got = ranked.agg(F.count_if(stopped), F.sum(F.when(stopped, big("source_size") * cap)),
                         F.sum(F.when(~stopped, big("weight")))).first()
        share, over = total - (got[1] or 0), got[2]
        if got[0] == known or over is None:
            break
        known = got[0]
        stopped = big("source_size") * cap * F.lit(over) < big("weight") * F.lit(share)
    free = (big("weight") * F.lit(share)).cast("double") / F.lit(float(over or 1))
    return ranked.withColumn("target", F.when(stopped, (F.col("source_size") * cap).cast("double")).otherwise(free))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: Column | None = None,
        weights: tuple = WEIGHTS, cap: int = CAP, ramps: tuple = RAMPS, keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``position``, the
    training time of the first copy (null if none is taken), range-sorted by it.

    A null source is a source of its own.  A document without words is never
    taken.  Rows with equal ids run by size; rows equal in both are told apart
    only by the words they get, so reruns agree on the result as a whole.
    """
    mixed = _placed(docs, id_col, source, size, weights, cap, keep)
    position = F.when(F.col("taken") > 0, _when(_share(F.lit(0)), F.col("rank"), ramps))
    # The key spreads the many documents without a position over all ranges.
    return (mixed.withColumn("position", position).select("row", "size", "source_size", "target", "taken", "position", "key")
            .orderBy(F.col("position").asc_nulls_last(), "key").drop("key"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: Column | None = None,
               weights: tuple = WEIGHTS, cap: int = CAP, ramps: tuple = RAMPS, keep: list | None = None) -> DataFrame:
    """The documents of ``mix`` once for each pass that takes words of them: ``row``, ``size``,
    ``pass`` (from 0), ``words`` (taken by the pass; fewer than ``size`` only where the source's
    target ends) and the copy's own ``position``, range-sorted by it."""
    mixed = _placed(docs, id_col, source, size, weights, cap, keep)
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = mixed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return (copies.withColumn("position", _when(_share(F.col("pass")), F.col("rank"), ramps))
            .select("row", "size", "pass", words.alias("words"), "position", "key")
            .orderBy("position", "key").drop("key"))


def _placed(docs: DataFrame, id_col: str, source: str, size: Column | None, weights: tuple, cap: int,
            keep: list | None) -> DataFrame:
    """``mix`` before it is ordered: with ``done``, the words of the source before the document."""
    size = word_count("text") if size is None else size
    sized = materialise(docs.select(
        F.struct(*(keep or ["*"])).alias("row"), size.alias("size"), F.col(source).alias("source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key")))
    plan = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    # Running sums by source: slices of about the square root of the rows keep
    # both a slice and the list of a source's slices small, however hot it is.
    slices = max(1, math.isqrt(sized.count()))
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    sliced = sized.withColumn("slice", F.floor(head * slices / F.lit(1 << 32)))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
              .withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
              .withColumnRenamed("source", "of"))
    start = materialise(starts.join(plan, F.col("of").eqNullSafe(F.col("source")))
                        .select("of", F.col("slice").alias("at"), "start", "source_size", "rank", "target"))
    inside = (Window.partitionBy("source", "slice").orderBy("key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (sliced.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(start, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("slice"))))
    done = F.col("start") + F.col("inside")
    want = F.floor("target")
    whole = F.expr("floor(target) div greatest(source_size, 1L)")
    rest = want - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - done))
    return placed.select("row", "key", "size", "source_size", "target", "rank", done.alias("done"), taken.cast("long").alias("taken"))


def _share(passed: Column) -> Column:
    """The part of its target that a source has asked for in the middle of a document, in the pass after ``passed`` others."""
    before = F.col("done") + passed * F.col("source_size")
    return F.least(F.lit(1.0), F.try_divide(before + F.col("size") / 2, F.col("target")))


def _when(share: Column, rank: Column, ramps: tuple) -> Column:
    """The time at which a linear ramp's integral reaches ``share`` of its whole."""
    a, b = (_of_class(tuple(r[i] for r in ramps), rank) for i in (0, 1))
    return share * (a + b) / (a + F.sqrt(a * a + (b * b - a * a) * share))
