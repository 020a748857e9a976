"""Ordered measures over keys of any size, all in one scan.

The rows of a key, in order, are cut into slices at rows of their own.  The cut
rows come from a sample by hash: a row in ``each`` is drawn, every OVER-th drawn row of
a key is a cut, and ``each`` follows from the number of rows, so a key has as many
slices as its rows need, a key with few rows has one, and a table has about
MOST cuts at the most, however large it is.  A cut is a whole order tuple, so it also
falls between rows of equal time.  The drawing depends on the data alone: it is the same
however often and in whatever order a task is run.

Every measure is computed inside one slice of one key, in one window stage.  What a
slice needs from the others is a small state (last and first row, counts and sums), which is
aggregated per slice of the cut keys, scanned there, and broadcast as an array a key.
Nothing runs before the caller's action, and nothing is written or collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.globals import attach_one_row

#: Rows of a slice that are not worth cutting, cuts of a table, drawn rows a cut.
ROWS = 1 << 20
MOST = 50_000
OVER = 4
_BITS = 17  # of a slice number: MOST, and more than twice what chance can add


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS,
               weight: str | None = None) -> DataFrame:
    """(keys..., __cuts): the sorted cut rows of the keys that have any (without keys: of the
    table, one row, none if empty).  ``weight`` is a column of positive numbers, such as a histogram's
    counts, whose sum may stand for the number of rows: all branches of a scan then read the
    same columns of the histogram and share its one exchange."""
    total = df.agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__total"))
    each = F.greatest(F.lit(1), F.greatest(F.lit(rows), F.ceil(F.col("__total") / MOST)) / OVER).cast("long")
    lot = F.pmod(F.xxhash64(*keys, *order), each)
    # A condition on the order alone would be pushed below the histogram's aggregate, which then is one of its own.
    lot = lot if weight is None else F.when(F.col(weight) > 0, lot)
    drawn = (attach_one_row(df, total).where(lot == 0)
             .select(*keys, F.struct(*order).alias("__at")).groupBy(*keys)
             .agg(F.sort_array(F.array_distinct(F.collect_list("__at"))).alias("__drawn")))
    cuts = drawn.select(*keys, F.filter("__drawn", lambda _, i: (i + 1) % OVER == 0).alias("__cuts"))
    return cuts.where(F.size("__cuts") > 0)


def with_bounded(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` joined on ``keys``, NULL meeting NULL, with a side of about MOST rows or array
    elements at the most, which is broadcast; without keys the side is one row at the most."""
    df, side, keys = ((df, side, list(keys)) if keys else
                      (df.withColumn("__all", F.lit(1)), side.withColumn("__all", F.lit(1)), ["__all"]))
    r = F.broadcast(side.withColumnsRenamed({c: f"__j_{c}" for c in keys}))
    joined = df.join(r, [df[c].eqNullSafe(r[f"__j_{c}"]) for c in keys], how)
    return joined.drop(*[f"__j_{c}" for c in keys], "__all")


def reached(points: Column, at: Column) -> Column:
    """How many of the sorted ``points`` are not after ``at``, by binary search (NULL points: 0)."""
    step = lambda n, b: F.when(F.get(points, n + b - 1) <= at, n + b).otherwise(n)
    found = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(_BITS))]), F.lit(0), step)
    return F.when(points.isNotNull(), found).otherwise(0)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS,
           weight: str | None = None, how: str = "left") -> DataFrame:
    """``df`` plus ``__cuts`` and ``__slice``, which grows from 0 with the order inside a key; ``how``
    "inner" leaves only the keys that are cut."""
    cut = with_bounded(df, cut_points(df, keys, order, rows, weight), keys, how)
    return cut.withColumn("__slice", reached(F.col("__cuts"), F.struct(*order)))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


_SUMS = {"n": F.count, "s": F.sum, "q": F.sum}


def _terms(value: str) -> dict[str, Column]:
    return {"n": F.col(value), "s": F.col(value), "q": F.col(value) * F.col(value)}


def _brought(df: DataFrame, keys: list[str], order: list[str], lag: dict, lead: dict, before: dict, whole: dict,
             running: dict, rows: int, weight: str | None) -> DataFrame:
    """(keys..., __slices): for every key that is cut, its slices in order: their number, their first
    row, and what the other slices bring them."""
    at, time = F.struct(*order), F.col(order[0])
    s = sliced(df, keys, order, rows, weight, "inner")
    s = s.withColumn("__from", F.get("__cuts", F.col("__slice") - 1)[order[0]])
    peer = (F.col("__slice") > 0) & time.eqNullSafe(F.col("__from"))
    terms = [(f"{i}{k}", _SUMS[k], x) for i, v in enumerate(running.values()) for k, x in _terms(v).items()]
    states = s.groupBy(*keys, "__slice").agg(
        F.min(at).alias("__first"), F.first("__from").alias("__from"),
        *([F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lag.items()]), at).alias("__last")] if lag else []),
        *([F.min_by(F.struct(*[F.col(c).alias(n) for n, c in lead.items()]), at).alias("__lead")] if lead else []),
        *[_or_zero(F.sum(c)).alias(f"__b_{n}") for n, c in before.items()],
        *[_or_zero(F.sum(c)).alias(f"__w_{n}") for n, c in whole.items()],
        *[_or_zero(sums(x)).alias(f"__all_{f}") for f, sums, x in terms],
        *[_or_zero(sums(F.when(peer, x))).alias(f"__peer_{f}") for f, sums, x in terms])
    across = Window.partitionBy(*keys, F.lit(0)).orderBy("__slice")
    sofar = across.rowsBetween(Window.unboundedPreceding, -1)
    if terms:  # the peers of a cut's time in its slice and in those after it that begin at the same time
        on = Window.partitionBy(*keys, "__from").orderBy(F.desc("__slice"))
        states = states.select("*", *[F.sum(f"__peer_{f}").over(on).alias(f"__peers_{f}") for f, _, _ in terms])
    state = states.select(*keys, F.struct(
        "__slice", "__first",
        *[F.lag("__last").over(across)[n].alias(f"l_{n}") for n in lag],
        *[F.lead("__lead").over(across)[n].alias(f"f_{n}") for n in lead],
        *[_or_zero(F.sum(f"__b_{n}").over(sofar)).alias(f"b_{n}") for n in before],
        *[(F.sum(f"__w_{n}").over(Window.partitionBy(*keys, F.lit(0))) - F.col(f"__w_{n}")).alias(f"w_{n}") for n in whole],
        *[_or_zero(F.sum(f"__all_{f}").over(sofar)).alias(f"before_{f}") for f, _, _ in terms],
        *[_or_zero(F.lead(f"__peers_{f}").over(across)).alias(f"later_{f}") for f, _, _ in terms]).alias("__state"))
    return state.groupBy(*keys).agg(F.sort_array(F.collect_list("__state")).alias("__slices"))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], lag: Mapping[str, str] | None = None,
         lead: Mapping[str, str] | None = None, before: Mapping[str, str] | None = None,
         whole: Mapping[str, str] | None = None, running: Mapping[tuple[str, str], str] | None = None,
         rows: int = ROWS, weight: str | None = None) -> DataFrame:
    """``df`` plus ordered measures over (partition by ``keys`` order by ``order``, NULLs first):

    * ``lag`` and ``lead``: {result: column} of the row before and after;
    * ``before`` and ``whole``: {result: column}, its sum over the rows before (0 for the first) and over the key;
    * ``running``: {(mean, deviation): column}, the average and sample standard deviation over
      the default frame of a window by ``order[0]``: all earlier rows and the peers.  Sums are
      exact decimals where the values are, so the figures never depend on the slices.

    Rows that are equal in the whole order come in any order, as in Spark's windows.  ``weight``
    is as in ``cut_points``."""
    keys, order = list(keys), list(order)
    lag, lead, before, whole, running = (dict(m or {}) for m in (lag, lead, before, whole, running))
    slices = with_bounded(df, _brought(df, keys, order, lag, lead, before, whole, running, rows, weight), keys)
    number = reached(F.transform("__slices", lambda x: x["__first"]), F.struct(*order))
    state, following = F.get("__slices", F.col("__at") - 1), F.get("__slices", F.col("__at"))
    s = (slices.withColumn("__at", number)
         .withColumns({"__state": state, "__slice": F.coalesce(state["__slice"], F.lit(0)),
                       "__tail": following.isNotNull() & following["__first"][order[0]].eqNullSafe(F.col(order[0]))})
         .drop("__slices", "__at"))

    part = ["__slice", *keys]
    ordered = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy(*part).orderBy(F.col(order[0]).asc_nulls_first())  # RANGE frame: peers included
    brought = lambda name: _or_zero(F.col("__state")[name])
    results = [F.when(F.lag(F.lit(True)).over(ordered).isNull(), F.col("__state")[f"l_{n}"]).otherwise(F.lag(c).over(ordered)).alias(n)
               for n, c in lag.items()]
    results += [F.when(F.lead(F.lit(True)).over(ordered).isNull(), F.col("__state")[f"f_{n}"]).otherwise(F.lead(c).over(ordered)).alias(n)
                for n, c in lead.items()]
    results += [(_or_zero(F.sum(c).over(earlier)) + brought(f"b_{n}")).alias(n) for n, c in before.items()]
    results += [(_or_zero(F.sum(c).over(Window.partitionBy(*part))) + brought(f"w_{n}")).alias(n) for n, c in whole.items()]
    for i, ((mean, deviation), value) in enumerate(running.items()):
        sums = [_or_zero(_SUMS[k](x).over(peers)) + brought(f"before_{i}{k}") + F.when(F.col("__tail"), brought(f"later_{i}{k}")).otherwise(0)
                for k, x in _terms(value).items()]
        results += [c.alias(n) for c, n in zip(_moments(*sums, df.schema[value].dataType), (mean, deviation), strict=True)]
    return s.select(*[F.col(c) for c in df.columns], *results)


def _moments(n: Column, total: Column, squares: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Mean and sample standard deviation from a count, a sum and a sum of squares.
    Decimals are exact up to 38 digits; a history too long for that goes on in doubles."""
    wide = lambda c: c.cast("double")
    rough = wide(n) * wide(squares) - wide(total) * wide(total)
    if isinstance(kind, T.DecimalType):
        count = n.cast("decimal(20,0)")
        exact = F.try_subtract(F.try_multiply(count, squares), F.try_multiply(total, total))
        # four more places than the values, as an average of decimals has; the
        # types leave the quotient enough places to be rounded only once
        mean = F.try_divide(total.cast(T.DecimalType(26 + kind.scale, kind.scale)), count).cast(T.DecimalType(38, kind.scale + 4))
        rough = F.coalesce(wide(exact), rough)
    else:
        mean = F.try_divide(total, n)
    var = F.try_divide(rough, wide(n) * (wide(n) - 1))
    return mean, F.sqrt(F.when(var < 0, F.lit(0.0)).otherwise(var))


def neighbors(df: DataFrame, keys, time: str, ties, cols, step: int = 1, prefix: str = "prev_",
              rows: int = ROWS) -> DataFrame:
    """``df`` plus ``prefix + c`` = lag (step=1) or lead (step=-1) of each column over
    (partition by keys order by ``time`` NULLs first, ``ties``), which must be a total order
    inside a key for the result to be deterministic."""
    wanted = {prefix + c: c for c in cols}
    return scan(df, keys, [time, *ties], **{"lag" if step == 1 else "lead": wanted}, rows=rows)


def running_stats(df: DataFrame, keys, order_col: str, value: str, avg_name: str, std_name: str, ties=(),
                  rows: int = ROWS) -> DataFrame:
    """``df`` plus the running average and sample standard deviation of ``value`` over
    (partition by keys order by ``order_col``) with the default frame.  ``ties`` only tell where rows
    of equal ``order_col`` may be cut apart."""
    return scan(df, keys, [order_col, *ties], running={(avg_name, std_name): value}, rows=rows)
