"""Column-level building blocks shared by the analyses.

All of them return Catalyst expressions built from ``pyspark.sql.functions``,
so they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of) -> Column:
    """Literal DATE for "today"; the analyses never read the wall clock."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def dec(value: str) -> Column:
    """Exact DECIMAL literal; money arithmetic stays exact and order-free."""
    return F.lit(Decimal(value))


def ratio(num, den) -> Column:
    """``num / den`` as DOUBLE, NULL when ``den`` is 0 or NULL.

    ANSI mode raises on division by zero; the analyses want the NULL that
    the non-ANSI engine gave (empty branch, customer without accounts, ...).
    """
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def mean(total, n) -> Column:
    """Average of money with two places from its exact sum and the number of values, with
    the four more places of an average of decimals; NULL without values."""
    return F.try_divide(_c(total).cast("decimal(26,2)"), _c(n).cast("decimal(20,0)")).cast("decimal(38,6)")


def ladder(*branches, default) -> Column:
    """First-match CASE: ``ladder((cond, value), ..., default=v)``."""
    expr = None
    for cond, value in branches:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def above(col, cuts, default) -> Column:
    """Ladder of strict ``col > threshold`` tests, in the given order."""
    c = _c(col)
    return ladder(*[(c > t, label) for t, label in cuts], default=default)


def below(col, cuts, default) -> Column:
    """Ladder of strict ``col < threshold`` tests, in the given order."""
    c = _c(col)
    return ladder(*[(c < t, label) for t, label in cuts], default=default)


# The six age bands (strict upper bounds, NULL age falls to 65+).
AGE_BANDS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
AGE_DEFAULT = "65+"


def age_years(later, date_of_birth) -> Column:
    """Whole years between two dates, by 365.25-day years."""
    return F.floor(F.datediff(_c(later), _c(date_of_birth)) / 365.25)


def age_group(age) -> Column:
    return below(age, AGE_BANDS, AGE_DEFAULT)


def flag_score(*terms) -> Column:
    """Sum of weights whose condition holds: ``flag_score((cond, w), ...)``."""
    total = None
    for cond, weight in terms:
        t = F.when(cond, weight).otherwise(0)
        total = t if total is None else total + t
    return total


def weighted(*terms) -> Column:
    """``sum(col * weight)`` in DOUBLE, left to right; NULL if any input is."""
    total = None
    for col, weight in terms:
        t = _c(col) * float(weight)
        total = t if total is None else total + t
    return total


def growth(measure, window) -> Column:
    """Relative change to the previous row of ``window``; NULL for the first."""
    prev = F.lag(_c(measure)).over(window)
    return ratio(_c(measure) - prev, prev)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
