"""Small SQL builders for the DuckDB oracle (mirroring Spark semantics)."""

from __future__ import annotations

D = "DATE '2002-01-01'"          # as_of of the test tables
D_LIQ = "DATE '2001-07-01'"      # as_of of the liquidity analysis
D_DENSE = "DATE '2024-02-15'"    # as_of of transactions_dense


def havg(x: str, s: int = 2, over: str = "") -> str:
    """Spark's AVG over DECIMAL(p, s): exact quotient rounded HALF_UP at scale
    s+4, as an exact DECIMAL (DuckDB's AVG is an unrounded DOUBLE).  ``over``
    makes it a window aggregate (e.g. "OVER w")."""
    k = s + 4
    num = f"(CAST(SUM({x}) {over} * {10 ** s} AS HUGEINT) * {10 ** (k - s)})"
    n = f"NULLIF(COUNT({x}) {over}, 0)"
    return (f"(CAST(sign({num}) * ((abs({num}) * 2 + {n}) // (2 * {n})) AS DECIMAL(38,0))"
            f" * 0.{'0' * (k - 1)}1)")


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def div(a: str, b: str) -> str:
    """Spark's try_divide on DOUBLE operands."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def wsum(*terms) -> str:
    """Weighted score: left-to-right sum of DOUBLE(col) * DOUBLE weight."""
    return "(" + " + ".join(f"CAST({c} AS DOUBLE) * {w}::DOUBLE" for c, w in terms) + ")"


def case_gt(x: str, cuts, default) -> str:
    arms = " ".join(f"WHEN {x} > {t} THEN {_lit(v)}" for t, v in cuts)
    return f"CASE {arms} ELSE {_lit(default)} END"


def _lit(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def age_band(age: str) -> str:
    arms = " ".join(f"WHEN {age} < {hi} THEN '{lab}'" for hi, lab in
                    ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64")))
    return f"CASE {arms} ELSE '65+' END"


def age_years(later: str, dob: str) -> str:
    return f"FLOOR(({later} - {dob}) / 365.25::DOUBLE)"


def months_between(a: str, b: str) -> str:
    """Spark's months_between(a, b) for DATE operands (rounded to 8 places)."""
    md = f"((year({a}) * 12 + month({a})) - (year({b}) * 12 + month({b})))"
    frac = f"((day({a}) - 1) * 86400 - (day({b}) - 1) * 86400) / 2678400::DOUBLE"
    return (f"(CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b})) "
            f"THEN CAST({md} AS DOUBLE) "
            f"ELSE floor(({md} + {frac}) * 1e8 + 0.5) / 1e8 END)")



def hdiv(num: str, s_in: int, den: int, s_out: int) -> str:
    """Spark's DECIMAL division ``num / den``: exact quotient rounded HALF_UP
    at scale ``s_out`` (``num`` has scale ``s_in``), as an exact DECIMAL."""
    u = f"(CAST(CAST(({num}) AS DECIMAL(38,{s_in})) * {10 ** s_in} AS HUGEINT) * {10 ** (s_out - s_in)})"
    return (f"(CAST(sign({u}) * ((abs({u}) * 2 + {den}) // (2 * {den})) AS DECIMAL(38,0))"
            f" * 0.{'0' * (s_out - 1)}1)")


def zfill(parts) -> str:
    """SELECT list of a zero-filled profile: parts = [(alias, [cols])]."""
    return ", ".join(f"COALESCE({a}.{c}, 0) AS {c}" for a, cols in parts for c in cols)


def joins(entity_alias: str, key: str, aliases) -> str:
    return " ".join(f"LEFT JOIN {a} ON {entity_alias}.{key} = {a}.{key}" for a in aliases)




def flags(*terms) -> str:
    """Spark's flag score: left-to-right sum of CASE WHEN cond THEN w ELSE 0 (DOUBLE)."""
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in terms) + ")"


def ladder_eq(x: str, pairs, default) -> str:
    arms = " ".join(f"WHEN {x} = {_lit(k)} THEN {_lit(v)}" for k, v in pairs)
    return f"CASE {arms} ELSE {_lit(default)} END"


# Fragments shared by several analysis families.
EPOCH = "CAST(floor(epoch_us({c}) / 1000000) AS BIGINT)"
TX_ORDER = ", ".join(f"t.{c} NULLS FIRST" for c in (
    "transaction_date", "transaction_id", "transaction_type", "amount", "description",
    "related_account_id", "transaction_status"))
TXA = "transactions t JOIN accounts a ON t.account_id = a.account_id"
BRANCH_COLS = ("b.branch_id, b.branch_name, b.branch_code, b.address, b.city, b.state, b.phone, "
               "COALESCE(b.manager_id, 0) AS manager_id")
ACTIVE_LOANS = "loans WHERE status = 'ACTIVE'"


def zcol(x: str, name: str | None = None) -> str:
    """A left-joined measure filled with 0, as ``fillna(0)`` fills it."""
    return f"COALESCE({x}, 0) AS {name or x.split('.')[-1]}"
