"""One canonical form for results, so Spark and DuckDB answers compare equal.

Both engines are asked for the same canonical column types:
  fractional numbers (DECIMAL, DOUBLE)  -> DOUBLE rounded to 6 places as
                                           floor(x * 1e6 + 0.5) / 1e6, the same
                                           IEEE operations in both engines
  integers                              -> decimal digits as text (an integer
                                           column with NULLs would otherwise
                                           become float in one engine's pandas
                                           form and nullable int in the other)
  booleans                              -> 'true' / 'false'
  dates                                 -> 'YYYY-MM-DD'
  timestamps                            -> 'YYYY-MM-DD HH:MM:SS.ffffff' (wall time,
                                           whatever the session time zone)
  arrays                                -> elements in canonical form, in order,
                                           joined by ','
  maps                                  -> "key=value" in the order of the keys,
                                           fractions with 6 places, joined by ','
The kinds of a result's columns are read from its Spark schema; the same
kinds wrap the oracle SQL (``wrap_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACS = (T.DecimalType, T.DoubleType, T.FloatType)
_TS = (T.TimestampType, T.TimestampNTZType)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, _FRACS):
        return "f"
    if isinstance(t, _INTS):
        return "i"
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, T.DateType):
        return "d"
    if isinstance(t, _TS):
        return "t"
    if isinstance(t, T.ArrayType):
        return "a" + kind_of(t.elementType)
    if isinstance(t, T.MapType):
        return "m" + kind_of(t.valueType)
    return "s"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def _spark_canon(c: Column, kind: str) -> Column:
    if kind == "f":
        d = c.cast("double")
        return F.when(F.abs(d) < 1e12, F.floor(d * 1e6 + 0.5) / 1e6).otherwise(d)
    if kind == "i":
        return c.cast("bigint").cast("string")
    if kind == "b":
        return c.cast("string")
    if kind == "d":
        return c.cast("string")
    if kind == "t":
        # date_format goes through the session time zone (a wall time in a DST
        # gap would shift); the cast to string does not.  Pad the fraction.
        text = c.cast("string")
        return F.when(F.instr(text, ".") == 0, F.concat(text, F.lit(".000000"))).otherwise(F.rpad(text, 26, "0"))
    if kind.startswith("a"):
        inner = kind[1:]
        as_text = F.transform(c, lambda x: _spark_canon(x, inner).cast("string"))
        return F.array_join(as_text, ",")
    if kind.startswith("m"):
        typed = "decimal(38,6)" if kind == "mf" else "string"
        pair = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast(typed).cast("string"))
        return F.array_join(F.transform(F.sort_array(F.map_entries(c)), pair), ",")
    return c


def compare_form(df: DataFrame) -> DataFrame:
    return df.select(*[_spark_canon(F.col(f"`{n}`"), k).alias(n) for n, k in kinds(df).items()])


def _sql_canon(expr: str, kind: str) -> str:
    if kind == "f":
        d = f"CAST({expr} AS DOUBLE)"
        return f"CASE WHEN abs({d}) < 1e12 THEN floor({d} * 1e6 + 0.5) / 1e6 ELSE {d} END"
    if kind == "i":
        return f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"
    if kind == "b":
        return f"CAST({expr} AS VARCHAR)"
    if kind == "d":
        return f"strftime({expr}, '%Y-%m-%d')"
    if kind == "t":
        return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
    if kind.startswith("a"):
        inner = _sql_canon("x", kind[1:])
        return f"array_to_string(list_transform({expr}, lambda x: CAST({inner} AS VARCHAR)), ',')"
    if kind.startswith("m"):
        value = "CAST(e.value AS DECIMAL(38,6))" if kind == "mf" else "e.value"
        entries = f"list_transform(list_sort(map_entries({expr})), lambda e: e.key || '=' || CAST({value} AS VARCHAR))"
        return f"COALESCE(array_to_string({entries}, ','), '')"
    return expr


def wrap_sql(sql: str, col_kinds: dict[str, str]) -> str:
    """Wrap an oracle query so that it yields the canonical column forms."""
    cols = ",\n  ".join(f'{_sql_canon(chr(34) + n + chr(34), k)} AS "{n}"' for n, k in col_kinds.items())
    return f"SELECT\n  {cols}\nFROM (\n{sql}\n) AS q"
