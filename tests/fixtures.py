"""Hand-made banking rows for edge-case tests (typed by the fixed schemas)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.model import SCHEMAS
from ledgerlens.sources.tables import BankTables


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    schema = SCHEMAS["transactions" if name == "transactions_dense" else name]
    data = [tuple(_coerce(r.get(f.name), f.dataType.typeName()) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def _coerce(v, type_name):
    if v is None:
        return None
    if type_name == "decimal" and not isinstance(v, Decimal):
        return Decimal(str(v))
    if type_name == "date" and isinstance(v, str):
        return dt.date.fromisoformat(v)
    if type_name == "timestamp" and isinstance(v, str):
        return dt.datetime.fromisoformat(v)
    return v


def bank(spark: SparkSession, **tables: list[dict]) -> BankTables:
    """BankTables of hand-made rows; tables not given are empty."""
    frames = {name: table(spark, name, tables.get(name, [])) for name in SCHEMAS}
    return BankTables.from_frames(**frames)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
