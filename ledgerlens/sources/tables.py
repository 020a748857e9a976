"""A lazily-built set of the banking tables, from any loader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.model import SCHEMAS

#: The key whose facts and entities meet, by table: what the bucketed layout is dealt by.
DEALT_BY = {"transactions": "account_id", "transactions_dense": "account_id", "accounts": "account_id",
            "account_beneficiaries": "account_id", "loans": "loan_id", "loan_payments": "loan_id",
            "credit_cards": "card_id", "card_transactions": "card_id"}


def _fixed(df: DataFrame, name: str) -> DataFrame:
    """The columns of the fixed schema, in its order and types."""
    schema = SCHEMAS["transactions" if name == "transactions_dense" else name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


class BankTables:
    """Named access to the banking tables; each is loaded on first use.

    ``BankTables.from_testdata(spark, dir)`` maps the driver's test tables,
    ``BankTables.from_parquet(spark, root)`` reads real tables written as
    ``root/<table>`` with the fixed schemas.  Loading only builds a lazy scan.
    """

    def __init__(self, loader: Callable[[str], DataFrame]):
        self._loader = loader
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "BankTables":
        from ledgerlens.sources.testdata import mapped_table
        return cls(lambda name: mapped_table(spark, sf_dir, name))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "BankTables":
        def load(name: str) -> DataFrame:
            schema = SCHEMAS["transactions" if name == "transactions_dense" else name]
            return spark.read.schema(schema).parquet(f"{root}/{name}")
        return cls(load)

    def write_parquet(self, root: str, names=None, mode: str = "errorifexists") -> None:
        """Write tables as ``root/<table>`` parquet in the fixed schemas (column
        order and types), the layout ``from_parquet`` reads."""
        for name in names or SCHEMAS:
            _fixed(self[name], name).write.mode(mode).parquet(f"{root}/{name}")

    def write_bucketed(self, database: str, buckets: int, names=None, mode: str = "errorifexists") -> None:
        """Write tables to the catalogue, dealt into ``buckets`` and sorted by the key
        their facts meet on (``DEALT_BY``; others plain): joins and aggregates on that key then
        plan without an exchange.  A bucket is read by one task, so take buckets enough for
        its size, and leave a table plain (``write_parquet``) if one key holds much of it."""
        for name in names or SCHEMAS:
            rows, key = _fixed(self[name], name), DEALT_BY.get(name)
            if key is None:
                rows.write.mode(mode).format("parquet").saveAsTable(f"{database}.{name}")
            else:  # dealt before the write: one file a bucket
                (rows.repartition(buckets, key).write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
                 .saveAsTable(f"{database}.{name}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "BankTables":
        """Tables of the catalogue, as ``write_bucketed`` leaves them."""
        return cls(lambda name: spark.table(f"{database}.{name}"))

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> "BankTables":
        def load(name: str) -> DataFrame:
            if name not in frames:
                raise KeyError(f"table {name!r} not given")
            return frames[name]
        return cls(load)
