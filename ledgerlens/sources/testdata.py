"""The banking tables derived from the driver's TPC-H-style test tables.

Each banking table is one projection (plus an optional filter) of a test
table.  The expressions are plain SQL that Spark and DuckDB evaluate the same
way, so the very same text builds the Spark DataFrames here and the DuckDB
CTEs of the oracle (``cte_sql``).  Nothing is materialised: every table is a
lazy projection of a parquet scan, so Catalyst prunes columns and pushes the
filters into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    source: str                 # test table
    columns: tuple              # (name, SQL expression)
    where: str | None = None    # filter on the test table
    join: tuple | None = None   # (other test table, left key, right key)


def _cols(*pairs):
    return tuple(pairs)


# The mapping of the banking model onto the test tables.
# Every expression must stay identical between engines; do not edit one side.
MAPPINGS = {
    "customers": Mapping(
        "customer",
        _cols(
            ("customer_id", "CAST(c_custkey AS BIGINT)"),
            ("first_name", "c_name"),
            ("last_name", "CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN NULL ELSE c_name END"),
            ("email", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CONCAT(c_name, '@example.com') END"),
            ("phone", "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CONCAT('555-', c_custkey) END"),
            ("date_of_birth", "CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN NULL ELSE DATE '1935-01-01' + CAST(c_custkey * 7919 % 16000 AS INT) END"),
            ("address", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CONCAT(c_custkey, ' Main St') END"),
            ("city", "CONCAT('CITY_', c_custkey % 3)"),
            ("state", "n_name"),
            ("zip_code", "CONCAT('Z', c_nationkey)"),
            ("customer_since", "DATE '1990-01-01' + CAST(c_custkey * 31 % 1800 AS INT)"),
            ("customer_type", "CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN 'BUSINESS' ELSE 'INDIVIDUAL' END"),
        ),
        join=("nation", "c_nationkey", "n_nationkey"),
    ),
    "accounts": Mapping(
        "orders",
        _cols(
            ("account_id", "CAST(o_orderkey AS BIGINT)"),
            ("customer_id", "CAST(o_custkey AS BIGINT)"),
            ("account_number", "CONCAT('ACC', o_orderkey)"),
            ("account_type", "CASE WHEN o_orderkey % 10 < 4 THEN 'CHECKING' WHEN o_orderkey % 10 < 8 THEN 'SAVINGS' WHEN o_orderkey % 10 = 8 THEN 'BUSINESS' ELSE 'LOAN' END"),
            ("balance", "CASE WHEN o_orderkey % 10 = 9 THEN -CAST(o_totalprice AS DECIMAL(15,2)) ELSE CAST(o_totalprice AS DECIMAL(15,2)) END"),
            ("open_date", "CAST(o_orderdate AS DATE)"),
            ("close_date", "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 365 ELSE CAST(NULL AS DATE) END"),
            ("status", "CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END"),
            ("branch_id", "CAST(o_orderkey % 23 AS BIGINT)"),
        ),
    ),
    "transactions": Mapping(
        "lineitem",
        _cols(
            ("transaction_id", "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)"),
            ("account_id", "CAST(l_orderkey AS BIGINT)"),
            ("transaction_type", "CASE WHEN l_partkey % 5 = 0 THEN 'DEPOSIT' WHEN l_partkey % 5 = 1 THEN 'WITHDRAWAL' WHEN l_partkey % 5 = 2 THEN 'TRANSFER' WHEN l_partkey % 5 = 3 THEN 'PAYMENT' ELSE 'CASH_DEPOSIT' END"),
            ("amount", "CAST(l_extendedprice AS DECIMAL(15,2))"),
            ("transaction_date", "l_shipdate + INTERVAL '1' SECOND * CAST((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber) % 86400 AS INT)"),
            ("description", "CASE WHEN l_suppkey % 6 = 0 THEN 'offshore transfer' WHEN l_suppkey % 6 = 1 THEN 'international wire' ELSE 'regular' END"),
            ("related_account_id", "CASE WHEN l_partkey % 5 = 2 THEN CAST(l_partkey AS BIGINT) ELSE CAST(NULL AS BIGINT) END"),
            ("transaction_status", "CASE WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'COMPLETED' END"),
        ),
    ),
    "branches": Mapping(
        "nation",
        _cols(
            ("branch_id", "CAST(n_nationkey AS BIGINT)"),
            ("branch_name", "CONCAT('BRANCH_', n_name)"),
            ("branch_code", "CONCAT('B', n_nationkey)"),
            ("address", "CONCAT(n_nationkey, ' Bank St')"),
            ("city", "CONCAT('CITY_', n_nationkey % 3)"),
            ("state", "n_name"),
            ("phone", "CONCAT('555-1', n_nationkey)"),
            ("manager_id", "CAST(n_nationkey % 10 AS BIGINT)"),
        ),
    ),
    "employees": Mapping(
        "supplier",
        _cols(
            ("employee_id", "CAST(s_suppkey AS BIGINT)"),
            ("branch_id", "CAST(s_nationkey AS BIGINT)"),
            ("first_name", "s_name"),
            ("last_name", "s_name"),
            ("position", "CASE WHEN s_suppkey % 4 = 0 THEN 'Branch Manager' WHEN s_suppkey % 4 = 1 THEN 'Loan Officer' WHEN s_suppkey % 4 = 2 THEN 'Teller' ELSE 'Financial Advisor' END"),
            ("email", "CONCAT(s_name, '@bank.example')"),
            ("phone", "CONCAT('555-2', s_suppkey)"),
            ("hire_date", "DATE '1985-01-01' + CAST(s_suppkey * 97 % 3650 AS INT)"),
            ("salary", "CAST(35000 + ABS(CAST(s_acctbal AS DECIMAL(9,2))) * 5 AS DECIMAL(10,2))"),
            ("manager_id", "CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(s_suppkey - s_suppkey % 4 AS BIGINT) END"),
        ),
    ),
    "loans": Mapping(
        "orders",
        _cols(
            ("loan_id", "CAST(o_orderkey AS BIGINT)"),
            ("customer_id", "CAST(o_custkey AS BIGINT)"),
            ("account_id", "CAST(o_orderkey AS BIGINT)"),
            ("loan_type", "CASE WHEN o_orderkey % 16 = 0 THEN 'MORTGAGE' WHEN o_orderkey % 16 = 4 THEN 'AUTO' WHEN o_orderkey % 16 = 8 THEN 'PERSONAL' ELSE 'BUSINESS' END"),
            ("loan_amount", "CAST(o_totalprice AS DECIMAL(15,2))"),
            ("interest_rate", "CAST((3000 + o_orderkey * 37 % 9000) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(5,3))"),
            ("term_months", "CASE WHEN o_orderkey % 16 = 0 THEN 360 WHEN o_orderkey % 16 = 4 THEN 60 WHEN o_orderkey % 16 = 8 THEN 12 ELSE 48 END"),
            ("start_date", "CAST(o_orderdate AS DATE)"),
            ("end_date", "CAST(o_orderdate AS DATE) + 1825"),
            ("status", "CASE WHEN o_orderkey % 20 = 0 THEN 'DEFAULTED' WHEN o_orderkey % 20 = 4 THEN 'CLOSED' ELSE 'ACTIVE' END"),
            ("approved_by", "CAST(o_orderkey % 10 AS BIGINT)"),
        ),
    ),
    "loan_payments": Mapping(
        "lineitem",
        _cols(
            ("payment_id", "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)"),
            ("loan_id", "CAST(l_orderkey AS BIGINT)"),
            ("due_date", "CAST(l_shipdate AS DATE)"),
            ("payment_date", "CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 - 20 AS INT) ELSE CAST(NULL AS DATE) END"),
            ("amount_due", "CAST(l_extendedprice AS DECIMAL(10,2))"),
            ("amount_paid", "CASE WHEN l_returnflag <> 'A' THEN CAST(0 AS DECIMAL(10,2)) WHEN l_suppkey % 5 = 0 THEN CAST(100 AS DECIMAL(10,2)) ELSE CAST(l_extendedprice AS DECIMAL(10,2)) END"),
            ("principal_amount", "CAST(l_extendedprice AS DECIMAL(10,2)) - 50"),
            ("interest_amount", "CAST(50 AS DECIMAL(10,2))"),
            ("status", "CASE WHEN l_returnflag = 'R' THEN 'OVERDUE' WHEN l_returnflag = 'A' THEN 'PAID' ELSE 'PENDING' END"),
        ),
    ),
    "credit_cards": Mapping(
        "customer",
        _cols(
            ("card_id", "CAST(c_custkey AS BIGINT)"),
            ("customer_id", "CAST(c_custkey AS BIGINT)"),
            ("account_id", "CAST(c_custkey AS BIGINT)"),
            ("card_number", "CONCAT('4000-', c_custkey)"),
            ("card_type", "CASE WHEN c_custkey % 3 = 0 THEN 'VISA' WHEN c_custkey % 3 = 1 THEN 'MASTERCARD' ELSE 'AMEX' END"),
            ("credit_limit", "CAST(CASE WHEN c_custkey % 5 = 0 THEN 75000 WHEN c_custkey % 5 = 1 THEN 500 WHEN c_custkey % 5 = 2 THEN 8000 ELSE 12000 END AS DECIMAL(10,2))"),
            ("current_balance", "ABS(CAST(c_acctbal AS DECIMAL(10,2)))"),
            ("issue_date", "DATE '1996-01-01' + CAST(c_custkey % 1000 AS INT)"),
            ("expiry_date", "DATE '2003-01-01' + CAST(c_custkey % 1000 AS INT)"),
            ("status", "CASE WHEN c_custkey % 10 = 9 THEN 'EXPIRED' ELSE 'ACTIVE' END"),
        ),
    ),
    "card_transactions": Mapping(
        "events",
        _cols(
            ("card_transaction_id", "CAST(event_id AS BIGINT)"),
            ("card_id", "CAST(user_id AS BIGINT)"),
            ("transaction_date", "ts"),
            ("merchant_name", "CONCAT('M', event_id % 50)"),
            ("amount", "CAST(value AS DECIMAL(10,2)) * 4"),
            ("transaction_type", "'PURCHASE'"),
            ("category", "event_type"),
            ("city", "CONCAT('CITY_', event_id % 3)"),
            ("country", "'USA'"),
        ),
    ),
    "account_beneficiaries": Mapping(
        "orders",
        _cols(
            ("beneficiary_id", "CAST(o_orderkey AS BIGINT)"),
            ("account_id", "CAST(o_orderkey AS BIGINT)"),
            ("customer_id", "CAST(o_orderkey % 149 AS BIGINT)"),
            ("relationship", "CASE WHEN o_orderkey % 12 = 0 THEN 'SPOUSE' WHEN o_orderkey % 12 = 3 THEN 'CHILD' WHEN o_orderkey % 12 = 6 THEN 'PARENT' ELSE 'BUSINESS_PARTNER' END"),
            ("allocation_percentage", "CAST(CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 100 END AS DECIMAL(5,2))"),
            ("added_date", "CAST(o_orderdate AS DATE) + 5"),
        ),
    ),
    # Second source for the transaction monitors: many rows per account and
    # day, unique ids, January 2024 (use as_of 2024-02-15).
    "transactions_dense": Mapping(
        "events",
        _cols(
            ("transaction_id", "CAST(event_id AS BIGINT)"),
            ("account_id", "CAST(user_id AS BIGINT)"),
            ("transaction_type", "CASE WHEN event_type = 'signup' THEN 'DEPOSIT' WHEN event_type = 'purchase' THEN 'PAYMENT' WHEN event_type = 'click' THEN 'TRANSFER' WHEN event_type = 'view' THEN 'WITHDRAWAL' ELSE 'CASH_DEPOSIT' END"),
            ("amount", "CAST(value AS DECIMAL(9,2)) * 50"),
            ("transaction_date", "ts"),
            ("description", "CASE WHEN event_id % 6 = 0 THEN 'offshore transfer' WHEN event_id % 6 = 1 THEN 'international wire' WHEN event_id % 6 = 2 THEN NULL ELSE 'regular' END"),
            ("related_account_id", "CAST(NULL AS BIGINT)"),
            ("transaction_status", "'COMPLETED'"),
        ),
    ),
}

# as_of dates for the test tables: after the last mapped event, except the
# forward-looking liquidity analysis.
AS_OF = "2002-01-01"
AS_OF_LIQUIDITY = "2001-07-01"
AS_OF_DENSE = "2024-02-15"


def mapped_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy DataFrame of banking table ``name`` over the test parquet files."""
    m = MAPPINGS[name]
    df = spark.read.parquet(f"{sf_dir}/{m.source}.parquet")
    if m.where:
        df = df.where(m.where)
    if m.join:
        other, lk, rk = m.join
        # nation is a fixed 25-row dimension; AQE broadcasts it after measuring.
        dim = spark.read.parquet(f"{sf_dir}/{other}.parquet")
        df = df.join(dim, F.col(lk) == F.col(rk))
    return df.selectExpr(*[f"{expr} AS {col}" for col, expr in m.columns])


def cte_sql(names) -> str:
    """DuckDB ``WITH`` clause defining the banking tables in ``names``."""
    parts = []
    for name in names:
        m = MAPPINGS[name]
        cols = ",\n    ".join(f"{expr} AS {col}" for col, expr in m.columns)
        src = m.source
        if m.join:
            other, lk, rk = m.join
            src = f"{m.source} JOIN {other} ON {lk} = {rk}"
        where = f" WHERE {m.where}" if m.where else ""
        parts.append(f"{name} AS (\n  SELECT\n    {cols}\n  FROM {src}{where}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
