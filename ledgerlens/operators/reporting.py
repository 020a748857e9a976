"""Bank-wide reports: the four-part reporting framework and liquidity.

One-row figures are aggregates with partial aggregation on every task;
they are combined by broadcast joins of frames that are one row by
construction (``plans.attach_one_row``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import above, as_of_date, mean, ratio
from ledgerlens.operators.customers import active
from ledgerlens.plans import attach_one_row, profile


def _grains(accounts: DataFrame) -> DataFrame:
    """Accounts by type and branch, the finest grain of the reports: all coarser ones
    come from this aggregate, so that they share one scan."""
    return accounts.groupBy("account_type", "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("balance").alias("valued"), F.sum("balance").alias("held"))


def _coarser(grains: DataFrame, *keys: str) -> DataFrame:
    """Number, balance and average balance of accounts by ``keys`` (none: one row)."""
    held, valued = F.sum("held"), F.sum("valued")
    return grains.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accounts"),
                                     F.when(valued > 0, held).alias("deposits"), mean(held, valued).alias("avg_balance"))


def _one_row_join(*frames: DataFrame) -> DataFrame:
    """One row from several one-row aggregates."""
    return attach_one_row(frames[0], *frames[1:])


# ---------------------------------------------------------------- A08
def executive_summary(customers: DataFrame, accounts: DataFrame, transactions: DataFrame,
                      loans: DataFrame) -> DataFrame:
    """Bank totals in one row.  Distinct customers per type come from one
    shuffle by customer (not three distinct-count expansions)."""
    per_customer = (customers.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
                    .agg(F.max((F.col("customer_type") == "BUSINESS").cast("int")).alias("__b"),
                         F.max((F.col("customer_type") == "INDIVIDUAL").cast("int")).alias("__i")))
    cust = per_customer.agg(F.count(F.lit(1)).alias("total_customers"),
                            F.coalesce(F.sum("__b"), F.lit(0)).alias("business_customers"),
                            F.coalesce(F.sum("__i"), F.lit(0)).alias("individual_customers"))
    acc = _coarser(_grains(accounts)).withColumnsRenamed(
        {"accounts": "total_accounts", "deposits": "total_deposits", "avg_balance": "avg_account_balance"})
    ln = active(loans).agg(F.count(F.lit(1)).alias("active_loans"),
                           F.sum("loan_amount").alias("total_loan_portfolio"))
    tx = transactions.agg(F.count(F.lit(1)).alias("total_transactions"),
                          F.sum("amount").alias("total_transaction_volume"))
    return _one_row_join(cust, acc, ln, tx)


def product_dashboard(accounts: DataFrame, loans: DataFrame, credit_cards: DataFrame) -> DataFrame:
    """Accounts by type, active loans by loan type and active cards, as one table."""
    def agg(df, key, measure):
        return df.groupBy(key.alias("account_type")).agg(
            F.count(F.lit(1)).alias("accounts"), F.sum(measure).alias("deposits"), F.avg(measure).alias("avg_balance"))
    return (_coarser(_grains(accounts), "account_type")
            .unionByName(agg(active(loans), F.col("loan_type"), "loan_amount"))
            .unionByName(agg(active(credit_cards), F.lit("CREDIT_CARD"), "current_balance")))


def regional_performance(branches: DataFrame, accounts: DataFrame, employees: DataFrame) -> DataFrame:
    """Per branch: accounts, deposits, staff and two per-employee ratios (NULL without staff)."""
    acc = _coarser(_grains(accounts), "branch_id").drop("avg_balance").withColumnRenamed("branch_id", "__branch")
    emp = employees.groupBy("branch_id").agg(F.count(F.lit(1)).alias("employees"), F.avg("salary").alias("avg_salary"))
    # Null-safe: a plain equality would be pushed into the scan of accounts as a filter, which then is a scan of its own.
    same = F.col("branch_id").isNotNull() & F.col("branch_id").eqNullSafe(F.col("__branch"))
    return (profile(branches.join(acc, same, "left").drop("__branch"), "branch_id", emp)
            .withColumn("deposits_per_employee", ratio("deposits", "employees"))
            .withColumn("efficiency_ratio", ratio("accounts", "employees")))


def risk_overview(loans: DataFrame) -> DataFrame:
    """One row: defaulted loans against all loans, by count and by amount."""
    defaulted = loans.filter(F.col("status") == "DEFAULTED").agg(
        F.count(F.lit(1)).alias("defaulted_loans"), F.sum("loan_amount").alias("defaulted_amount"))
    total = loans.agg(F.count(F.lit(1)).alias("total_loans"), F.sum("loan_amount").alias("total_loan_amount"))
    return (_one_row_join(defaulted, total)
            .withColumn("default_rate", ratio("defaulted_loans", "total_loans"))
            .withColumn("default_ratio", ratio("defaulted_amount", "total_loan_amount")))


def reporting_framework(customers: DataFrame, accounts: DataFrame, transactions: DataFrame, loans: DataFrame,
                        credit_cards: DataFrame, branches: DataFrame, employees: DataFrame) -> DataFrame:
    """The four reports as one long table (section, key, measure, value): key is
    the row's name inside its section, empty where the section is one row."""
    reports = {
        "executive_summary": executive_summary(customers, accounts, transactions, loans),
        "product_dashboard": product_dashboard(accounts, loans, credit_cards),
        "regional_performance": regional_performance(branches, accounts, employees),
        "risk_overview": risk_overview(loans),
    }
    keys = {"product_dashboard": "account_type", "regional_performance": "branch_id"}
    return reduce(DataFrame.unionByName, [_long(name, df, keys.get(name)) for name, df in reports.items()])


def _long(section: str, df: DataFrame, key: str | None) -> DataFrame:
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)
               and not f.name.endswith("_id")]
    name = F.col(key).cast("string") if key else F.lit("")
    return (df.select(name.alias("key"), *[F.col(c).cast("double").alias(c) for c in numbers])
            .unpivot("key", numbers, "measure", "value")
            .select(F.lit(section).alias("section"), "key", "measure", "value"))


# ---------------------------------------------------------------- A33
def liquidity(accounts: DataFrame, loans: DataFrame, transactions: DataFrame, *, as_of) -> DataFrame:
    """Liquid deposits against withdrawals and payments dated in the 30 days
    from ``as_of`` and against active loan commitments.  No outflows gives a
    NULL ratio and INADEQUATE."""
    today = as_of_date(as_of)
    liquid = (active(accounts).filter(F.col("account_type").isin("SAVINGS", "CHECKING"))
              .agg(F.sum("balance").alias("total_liquid_assets")))
    td = F.col("transaction_date")
    outflows = (transactions.filter(F.col("transaction_type").isin("WITHDRAWAL", "PAYMENT")
                                    & (td >= today) & (td <= F.date_add(today, 30)))
                .agg(F.sum("amount").alias("projected_outflows_30d")))
    commitments = active(loans).agg(F.sum("loan_amount").alias("total_loan_commitments"))
    return (_one_row_join(liquid, outflows, commitments)
            .withColumn("liquidity_ratio", ratio("total_liquid_assets", "projected_outflows_30d"))
            .withColumn("coverage_ratio", ratio("total_liquid_assets", "total_loan_commitments"))
            .withColumn("liquidity_status",
                        above("liquidity_ratio", [(2.0, "EXCELLENT"), (1.5, "ADEQUATE"), (1.0, "MINIMAL")],
                              "INADEQUATE")))
