"""What the analyses measure, by entity: customers, accounts, loans, cards, staff
and branches, each with its sources and their SQL aggregates.

Transactions are aggregated per account (counts, exact DECIMAL sums and sums of
squares) before they meet accounts, so means and deviations per customer need
no raw row after the first, map-side combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import dec, growth
from ledgerlens.plans.entity import Entity


def active(df: DataFrame) -> DataFrame:
    """Rows whose status is ACTIVE (accounts, loans, cards)."""
    return df.filter(F.col("status") == "ACTIVE")


def loan_rates(loans: DataFrame, rate_unit: str = "as_stored") -> DataFrame:
    """Loans with ``interest_rate`` as a fraction when ``rate_unit`` is
    "percent" (7.5 -> 0.075, exact DECIMAL); "as_stored" keeps the stored
    value, which is what the analyses compute by default.  Loan rates stored in
    percent make rate-based ladders (thresholds 0.10, 0.15) and revenues
    disagree in units with the card rate 0.18."""
    if rate_unit == "as_stored":
        return loans
    if rate_unit != "percent":
        raise ValueError(f"rate_unit must be 'as_stored' or 'percent', not {rate_unit!r}")
    return loans.withColumn("interest_rate", F.col("interest_rate") / 100)


def credit_book(loans: DataFrame, credit_cards: DataFrame, *cols: str) -> DataFrame:
    """Active loans and active cards as one facility table (``cols`` of the
    loan layout: loan_id, customer_id, loan_amount, loan_type, interest_rate,
    term_months).  A card is a CREDIT_CARD facility at 18% over 36 months."""
    card = {"loan_id": F.col("card_id"), "customer_id": F.col("customer_id"),
            "loan_amount": F.col("current_balance"), "loan_type": F.lit("CREDIT_CARD"),
            "interest_rate": dec("0.18"), "term_months": F.lit(36)}
    return active(loans).select(*cols).unionByName(
        active(credit_cards).select(*[card[c].alias(c) for c in cols]))


def tx_keys(accounts: DataFrame, *cols: str) -> DataFrame:
    """The account columns a rollup needs, one row per account."""
    return accounts.select("account_id", *cols)


def per_account(transactions: DataFrame, *keys: str, **measures) -> DataFrame:
    """Transactions aggregated per (account_id, *keys) before any join."""
    return transactions.groupBy("account_id", *keys).agg(
        *[expr.alias(name) for name, expr in measures.items()])


def with_delay(loan_payments: DataFrame, today: Column) -> DataFrame:
    """Instalments with ``delay`` in days; an unpaid one is late until ``today``."""
    return loan_payments.withColumn("delay", F.datediff(F.coalesce("payment_date", today), "due_date"))


def _usage(*keys: str):
    """Moments of transactions by account (and ``keys``), with the customer."""
    def rows(t) -> DataFrame:
        x = F.col("amount")
        per = per_account(t["transactions"], *keys, n=F.count(F.lit(1)), nx=F.count(x), x=F.sum(x), xx=F.sum(x * x),
                          last=F.max("transaction_date"))
        return per.join(tx_keys(t["accounts"], "customer_id"), "account_id")
    return rows


def _network(t) -> DataFrame:
    """Beneficiaries with the owner and balance of their account."""
    return (t["account_beneficiaries"].select("beneficiary_id", "account_id", "relationship")
            .join(tx_keys(t["accounts"], "customer_id", "balance"), "account_id"))


def _monthly(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key, F.date_trunc("month", "transaction_date").alias("month")).agg(F.sum("amount").alias("volume"))


_ACCOUNTS = {"count": "count(*)", "balance": "sum(balance)", "mean": "avg(balance)", "deviation": "stddev(balance)",
             "types": "count(DISTINCT account_type)", "age": "avg(age)"}
_USAGE = {"count": "sum(n)", "volume": "sum(x)", "mean": "try_divide(sum(x), sum(nx))", "last": "max(last)",
          "fees": "sum(n) * 0.10",
          # exact: the numerator is never below 0
          "deviation": "sqrt(try_divide(double(sum(nx) * sum(xx) - sum(x) * sum(x)), double(sum(nx) * (sum(nx) - 1))))"}

CUSTOMER = Entity(
    "customer_id",
    measures={
        "accounts": _ACCOUNTS,
        "open": _ACCOUNTS | {t.lower(): f"sum(balance) FILTER (WHERE account_type = '{t}')"
                             for t in ("CHECKING", "SAVINGS", "BUSINESS", "LOAN")},
        # accounts with ``idle``, the days since their last transaction
        "account_use": _ACCOUNTS | {"active": "count_if(status = 'ACTIVE')", "idle": "count_if(idle > 90)",
                                    "idle_share": "try_divide(double(count_if(idle > 90)), double(count(*)))",
                                    "shortest": "min(idle)", "longest": "max(idle)"},
        "usage": _USAGE,
        "usage_by_type": _USAGE | {"types": "count(DISTINCT transaction_type)"},
        "usage_by_time": {"times": "count(DISTINCT transaction_date)",
                          "office_hours": "try_divide(double(sum(if(hour(transaction_date) BETWEEN 9 AND 17, n, 0))),"
                                          " double(sum(n)))"},
        "loans": {"count": "count(*)", "amount": "sum(loan_amount)", "rate": "avg(interest_rate)",
                  "interest": "sum(loan_amount * interest_rate * term_months / 12)"},
        "cards": {"count": "count(*)", "limit": "sum(credit_limit)", "balance": "sum(current_balance)",
                  "interest": "sum(current_balance * 0.18)",
                  "utilization": "avg(try_divide(double(current_balance), double(credit_limit)))"},
        "facilities": {"count": "count(*)", "amount": "sum(loan_amount)", "types": "count(DISTINCT loan_type)"},
        "beneficiaries": {"count": "count(*)", "types": "count(DISTINCT relationship)"},
        "partners": {"count": "count(*)", "allocation": "sum(allocation_percentage)"},
        "network": {"accounts": "count(DISTINCT account_id)", "balance": "sum(balance)",
                    "people": "count(DISTINCT beneficiary_id)"}
        | {r.lower(): f"count_if(relationship = '{r}')" for r in ("SPOUSE", "CHILD", "PARENT", "BUSINESS_PARTNER")},
        "borrowing": {"amount": "sum(loan_amount)"},
    },
    sources={
        "open": lambda t: active(t["accounts"]),
        "usage": _usage(),
        "usage_by_type": _usage("transaction_type"),
        "usage_by_time": _usage("transaction_date"),
        "loans": lambda t: active(t["loans"]),
        "cards": lambda t: active(t["credit_cards"]),
        "facilities": lambda t: credit_book(t["loans"], t["credit_cards"], "customer_id", "loan_amount", "loan_type"),
        "beneficiaries": lambda t: t["account_beneficiaries"],
        "partners": lambda t: t["account_beneficiaries"].filter("relationship = 'BUSINESS_PARTNER'"),
        "network": _network,
        "borrowing": lambda t: t["loans"].join(tx_keys(t["accounts"]), "account_id", "left_semi"),
    })

#: ``changes``: relative change of an account's monthly volume; its first month has none.
ACCOUNT = Entity(
    "account_id",
    measures={"changes": {"mean": "avg(change)", "deviation": "stddev(change)", "worst": "min(change)"}},
    sources={"changes": lambda t: _monthly(t["transactions"], "account_id").withColumn(
        "change", growth("volume", Window.partitionBy("account_id").orderBy("month")))})

#: ``payments`` may come ``with_delay``.
LOAN = Entity(
    "loan_id",
    measures={"payments": {
        "count": "count(*)", "overdue": "count_if(status = 'OVERDUE')", "delayed": "count_if(delay > 0)",
        "delayed_share": "try_divide(double(count_if(delay > 0)), double(count(*)))",
        "delay": "avg(delay)", "delay_deviation": "stddev(delay)", "longest_delay": "max(delay)",
        "late": "max(datediff(payment_date, due_date))", "paid": "sum(amount_paid)", "due": "sum(amount_due)",
        "completion": "try_divide(double(sum(amount_paid)), double(sum(amount_due)))",
        "paid_share": "avg(try_divide(double(amount_paid), double(amount_due)))"}})

#: ``months``: a card's spend by month.
CARD = Entity(
    "card_id",
    measures={"months": {"mean": "avg(double(volume))", "deviation": "stddev(double(volume))",
                         "least": "min(volume)", "most": "max(volume)"}},
    sources={"months": lambda t: _monthly(t["card_transactions"], "card_id")})

#: ``approvals``: loans by the employee who approved them.
STAFF = Entity(
    "employee_id",
    measures={"approvals": {"by": "max(employee_id)", "count": "count(*)", "volume": "sum(loan_amount)",
                            "mean": "avg(loan_amount)"}},
    sources={"approvals": lambda t: t["loans"].select(F.col("approved_by").alias("employee_id"), "loan_amount")})

BRANCH = Entity("branch_id", measures={"accounts": _ACCOUNTS})

#: Measures of loans under a rate move, for any grouping of them.
RATE_BOOK = {
    "count": "count(*)", "amount": "sum(loan_amount)", "rate": "avg(interest_rate)",
    "impact_1pct": "sum(loan_amount * interest_rate * 0.01 * term_months / 12)",
    "impact_2pct": "sum(loan_amount * interest_rate * 0.02 * term_months / 12)",
}
