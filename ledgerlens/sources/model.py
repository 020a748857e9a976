"""Schemas of the ten banking tables.

Fixed values: column names, order, types and nullability must equal the data
model the analyses are written against (primary ids non-null, everything else
nullable), but ids are 64-bit: large tables have more rows than INT numbers.
"""

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


I, L, S, D, TS = IntegerType(), LongType(), StringType(), DateType(), TimestampType()

# The data model.
SCHEMAS = {
    "customers": _s(
        ("customer_id", L, False), ("first_name", S, True), ("last_name", S, True),
        ("email", S, True), ("phone", S, True), ("date_of_birth", D, True),
        ("address", S, True), ("city", S, True), ("state", S, True),
        ("zip_code", S, True), ("customer_since", D, True), ("customer_type", S, True)),
    "accounts": _s(
        ("account_id", L, False), ("customer_id", L, True), ("account_number", S, True),
        ("account_type", S, True), ("balance", DecimalType(15, 2), True),
        ("open_date", D, True), ("close_date", D, True), ("status", S, True),
        ("branch_id", L, True)),
    "transactions": _s(
        ("transaction_id", L, False), ("account_id", L, True), ("transaction_type", S, True),
        ("amount", DecimalType(15, 2), True), ("transaction_date", TS, True),
        ("description", S, True), ("related_account_id", L, True),
        ("transaction_status", S, True)),
    "branches": _s(
        ("branch_id", L, False), ("branch_name", S, True), ("branch_code", S, True),
        ("address", S, True), ("city", S, True), ("state", S, True), ("phone", S, True),
        ("manager_id", L, True)),
    "employees": _s(
        ("employee_id", L, False), ("branch_id", L, True), ("first_name", S, True),
        ("last_name", S, True), ("position", S, True), ("email", S, True),
        ("phone", S, True), ("hire_date", D, True), ("salary", DecimalType(10, 2), True),
        ("manager_id", L, True)),
    "loans": _s(
        ("loan_id", L, False), ("customer_id", L, True), ("account_id", L, True),
        ("loan_type", S, True), ("loan_amount", DecimalType(15, 2), True),
        ("interest_rate", DecimalType(5, 3), True), ("term_months", I, True),
        ("start_date", D, True), ("end_date", D, True), ("status", S, True),
        ("approved_by", L, True)),
    "loan_payments": _s(
        ("payment_id", L, False), ("loan_id", L, True), ("due_date", D, True),
        ("payment_date", D, True), ("amount_due", DecimalType(10, 2), True),
        ("amount_paid", DecimalType(10, 2), True),
        ("principal_amount", DecimalType(10, 2), True),
        ("interest_amount", DecimalType(10, 2), True), ("status", S, True)),
    "credit_cards": _s(
        ("card_id", L, False), ("customer_id", L, True), ("account_id", L, True),
        ("card_number", S, True), ("card_type", S, True),
        ("credit_limit", DecimalType(10, 2), True),
        ("current_balance", DecimalType(10, 2), True), ("issue_date", D, True),
        ("expiry_date", D, True), ("status", S, True)),
    "card_transactions": _s(
        ("card_transaction_id", L, False), ("card_id", L, True), ("transaction_date", TS, True),
        ("merchant_name", S, True), ("amount", DecimalType(10, 2), True),
        ("transaction_type", S, True), ("category", S, True), ("city", S, True),
        ("country", S, True)),
    "account_beneficiaries": _s(
        ("beneficiary_id", L, False), ("account_id", L, True), ("customer_id", L, True),
        ("relationship", S, True), ("allocation_percentage", DecimalType(5, 2), True),
        ("added_date", D, True)),
}

TABLE_NAMES = tuple(SCHEMAS)
