"""Oracle SQL (DuckDB) for the bank-wide reports."""

from __future__ import annotations

from ledgerlens.checks.sqlkit import ACTIVE_LOANS, BRANCH_COLS, D_LIQ, case_gt, div, havg, joins, zfill

SQL: dict[str, str] = {}


SQL["executive_summary"] = f"""
SELECT * FROM
  (SELECT COUNT(DISTINCT customer_id) AS total_customers,
          COUNT(DISTINCT CASE WHEN customer_type = 'BUSINESS' THEN customer_id END) AS business_customers,
          COUNT(DISTINCT CASE WHEN customer_type = 'INDIVIDUAL' THEN customer_id END) AS individual_customers
   FROM customers) c
  CROSS JOIN (SELECT COUNT(*) AS total_accounts, SUM(balance) AS total_deposits,
                     {havg("balance")} AS avg_account_balance FROM accounts) a
  CROSS JOIN (SELECT COUNT(*) AS active_loans, SUM(loan_amount) AS total_loan_portfolio FROM {ACTIVE_LOANS}) l
  CROSS JOIN (SELECT COUNT(*) AS total_transactions, SUM(amount) AS total_transaction_volume FROM transactions) t"""

SQL["product_dashboard"] = f"""
SELECT account_type, COUNT(*) AS accounts, SUM(balance) AS deposits, {havg("balance")} AS avg_balance
FROM accounts GROUP BY account_type
UNION ALL
SELECT loan_type, COUNT(*), SUM(loan_amount), {havg("loan_amount")} FROM {ACTIVE_LOANS} GROUP BY loan_type
UNION ALL
SELECT 'CREDIT_CARD', COUNT(*), SUM(current_balance), {havg("current_balance")}
FROM credit_cards WHERE status = 'ACTIVE' GROUP BY 1"""

SQL["regional_performance"] = f"""
WITH acc AS (SELECT branch_id, COUNT(*) AS accounts, SUM(balance) AS deposits FROM accounts GROUP BY branch_id),
emp AS (SELECT branch_id, COUNT(*) AS employees, {havg("salary")} AS avg_salary FROM employees GROUP BY branch_id),
p AS (SELECT {BRANCH_COLS}, {zfill([("acc", ["accounts", "deposits"]), ("emp", ["employees", "avg_salary"])])}
      FROM branches b {joins("b", "branch_id", ["acc", "emp"])})
SELECT *, {div("deposits", "employees")} AS deposits_per_employee, {div("accounts", "employees")} AS efficiency_ratio
FROM p"""

SQL["risk_overview"] = f"""
SELECT *, {div("defaulted_loans", "total_loans")} AS default_rate,
          {div("defaulted_amount", "total_loan_amount")} AS default_ratio
FROM (SELECT COUNT(*) AS defaulted_loans, SUM(loan_amount) AS defaulted_amount FROM loans WHERE status = 'DEFAULTED') d
CROSS JOIN (SELECT COUNT(*) AS total_loans, SUM(loan_amount) AS total_loan_amount FROM loans) t"""

_REPORTS = {"executive_summary": "''", "product_dashboard": "account_type", "regional_performance": "branch_id::VARCHAR",
            "risk_overview": "''"}
# A measure without a value (a ratio of a branch without staff) keeps its row, as
# in the report itself; without INCLUDE NULLS, DuckDB leaves it out.
SQL["reporting_framework"] = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS section, key, measure, value FROM (SELECT {key} AS key, "
    f"COLUMNS(lambda c: c NOT IN ('account_type') AND c NOT LIKE '%\\_id' ESCAPE '\\' "
    f"AND c NOT IN ('branch_name', 'branch_code', 'address', 'city', 'state', 'phone'))::DOUBLE "
    f"FROM ({SQL[name]})) UNPIVOT INCLUDE NULLS (value FOR measure IN (COLUMNS(* EXCLUDE key)))"
    for name, key in _REPORTS.items())

SQL["liquidity"] = f"""
WITH s AS (
  SELECT *, {div("total_liquid_assets", "projected_outflows_30d")} AS liquidity_ratio,
            {div("total_liquid_assets", "total_loan_commitments")} AS coverage_ratio
  FROM (SELECT SUM(balance) AS total_liquid_assets FROM accounts
        WHERE status = 'ACTIVE' AND account_type IN ('SAVINGS', 'CHECKING')) a
  CROSS JOIN (SELECT SUM(amount) AS projected_outflows_30d FROM transactions
              WHERE transaction_type IN ('WITHDRAWAL', 'PAYMENT')
                AND transaction_date >= {D_LIQ} AND transaction_date <= {D_LIQ} + 30) o
  CROSS JOIN (SELECT SUM(loan_amount) AS total_loan_commitments FROM {ACTIVE_LOANS}) c)
SELECT *, {case_gt("liquidity_ratio", [(2.0, "EXCELLENT"), (1.5, "ADEQUATE"), (1.0, "MINIMAL")], "INADEQUATE")}
          AS liquidity_status
FROM s"""
