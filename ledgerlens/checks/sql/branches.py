"""Oracle SQL (DuckDB) for the branch, employee and geography analyses."""

from __future__ import annotations

from ledgerlens.checks.sqlkit import BRANCH_COLS, D, case_gt, dbl, div, havg, months_between, wsum, zcol

SQL: dict[str, str] = {}


SQL["branch_network"] = f"""
WITH acc AS (SELECT branch_id, COUNT(*) AS total_accounts, SUM(balance) AS total_deposits FROM accounts GROUP BY branch_id),
tx AS (SELECT a.branch_id, COUNT(*) AS total_transactions, SUM(t.amount) AS transaction_volume
       FROM transactions t JOIN accounts a ON t.account_id = a.account_id GROUP BY a.branch_id),
cu AS (SELECT a.branch_id, COUNT(DISTINCT c.customer_id) AS unique_customers
       FROM customers c JOIN accounts a ON c.customer_id = a.customer_id GROUP BY a.branch_id),
bp AS (
  SELECT {BRANCH_COLS}, {zcol("acc.total_accounts")}, {zcol("acc.total_deposits")},
         {zcol("tx.total_transactions")}, {zcol("tx.transaction_volume")}, {zcol("cu.unique_customers")}
  FROM branches b LEFT JOIN acc ON b.branch_id = acc.branch_id LEFT JOIN tx ON b.branch_id = tx.branch_id
  LEFT JOIN cu ON b.branch_id = cu.branch_id),
s AS (
  SELECT *, {div("total_deposits", "unique_customers")} AS deposits_per_customer,
            {div("total_transactions", "unique_customers")} AS transactions_per_customer,
            {wsum(("total_deposits", 0.4), ("transaction_volume", 0.3), ("unique_customers", 0.3))} AS efficiency_score
  FROM bp),
q AS (SELECT quantile_disc(efficiency_score, 0.25) AS p25, quantile_disc(efficiency_score, 0.75) AS p75 FROM s)
SELECT s.*, CASE WHEN efficiency_score < p25 THEN 'CONSOLIDATE' WHEN efficiency_score > p75 THEN 'EXPAND'
                 ELSE 'MAINTAIN' END AS optimization_recommendation
FROM s CROSS JOIN q"""

SQL["branch_performance"] = f"""
WITH acc AS (SELECT branch_id, COUNT(*) AS total_accounts, SUM(balance) AS total_deposits,
                    {havg("balance")} AS avg_account_balance, COUNT(DISTINCT customer_id) AS unique_customers
             FROM accounts GROUP BY branch_id),
emp AS (SELECT branch_id, COUNT(*) AS total_employees, {havg("salary")} AS avg_salary,
               COUNT(DISTINCT position) AS diverse_positions FROM employees GROUP BY branch_id),
tx AS (SELECT a.branch_id, COUNT(*) AS total_transactions, SUM(t.amount) AS total_transaction_volume,
              {havg("t.amount")} AS avg_transaction_size
       FROM transactions t JOIN accounts a ON t.account_id = a.account_id GROUP BY a.branch_id),
bp AS (
  SELECT {BRANCH_COLS}, {zcol("acc.total_accounts")}, {zcol("acc.total_deposits")}, {zcol("acc.avg_account_balance")},
         {zcol("acc.unique_customers")}, {zcol("emp.total_employees")}, {zcol("emp.avg_salary")},
         {zcol("emp.diverse_positions")}, {zcol("tx.total_transactions")}, {zcol("tx.total_transaction_volume")},
         {zcol("tx.avg_transaction_size")}
  FROM branches b LEFT JOIN acc ON b.branch_id = acc.branch_id LEFT JOIN emp ON b.branch_id = emp.branch_id
  LEFT JOIN tx ON b.branch_id = tx.branch_id),
r AS (
  SELECT *, {div("total_transaction_volume", "total_employees")} AS efficiency_ratio,
            {div("total_deposits", "unique_customers")} AS deposit_growth_score
  FROM bp)
SELECT *, {wsum(("efficiency_ratio", 0.4), ("deposit_growth_score", 0.3), ("avg_account_balance", 0.3))}
          AS overall_performance_score
FROM r"""

_LA = f"""la AS (SELECT approved_by, COUNT(*) AS loans_approved, SUM(loan_amount) AS total_loan_volume,
                 {havg("loan_amount")} AS avg_loan_size FROM loans GROUP BY approved_by)"""

SQL["employee_performance"] = f"""
WITH {_LA},
am AS (SELECT branch_id, COUNT(*) AS accounts_in_branch FROM accounts GROUP BY branch_id),
ep AS (
  SELECT e.employee_id, e.branch_id, e.first_name, e.last_name, e.position, e.email, e.phone, e.hire_date,
         {zcol("e.salary")}, {zcol("e.manager_id")}, {zcol("la.approved_by")}, {zcol("la.loans_approved")},
         {zcol("la.total_loan_volume")}, {zcol("la.avg_loan_size")}, am.accounts_in_branch,
         b.branch_name, b.branch_code, b.address, b.city, b.state, b.phone AS branch_phone,
         {zcol("b.manager_id", "branch_manager_id")}
  FROM employees e LEFT JOIN la ON e.employee_id = la.approved_by
  JOIN am ON e.branch_id = am.branch_id JOIN branches b ON e.branch_id = b.branch_id),
s AS (
  SELECT *, {wsum(("loans_approved", 0.4), ("total_loan_volume", 0.3), ("salary", 0.3))} AS performance_score,
            {div("total_loan_volume", "accounts_in_branch")} AS efficiency_ratio
  FROM ep)
SELECT *, CASE WHEN performance_score > AVG(performance_score) OVER () THEN 'TOP'
               WHEN performance_score < AVG(performance_score) OVER () THEN 'LOW'
               ELSE 'AVERAGE' END AS performance_tier
FROM s"""

SQL["employee_productivity"] = f"""
WITH la AS (SELECT approved_by, COUNT(*) AS loans_approved, SUM(loan_amount) AS total_loan_volume
            FROM loans GROUP BY approved_by),
ba AS (SELECT branch_id, COUNT(*) AS branch_accounts FROM accounts GROUP BY branch_id),
em AS (
  SELECT e.*, la.approved_by, la.loans_approved, la.total_loan_volume, ba.branch_accounts,
         {months_between(D, "e.hire_date")} AS tenure_months
  FROM employees e LEFT JOIN la ON e.employee_id = la.approved_by JOIN ba ON e.branch_id = ba.branch_id),
s AS (
  SELECT *, {wsum(("COALESCE(loans_approved, 0)", 0.5), ("COALESCE(total_loan_volume, 0)", 0.3),
                  ("tenure_months", 0.2))} AS productivity_score
  FROM em),
r AS (SELECT *, PERCENT_RANK() OVER (PARTITION BY position ORDER BY productivity_score NULLS FIRST)
                AS position_percentile FROM s)
SELECT *, {case_gt("position_percentile", [(0.8, "TOP_PERFORMER"), (0.6, "HIGH_PERFORMER"), (0.4, "AVERAGE"),
                                            (0.2, "LOW_PERFORMER")], "UNDER_PERFORMER")} AS performance_category,
          {div("salary", "productivity_score")} AS salary_to_productivity_ratio
FROM r"""

SQL["geographic_expansion"] = f"""
WITH cov AS (
  SELECT c.state, c.city, COUNT(DISTINCT c.customer_id) AS current_customers, SUM(a.balance) AS total_deposits,
         {havg("a.balance")} AS avg_balance_per_customer
  FROM customers c JOIN accounts a ON c.customer_id = a.customer_id GROUP BY 1, 2),
bc AS (SELECT state, city, COUNT(*) AS branch_count FROM branches GROUP BY 1, 2),
j AS (
  SELECT cov.state, cov.city, {zcol("cov.current_customers")}, {zcol("cov.total_deposits")},
         {zcol("cov.avg_balance_per_customer")}, {zcol("bc.branch_count")}
  FROM cov LEFT JOIN bc ON cov.state = bc.state AND cov.city = bc.city),
m AS (
  SELECT *,
    CASE WHEN branch_count > 0 THEN {div("current_customers", "branch_count")} ELSE {dbl("current_customers")} END
      AS customers_per_branch,
    CASE WHEN branch_count > 0 THEN {div("total_deposits", "branch_count")} ELSE {dbl("total_deposits")} END
      AS deposits_per_branch
  FROM j),
s AS (
  SELECT *, {case_gt("customers_per_branch", [(5000, "OVERSATURATED"), (3000, "MATURE"), (1500, "GROWING"),
                                               (500, "EMERGING")], "UNDERSERVED")} AS market_saturation
  FROM m)
SELECT *,
  CASE WHEN market_saturation = 'UNDERSERVED' THEN 'HIGH_PRIORITY' WHEN market_saturation = 'EMERGING' THEN 'MEDIUM_PRIORITY'
       WHEN market_saturation = 'GROWING' THEN 'LOW_PRIORITY' ELSE 'NO_EXPANSION' END AS expansion_priority,
  CASE WHEN market_saturation = 'UNDERSERVED' THEN 5000 WHEN market_saturation = 'EMERGING' THEN 3000
       WHEN market_saturation = 'GROWING' THEN 1000 ELSE 0 END AS potential_new_customers
FROM s"""

SQL["operational_efficiency"] = f"""
WITH acc AS (SELECT branch_id, COUNT(*) AS accounts_managed, SUM(balance) AS deposits_managed FROM accounts GROUP BY branch_id),
tx AS (SELECT a.branch_id, COUNT(*) AS transactions_processed
       FROM transactions t JOIN accounts a ON t.account_id = a.account_id GROUP BY a.branch_id),
emp AS (SELECT branch_id, COUNT(*) AS staff_count, {havg("salary")} AS avg_salary FROM employees GROUP BY branch_id),
be AS (
  SELECT {BRANCH_COLS}, {zcol("acc.accounts_managed")}, {zcol("acc.deposits_managed")},
         {zcol("tx.transactions_processed")}, {zcol("emp.staff_count")}, {zcol("emp.avg_salary")}
  FROM branches b LEFT JOIN acc ON b.branch_id = acc.branch_id LEFT JOIN tx ON b.branch_id = tx.branch_id
  LEFT JOIN emp ON b.branch_id = emp.branch_id),
r AS (
  SELECT *, {div("accounts_managed", "staff_count")} AS accounts_per_staff,
            {div("transactions_processed", "staff_count")} AS transactions_per_staff,
            {div("deposits_managed", "staff_count")} AS deposits_per_staff
  FROM be),
r2 AS (
  SELECT *, {div("avg_salary", "transactions_per_staff")} AS cost_per_transaction,
            {wsum(("accounts_per_staff", 0.3), ("transactions_per_staff", 0.4), ("deposits_per_staff", 0.3))}
              AS efficiency_score
  FROM r),
q AS (SELECT *, NTILE(4) OVER (ORDER BY efficiency_score NULLS FIRST, branch_id) AS efficiency_quartile FROM r2)
SELECT *, CASE WHEN efficiency_quartile = 1 THEN 'MAJOR_IMPROVEMENT_NEEDED'
               WHEN efficiency_quartile = 2 THEN 'MODERATE_IMPROVEMENT_NEEDED'
               WHEN efficiency_quartile = 3 THEN 'MINOR_IMPROVEMENT_NEEDED'
               ELSE 'MAINTAIN_PERFORMANCE' END AS improvement_recommendation
FROM q"""

SQL["operational_risk"] = f"""
WITH j AS (
  SELECT a.branch_id, t.amount, CASE WHEN t.amount > 5000 THEN 1 ELSE 0 END AS hv,
         CASE WHEN dayofweek(t.transaction_date) IN (0, 6) THEN 1 ELSE 0 END AS wk
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id JOIN branches b ON a.branch_id = b.branch_id),
g AS (
  SELECT branch_id, COUNT(*) AS total_transactions, SUM(hv) AS high_value_transactions,
         SUM(wk) AS weekend_transactions, {havg("amount")} AS avg_transaction_size
  FROM j GROUP BY branch_id),
s AS (SELECT *, {wsum(("high_value_transactions", 0.4), ("weekend_transactions", 0.3), ("avg_transaction_size", 0.3))}
                AS operational_risk_score FROM g),
q AS (SELECT quantile_disc(operational_risk_score, 0.8) AS p80, quantile_disc(operational_risk_score, 0.5) AS p50 FROM s)
SELECT s.*, CASE WHEN operational_risk_score > p80 THEN 'HIGH' WHEN operational_risk_score > p50 THEN 'MEDIUM'
                 ELSE 'LOW' END AS risk_category
FROM s CROSS JOIN q"""
