"""Oracle SQL (DuckDB) for the account-level analyses."""

from __future__ import annotations

from ledgerlens.checks.sqlkit import D, age_band, age_years, case_gt, div, havg, wsum

SQL: dict[str, str] = {}


_LAST_TX = "last AS (SELECT account_id, MAX(transaction_date) AS last_transaction_date FROM transactions GROUP BY account_id)"

SQL["account_aging"] = f"""
WITH {_LAST_TX},
g AS (
  SELECT a.balance, ({D} - CAST(l.last_transaction_date AS DATE)) AS dslt, ({D} - a.open_date) AS dsao
  FROM accounts a LEFT JOIN last l ON a.account_id = l.account_id),
c AS (
  SELECT balance,
    CASE WHEN dslt IS NULL THEN 'NO_TRANSACTIONS' WHEN dslt > 365 THEN 'DORMANT' WHEN dslt > 180 THEN 'INACTIVE'
         WHEN dslt > 90 THEN 'LOW_ACTIVITY' ELSE 'ACTIVE' END AS aging_category,
    {case_gt("dsao", [(3650, "VETERAN"), (1825, "ESTABLISHED"), (365, "MATURE")], "NEW")} AS account_age_category
  FROM g),
s AS (
  SELECT aging_category, account_age_category, COUNT(*) AS account_count, SUM(balance) AS total_balance,
         {havg("balance")} AS avg_balance
  FROM c GROUP BY 1, 2)
SELECT *, {div("total_balance", "SUM(total_balance) OVER ()")} AS balance_percentage FROM s"""

SQL["account_opening_patterns"] = f"""
WITH j AS (
  SELECT year(a.open_date) AS opening_year, quarter(a.open_date) AS opening_quarter,
         {age_band(age_years("a.open_date", "c.date_of_birth"))} AS age_group,
         c.customer_type, a.account_type, a.balance
  FROM accounts a JOIN customers c ON a.customer_id = c.customer_id
  JOIN branches b ON a.branch_id = b.branch_id),
g AS (
  SELECT opening_year, opening_quarter, age_group, customer_type, account_type,
         COUNT(*) AS accounts_opened, {havg("balance")} AS avg_initial_balance,
         SUM(balance) AS total_initial_deposits
  FROM j GROUP BY 1, 2, 3, 4, 5)
SELECT *, {div("accounts_opened - LAG(accounts_opened) OVER w", "LAG(accounts_opened) OVER w")} AS growth_rate
FROM g
WINDOW w AS (PARTITION BY age_group, account_type, customer_type
             ORDER BY opening_year NULLS FIRST, opening_quarter NULLS FIRST)"""

SQL["churn_features"] = f"""
WITH {_LAST_TX},
a AS (
  SELECT a.customer_id, a.status, a.balance, ({D} - CAST(l.last_transaction_date AS DATE)) AS d
  FROM accounts a LEFT JOIN last l ON a.account_id = l.account_id),
g AS (
  SELECT customer_id, COUNT(*) AS total_accounts,
         SUM(CASE WHEN status = 'ACTIVE' THEN 1 ELSE 0 END) AS active_accounts,
         SUM(CASE WHEN d > 90 THEN 1 ELSE 0 END) AS inactive_accounts,
         {havg("balance")} AS avg_balance, SUM(balance) AS total_balance,
         MIN(d) AS min_days_inactive, MAX(d) AS max_days_inactive
  FROM a GROUP BY customer_id),
r AS (SELECT *, {div("inactive_accounts", "total_accounts")} AS inactive_ratio FROM g)
SELECT *, CASE WHEN inactive_ratio > 0.7 THEN 'HIGH' WHEN inactive_ratio > 0.4 THEN 'MEDIUM'
               WHEN max_days_inactive > 180 THEN 'HIGH' ELSE 'LOW' END AS churn_risk_score
FROM r"""

SQL["product_benchmark"] = f"""
WITH g AS (
  SELECT account_type, COUNT(*) AS current_accounts, SUM(balance) AS current_balance,
         {havg("balance")} AS current_avg_balance
  FROM accounts GROUP BY account_type),
t AS (
  SELECT *,
    CASE WHEN account_type = 'SAVINGS' THEN 10000 WHEN account_type = 'CHECKING' THEN 15000
         WHEN account_type = 'BUSINESS' THEN 5000 ELSE 2000 END AS target_accounts,
    CASE WHEN account_type = 'SAVINGS' THEN 50000000 WHEN account_type = 'CHECKING' THEN 75000000
         WHEN account_type = 'BUSINESS' THEN 100000000 ELSE 10000000 END AS target_balance
  FROM g),
r AS (
  SELECT *, {div("current_accounts", "target_accounts")} AS accounts_target_achievement,
            {div("current_balance", "target_balance")} AS balance_target_achievement
  FROM t),
s AS (SELECT *, {wsum(("accounts_target_achievement", 0.4), ("balance_target_achievement", 0.6))}
                AS overall_performance_score FROM r)
SELECT *, {case_gt("overall_performance_score", [(1.1, "EXCEEDS_TARGET"), (0.9, "MEETS_TARGET"),
                                                  (0.7, "APPROACHING_TARGET")], "BELOW_TARGET")}
          AS performance_status
FROM s"""

SQL["product_loans"] = f"""
SELECT loan_type, COUNT(*) AS total_loans, SUM(loan_amount) AS total_loan_amount,
       {havg("loan_amount")} AS avg_loan_amount, {havg("interest_rate", 3)} AS avg_interest_rate
FROM loans GROUP BY loan_type"""

SQL["product_cards"] = f"""
SELECT card_type, COUNT(*) AS total_cards, SUM(credit_limit) AS total_credit_limit,
       {havg("current_balance")} AS avg_balance, {havg("credit_limit")} AS avg_credit_limit
FROM credit_cards GROUP BY card_type"""

SQL["product_portfolio"] = f"""
WITH ap AS (
  SELECT account_type, COUNT(*) AS total_accounts, SUM(balance) AS total_balance,
         {havg("balance")} AS avg_balance, COUNT(DISTINCT customer_id) AS unique_customers,
         AVG({D} - open_date) AS avg_account_age_days
  FROM accounts GROUP BY account_type),
tp AS (
  SELECT a.account_type, COUNT(*) AS total_transactions, SUM(t.amount) AS total_transaction_volume,
         {havg("t.amount")} AS avg_transaction_amount
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id GROUP BY a.account_type),
p AS (
  SELECT ap.*, tp.total_transactions, tp.total_transaction_volume, tp.avg_transaction_amount,
         {wsum(("ap.total_balance", 0.4), ("tp.total_transaction_volume", 0.3), ("ap.unique_customers", 0.3))}
           AS profitability_score
  FROM ap LEFT JOIN tp ON ap.account_type = tp.account_type),
q AS (SELECT quantile_disc(profitability_score, 0.8) AS p80, quantile_disc(profitability_score, 0.5) AS p50,
             quantile_disc(profitability_score, 0.2) AS p20 FROM p)
SELECT p.*, CASE WHEN profitability_score > p80 THEN 'STAR' WHEN profitability_score > p50 THEN 'CORE'
                 WHEN profitability_score > p20 THEN 'SUPPORTING' ELSE 'NICHE' END AS product_performance_tier
FROM p CROSS JOIN q"""
