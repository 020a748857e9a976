"""Oracle SQL (DuckDB) for the transaction-level analyses."""

from __future__ import annotations

from ledgerlens.checks.sqlkit import EPOCH, TX_ORDER, havg

SQL: dict[str, str] = {}


def _velocity(table: str) -> str:
    return f"""
WITH daily AS (
  SELECT account_id, CAST(transaction_date AS DATE) AS transaction_date_only,
         COUNT(*) AS daily_transaction_count,
         SUM(amount) AS daily_transaction_amount,
         AVG(amount) AS avg_transaction_amount,
         COUNT(DISTINCT transaction_type) AS unique_transaction_types
  FROM {table}
  WHERE account_id IN (SELECT account_id FROM accounts)
  GROUP BY 1, 2),
r AS (
  SELECT *, AVG(daily_transaction_count) OVER (
      PARTITION BY account_id ORDER BY transaction_date_only
      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_avg_7d
  FROM daily),
l AS (
  SELECT *, CASE WHEN daily_transaction_count > rolling_avg_7d * 3 THEN 'HIGH_VELOCITY'
                 WHEN daily_transaction_amount > 10000 THEN 'LARGE_AMOUNT'
                 ELSE 'NORMAL' END AS velocity_alert
  FROM r)
SELECT * FROM l WHERE velocity_alert <> 'NORMAL'"""


SQL["transaction_velocity"] = _velocity("transactions")
SQL["transaction_velocity_dense"] = _velocity("transactions_dense")


_FLOWS = f"""
WITH m AS (
  SELECT a.customer_id, date_trunc('month', t.transaction_date) AS transaction_month,
         CASE WHEN t.transaction_type IN ('DEPOSIT','TRANSFER') THEN 'INFLOW'
              WHEN t.transaction_type IN ('WITHDRAWAL','PAYMENT') THEN 'OUTFLOW'
              ELSE 'OTHER' END AS flow_type,
         SUM(t.amount) AS total_amount
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  GROUP BY 1, 2, 3),
f AS (
  SELECT customer_id, flow_type,
         {havg("total_amount")} AS avg_monthly_flow,
         STDDEV_SAMP(total_amount) AS flow_volatility,
         SUM(total_amount) AS total_flow,
         COUNT(*) AS months_analyzed,
         (CASE WHEN flow_type = 'INFLOW' THEN 1 WHEN flow_type = 'OUTFLOW' THEN -1 ELSE 0 END)
           * {havg("total_amount")} AS net_flow_ratio
  FROM m GROUP BY 1, 2)"""

SQL["cash_flow_net"] = _FLOWS + "\nSELECT * FROM f"
SQL["cash_flow"] = _FLOWS + "\nSELECT customer_id,\n" + ",\n".join(
    f"  COALESCE(SUM(CASE WHEN flow_type = '{ft}' THEN {m} END), 0) AS {ft}_{m}"
    for ft in ("INFLOW", "OUTFLOW", "OTHER") for m in ("avg_monthly_flow", "flow_volatility")
) + "\nFROM f GROUP BY customer_id"

SQL["transaction_segmentation"] = """
WITH ct AS (
  SELECT a.customer_id, COUNT(*) AS total_transactions,
         AVG(t.amount) AS avg_transaction_amount,
         STDDEV_SAMP(t.amount) AS std_transaction_amount,
         SUM(t.amount) AS total_transaction_volume,
         COUNT(DISTINCT t.transaction_type) AS unique_transaction_types
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  GROUP BY a.customer_id),
ca AS (
  SELECT customer_id, COUNT(*) AS total_accounts, SUM(balance) AS total_balance,
         AVG(balance) AS avg_balance
  FROM accounts GROUP BY customer_id)
SELECT ct.*, ca.total_accounts, ca.total_balance, ca.avg_balance,
       CASE WHEN total_transactions > 100 THEN 'HIGH' WHEN total_transactions > 50 THEN 'MEDIUM'
            ELSE 'LOW' END AS transaction_frequency_segment,
       CASE WHEN total_balance > 100000 THEN 'WEALTHY' WHEN total_balance > 50000 THEN 'AFFLUENT'
            ELSE 'STANDARD' END AS balance_segment
FROM ct JOIN ca ON ct.customer_id = ca.customer_id"""


SQL["service_levels"] = f"""
WITH s AS (
  SELECT t.account_id, t.transaction_type,
         ({EPOCH.format(c="t.transaction_date")}
          - LAG({EPOCH.format(c="t.transaction_date")}) OVER (PARTITION BY t.account_id ORDER BY {TX_ORDER}))
         / 3600 AS processing_time_hours
  FROM transactions t),
g AS (
  SELECT a.account_type, s.transaction_type,
         AVG(processing_time_hours) AS avg_processing_time,
         quantile_disc(processing_time_hours, 0.95) AS p95_processing_time,
         COUNT(*) AS transaction_count
  FROM s JOIN accounts a ON s.account_id = a.account_id
  WHERE processing_time_hours IS NOT NULL
  GROUP BY 1, 2)
SELECT *,
  CASE WHEN p95_processing_time < 1 THEN 'WITHIN_SLA' WHEN p95_processing_time < 4 THEN 'NEAR_SLA'
       ELSE 'BREACH_SLA' END AS service_level_agreement,
  CASE WHEN avg_processing_time < 0.5 THEN 'EXCELLENT' WHEN avg_processing_time < 2 THEN 'GOOD'
       WHEN avg_processing_time < 6 THEN 'ACCEPTABLE' ELSE 'POOR' END AS performance_rating
FROM g"""

SQL["digital_engagement"] = """
WITH r AS (
  SELECT a.customer_id, t.amount,
         CASE WHEN hour(t.transaction_date) < 9 OR hour(t.transaction_date) > 17 THEN 1 ELSE 0 END AS off_h,
         CASE WHEN dayofweek(t.transaction_date) IN (0, 6) THEN 1 ELSE 0 END AS wkd
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  JOIN customers c ON a.customer_id = c.customer_id),
g AS (
  SELECT customer_id, COUNT(*) AS total_transactions,
         SUM(off_h) AS off_hours_transactions, SUM(wkd) AS weekend_transactions,
         AVG(amount) AS avg_transaction_size,
         SUM(CASE WHEN off_h = 1 OR wkd = 1 THEN 1 ELSE 0 END) AS digital_transactions,
         SUM(CASE WHEN off_h = 1 OR wkd = 1 THEN 0 ELSE 1 END) AS branch_transactions
  FROM r GROUP BY customer_id),
e AS (
  SELECT *, CAST(off_hours_transactions + weekend_transactions AS DOUBLE)
            / NULLIF(CAST(total_transactions AS DOUBLE), 0) AS digital_engagement_ratio
  FROM g),
l AS (
  SELECT *, CASE WHEN digital_engagement_ratio > 0.8 THEN 'DIGITAL_FIRST'
                 WHEN digital_engagement_ratio > 0.5 THEN 'DIGITAL_PREFERRED'
                 WHEN digital_engagement_ratio > 0.2 THEN 'MIXED_USAGE'
                 ELSE 'BRANCH_PREFERRED' END AS digital_adoption_level
  FROM e)
SELECT *, CASE WHEN digital_adoption_level = 'BRANCH_PREFERRED' THEN 'DIGITAL_ONBOARDING'
               WHEN digital_adoption_level = 'MIXED_USAGE' THEN 'DIGITAL_ENHANCEMENT'
               WHEN digital_adoption_level = 'DIGITAL_PREFERRED' THEN 'ADVANCED_FEATURES'
               ELSE 'MAINTAIN_SUPPORT' END AS migration_opportunity
FROM l"""

SQL["fee_income"] = """
WITH f AS (
  SELECT c.customer_type, a.account_type, t.amount,
         CASE WHEN t.transaction_type = 'WITHDRAWAL' THEN greatest(2.0, t.amount * 0.01)
              WHEN t.transaction_type = 'TRANSFER' THEN greatest(1.5, t.amount * 0.005)
              WHEN t.transaction_type = 'PAYMENT' THEN greatest(1.0, t.amount * 0.003)
              ELSE 0.0 END AS estimated_fee
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  JOIN customers c ON a.customer_id = c.customer_id),
g AS (
  SELECT *, CASE WHEN estimated_fee > 10 THEN 'HIGH_FEE' WHEN estimated_fee > 5 THEN 'MEDIUM_FEE'
                 WHEN estimated_fee > 1 THEN 'LOW_FEE' ELSE 'NO_FEE' END AS fee_category
  FROM f),
s AS (
  SELECT customer_type, account_type, fee_category, COUNT(*) AS transaction_count,
         SUM(estimated_fee) AS total_fee_income, AVG(estimated_fee) AS avg_fee_per_transaction,
         SUM(amount) AS total_transaction_volume
  FROM g GROUP BY 1, 2, 3),
r AS (
  SELECT *, CAST(total_fee_income AS DOUBLE) / NULLIF(CAST(total_transaction_volume AS DOUBLE), 0)
            AS fee_to_volume_ratio
  FROM s)
SELECT *, CASE WHEN fee_to_volume_ratio < 0.01 AND transaction_count > 100 THEN 'INCREASE_FEES'
               WHEN fee_to_volume_ratio > 0.05 AND transaction_count < 50 THEN 'REDUCE_FEES'
               ELSE 'OPTIMAL' END AS optimization_opportunity
FROM r"""

SQL["seasonal_patterns"] = """
WITH s AS (
  SELECT year(t.transaction_date) AS transaction_year, quarter(t.transaction_date) AS transaction_quarter,
         month(t.transaction_date) AS transaction_month, a.account_type,
         COUNT(*) AS transaction_count, SUM(t.amount) AS transaction_volume,
         AVG(t.amount) AS avg_transaction_size
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  GROUP BY 1, 2, 3, 4)
SELECT *,
  CAST(transaction_volume AS DOUBLE)
    / NULLIF(CAST(AVG(transaction_volume) OVER (PARTITION BY account_type, transaction_month) AS DOUBLE), 0)
    AS seasonal_index,
  CASE WHEN transaction_month IN (11, 12) THEN 'HOLIDAY_PEAK'
       WHEN transaction_month IN (1, 2) THEN 'POST_HOLIDAY_DIP'
       WHEN transaction_month IN (4, 5) THEN 'SPRING_INCREASE'
       WHEN transaction_month IN (7, 8) THEN 'SUMMER_SLOWDOWN' ELSE 'NORMAL' END AS seasonal_pattern,
  CAST(transaction_volume - LAG(transaction_volume) OVER w AS DOUBLE)
    / NULLIF(CAST(LAG(transaction_volume) OVER w AS DOUBLE), 0) AS year_over_year_growth
FROM s
WINDOW w AS (PARTITION BY account_type, transaction_month ORDER BY transaction_year)"""

SQL["transaction_anomalies"] = f"""
WITH st AS (
  SELECT account_id, {havg("amount")} AS account_avg_amount, STDDEV_SAMP(amount) AS account_std_amount
  FROM transactions GROUP BY account_id),
j AS (
  SELECT t.transaction_id, t.account_id, t.amount, t.transaction_type, a.balance, st.account_avg_amount,
         CAST(t.amount - st.account_avg_amount AS DOUBLE) / NULLIF(st.account_std_amount, 0) AS z_score
  FROM transactions t JOIN accounts a ON t.account_id = a.account_id
  JOIN st ON t.account_id = st.account_id)
SELECT transaction_id, account_id, amount, transaction_type, z_score, balance, account_avg_amount
FROM j WHERE abs(z_score) > 3 OR amount > balance * 0.5"""
