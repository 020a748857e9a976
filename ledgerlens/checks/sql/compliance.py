"""Oracle SQL (DuckDB) for the compliance, concentration and counterparty analyses."""

from __future__ import annotations

from ledgerlens.checks.sqlkit import TXA, case_gt, div, flags, havg, joins, zfill

SQL: dict[str, str] = {}


_AML = f"""al AS (
  SELECT a.customer_id, t.transaction_id, t.amount, t.transaction_date,
         CASE WHEN t.amount > 10000 THEN 'LARGE_TRANSACTION'
              WHEN t.amount > 5000 AND t.transaction_type = 'CASH_DEPOSIT' THEN 'SUSPICIOUS_CASH'
              WHEN t.amount > 8000 AND t.description LIKE '%international%' THEN 'CROSS_BORDER'
              ELSE 'NORMAL' END AS suspicious_indicator
  FROM {TXA} JOIN customers c ON a.customer_id = c.customer_id),
f AS (SELECT * FROM al WHERE suspicious_indicator <> 'NORMAL')"""
_KYC = """kyc AS (
  SELECT kyc_risk_indicator, COUNT(*) AS non_compliant_customers
  FROM (SELECT CASE WHEN date_of_birth IS NULL THEN 'MISSING_DOB' WHEN address IS NULL THEN 'MISSING_ADDRESS'
                    WHEN phone IS NULL THEN 'MISSING_PHONE' WHEN email IS NULL THEN 'MISSING_EMAIL'
                    ELSE 'COMPLETE' END AS kyc_risk_indicator FROM customers) x
  WHERE kyc_risk_indicator <> 'COMPLETE' GROUP BY 1)"""
_CRED = f"""cr AS (
  SELECT compliance_issue, COUNT(*) AS non_compliant_cards, {havg("current_balance")} AS avg_balance,
         {havg("credit_limit")} AS avg_limit
  FROM (SELECT cc.current_balance, cc.credit_limit,
               CASE WHEN cc.current_balance > cc.credit_limit * 0.9 THEN 'HIGH_UTILIZATION'
                    WHEN cc.credit_limit > 50000 THEN 'HIGH_LIMIT' ELSE 'COMPLIANT' END AS compliance_issue
        FROM credit_cards cc JOIN customers c ON cc.customer_id = c.customer_id) x
  WHERE compliance_issue <> 'COMPLIANT' GROUP BY 1)"""

SQL["compliance_aml"] = f"""
WITH {_AML}
SELECT customer_id, suspicious_indicator, COUNT(*) AS alert_count, SUM(amount) AS total_suspicious_amount,
       COUNT(DISTINCT transaction_date) AS suspicious_date_count
FROM f GROUP BY 1, 2"""
SQL["compliance_aml_dates"] = f"WITH {_AML}\nSELECT DISTINCT customer_id, suspicious_indicator, transaction_date FROM f"
SQL["compliance_aml_date_pages"] = f"""
WITH {_AML},
p AS (SELECT *, row_number() OVER (PARTITION BY customer_id, suspicious_indicator ORDER BY transaction_date) - 1 AS place
      FROM (SELECT DISTINCT customer_id, suspicious_indicator, transaction_date FROM f) AS d WHERE transaction_date IS NOT NULL)
SELECT customer_id, suspicious_indicator, place // 1000 AS page, list(transaction_date ORDER BY transaction_date) AS suspicious_dates
FROM p GROUP BY ALL"""
SQL["compliance_kyc"] = f"WITH {_KYC}\nSELECT * FROM kyc"
SQL["compliance_credit"] = f"WITH {_CRED}\nSELECT * FROM cr"
SQL["compliance_risk"] = f"""
WITH {_AML}, {_KYC}, {_CRED},
s AS (
  SELECT * FROM (SELECT COUNT(DISTINCT customer_id) AS aml_alert_customers FROM f) a
  CROSS JOIN (SELECT SUM(non_compliant_customers) AS kyc_non_compliant FROM kyc) k
  CROSS JOIN (SELECT SUM(non_compliant_cards) AS credit_non_compliant FROM cr) c)
SELECT *, CASE WHEN aml_alert_customers > 100 OR kyc_non_compliant > 50 OR credit_non_compliant > 200 THEN 'HIGH_RISK'
               WHEN aml_alert_customers > 50 OR kyc_non_compliant > 20 OR credit_non_compliant > 100 THEN 'MEDIUM_RISK'
               ELSE 'LOW_RISK' END AS overall_compliance_risk
FROM s"""

SQL["concentration_risk"] = f"""
WITH sc AS (
  SELECT c.customer_type, c.state, COUNT(DISTINCT c.customer_id) AS customer_count, SUM(a.balance) AS total_exposure,
         {havg("a.balance")} AS avg_exposure
  FROM customers c JOIN accounts a ON c.customer_id = a.customer_id GROUP BY 1, 2),
s AS (SELECT *, {div("total_exposure", "SUM(total_exposure) OVER ()")} AS exposure_percentage FROM sc)
SELECT *, {case_gt("exposure_percentage", [(0.1, "HIGH"), (0.05, "MEDIUM")], "LOW")} AS concentration_risk FROM s"""

SQL["counterparty_risk"] = f"""
WITH br AS (
  SELECT customer_id, COUNT(*) AS business_partner_count, SUM(allocation_percentage) AS total_business_allocation
  FROM account_beneficiaries WHERE relationship = 'BUSINESS_PARTNER' GROUP BY customer_id),
bo AS (SELECT l.customer_id, SUM(l.loan_amount) AS total_borrowing
       FROM loans l JOIN accounts a ON l.account_id = a.account_id GROUP BY l.customer_id),
le AS (SELECT *, PERCENT_RANK() OVER (ORDER BY total_borrowing NULLS FIRST) AS exposure_percentile FROM bo),
le2 AS (SELECT *, exposure_percentile > 0.95 AS is_large_exposure FROM le),
p AS (
  SELECT c.*, {zfill([("br", ["business_partner_count", "total_business_allocation"]),
                      ("le2", ["total_borrowing", "exposure_percentile"])])}, le2.is_large_exposure
  FROM customers c {joins("c", "customer_id", ["br", "le2"])}),
s AS (SELECT *, {flags(("business_partner_count > 5", 0.3), ("total_business_allocation > 50", 0.3),
                       ("is_large_exposure = TRUE", 0.4))} AS counterparty_risk_score FROM p)
SELECT *, {case_gt("counterparty_risk_score", [(0.6, "HIGH_RISK"), (0.3, "MEDIUM_RISK")], "LOW_RISK")} AS risk_category
FROM s WHERE counterparty_risk_score > 0"""

_REG = f"""r AS (
  SELECT a.customer_id, t.account_id, t.transaction_id, t.amount, t.amount > 10000 AS hv,
         CASE WHEN t.amount > 5000 AND t.transaction_type = 'CASH_DEPOSIT' THEN TRUE
              WHEN t.amount > 8000 AND t.transaction_type = 'TRANSFER' AND t.description LIKE '%offshore%' THEN TRUE
              ELSE FALSE END AS sp
  FROM {TXA} JOIN customers c ON a.customer_id = c.customer_id),
ra AS (
  SELECT customer_id, account_id, transaction_id, amount,
         CASE WHEN hv AND sp THEN 'HIGH' WHEN hv THEN 'MEDIUM' WHEN sp THEN 'MEDIUM' ELSE 'LOW' END
           AS compliance_alert_level
  FROM r),
alerts AS (SELECT * FROM ra WHERE compliance_alert_level IN ('HIGH', 'MEDIUM'))"""

SQL["regulatory_alerts"] = f"WITH {_REG}\nSELECT * FROM alerts"
SQL["regulatory_alert_pages"] = f"""
WITH {_REG},
p AS (SELECT *, row_number() OVER (PARTITION BY customer_id, compliance_alert_level ORDER BY transaction_id) - 1 AS place
      FROM alerts WHERE transaction_id IS NOT NULL)
SELECT customer_id, compliance_alert_level, place // 1000 AS page, list(transaction_id ORDER BY transaction_id) AS alert_transactions
FROM p GROUP BY customer_id, compliance_alert_level, place // 1000"""
SQL["regulatory_compliance"] = f"""
WITH {_REG}
SELECT customer_id, compliance_alert_level, COUNT(*) AS alert_count, SUM(amount) AS total_alert_amount
FROM alerts GROUP BY 1, 2"""
