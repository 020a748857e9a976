"""Invariants on the real test tables: counts per label add up to the input,
shares add up to one, filtered results are subsets of their input."""

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from ledgerlens.registry import registry
from ledgerlens.sources.tables import BankTables


@pytest.fixture(scope="module")
def t(spark):
    return BankTables.from_testdata(spark, SF_SMALL)


def q(name, t):
    return registry()[name].build(t)


def _sum(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_label_counts_add_up(t):
    assert _sum(q("account_aging", t), "account_count") == t.accounts.count()
    assert _sum(q("account_opening_patterns", t), "accounts_opened") == t.accounts.count()
    assert _sum(q("fee_income", t), "transaction_count") == t.transactions.count()
    active_loans = t.loans.filter("status = 'ACTIVE'").count()
    assert _sum(q("interest_rate_risk", t), "loan_count") == active_loans
    assert _sum(q("market_risk", t), "loan_count") == active_loans
    active_cards = t.credit_cards.filter("status = 'ACTIVE'").count()
    assert _sum(q("stress_testing", t), "portfolio_count") == active_loans + active_cards
    assert _sum(q("product_benchmark", t), "current_accounts") == t.accounts.count()


def test_shares_add_to_one(t):
    for name, col in [("account_aging", "balance_percentage"), ("concentration_risk", "exposure_percentage"),
                      ("product_concentration", "portfolio_concentration")]:
        assert _sum(q(name, t), col) == pytest.approx(1.0), name


def test_one_row_per_entity(t):
    n = t.customers.count()
    for name in ["cross_sell", "behavior_segmentation", "customer_lifetime_value", "customer_portfolio",
                 "relationship_network", "satisfaction", "customer_360"]:
        df = q(name, t)
        assert df.count() == n and df.select("customer_id").distinct().count() == n, name
    assert q("branch_performance", t).count() == t.branches.count()
    assert q("operational_efficiency", t).count() == t.branches.count()


def test_filtered_results_are_subsets(t):
    an = q("transaction_anomalies", t)
    assert an.join(t.transactions, ["transaction_id", "account_id", "amount"], "left_anti").count() == 0
    cf = q("card_fraud", t)
    assert cf.select("card_transaction_id").distinct().count() == cf.count()
    assert cf.join(t.card_transactions, "card_transaction_id", "left_anti").count() == 0
    alerts = q("regulatory_alerts", t)
    reg = q("regulatory_compliance", t)
    assert _sum(reg, "alert_count") == alerts.count()
    assert q("counterparty_risk", t).filter("counterparty_risk_score <= 0").count() == 0


def test_percent_ranks_are_in_unit_interval(t):
    for name, col in [("counterparty_risk", "exposure_percentile"), ("employee_productivity", "position_percentile"),
                      ("market_position", "market_share_ranking")]:
        lo, hi = q(name, t).agg(F.min(col), F.max(col)).first()
        assert 0.0 <= lo <= hi <= 1.0, name
