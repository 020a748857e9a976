"""Registered queries: every analysis (and each extra result it computes) run
over the banking tables mapped from the test data.

``REGISTRY[name].build(tables)`` returns the analysis' own DataFrame; the
driver contract (``__spark_entry__.py``) wraps it in the canonical compare
form and pairs it with the oracle SQL of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlens.sources.tables import BankTables
from ledgerlens.sources.testdata import AS_OF, AS_OF_DENSE, AS_OF_LIQUIDITY


@dataclass(frozen=True)
class Spec:
    build: Callable[[BankTables], DataFrame]
    family: str


REGISTRY: dict[str, Spec] = {}


def _reg(name: str, family: str):
    def deco(fn):
        REGISTRY[name] = Spec(fn, family)
        return fn
    return deco


def _load():
    """Import the operator modules and register their queries (idempotent)."""
    if REGISTRY:
        return REGISTRY
    from ledgerlens.operators import transactions as tx

    _reg("transaction_velocity", "transactions")(
        lambda t: tx.transaction_velocity(t.transactions, t.accounts))
    _reg("transaction_velocity_dense", "transactions")(
        lambda t: tx.transaction_velocity(t.transactions_dense, t.accounts))
    _reg("cash_flow", "transactions")(lambda t: tx.cash_flow(t.transactions, t.accounts, t.customers))
    _reg("cash_flow_net", "transactions")(lambda t: tx.cash_flow_net(t.transactions, t.accounts, t.customers))
    _reg("transaction_segmentation", "transactions")(
        lambda t: tx.transaction_segmentation(t.transactions, t.accounts, t.customers))
    _reg("service_levels", "transactions")(lambda t: tx.service_levels(t.transactions, t.accounts, t.loans))
    _reg("digital_engagement", "transactions")(
        lambda t: tx.digital_engagement(t.transactions, t.accounts, t.customers))
    _reg("fee_income", "transactions")(lambda t: tx.fee_income(t.transactions, t.accounts, t.customers))
    _reg("seasonal_patterns", "transactions")(lambda t: tx.seasonal_patterns(t.transactions, t.accounts, t.loans))
    _reg("transaction_anomalies", "transactions")(lambda t: tx.transaction_anomalies(t.transactions, t.accounts))
    # the dense event-based transactions: microsecond times, NULL descriptions,
    # many rows per account and day
    _reg("service_levels_dense", "transactions")(
        lambda t: tx.service_levels(t.transactions_dense, t.accounts, t.loans))
    _reg("transaction_anomalies_dense", "transactions")(
        lambda t: tx.transaction_anomalies(t.transactions_dense, t.accounts))
    from ledgerlens.operators import accounts as ac
    from ledgerlens.operators import branches as br
    _reg("account_aging", "accounts")(lambda t: ac.account_aging(t.accounts, t.transactions, as_of=AS_OF))
    _reg("account_opening_patterns", "accounts")(
        lambda t: ac.account_opening_patterns(t.accounts, t.customers, t.branches))
    _reg("churn_features", "accounts")(
        lambda t: ac.churn_features(t.customers, t.accounts, t.transactions, as_of=AS_OF))
    _reg("product_benchmark", "accounts")(
        lambda t: ac.product_benchmark(t.accounts, t.loans, t.credit_cards, t.transactions))
    _reg("product_portfolio", "accounts")(
        lambda t: ac.product_portfolio(t.accounts, t.loans, t.credit_cards, t.transactions, as_of=AS_OF))
    _reg("product_loans", "accounts")(lambda t: ac.product_loans(t.loans))
    _reg("product_cards", "accounts")(lambda t: ac.product_cards(t.credit_cards))
    _reg("branch_network", "branches")(
        lambda t: br.branch_network(t.branches, t.accounts, t.transactions, t.customers))
    _reg("branch_performance", "branches")(
        lambda t: br.branch_performance(t.branches, t.accounts, t.employees, t.transactions))
    _reg("employee_performance", "branches")(
        lambda t: br.employee_performance(t.employees, t.loans, t.accounts, t.branches))
    _reg("employee_productivity", "branches")(
        lambda t: br.employee_productivity(t.employees, t.loans, t.accounts, t.branches, as_of=AS_OF))
    _reg("geographic_expansion", "branches")(
        lambda t: br.geographic_expansion(t.branches, t.customers, t.accounts, t.transactions))
    _reg("operational_efficiency", "branches")(
        lambda t: br.operational_efficiency(t.employees, t.branches, t.transactions, t.accounts))
    _reg("operational_risk", "branches")(
        lambda t: br.operational_risk(t.transactions, t.accounts, t.employees, t.branches))
    from ledgerlens.operators import customers as cu
    _reg("cross_sell", "customers")(lambda t: cu.cross_sell(t.customers, t.accounts, t.loans, t.credit_cards))
    _reg("behavior_segmentation", "customers")(
        lambda t: cu.behavior_segmentation(t.customers, t.accounts, t.transactions, t.credit_cards))
    _reg("customer_lifetime_value", "customers")(
        lambda t: cu.customer_lifetime_value(t.customers, t.accounts, t.transactions, t.loans, t.credit_cards))
    _reg("customer_migration", "customers")(
        lambda t: cu.customer_migration(t.accounts, t.transactions, t.customers, t.branches))
    _reg("branch_migration", "customers")(
        lambda t: cu.branch_migration(t.accounts, t.transactions, t.customers, t.branches))
    _reg("product_migration", "customers")(
        lambda t: cu.product_migration(t.accounts, t.transactions, t.customers, t.branches))
    _reg("customer_portfolio", "customers")(
        lambda t: cu.customer_portfolio(t.customers, t.accounts, t.loans, t.credit_cards))
    _reg("customer_portfolio_types", "customers")(lambda t: cu.customer_portfolio_types(t.accounts))
    _reg("relationship_types", "customers")(
        lambda t: cu.relationship_types(t.account_beneficiaries, t.accounts))
    _reg("relationship_network", "customers")(
        lambda t: cu.relationship_network(t.customers, t.account_beneficiaries, t.accounts))
    _reg("satisfaction", "customers")(
        lambda t: cu.satisfaction(t.customers, t.accounts, t.transactions, t.loans, as_of=AS_OF))
    _reg("demographic_targeting", "customers")(
        lambda t: cu.demographic_targeting(t.customers, t.accounts, t.transactions, t.loans, as_of=AS_OF))
    _reg("customer_360", "customers")(
        lambda t: cu.customer_360(t.customers, t.accounts, t.transactions, t.loans, t.credit_cards,
                                  t.account_beneficiaries, as_of=AS_OF))
    _reg("strategic_planning", "customers")(
        lambda t: cu.strategic_planning(t.customers, t.accounts, t.loans, t.transactions, t.branches, as_of=AS_OF))
    _reg("market_position", "customers")(lambda t: cu.market_position(t.customers, t.accounts))
    _reg("product_concentration", "customers")(lambda t: cu.product_concentration(t.accounts, as_of=AS_OF))
    _reg("single_product_customers", "customers")(lambda t: cu.single_product_customers(t.customers, t.accounts))
    from ledgerlens.operators import compliance as co
    from ledgerlens.operators import credit as cr
    from ledgerlens.operators import reporting as rp
    _reg("collateral_coverage", "credit")(lambda t: cr.collateral_coverage(t.loans, t.accounts, t.customers))
    _reg("card_fraud", "credit")(lambda t: cr.card_fraud(t.card_transactions, t.credit_cards, t.customers))
    _reg("credit_risk_portfolio", "credit")(lambda t: cr.credit_risk_portfolio(t.loans, t.credit_cards, t.customers))
    _reg("credit_utilization", "credit")(
        lambda t: cr.credit_utilization(t.credit_cards, t.customers, t.card_transactions))
    _reg("early_warning", "credit")(
        lambda t: cr.early_warning(t.loans, t.loan_payments, t.accounts, t.transactions, as_of=AS_OF))
    _reg("interest_rate_risk", "credit")(lambda t: cr.interest_rate_risk(t.loans, t.accounts))
    _reg("loan_default_features", "credit")(
        lambda t: cr.loan_default_features(t.loans, t.loan_payments, t.accounts, t.customers, as_of=AS_OF))
    _reg("loan_risk", "credit")(lambda t: cr.loan_risk(t.loans, t.loan_payments, t.customers, t.accounts))
    _reg("market_risk", "credit")(lambda t: cr.market_risk(t.loans, t.accounts, t.transactions))
    _reg("deposit_sensitivity", "credit")(lambda t: cr.deposit_sensitivity(t.accounts))
    _reg("non_performing_assets", "credit")(
        lambda t: cr.non_performing_assets(t.loans, t.loan_payments, t.accounts, as_of=AS_OF))
    _reg("recovery_rate", "credit")(lambda t: cr.recovery_rate(t.loans, t.loan_payments, t.accounts))
    _reg("risk_adjusted_returns", "credit")(
        lambda t: cr.risk_adjusted_returns(t.loans, t.accounts, t.credit_cards, t.loan_payments))
    _reg("stress_testing", "credit")(
        lambda t: cr.stress_testing(t.loans, t.accounts, t.transactions, t.credit_cards))
    _reg("compliance_risk", "compliance")(
        lambda t: co.compliance_risk(t.transactions, t.accounts, t.customers, t.credit_cards))
    _reg("compliance_aml", "compliance")(lambda t: co.compliance_aml(t.transactions, t.accounts, t.customers))
    _reg("compliance_aml_dates", "compliance")(
        lambda t: co.compliance_aml_dates(t.transactions, t.accounts, t.customers))
    _reg("compliance_aml_date_pages", "compliance")(
        lambda t: co.compliance_aml_date_pages(t.transactions, t.accounts, t.customers))
    _reg("regulatory_alert_pages", "compliance")(
        lambda t: co.regulatory_alert_pages(t.transactions, t.accounts, t.customers))
    _reg("compliance_kyc", "compliance")(lambda t: co.compliance_kyc(t.customers))
    _reg("compliance_credit", "compliance")(lambda t: co.compliance_credit(t.credit_cards, t.customers))
    _reg("concentration_risk", "compliance")(lambda t: co.concentration_risk(t.accounts, t.loans, t.customers))
    _reg("counterparty_risk", "compliance")(
        lambda t: co.counterparty_risk(t.customers, t.accounts, t.loans, t.account_beneficiaries))
    _reg("regulatory_compliance", "compliance")(
        lambda t: co.regulatory_compliance(t.transactions, t.accounts, t.customers))
    _reg("regulatory_compliance_dense", "compliance")(
        lambda t: co.regulatory_compliance(t.transactions_dense, t.accounts, t.customers))
    _reg("compliance_aml_dense", "compliance")(
        lambda t: co.compliance_aml(t.transactions_dense, t.accounts, t.customers))
    _reg("regulatory_alerts", "compliance")(
        lambda t: co.regulatory_alerts(t.transactions, t.accounts, t.customers))
    _reg("reporting_framework", "reporting")(
        lambda t: rp.reporting_framework(t.customers, t.accounts, t.transactions, t.loans, t.credit_cards,
                                         t.branches, t.employees))
    _reg("executive_summary", "reporting")(
        lambda t: rp.executive_summary(t.customers, t.accounts, t.transactions, t.loans))
    _reg("product_dashboard", "reporting")(lambda t: rp.product_dashboard(t.accounts, t.loans, t.credit_cards))
    _reg("regional_performance", "reporting")(
        lambda t: rp.regional_performance(t.branches, t.accounts, t.employees))
    _reg("risk_overview", "reporting")(lambda t: rp.risk_overview(t.loans))
    _reg("liquidity", "reporting")(
        lambda t: rp.liquidity(t.accounts, t.loans, t.transactions, as_of=AS_OF_LIQUIDITY))
    return REGISTRY


def registry() -> dict[str, Spec]:
    return _load()


__all__ = ["registry", "Spec", "AS_OF", "AS_OF_DENSE", "AS_OF_LIQUIDITY"]
