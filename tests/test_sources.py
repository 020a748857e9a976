"""The parquet layout in the fixed schemas round-trips: analyses read from it
give the same results as from the mapped test tables."""

from paths import SF_SMALL
from ledgerlens.checks.compare import compare_form
from ledgerlens.registry import registry
from ledgerlens.sources.model import SCHEMAS
from ledgerlens.sources.tables import BankTables


def test_parquet_layout_round_trip(spark, tmp_path):
    mapped = BankTables.from_testdata(spark, SF_SMALL)
    mapped.write_parquet(str(tmp_path))
    stored = BankTables.from_parquet(spark, str(tmp_path))
    for name, schema in SCHEMAS.items():
        assert [f.name for f in stored[name].schema.fields] == schema.names
        assert stored[name].count() == mapped[name].count(), name
    for q in ["customer_360", "transaction_velocity", "service_levels", "early_warning", "card_fraud",
              "stress_testing", "compliance_aml"]:
        a = compare_form(registry()[q].build(mapped))
        b = compare_form(registry()[q].build(stored))
        assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, q


def test_bucketed_layout_joins_facts_without_an_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE dealt LOCATION '{tmp_path}'")
    plain = BankTables.from_testdata(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain.write_bucketed("dealt", 4, ["transactions", "accounts", "loans", "loan_payments", "customers"])
        dealt = BankTables.from_catalog(spark, "dealt")
        for name, above in (("transaction_anomalies", 0), ("loan_risk", 2)):  # loan_risk then meets accounts on another key
            build = registry()[name].build
            plan = build(dealt)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == above < build(plain)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
            want = build(plain)
            assert sorted(map(str, compare_form(build(dealt).select(want.columns)).collect())) == sorted(map(str, compare_form(want).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE dealt CASCADE")
