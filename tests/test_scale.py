"""Results that must not gather a group: pages of alert arrays, open maps, grains that share a scan."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import compliance, customers, reporting
from ledgerlens.plans.distinct import distinct_ids
from ledgerlens.registry import registry
from ledgerlens.sources.tables import BankTables
from paths import SF_SMALL


def test_alert_pages_are_the_alerts(spark):
    t = BankTables.from_testdata(spark, SF_SMALL)
    args = (t.transactions, t.accounts, t.customers)
    keys = ["customer_id", "compliance_alert_level"]
    want = {}
    for r in compliance.regulatory_alerts(*args).select(*keys, "transaction_id").collect():
        want.setdefault((r[0], r[1]), []).append(r[2])
    pages = compliance.regulatory_alert_pages(*args, page_size=3).orderBy("page").collect()
    got = {}
    for r in pages:
        got.setdefault((r[0], r[1]), []).append(r["alert_transactions"])
    assert {k: [i for p in v for i in p] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(p) == 3 for v in got.values() for p in v[:-1]) and max(map(len, got.values())) > 3
    dates = compliance.compliance_aml_date_pages(*args, page_size=2)
    assert dates.select(F.max(F.size("suspicious_dates"))).first()[0] == 2
    assert dates.select(F.explode("suspicious_dates")).count() == compliance.compliance_aml_dates(*args).where("transaction_date is not null").count()


def test_unknown_types_are_in_the_maps(spark):
    t = BankTables.from_testdata(spark, SF_SMALL)
    one = t.accounts.where("status = 'ACTIVE'").limit(1).withColumn("account_type", F.lit("ESCROW")).withColumn("balance", F.lit(Decimal("7.50")).cast(t.accounts.schema["balance"].dataType))
    owner = one.first()["customer_id"]
    got = {r["customer_id"]: r["balances_by_type"] for r in customers.customer_portfolio(
        t.customers, t.accounts.unionByName(one), t.loans, t.credit_cards).select("customer_id", "balances_by_type").collect()}
    assert got[owner]["ESCROW"] == Decimal("7.50") and all(m is not None for m in got.values())
    kin = t.account_beneficiaries.limit(1).withColumn("relationship", F.lit("GODPARENT"))
    net = customers.relationship_network(t.customers, t.account_beneficiaries.unionByName(kin), t.accounts)
    assert [r[0] for r in net.select(F.col("beneficiaries_by_relationship")["GODPARENT"].alias("n")).where("n is not null").collect()] == [1]


def test_reports_scan_accounts_once(spark, tmp_path):
    BankTables.from_testdata(spark, SF_SMALL).write_parquet(str(tmp_path))
    t = BankTables.from_parquet(spark, str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = reporting.reporting_framework(t.customers, t.accounts, t.transactions, t.loans, t.credit_cards, t.branches, t.employees)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count(f"{tmp_path}/accounts]") == 1


def test_bitmaps_count_like_a_distinct_count(spark):
    rows = [(i % 3 if i % 7 else None, v, i) for i, v in enumerate([0, 1, 32767, 32768, 32769, 2**31 + 5, 2**40, 2**40 + 1, -1, -32768, -2**35, None] * 20)]
    df = spark.createDataFrame(rows, "g int, id long, x int").repartition(4)
    want = df.groupBy("g").agg(F.countDistinct("id").alias("n"), F.sum("x").alias("s"), F.count("id").alias("c"))
    got = distinct_ids(df, ["g"], "id", "n", s=F.sum("x"), c=F.count("id"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert distinct_ids(df.limit(0), [], "id", "n").collect()[0]["n"] == 0


def test_distinct_customers_move_as_bitmaps(spark):
    plan = registry()["concentration_risk"].build(BankTables.from_testdata(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "distinct" not in plan.lower()
