"""Sliced per-key sequences agree with plain windows, on data where one key
holds a third of the rows, order values tie, and keys or values are NULL."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans import sequence
from ledgerlens.plans.sequence import neighbors, running_stats, scan, sliced


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        k = 1 if i % 3 == 0 else (None if i % 97 == 0 else rnd.randint(2, 60))
        t = rnd.randint(0, 400)                      # many ties inside a key
        v = None if rnd.random() < 0.03 else Decimal(str(round(rnd.uniform(-50, 500), 2)))
        rows.append((i, k, t, v, f"c{rnd.randint(0, 3)}"))
    return spark.createDataFrame(rows, "id int, k int, t int, v decimal(10,2), city string")


@pytest.fixture(params=[1 << 20, 1000, 60, 4])
def slices(request):
    """Rows a slice."""
    return request.param


def _by_id(df, cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.select("id", *cols).collect()}


@pytest.mark.parametrize("step", [1, -1])
def test_neighbors_match_window(spark, events, slices, step):
    order = [F.col("t").asc_nulls_first(), F.col("id")]
    fn = F.lag if step == 1 else F.lead
    w = Window.partitionBy("k").orderBy(*order)
    want = events.select("*", fn("v").over(w).alias("p_v"), fn("city").over(w).alias("p_city"))
    got = neighbors(events, ["k"], "t", ["id"], ["v", "city"], step=step, prefix="p_", rows=slices)
    assert got.count() == events.count()
    assert _by_id(got, ["p_v", "p_city"]) == _by_id(want, ["p_v", "p_city"])


def test_running_stats_match_window(spark, events, slices):
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first())
    want = _by_id(events.withColumn("a", F.avg("v").over(w)).withColumn("s", F.stddev("v").over(w)), ["a", "s"])
    got = _by_id(running_stats(events, ["k"], "t", "v", "a", "s", rows=slices), ["a", "s"])
    assert set(got) == set(want)
    for i, (a, s) in want.items():
        ga, gs = got[i]
        assert (a is None) == (ga is None) and (a is None or float(ga) == pytest.approx(float(a), abs=1e-6))
        assert (s is None) == (gs is None) and (s is None or gs == pytest.approx(s, rel=1e-9, abs=1e-9))


def _slices(df, keys, order, rows):
    return {tuple(r[k] for k in keys): (r["n"], r["most"]) for r in sliced(df, keys, order, rows=rows).groupBy(*keys, "__slice").count()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()}


def test_one_timestamp_is_cut_apart(spark):
    """Half of a key's rows share one timestamp: several slices, same results."""
    rows = [(i, 1, 5 if i % 2 else i % 11, None if i % 17 == 0 else Decimal(i % 23)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k int, t int, v decimal(10,2)").repartition(3)
    at_once = sliced(df, ["k"], ["t", "id"], rows=100).where("t = 5").select("__slice").distinct().count()
    assert at_once > 5
    w = Window.partitionBy("k").orderBy("t")
    want = _by_id(df.select("*", F.avg("v").over(w).alias("a"), F.stddev("v").over(w).alias("s"),
                            F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")).alias("p")), ["a", "s", "p"])
    got = _by_id(scan(df, ["k"], ["t", "id"], lag={"p": "v"}, running={("a", "s"): "v"}, rows=100), ["a", "s", "p"])
    for i, (a, s, p) in want.items():
        assert got[i][2] == p and got[i][0] == (None if a is None else pytest.approx(a, abs=Decimal("1e-5")))
        assert got[i][1] == (None if s is None else pytest.approx(s, rel=1e-9, abs=1e-9))


def test_slices_follow_the_rows_of_a_key(spark):
    """A key with a third of the rows gets more slices as the table grows; small keys have one."""
    def table(n):
        return spark.range(n).selectExpr("id", "if(id % 3 = 0, -1, id % 1000) as k", "id * 7919 % 100003 as t")
    many = []
    for n in (3_000, 30_000, 300_000):
        found = _slices(table(n), ["k"], ["t", "id"], 1_000)
        many.append(found[(-1,)][0])
        assert found[(-1,)][1] < 5_000 and found[(1,)][0] == 1
    assert many[0] < 5 < many[1] < 30 < many[2] and many[2] > 60


def test_cuts_of_a_table_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sequence, "MOST", 20)
    cuts = sequence.cut_points(spark.range(100_000), [], ["id"], rows=10)
    assert 10 < cuts.select(F.size("__cuts")).first()[0] < 40


def test_all_measures_of_a_scan(spark, events, slices):
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = events.select("id", F.lag("city").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                         F.coalesce(F.sum("v").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("v").over(Window.partitionBy("k")), F.lit(0)).alias("w"))
    got = scan(events, ["k"], ["t", "id"], lag={"p": "city"}, lead={"n": "v"}, before={"b": "v"}, whole={"w": "v"}, rows=slices)
    assert got.columns == [*events.columns, "p", "n", "b", "w"]
    assert _by_id(got, ["p", "n", "b", "w"]) == _by_id(want, ["p", "n", "b", "w"])
    assert scan(events.limit(0), ["k"], ["t", "id"], lag={"p": "city"}, before={"b": "v"}, rows=slices).count() == 0


def test_long_histories_go_on_in_doubles(spark):
    rows = [(i, Decimal("9" * 18) + i) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, v decimal(20,0)").withColumn("k", F.lit(1))
    got = running_stats(df, ["k"], "id", "v", "a", "s", rows=8).orderBy("id").collect()
    assert got[-1]["a"] == Decimal("9" * 18) + Decimal("24.5") and all(r["s"] is None or r["s"] >= 0 for r in got)


def test_card_fraud_plans_one_window_exchange(spark):
    from paths import SF_SMALL

    from ledgerlens.registry import registry
    from ledgerlens.sources.tables import BankTables
    df = registry()["card_fraud"].build(BankTables.from_testdata(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__slice") == 1 and "percentile" not in plan
