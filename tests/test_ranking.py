"""The distributed rank and percentile operators agree with Spark's own window
functions and sorted lists, on data with a hot key (a third of all rows), ties
and NULLs, for several sizes of slices."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        v = None if rnd.random() < 0.05 else rnd.randint(0, 60) / 4
        rows.append((i, k, v))
    return spark.createDataFrame(rows, "id int, k string, v double")


@pytest.fixture(params=[1 << 20, 700, 60, 4])
def slices(request):
    """Rows a slice."""
    return request.param


def _by_id(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("descending", [False, True])
def test_percent_rank_matches_window(spark, skewed, slices, keys, descending):
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    want = skewed.withColumn("pr", F.percent_rank().over(Window.partitionBy(*keys).orderBy(order)))
    got = ranking.percent_rank(skewed, "v", "pr", partition_by=keys, descending=descending, rows=slices)
    assert got.count() == skewed.count()
    assert _by_id(got, "pr") == pytest.approx(_by_id(want, "pr"))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_are_nearest_rank(spark, skewed, keys):
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    agg = skewed.groupBy(*keys).agg(F.count("v").alias("n"))
    got = {tuple(r[k] for k in keys): r for r in ranking.with_percentiles(agg, skewed, "v", probs, keys).collect()}
    groups = {}
    for r in skewed.collect():
        if r["v"] is not None:
            groups.setdefault(tuple(r[k] for k in keys), []).append(r["v"])
    assert set(got) == set(groups)
    for g, vals in groups.items():
        vals.sort()
        for name, p in probs.items():
            assert got[g][name] == vals[math.ceil(p * len(vals)) - 1]


def test_with_percentiles_keeps_groups_without_values(spark):
    agg = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    out = {r["k"]: r["med"] for r in ranking.with_percentiles(agg, df, "v", {"med": 0.5}, ["k"]).collect()}
    assert out == {"a": 1.0, "b": None}


def test_ntile_matches_window(spark, slices):
    rows = [(i, None if i % 11 == 0 else (i * 7919) % 50) for i in range(203)]
    df = spark.createDataFrame(rows, "id int, score int")
    want = df.withColumn("q", F.ntile(4).over(Window.orderBy(F.col("score").asc_nulls_first(), "id")))
    got = ranking.ntile(df, ["score", "id"], 4, "q", rows=slices)
    assert _by_id(got, "q") == _by_id(want, "q")
    few = df.limit(3)
    assert sorted(r["q"] for r in ranking.ntile(few, ["score", "id"], 4, "q").collect()) == [1, 2, 3]
