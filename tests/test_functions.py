"""Property tests: the column building blocks agree with plain Python on
random values, NULLs and values exactly on a threshold."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import above, age_group, below, flag_score, ladder, ratio, weighted

CUTS = [(100, "A"), (50, "B"), (10, "C")]
values = st.one_of(st.none(), st.sampled_from([100, 50, 10, 0, -1]), st.integers(-200, 300))


def _py_above(v):
    if v is None:
        return "D"
    for t, lab in CUTS:
        if v > t:
            return lab
    return "D"


@settings(max_examples=5, deadline=None)
@given(st.lists(values, min_size=1, max_size=40))
def test_above_is_first_strict_match(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v int")
    got = [r["b"] for r in df.select("i", above("v", CUTS, "D").alias("b")).orderBy("i").collect()]
    assert got == [_py_above(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(values, values), min_size=1, max_size=40))
def test_ratio_is_null_safe(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    got = [r["r"] for r in df.select("i", ratio("a", "b").alias("r")).orderBy("i").collect()]
    want = [None if a is None or b is None or b == 0 else a / b for a, b in pairs]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(values, values), min_size=1, max_size=40))
def test_flag_and_weighted_scores(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    out = df.select("i", flag_score((F.col("a") > 50, 0.3), (F.col("b") > 50, 0.4)).alias("f"),
                    weighted(("a", 0.4), ("b", 0.6)).alias("w")).orderBy("i").collect()
    for (a, b), r in zip(pairs, out):
        assert r["f"] == (0.3 if a is not None and a > 50 else 0) + (0.4 if b is not None and b > 50 else 0)
        assert r["w"] == (None if a is None or b is None else a * 0.4 + b * 0.6)


def test_age_bands_and_ladder_edges(spark):
    ages = [None, 17, 24, 25, 34, 35, 64, 65, 90]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a int")
    got = [r["g"] for r in df.select("i", age_group("a").alias("g")).orderBy("i").collect()]
    assert got == ["65+", "18-24", "18-24", "25-34", "25-34", "35-44", "55-64", "65+", "65+"]
    lad = df.select(ladder((F.col("a").isNull(), "none"), (F.col("a") > 30, "old"), default="young").alias("x"),
                    below("a", [(18, "minor")], "adult").alias("y")).collect()
    assert [r["x"] for r in lad][:3] == ["none", "young", "young"] and lad[1]["y"] == "minor"


def test_decimal_ratio_on_exact_tie(spark):
    df = spark.createDataFrame([(Decimal("1882.94"), Decimal("8000.00"))], "a decimal(10,2), b decimal(10,2)")
    assert df.select(ratio("a", "b")).first()[0] == 1882.94 / 8000.0
