import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tripleflow.functions.stats import f_upper_tail
from tripleflow.functions.text import number_or_null
from tripleflow.operators.aggregate import (
    anova_oneway,
    first_and_last,
    means_by,
    numeric_mean,
    rollup_partials,
    sort_by_leading_number,
)


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos bigint, line string")


def test_rollup(spark, rows):
    df = lines(
        spark,
        "CounterTerminal0: partialCount=12",
        "x CounterTerminal1: partialCount=5 y",
        "CounterTerminal0: partialCount=3",
        "nothing",
    )
    assert rows(rollup_partials(df)) == [(0, 15), (1, 5)]
    with pytest.raises(PySparkException, match="no counter id"):
        rollup_partials(df, strict=True).collect()


def test_mean_skips_what_is_no_number(spark):
    assert numeric_mean(lines(spark, "1.5", "x", "2", "", "1e1")).first()["mean"] == 4.5
    assert numeric_mean(lines(spark, "1", "2", "2")).first()["mean"] == 1.667
    assert math.isnan(numeric_mean(lines(spark, "x")).first()["mean"])


def test_means_by_file(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x")], "file string, line string")
    got = {r["file"]: (r["mean"], r["report"]) for r in means_by(df).collect()}
    assert got["a"] == (1.5, "1.500 a")
    assert math.isnan(got["b"][0]) and got["b"][1] == "NaN b"


def test_anova_by_hand(spark):
    groups = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    row = anova_oneway(spark.createDataFrame(data, "g string, v double"), "g", "v").first()
    assert (row["df_between"], row["df_within"]) == (2, 15)
    assert row["f"] == pytest.approx(84 / 2 / (68 / 15))
    assert row["p"] == pytest.approx((1 + 2 * row["f"] / 15) ** -7.5, rel=1e-10)


def test_anova_without_spread(spark):
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert math.isnan(anova_oneway(same, "g", "v").first()["p"])


def test_f_tail_against_closed_forms():
    for f in (0.01, 0.5, 1.0, 3.7, 40.0):
        for d in (1, 4, 9, 250):
            # two numerator degrees, and by symmetry two denominator degrees
            assert f_upper_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-9)
            assert f_upper_tail(f, d, 2) == pytest.approx(1 - (1 + 2 / (d * f)) ** (-d / 2), rel=1e-9)
        # one and one: the square of a Cauchy variable
        assert f_upper_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), rel=1e-9)
    assert f_upper_tail(4.35124, 1, 20) == pytest.approx(0.05, abs=1e-5)


def test_sort_is_numeric_and_stable(spark):
    texts = ["10 b", "9.5 a", "-1 c", "10 a", "1e3 z", "9.5 b"]
    df = lines(spark, *texts).repartition(3)
    in_order = ["-1 c", "9.5 a", "9.5 b", "10 b", "10 a", "1e3 z"]
    assert [r["line"] for r in sort_by_leading_number(df, "pos").collect()] == in_order
    for split_rows in (1, 10**6):
        ranked = sort_by_leading_number(df, "pos", rank="place", split_rows=split_rows)
        assert [r["line"] for r in ranked.orderBy("place").collect()] == in_order
        assert sorted(r["place"] for r in ranked.collect()) == [1, 2, 3, 4, 5, 6]


def test_first_and_last(spark, rows):
    df = spark.createDataFrame(
        [("f", 1, "x"), ("f", 2, "m1"), ("f", 3, "m2"), ("g", 1, "x")], "file string, pos int, line string"
    )
    marked = F.col("line").startswith("m")
    assert rows(first_and_last(df, "file", "pos", marked, marked)) == [("f", "m1", "m2"), ("g", None, None)]


@pytest.mark.parametrize("df", [10.0**k for k in range(3, 14)])
@pytest.mark.parametrize("f", [0.01, 0.5, 3.0, 20.0])
def test_p_of_three_groups_keeps_its_digits(df, f):
    """With two degrees of freedom between groups the tail has a closed form."""
    exact = math.exp(-df / 2 * math.log1p(2 * f / df))
    assert f_upper_tail(f, 2, df) == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_numbers_are_plain_decimals(spark):
    texts = ["12", "12d", "3f", "0x1p3", " 7.5 ", "1_000", "_1", "1e3", ".5", "5.", "nan", "-inf", "", None, "1.2.3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.x for r in rows.select("i", number_or_null(F.col("t")).alias("x")).collect()}
    assert math.isnan(found.pop(10))
    assert [found[i] for i in sorted(found)] == [
        12.0, None, None, None, 7.5, 1000.0, None, 1000.0, 0.5, 5.0, -math.inf, None, None, None
    ]
