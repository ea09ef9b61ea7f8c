import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import simulate
from tripleflow.functions.ordered import arrival_number, running
from tripleflow.operators.correlate import (
    bounded_join,
    pair_up,
    pair_up_obj_subj,
    threshold_reached,
)


def sides(spark, arrivals):
    def side(name):
        rows = [(k, s, f"{name}{s}") for n, k, s in arrivals if n == name]
        return spark.createDataFrame(rows, f"k string, seq bigint, {name}v string")

    return side("l"), side("r")


def random_arrivals(seed, n, keys):
    rng = random.Random(seed)
    seq = 0
    arrivals = []
    for _ in range(n):
        seq += rng.randrange(1, 4)
        # one key holds a third of the rows, and sides come in bursts
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}"
        side = "l" if (rng.random() < 0.5 if seq % 50 < 25 else rng.random() < 0.1) else "r"
        arrivals.append((side, key, seq))
    return arrivals


def pairs(df):
    return Counter((r["k"], r["left_seq"], r["right_seq"]) for r in df.collect())


def test_hand_worked_bounded_join(spark):
    left, right = sides(spark, [("l", "k", 1), ("l", "k", 2), ("l", "k", 3), ("r", "k", 4)])
    first = bounded_join(left, right, ["k"], capacity=2, retain="first")
    assert pairs(first) == Counter([("k", 1, 4), ("k", 3, 4)])
    assert {(r["lv"], r["rv"]) for r in first.collect()} == {("l1", "r4"), ("l3", "r4")}
    latest = bounded_join(left, right, ["k"], capacity=2, retain="latest")
    assert pairs(latest) == Counter([("k", 2, 4), ("k", 3, 4)])


@pytest.mark.parametrize(
    ("retain", "capacity", "split_rows"),
    [
        ("first", 1, 10), ("first", 3, 10), ("first", 1000, 10**6),
        ("latest", 1, 10**6), ("latest", 3, 10), ("latest", 1000, 10),
    ],
)
def test_bounded_join_equals_simulation(spark, retain, capacity, split_rows):
    arrivals = random_arrivals(capacity, 160, 4)
    left, right = sides(spark, arrivals)
    per_key = bounded_join(left, right, ["k"], "seq", capacity, retain, "key", split_rows)
    assert pairs(per_key) == simulate.bounded_join_per_key(arrivals, capacity, retain)
    per_stream = bounded_join(left, right, ["k"], "seq", capacity, retain, "stream", split_rows)
    assert pairs(per_stream) == simulate.bounded_join(arrivals, capacity, retain)


def test_bounded_join_refuses_nonsense(spark):
    left, right = sides(spark, [("l", "k", 1), ("r", "k", 2)])
    for wrong in ({"capacity": 0}, {"retain": "some"}, {"per": "row"}):
        with pytest.raises(ValueError):
            bounded_join(left, right, ["k"], **wrong)


def test_hand_worked_pair_up(spark):
    df = spark.createDataFrame(list(zip("abaaba", range(1, 7))), "k string, seq bigint")
    assert sorted(map(tuple, pair_up(df, "k").collect())) == [("a", 3), ("a", 6), ("b", 5)]


@pytest.mark.parametrize("split_rows", [5, 40, 10**6])
def test_pair_up_equals_simulation(spark, split_rows):
    arrivals = [(k, s) for _, k, s in random_arrivals(7, 300, 9)]
    df = spark.createDataFrame(arrivals, "k string, seq bigint")
    got = pair_up(df, "k", split_rows=split_rows).collect()
    assert Counter(map(tuple, got)) == Counter(simulate.pair_up(arrivals))


def test_pair_up_takes_subject_without_object(spark, rows):
    df = spark.createDataFrame(
        [("A", None, 1), ("x", "A", 2), ("B", None, 3), ("A", None, 4)], "subj string, obj string, seq bigint"
    )
    assert rows(pair_up_obj_subj(df)) == [("A", 2)]


def test_hand_worked_threshold(spark, rows):
    def reached(n, *values):
        df = spark.createDataFrame([("a", v, i + 1) for i, v in enumerate(values)], "k string, v int, seq bigint")
        return rows(threshold_reached(df, "k", "v", n=n)), rows(threshold_reached(df, "k", "v", n=n, once=True))

    assert reached(2, 1, 1, 2, 2, 3, 3) == ([("a", 3), ("a", 4)], [("a", 3)])
    assert reached(1, 1, 1, 2) == ([("a", 2)], [("a", 2)])
    assert reached(1, 1, 2) == ([], [])
    assert reached(9, 1, 2) == ([], [])


@pytest.mark.parametrize("n", [1, 2, 5, 10])
def test_threshold_equals_simulation(spark, n):
    rng = random.Random(n)
    arrivals = [(k, rng.randrange(12), s) for _, k, s in random_arrivals(n, 400, 5)]
    df = spark.createDataFrame(arrivals, "k string, v int, seq bigint")
    got = Counter(map(tuple, threshold_reached(df, "k", "v", n=n).collect()))
    assert got == Counter(simulate.threshold(arrivals, n))


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "g"]])
@pytest.mark.parametrize("split_rows", [3, 25, 10**6])
def test_running_totals_in_stretches(spark, keys, split_rows):
    rng = random.Random(split_rows)
    data = [
        ("hot" if rng.random() < 0.34 else rng.choice([None, "b", "c"]), rng.randrange(2), i * i, rng.randrange(100))
        for i in range(200)
    ]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, g int, at bigint, v bigint")
    got = running(df, keys, "at", {"s": F.col("v"), "n": F.lit(1)}, {"m": F.col("v")}, split_rows)
    sums, counts, highest, expected = Counter(), Counter(), {}, set()
    for k, g, at, v in sorted(data, key=lambda r: r[2]):
        key = tuple({"k": k, "g": g}[c] for c in keys)
        sums[key] += v
        counts[key] += 1
        highest[key] = max(v, highest.get(key, v))
        expected.add((at, sums[key], counts[key], highest[key]))
    assert {(r["at"], r["s"], r["n"], r["m"]) for r in got.collect()} == expected
    assert got.columns == ["k", "g", "at", "v", "s", "n", "m"]


def test_clumped_order_is_still_exact(spark):
    """Nearly all arrivals lie in one corner of the range, far from an outlier."""
    data = [("k", 10**12)] + [("k", i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, at bigint")
    got = {r["at"]: r["n"] for r in arrival_number(df, ["k"], "at", "n", 20).collect()}
    assert got == {at: i + 1 for i, (_, at) in enumerate(sorted(data))}


def test_bursty_key_is_cut_inside_its_burst(spark):
    """A large key that arrives in a short time still falls into several stretches."""
    data = [("k", i) for i in range(400)] + [(f"x{i}", 1000 * i) for i in range(1, 4000)]
    df = spark.createDataFrame(data, "k string, at bigint")
    numbered = arrival_number(df, ["k"], "at", "n", 100)
    got = {(r["k"], r["at"]): r["n"] for r in numbered.collect()}
    assert got == {("k", i): i + 1 for i in range(400)} | {(f"x{i}", 1000 * i): 1 for i in range(1, 4000)}
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in plan


def test_missing_positions_come_first(spark):
    df = spark.createDataFrame([("k", None)] + [("k", i) for i in range(50)], "k string, at bigint")
    got = {r["at"]: r["n"] for r in arrival_number(df, ["k"], "at", "n", 10).collect()}
    assert got == {None: 1} | {i: i + 2 for i in range(50)}


def test_no_window_over_a_whole_large_key(spark):
    df = spark.range(2000).selectExpr("'k' AS k", "id AS at")
    plan = arrival_number(df, ["k"], "at", "n", 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_stretch" in w for w in windows)
