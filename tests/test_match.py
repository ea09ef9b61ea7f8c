import pytest
from pyspark.sql import functions as F

from tripleflow.operators.counts import (
    count_each,
    count_matches,
    count_packed,
    count_patterns,
    publish,
    render,
)
from tripleflow.operators.match import (
    match,
    match_each,
    match_packed,
    match_shared,
    match_streams,
)
from tripleflow.patterns import DEFAULT_QUERY, pattern, patterns
from tripleflow.sources.triples import triple_universe

N = 10


@pytest.fixture(scope="module")
def universe(spark):
    return triple_universe(spark, N).cache()


QUERY = patterns([*DEFAULT_QUERY, "A_foo_1", "?a_foo_?a", "?x_foo_?y", "?s_?p_?o", "Z_foo_?x"])
SIZES = [3 * N, N, 2 * N, 2 * N, 6, 6, 6, 1, 0, 3 * N, 6 * N, 0]


def test_sizes_of_single_patterns(universe):
    assert [match(universe, p).count() for p in QUERY] == SIZES


def test_all_ways_to_match_many_agree(universe, rows):
    expected = [(i, n) for i, n in enumerate(SIZES)]
    found = [(i, n) for i, n in expected if n]
    each = match_each(universe, QUERY)
    assert sorted(rows(count_patterns(universe, QUERY))) == expected
    assert sorted(rows(count_matches(each, "pattern_id", range(len(QUERY))))) == expected
    assert sorted(rows(count_each(each))) == found
    assert sorted(rows(count_each(match_shared(universe, QUERY)))) == found
    frames = match_streams(universe, QUERY)
    assert [frames[i].count() for i in range(len(QUERY))] == SIZES


def test_shared_gives_each_pattern_its_own_names(universe):
    def bag(df):
        return sorted((r[0], sorted(r[1].items())) for r in df.collect())

    assert bag(match_shared(universe, QUERY)) == bag(match_each(universe, QUERY))


def test_shared_without_broadcast_is_the_same(universe, rows):
    free = match_shared(universe, QUERY, broadcast_patterns=0)
    assert sorted(rows(count_each(free))) == [(i, n) for i, n in enumerate(SIZES) if n]


def test_shared_with_many_patterns(universe, rows):
    many = [(s, p, str(o)) for s in "ABC" for p in ("foo", "bar") for o in range(300)]
    counted = dict(rows(count_each(match_shared(universe, many))))
    assert counted == {i: 1 for i, m in enumerate(many) if int(m[2]) < N}


def test_variable_free_pattern_counts_each_but_not_packed(universe, rows):
    pats = patterns(["A_foo_1", "A_foo_?x"])
    assert rows(count_each(match_each(universe, pats), 0)) == [(1,)]
    packed = match_packed(universe, pats)
    assert packed.count() == N
    assert rows(count_packed(packed, 0)) == [(0,)]
    assert rows(count_packed(packed)) == [(1, N)]


def test_packed_keeps_names_of_patterns_apart(spark):
    triples = spark.createDataFrame([("A", "foo", "1"), ("B", "bar", "2")], "subj string, pred string, obj string")
    packed = match_packed(triples, patterns(["?a_foo_?b", "?b_foo_?a"])).collect()
    assert [r[0] for r in packed] == [{0: {"?a": "A", "?b": "1"}, 1: {"?b": "A", "?a": "1"}}]


def test_repeated_variable(spark, rows):
    triples = spark.createDataFrame(
        [("A", "foo", "A"), ("A", "foo", "B"), ("x", "x", "x"), ("x", "x", "y")],
        "subj string, pred string, obj string",
    )
    assert rows(match(triples, pattern("?a_foo_?a"))) == [("A",)]
    assert rows(match(triples, pattern("?a_?a_?a"))) == [("x",)]
    assert rows(match(triples, pattern("?a_?a_?b"))) == [("x", "x"), ("x", "y")]
    shared = match_shared(triples, patterns(["?a_?a_?a", "?b_?a_?b", "?a_foo_?a"]))
    assert sorted(rows(count_each(shared))) == [(0, 1), (1, 2), (2, 1)]


def test_duplicates_stay(spark):
    triples = spark.createDataFrame([("A", "foo", "1")] * 3, "subj string, pred string, obj string")
    assert match(triples, pattern("?a_foo_?b")).count() == 3
    assert match(triples, pattern("A_foo_1")).count() == 3


def test_key_text_is_in_name_order(universe, rows):
    frames = match_streams(universe, patterns(["?b_foo_?a"]), [["a", "b", "zz"]], key_text=True)
    assert ("A", "3", "3A") in rows(frames[0], "b", "a", "valuesAsString")


def test_constant_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    triple_universe(spark, 100).write.parquet(path)
    plan = match(spark.read.parquet(path), pattern("A_foo_?o"))._jdf.queryExecution().toString()
    assert "EqualTo(subj,A)" in plan and "EqualTo(pred,foo)" in plan


def test_one_scan_for_all_patterns(spark, tmp_path):
    path = str(tmp_path / "t")
    triple_universe(spark, 10).write.parquet(path)
    for many in (match_each, match_packed, match_shared):
        plan = many(spark.read.parquet(path), QUERY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1, many.__name__


def test_render_and_publish(spark, universe, rows, tmp_path):
    bindings = match(universe.where(F.col("obj") == "1"), pattern("?b_foo_?a"))
    assert rows(render(bindings))[0] == ("{?a=1, ?b=A}",)
    publish(bindings, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == rows(render(bindings))
