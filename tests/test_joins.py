import random
import re
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter

from tripleflow.functions.text import merge_bindings
from tripleflow.operators.joins import (
    collapse_copies,
    cross,
    expand_copies,
    multi_join,
    natural_join,
    split_join,
)
from tripleflow.operators.match import share_scan
from tripleflow.patterns import DEFAULT_QUERY, patterns
from tripleflow.plans.bgp import bgp, bgp_grouped, count_bgp
from tripleflow.plans.domain import domain_cardinality, sketched_domains, variable_domains
from tripleflow.sources.triples import triple_universe


@pytest.fixture(scope="module")
def universe(spark):
    return triple_universe(spark, 10).cache()


def bag(df):
    names = sorted(df.columns)
    return Counter(map(tuple, df.select(*names).collect()))


def test_natural_join_keeps_copies(spark):
    left = spark.createDataFrame([("k", 1)] * 2 + [("m", 2)], "k string, a int")
    right = spark.createDataFrame([("k", 5)] * 3, "k string, b int")
    assert bag(natural_join(left, right)) == Counter({(1, 5, "k"): 6})


def test_natural_join_on_every_shared_variable(spark):
    left = spark.createDataFrame([("1", "11"), ("11", "1")], "a string, b string")
    right = spark.createDataFrame([("1", "11", "x")], "a string, b string, c string")
    assert bag(natural_join(left, right)) == Counter({("1", "11", "x"): 1})


def test_cross_and_multi_join(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "a string"), spark.createDataFrame([("x",)] * 2, "b string")
    assert cross(a, b).count() == 4
    assert multi_join([a, b, a]).count() == 4
    with pytest.raises(ValueError):
        multi_join([])


@pytest.mark.parametrize("hot_rows", [1, 7, 50, 10_000])
def test_split_join_equals_plain_join(spark, hot_rows):
    rng = random.Random(hot_rows)
    def side(n, name):
        # a third of all rows under one key, many of them copies of each other
        rows = [(("hot" if rng.random() < 0.34 else f"k{rng.randrange(30)}"), str(rng.randrange(9))) for _ in range(n)]
        return spark.createDataFrame(rows + [(None, "0")], f"k string, {name} string")
    left, right = side(300, "a"), side(200, "b")
    assert bag(split_join(left, right, ["k"], hot_rows)) == bag(left.join(right, "k"))


@pytest.mark.parametrize("salt", [(1, 1), (4, 1), (3, 5)])
def test_salted_join_equals_plain_join(spark, universe, salt):
    left = spark.createDataFrame([("hot", str(i % 7)) for i in range(60)] + [("k", "0")], "k string, a string")
    right = spark.createDataFrame([("hot", str(i)) for i in range(20)] + [("m", "0")], "k string, b string")
    assert bag(natural_join(left, right, salt=salt)) == bag(left.join(right, "k"))
    query = patterns(DEFAULT_QUERY)
    assert bag(bgp_grouped(universe, query, salt=salt)) == bag(bgp(universe, query))


def test_copies_survive_collapsing(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)], "k string")
    assert bag(expand_copies(collapse_copies(df))) == Counter({("a",): 5, ("b",): 1})
    one = spark.createDataFrame([("a", 200_000), ("b", 0), ("c", 65_536)], "k string, _copies bigint")
    assert sorted(map(tuple, expand_copies(one).groupBy("k").count().collect())) == [("a", 200_000), ("c", 65_536)]


def test_merge_bindings_right_wins(spark):
    df = spark.createDataFrame([({"?a": "1", "?b": "2"}, {"?b": "3", "?c": "4"})], "l map<string,string>, r map<string,string>")
    merged = df.select(merge_bindings(df.l, df.r).alias("m")).first()["m"]
    assert merged == {"?a": "1", "?b": "3", "?c": "4"}


@pytest.mark.parametrize("n", [10, 40])
def test_default_query_has_36_rows_per_object(spark, n):
    universe, query = triple_universe(spark, n), patterns(DEFAULT_QUERY)
    flat, bushy = bgp(universe, query), bgp_grouped(universe, query)
    assert bag(flat) == bag(bushy)
    assert flat.count() == 36 * n
    for eager in ("patterns", "joins"):
        assert count_bgp(universe, query, eager=eager).first()[0] == 36 * n


def test_counts_by_variable_equal_counted_rows(universe):
    query = patterns(DEFAULT_QUERY)
    for by in (["d"], ["a", "e"], ["b", "c"]):
        expected = Counter({tuple(r): n for r, n in Counter(map(tuple, bgp(universe, query).select(*by).collect())).items()})
        for eager in ("patterns", "joins"):
            counted = count_bgp(universe, query, by, eager)
            assert Counter({tuple(r)[:-1]: r["rows"] for r in counted.collect()}) == expected


def test_disconnected_query(universe):
    query = patterns(["A_foo_?x", "B_foo_?y"])
    with pytest.raises(ValueError, match="product"):
        bgp(universe, query)
    assert bgp(universe, query, allow_cross=True).count() == 100
    assert bgp_grouped(universe, query, allow_cross=True).count() == 100
    assert count_bgp(universe, query).first()[0] == 100
    by_y = {r["y"]: r["rows"] for r in count_bgp(universe, query, ["y"]).collect()}
    assert by_y == {str(i): 10 for i in range(10)}


def test_variable_free_patterns_multiply(spark):
    triples = spark.createDataFrame(
        [("A", "foo", "1")] * 3 + [("B", "bar", "2")] * 2, "subj string, pred string, obj string"
    )
    assert bag(bgp(triples, patterns(["A_foo_1", "?x_bar_?y"]))) == Counter({("B", "2"): 6})
    assert bgp(triples, patterns(["A_foo_9", "?x_bar_?y"])).count() == 0
    assert bgp(triples, patterns(["A_foo_1", "B_bar_2"])).count() == 6
    assert bgp_grouped(triples, patterns(["A_foo_1"])).count() == 3
    assert count_bgp(triples, patterns(["A_foo_1", "?x_bar_?y"])).first()[0] == 6
    assert count_bgp(triples, patterns(["A_foo_1", "?x_bar_?y"]), ["x"]).collect() == [("B", 6)]
    assert count_bgp(triples, patterns(["A_foo_9", "?x_bar_?y"]), ["x"]).collect() == []


def test_wrong_requests(universe):
    with pytest.raises(ValueError):
        bgp(universe, [])
    with pytest.raises(ValueError, match="no pattern binds"):
        count_bgp(universe, patterns(["?a_foo_?b"]), ["zz"])


def test_written_order_does_not_change_rows(universe):
    query = patterns(DEFAULT_QUERY)
    expected = bag(bgp(universe, query))
    shuffled = query[:]
    random.Random(3).shuffle(shuffled)
    assert bag(bgp(universe, shuffled)) == expected
    assert bag(bgp_grouped(universe, shuffled)) == expected


def test_hot_rows_in_whole_queries(universe):
    query = patterns(DEFAULT_QUERY)[:4]
    assert bag(bgp(universe, query, hot_rows=3)) == bag(bgp(universe, query))


def test_domain_estimates(spark, universe):
    def estimate(*query):
        return domain_cardinality(universe, patterns(list(query))).first()["n_rows"]

    assert estimate("?a_foo_?b") == 30
    assert estimate(*DEFAULT_QUERY) == 3 * 10 * 2 * 2 * 3
    assert estimate("?a_foo_?a") == 0
    assert estimate("?a_?a_?b") == 0
    assert estimate("A_foo_1") == 1
    assert estimate("A_foo_1", "A_foo_99") == 0
    # a variable that is subject and predicate in vain stays empty as an object too
    assert estimate("?a_?a_?a") == 0
    numbers = spark.createDataFrame([("1", "p", "2"), ("2", "p", "3")], "subj string, pred string, obj string")
    assert domain_cardinality(numbers, patterns(["?a_p_?b", "?b_p_?c"])).first()["n_rows"] == 2 * 1 * 2
    assert {r[0]: r[1] for r in variable_domains(numbers, patterns(["?a_p_?b", "?b_p_?c"])).collect()} == {
        "a": 2, "b": 1, "c": 2,
    }


@pytest.mark.parametrize("query", ["?a_foo_?b", "?a_foo_?a", "?a_?a_?a", "?e_?d_?b^?a_?d_?b"])
def test_sketches_of_few_values_are_exact(universe, query):
    found = sketched_domains(universe, patterns(query))
    assert {tuple(r) for r in found.collect()} == {(*r, 0.0) for r in variable_domains(universe, patterns(query)).collect()}
    assert domain_cardinality(universe, patterns(query), 12).first() == domain_cardinality(universe, patterns(query)).first()
    assert domain_cardinality(universe.where("false"), patterns(query), 12).first()["n_rows"] == 0


def test_sketches_of_many_values_keep_their_bound(spark):
    subj = "concat('v', id % 30000)", "concat('v', id * 7 % 50000 + 15000)", "id"
    for k in range(4):
        triples = spark.range(60_000).selectExpr(f"concat('{k}', {subj[0]}) AS subj", "id AS pred", f"concat('{k}', {subj[1]}) AS obj")
        query = patterns("?a_p_?b^?b_?k_?c")
        exact = dict(map(tuple, variable_domains(triples.selectExpr("subj", "cast(pred AS string) AS pred", "obj"), query).collect()))
        found = sketched_domains(triples, query, 10)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        for name, n, error in found.collect():
            assert 0 < error < exact[name] and abs(n - exact[name]) <= error, name


def test_groups_of_a_cycle_build_no_product(spark):
    """300 x 300 members of one nation, of whom one order each tells the pairs."""
    facts = [(f"{k}{i}", "inNation", "N1") for k in "cs" for i in range(300)]
    facts += [(f"o{i}", p, f"{k}{i}") for i in range(300) for p, k in (("placedBy", "c"), ("soldBy", "s"))]
    triples = spark.createDataFrame([*facts, ("N1", "inRegion", "R1")], "subj string, pred string, obj string")
    query = patterns(["?n_inRegion_R1", "?c_inNation_?n", "?o_placedBy_?c", "?o_soldBy_?s", "?s_inNation_?n"])
    joined = bgp_grouped(triples, query)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # the suppliers' nation is looked up with both of its variables, not by the nation alone
    keys = [line.count(" = ") for line in plan.splitlines() if "Join Inner" in line]
    assert sorted(keys) == [1, 1, 1, 2]
    assert joined.count() == 300 and bag(joined) == bag(bgp(triples, query))


def test_few_triples_of_a_pattern_are_sent_to_all_tasks(spark, monkeypatch):
    """A predicate has two values: dealt by them, all rows would lie in two tasks."""
    query = patterns(DEFAULT_QUERY)
    universe = triple_universe(spark, spark.range(3_000))
    with monkeypatch.context() as m:
        m.setattr("tripleflow.plans.bgp.FEW_ROWS", 1_000)  # ?e_?d_1 has six rows, A_bar_?b 3,000
        for source in (universe, share_scan(universe, query)):
            for plan in (bgp, bgp_grouped):
                joined = plan(source, query)
                text = joined._jdf.queryExecution().optimizedPlan().toString()
                hints = [line for line in text.splitlines() if "strategy=broadcast" in line]
                assert len(hints) == 3
                assert joined.count() == 36 * 3_000
    repeated = universe.unionAll(universe.where("obj = '1'"))
    assert bag(bgp_grouped(repeated, query)) == bag(bgp(repeated, query))


def test_shared_scan_writes_without_a_sort(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    seen = []
    real = DataFrameWriter.parquet

    def parquet(writer, path, *args, **kwargs):
        seen.append(spark.conf.get(key))
        return real(writer, path, *args, **kwargs)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", parquet)
        shared = share_scan(triple_universe(spark, 20), patterns(DEFAULT_QUERY))
    assert seen == [str(len(DEFAULT_QUERY))] and spark.conf.get(key) == before
    assert bag(bgp(shared, patterns(DEFAULT_QUERY))) == bag(bgp(triple_universe(spark, 20), patterns(DEFAULT_QUERY)))


def test_shared_scan_reads_the_source_once(universe, rows):
    query = patterns([*DEFAULT_QUERY, "?x_foo_?b", "A_foo_1"])
    shared = share_scan(universe, query)
    assert bag(bgp(shared, query)) == bag(bgp(universe, query))
    assert rows(count_bgp(shared, query, ["d"])) == rows(count_bgp(universe, query, ["d"]))
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in shared.values()]
    parts = [re.search(r"PartitionFilters: \[.*?_part#\d+ = (\d+)", plan).group(1) for plan in plans]
    # nine patterns, two of them equal up to names: each reads its own part
    assert sorted(set(parts)) == [str(i) for i in range(8)] and parts[0] == parts[7]


def test_skewed_natural_join_is_split_at_run_time(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k"
        left = spark.range(0, 60_000, 1, 6).selectExpr(key, "uuid() AS a")
        right = spark.range(0, 3_000, 1, 6).selectExpr(
            "CASE WHEN id = 0 THEN 'hot' ELSE concat('k', id) END AS k", "id AS b"
        )
        joined = natural_join(left, right)
        assert len(joined.collect()) == 20_000 + 2_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_count_plan_has_no_row_blow_up(universe):
    """Variables nobody asks for are counted away below the joins."""
    plan = count_bgp(universe, patterns(["?u_foo_?x", "?u_bar_?y"]), ["u"])._jdf.queryExecution().optimizedPlan().toString()
    below_join = plan[plan.index("Join"):]
    assert below_join.count("Aggregate") == 2


def _few(spark):
    return spark.createDataFrame(
        [("A", "foo", "1"), ("1", "baz", "B"), ("1", "baz", "A"), ("A", "bar", "2"), ("C", "bar", "3")],
        "subj string, pred string, obj string",
    )


@pytest.mark.parametrize("plan", [bgp, bgp_grouped])
@pytest.mark.parametrize(
    "query, names, rows",
    [
        ("?a_foo_?A^?A_baz_?x", {"a": "low", "A": "up"}, {("A", "1", "B"), ("A", "1", "A")}),
        (["?_m|foo|?b".split("|"), "?_m|bar|?c".split("|")], None, {("A", "1", "2")}),
        (["?_w|foo|?x.y".split("|"), "?_w|bar|?_copies".split("|")], None, {("A", "1", "2")}),
        ("?rows_foo_?v1^?rows_bar_?v0", None, {("A", "1", "2")}),
    ],
)
def test_any_variable_name(spark, plan, query, names, rows):
    found = plan(_few(spark), patterns(query), names=names)
    assert {tuple(r) for r in found.collect()} == rows
    assert found.count() == len(rows)


def test_counts_by_any_name(spark):
    query = patterns("?a_foo_?A^?A_baz_?x")
    assert [tuple(r) for r in count_bgp(_few(spark), query, by=["A"]).collect()] == [("1", 2)]
    named = count_bgp(_few(spark), patterns("?rows_bar_?x"), by=["rows"], names={"rows": "who"})
    assert {tuple(r) for r in named.collect()} == {("A", 1), ("C", 1)}
    with pytest.raises(ValueError, match="rows"):
        count_bgp(_few(spark), patterns("?rows_bar_?x"), by=["rows"])
    with pytest.raises(ValueError, match="tell apart"):
        bgp(_few(spark), query)


def test_counting_by_parts_that_share_nothing_needs_leave(spark):
    query = patterns("?a_foo_?b^?c_bar_?d")
    with pytest.raises(ValueError, match="allow_cross"):
        count_bgp(_few(spark), query, by=["a", "c"])
    found = count_bgp(_few(spark), query, by=["a", "c"], allow_cross=True)
    assert {tuple(r) for r in found.collect()} == {("A", "A", 1), ("A", "C", 1)}
