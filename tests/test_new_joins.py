"""Reduction by semi-joins, joins in one shuffle, and bounded joins of several sides."""

import itertools
import random
from collections import Counter

import pytest

from tests import simulate
from tripleflow.operators import hypercube
from tripleflow.operators.correlate import bounded_join, bounded_multi_join
from tripleflow.operators.hypercube import co_partitioned, even_shares, local_joins, one_shuffle_join, place_in_cells
from tripleflow.operators.joins import multi_join
from tripleflow.operators.match import match
from tripleflow.patterns import patterns
from tripleflow.plans.bgp import bgp
from tripleflow.plans.reduce import bgp_reduced, join_tree, reduce_relations


def bag(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def edges(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def some_edges(seed, n, of=8):
    rng = random.Random(seed)
    return [(f"x{rng.randrange(of)}", f"x{rng.randrange(of)}") for _ in range(n)]


@pytest.mark.parametrize(
    "var_sets, cyclic",
    [
        ([{"a", "b"}, {"b", "c"}, {"c", "d"}], False),
        ([{"a", "b"}, {"b", "c"}, {"a", "c"}], True),
        ([{"a", "b", "c"}, {"a", "b"}, {"b", "c"}, {"a", "c"}], False),
        ([{"a"}, {"b"}], False),
        ([{"a", "b"}, {"a", "b"}], False),
        ([{"o", "s"}, {"s", "n"}, {"n"}, {"o", "c"}, {"c", "n"}], True),
    ],
)
def test_join_tree(var_sets, cyclic):
    tree = join_tree(var_sets)
    if cyclic:
        assert tree is None
        return
    assert sorted(ear for ear, _ in tree) == list(range(len(var_sets)))
    removed = set()
    for ear, parent in tree:
        others = set().union(*(s for i, s in enumerate(var_sets) if i != ear and i not in removed), set())
        assert parent not in removed and (var_sets[ear] & others) <= (var_sets[parent] if parent is not None else set())
        removed.add(ear)


def test_reduced_relations_hold_just_the_rows_that_take_part(spark):
    for seed in range(2):
        relations = [edges(spark, c, some_edges(seed + 10 * i, 12)) for i, c in enumerate(("ab", "bc", "bd", "de"))]
        reduced = reduce_relations(relations)
        whole = multi_join(relations)
        assert bag(multi_join(reduced)) == bag(whole)
        for before, after in zip(relations, reduced):
            partners = set(map(tuple, whole.select(*before.columns).distinct().collect()))
            assert Counter(map(tuple, after.collect())) == Counter(r for r in map(tuple, before.collect()) if r in partners)


def test_dangling_triples_go_before_any_join(spark):
    """Patterns 1 and 2 alone join to 400 rows; only 20 of their triples take part."""
    rows = [("h", "p", f"m{i}") for i in range(20)] + [("h", "q", f"k{i}") for i in range(20)] + [("k3", "r", "end")]
    triples = spark.createDataFrame(rows, "subj string, pred string, obj string")
    pats = patterns(["?a_p_?b", "?a_q_?c", "?c_r_?d"])
    sizes = [r.count() for r in reduce_relations([match(triples, p) for p in pats])]
    assert sizes == [20, 1, 1]
    assert bag(bgp_reduced(triples, pats)) == bag(bgp(triples, pats)) and bgp_reduced(triples, pats).count() == 20
    both = [*pats, *patterns(["h_p_m1"])]
    assert bag(bgp_reduced(triples, both)) == bag(bgp(triples, both))
    for query in (["?a_p_?b", "?b_p_?c", "?c_p_?a"], ["?a_p_?b", "?c_q_?d"], ["h_p_m1"]):
        with pytest.raises(ValueError):
            bgp_reduced(triples, patterns(query))


@pytest.mark.parametrize("shares", [None, {"a": 2, "b": 3, "c": 1}, {"b": 5}])
def test_triangle_in_one_shuffle(spark, shares):
    relations = [edges(spark, c, some_edges(i, 60) + [("hot", f"x{k}") for k in range(20)]) for i, c in enumerate(("ab", "bc", "ca"))]
    assert bag(one_shuffle_join(relations, shares, cells=8)) == bag(multi_join(relations))


def test_the_plan_has_one_exchange_for_each_relation(spark, tmp_path):
    for i, c in enumerate(("ab", "bc", "ca", "ad")):
        edges(spark, c, some_edges(i, 60)).write.parquet(f"{tmp_path}/{c}")
    relations = [spark.read.schema(f"{c[0]} string, {c[1]} string").parquet(f"{tmp_path}/{c}") for c in ("ab", "bc", "ca", "ad")]
    hints = [r.hint("merge") for r in relations]
    with co_partitioned(spark):
        plan = local_joins(hints, even_shares(relations, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("SortMergeJoin") == 3
    assert bag(one_shuffle_join(relations, cells=8)) == bag(multi_join(relations))


def test_copies_are_dropped_where_rows_are_dealt_to(spark, tmp_path):
    """Fewer cells than shuffle partitions: an exchange for each relation and one for the partial result, none for the sets."""
    rows = {c: some_edges(i, 60) for i, c in enumerate(("ab", "bc", "ca"))}
    for c, some in rows.items():
        edges(spark, c, some + some[:30]).write.parquet(f"{tmp_path}/{c}")
    relations = [spark.read.schema(f"{c[0]} string, {c[1]} string").parquet(f"{tmp_path}/{c}") for c in rows]
    expected = bag(multi_join([r.distinct() for r in relations]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            with co_partitioned(spark):
                joined = local_joins([r.hint("merge") for r in relations], even_shares(relations, 8), distinct=True)
                plan = joined.select("b")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == (3 if partitions == "2" else 4)
            assert bag(one_shuffle_join(relations, cells=8, distinct=True)) == expected
            kept = one_shuffle_join(relations, cells=8, distinct=True, keep=["b"])
            assert kept.columns == ["b"] and kept.count() == sum(expected.values())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_dealt_by_join_keys_are_not_copied(spark):
    """Fewer cells than shuffle partitions: each relation is sent once, not once for every place on the axes it lacks."""
    relations = [edges(spark, c, some_edges(i, 60)) for i, c in enumerate(("ab", "bc", "ca"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        plan = local_joins(relations, even_shares(relations, 8))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan and hypercube.CELL not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("distinct", [False, True])
def test_crowded_values_of_the_first_join_spread_over_the_grid(spark, monkeypatch, distinct):
    monkeypatch.setattr(hypercube, "CROWDED_ROWS", 15)
    monkeypatch.setattr(hypercube, "CROWDED_TIMES", 0)
    names = ("ab", "bc", "ca", "ad", "de")
    relations = [edges(spark, c, some_edges(i, 40) + [("hot", f"x{k % 8}") for k in range(20)] + [(f"x{k % 8}", "hot") for k in range(20)]) for i, c in enumerate(names)]
    expected = bag(multi_join([r.distinct() for r in relations] if distinct else relations))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with co_partitioned(spark):
            joined = local_joins(relations, even_shares(relations, 16), distinct)
            assert "Generate" in joined._jdf.queryExecution().optimizedPlan().toString()
            assert bag(joined) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_combination_meets_in_one_cell(spark):
    shares = {"a": 2, "b": 3, "c": 2}
    rows = some_edges(5, 40)
    placed = {c: place_in_cells(edges(spark, c, rows).distinct(), shares).collect() for c in ("ab", "bc", "ca")}
    cells = {c: {} for c in placed}
    for c, found in placed.items():
        for x, y, cell in found:
            cells[c].setdefault((x, y), set()).add(cell)
        lacks = next(v for v in shares if v not in c)
        assert all(len(s) == shares[lacks] for s in cells[c].values())
    values = {v for r in rows for v in r}
    for a, b, c in itertools.product(values, repeat=3):
        if (a, b) in cells["ab"] and (b, c) in cells["bc"] and (c, a) in cells["ca"]:
            assert len(cells["ab"][a, b] & cells["bc"][b, c] & cells["ca"][c, a]) == 1


def _several_sides(arrivals, sides, capacity, retain):
    memory = [[] for _ in range(sides)]
    out = Counter()
    for side, key, seq in arrivals:
        own = memory[side]
        if len(own) == capacity:
            own.pop(-1 if retain == "first" else 0)
        own.append((key, seq))
        others = [[s for k, s in memory[j] if k == key] if j != side else [seq] for j in range(sides)]
        out.update((key, *combination) for combination in itertools.product(*others))
    return out


@pytest.mark.parametrize("retain", ["first", "latest"])
@pytest.mark.parametrize("sides, capacity", [(2, 2), (3, 2)])
def test_bounded_join_of_several_sides(spark, sides, capacity, retain):
    rng = random.Random(sides * 100 + capacity)
    arrivals = [(rng.randrange(sides), f"k{rng.randrange(3)}", s) for s in range(90)]
    frames = [
        spark.createDataFrame([(k, s, f"{n}-{s}") for n, k, s in arrivals if n == side], f"k string, seq bigint, v{side} string")
        for side in range(sides)
    ]
    columns = ["k", *[f"seq_{i + 1}" for i in range(sides)]]
    for split_rows in (1_000_000, 20) if retain == "first" else (20,):
        found = bounded_multi_join(frames, ["k"], "seq", capacity, retain, "stream", split_rows)
        assert Counter(map(tuple, found.select(*columns).collect())) == _several_sides(arrivals, sides, capacity, retain)
    per_key = Counter()
    for key in {k for _, k, _ in arrivals}:
        per_key += _several_sides([a for a in arrivals if a[1] == key], sides, capacity, retain)
    found = bounded_multi_join(frames, ["k"], "seq", capacity, retain, "key")
    assert Counter(map(tuple, found.select(*columns).collect())) == per_key
    if sides == 2:
        two = bounded_join(*frames, ["k"], "seq", capacity, retain)
        assert Counter(map(tuple, two.select("k", "left_seq", "right_seq").collect())) == per_key
        tagged = [("lr"[n], k, s) for n, k, s in arrivals]
        assert per_key == simulate.bounded_join_per_key(tagged, capacity, retain)
