"""Joins and whole conjunctive queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.registry import EVENTS, STAR, UNIVERSE, query
from tripleflow.functions.text import merge_bindings, render_map
from tripleflow.operators.hypercube import one_shuffle_join
from tripleflow.operators.joins import cross, multi_join, natural_join
from tripleflow.operators.match import match, match_each, share_scan
from tripleflow.patterns import DEFAULT_QUERY, pattern, patterns
from tripleflow.plans.bgp import bgp, bgp_grouped, count_bgp
from tripleflow.plans.domain import domain_cardinality, sketched_domains, variable_domains
from tripleflow.plans.reduce import bgp_reduced, reduce_relations
from tripleflow.sources.tables import event_triples, star_triples, table
from tripleflow.sources.triples import triple_universe

# Items sold to a customer of the supplier's own nation, inside region R1.
HOME_SALES = patterns(
    [
        "?o_soldBy_?s",
        "?s_inNation_?n",
        "?n_inRegion_R1",
        "?o_placedBy_?c",
        "?c_inNation_?n",
    ]
)

# The same query written so that its groups are region with customers, orders with items,
# and suppliers: joined left to right they never meet on a nation alone.
HOME_SALES_BY_GROUP = patterns(
    [
        "?n_inRegion_R1",
        "?c_inNation_?n",
        "?o_placedBy_?c",
        "?o_soldBy_?s",
        "?s_inNation_?n",
    ]
)

# A table expression for each predicate, filtered before anything is joined.
_HOME_PARTS = """in_region AS MATERIALIZED (SELECT 'N' || n_nationkey AS n FROM nation WHERE n_regionkey = 1),
customers AS MATERIALIZED (SELECT 'C' || c_custkey AS c, 'N' || c_nationkey AS n FROM customer),
suppliers AS MATERIALIZED (SELECT 'S' || s_suppkey AS s, 'N' || s_nationkey AS n FROM supplier),
placed AS MATERIALIZED (SELECT 'O' || o_orderkey AS o, 'C' || o_custkey AS c FROM orders),
sold AS MATERIALIZED (SELECT 'O' || l_orderkey AS o, 'S' || l_suppkey AS s FROM lineitem)"""
_HOME_JOINS = "FROM in_region JOIN customers USING (n) JOIN placed USING (c) JOIN sold USING (o) JOIN suppliers USING (s, n)"
_HOME_ROWS = f"WITH {_HOME_PARTS} SELECT n, c, o, s {_HOME_JOINS}"


def matched_star(spark: SparkSession, d: str, query: list[str]) -> list[DataFrame]:
    pats = patterns(query)
    star = star_triples(spark, d, pats)
    return [match(star, p) for p in pats]


@query(
    "jn1_natural",
    f"WITH {_HOME_PARTS} SELECT o, c, s FROM placed JOIN sold USING (o)",
)
def _natural(spark: SparkSession, d: str) -> DataFrame:
    return natural_join(*matched_star(spark, d, ["?o_placedBy_?c", "?o_soldBy_?s"]))


@query(
    "jn1_hot_keys",
    f"""WITH {STAR}
SELECT a.subj AS x, a.obj AS n, b.obj AS r FROM star a JOIN star b ON a.obj = b.subj
WHERE a.pred = 'inNation' AND b.pred = 'inRegion'""",
)
def _hot_keys(spark: SparkSession, d: str) -> DataFrame:
    # A nation holds a fixed share of all customers, however many there are.
    where, region = matched_star(spark, d, ["?x_inNation_?n", "?n_inRegion_?r"])
    return natural_join(where, region, hot_rows=50)


@query(
    "jn2_multi",
    f"""WITH {STAR}
SELECT a.subj AS o, a.obj AS c, b.obj AS st, s.obj AS g FROM star a
JOIN star b ON a.subj = b.subj JOIN star s ON s.subj = a.obj
WHERE a.pred = 'placedBy' AND b.pred = 'status' AND s.pred = 'segment'""",
)
def _multi(spark: SparkSession, d: str) -> DataFrame:
    return multi_join(matched_star(spark, d, ["?o_placedBy_?c", "?o_status_?st", "?c_segment_?g"]))


@query(
    "jn3_cross",
    f"""WITH {STAR}
SELECT a.subj AS n, b.subj AS s FROM star a, star b
WHERE a.pred = 'inRegion' AND a.obj = 'R1' AND b.pred = 'inNation' AND b.obj = 'N7'
  AND b.subj LIKE 'S%'""",
)
def _cross(spark: SparkSession, d: str) -> DataFrame:
    nations, members = matched_star(spark, d, ["?n_inRegion_R1", "?s_inNation_N7"])
    return cross(nations, members.where(F.col("s").startswith("S")))


@query(
    "jn4_bgp",
    _HOME_ROWS,
)
def _bgp(spark: SparkSession, d: str) -> DataFrame:
    return bgp(star_triples(spark, d, HOME_SALES), HOME_SALES)


@query("jn4_home_sales", f"WITH {_HOME_PARTS} SELECT n, count(*) AS n_items {_HOME_JOINS} GROUP BY n")
def home_sales(spark: SparkSession, d: str) -> DataFrame:
    counted = count_bgp(star_triples(spark, d, HOME_SALES), HOME_SALES, by=["n"])
    return counted.select(F.col("n").alias("n"), F.col("rows").alias("n_items"))


# The home sales as a cycle of four relations and one that closes it off, and a triangle.
@query("jn2_one_shuffle_cycle", _HOME_ROWS)
def _one_shuffle_cycle(spark: SparkSession, d: str) -> DataFrame:
    triples = star_triples(spark, d, HOME_SALES)
    return one_shuffle_join([match(triples, p) for p in HOME_SALES], {"o": 4, "n": 4}).select("n", "c", "o", "s")


@query(
    "jn2_triangle",
    """WITH sold AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
has AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
deals AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT 'S' || s AS s, count(*) AS n FROM sold JOIN has USING (o) JOIN deals USING (s, p) GROUP BY s""",
)
def _triangle(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(["?o_soldBy_?s", "?o_hasPart_?p"])
    sold, has = (match(star_triples(spark, d, pats), p) for p in pats)
    lines = table(spark, d, "lineitem")
    deals = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("p"))
    return one_shuffle_join([sold, has, deals], cells=27, distinct=True, keep=["s"]).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


# Acyclic, with many orders whose customer is of another region or segment.
_DANGLING = patterns(
    [("?o", "soldBy", "?s"), ("?o", "placedBy", "?c"), ("?c", "segment", "BUILDING"), ("?c", "inNation", "?n"), ("?n", "inRegion", "R1")]
)
_DANGLING_SQL = """FROM star o JOIN star p ON p.subj = o.subj AND p.pred = 'placedBy'
JOIN star g ON g.subj = p.obj AND g.pred = 'segment' AND g.obj = 'BUILDING'
JOIN star c ON c.subj = p.obj AND c.pred = 'inNation' JOIN star n ON n.subj = c.obj AND n.pred = 'inRegion' AND n.obj = 'R1'
WHERE o.pred = 'soldBy'"""


@query("jn4_reduced", f"WITH {STAR} SELECT o.subj AS o, o.obj AS s, p.obj AS c, c.obj AS n {_DANGLING_SQL}")
def _reduced(spark: SparkSession, d: str) -> DataFrame:
    return bgp_reduced(star_triples(spark, d, _DANGLING), _DANGLING)


@query(
    "jn4_reduced_sizes",
    f"""WITH {STAR}, r AS (SELECT o.subj AS o, o.obj AS s, p.obj AS c, c.obj AS n {_DANGLING_SQL})
SELECT 0 AS pattern_id, (SELECT count(*) FROM star WHERE pred = 'soldBy' AND subj IN (SELECT o FROM r)) AS n
UNION ALL SELECT 1, (SELECT count(DISTINCT o) FROM r) UNION ALL SELECT 2, (SELECT count(DISTINCT c) FROM r)
UNION ALL SELECT 3, (SELECT count(DISTINCT c) FROM r) UNION ALL SELECT 4, (SELECT count(DISTINCT n) FROM r)""",
)
def _reduced_sizes(spark: SparkSession, d: str) -> DataFrame:
    triples = star_triples(spark, d, _DANGLING)
    reduced = reduce_relations([match(triples, p) for p in _DANGLING])
    sizes = [r.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("pattern_id"), "n") for i, r in enumerate(reduced)]
    return reduce(DataFrame.unionByName, sizes)


@query(
    "jn4_variable_free",
    f"""WITH {EVENTS}
SELECT b.subj AS u, b.obj AS v FROM ev a, ev b
WHERE a.subj = 'U7' AND a.pred = 'click' AND a.obj = '12' AND b.pred = 'view' AND b.obj = '12'
UNION ALL
SELECT b.subj, b.obj FROM ev a, ev b
WHERE a.subj = 'U7' AND a.pred = 'view' AND b.pred = 'purchase' AND b.obj = '12'""",
)
def _variable_free(spark: SparkSession, d: str) -> DataFrame:
    events = event_triples(spark, d)
    exact = bgp(events, patterns(["U7_click_12", "?u_view_?v"])).where(F.col("v") == "12")
    existing = match(events, pattern("U7_view_?x")).select(F.lit("U7").alias("subj"), F.lit("viewed").alias("pred"), F.lit("x").alias("obj"))
    facts = events.select("subj", "pred", "obj").unionByName(existing)
    repeated = bgp(facts, patterns(["U7_viewed_x", "?u_purchase_?v"])).where(F.col("v") == "12")
    return exact.unionByName(repeated)


@query(
    "jn4_default_query",
    f"""WITH {UNIVERSE}
SELECT count(*) AS n FROM uni p0
JOIN uni p1 ON p1.subj = 'A' AND p1.pred = 'bar' AND p1.obj = p0.obj
JOIN uni p2 ON p2.subj = 'A' AND p2.obj = p0.obj
JOIN uni p3 ON p3.subj = 'B' AND p3.obj = p0.obj
JOIN uni p4 ON p4.obj = '1' AND p4.pred = p3.pred
JOIN uni p5 ON p5.obj = '2' AND p5.pred = p3.pred AND p5.subj = p4.subj
JOIN uni p6 ON p6.obj = '3' AND p6.pred = p3.pred AND p6.subj = p4.subj
WHERE p0.pred = 'foo'""",
)
def _default_query(spark: SparkSession, d: str) -> DataFrame:
    universe = triple_universe(spark, table(spark, d, "part").select("p_partkey"))
    return count_bgp(universe, patterns(DEFAULT_QUERY), eager="joins").select(F.col("rows").alias("n"))


_DEFAULT_ROWS = f"""WITH {UNIVERSE}
SELECT p0.subj AS a, p0.obj AS b, p2.pred AS c, p3.pred AS d, p4.subj AS e FROM uni p0
JOIN uni p1 ON p1.subj = 'A' AND p1.pred = 'bar' AND p1.obj = p0.obj
JOIN uni p2 ON p2.subj = 'A' AND p2.obj = p0.obj
JOIN uni p3 ON p3.subj = 'B' AND p3.obj = p0.obj
JOIN uni p4 ON p4.obj = '1' AND p4.pred = p3.pred
JOIN uni p5 ON p5.obj = '2' AND p5.pred = p3.pred AND p5.subj = p4.subj
JOIN uni p6 ON p6.obj = '3' AND p6.pred = p3.pred AND p6.subj = p4.subj
WHERE p0.pred = 'foo'"""


@query("jn4_default_rows", _DEFAULT_ROWS)
def _default_rows(spark: SparkSession, d: str) -> DataFrame:
    universe = triple_universe(spark, table(spark, d, "part").select("p_partkey"))
    return bgp(universe, patterns(DEFAULT_QUERY))


@query("jn4_shared_scan", _DEFAULT_ROWS)
def _shared_scan(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(DEFAULT_QUERY)
    universe = triple_universe(spark, table(spark, d, "part").select("p_partkey"))
    return bgp(share_scan(universe, pats), pats)


@query("jn5_default_rows", _DEFAULT_ROWS)
def _default_rows_grouped(spark: SparkSession, d: str) -> DataFrame:
    universe = triple_universe(spark, table(spark, d, "part").select("p_partkey"))
    return bgp_grouped(universe, patterns(DEFAULT_QUERY))


@query(
    "jn5_grouped",
    _HOME_ROWS,
)
def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return bgp_grouped(star_triples(spark, d, HOME_SALES), HOME_SALES_BY_GROUP)


@query(
    "jn5_two_hops",
    f"""WITH {EVENTS}
SELECT a.subj AS u, CAST(count(*) AS BIGINT) AS n_rows FROM ev a JOIN ev b ON a.subj = b.subj
JOIN ev c ON c.subj = a.subj WHERE a.pred = 'click' AND b.pred = 'view' AND c.pred = 'purchase'
GROUP BY a.subj""",
)
def _two_hops(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(["?u_click_?x", "?u_view_?y", "?u_purchase_?z"])
    return count_bgp(event_triples(spark, d), pats, by=["u"]).select("u", F.col("rows").alias("n_rows"))


@query(
    "jn4_count_disconnected",
    f"""WITH {STAR}
SELECT (SELECT count(*) FROM star WHERE pred = 'soldBy') *
       (SELECT count(*) FROM star WHERE pred = 'inRegion' AND obj = 'R1') AS n""",
)
def _count_disconnected(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(["?o_soldBy_?s", "?n_inRegion_R1"])
    return count_bgp(star_triples(spark, d, pats), pats).select(F.col("rows").alias("n"))


@query(
    "jn10_merge",
    f"""WITH {EVENTS}
SELECT a.seq AS seq, '{{?a=' || a.subj || ', ?p=' || b.pred || ', ?v=' || b.obj || '}}' AS merged
FROM ev a JOIN ev b ON a.seq = b.seq""",
)
def _merge(spark: SparkSession, d: str) -> DataFrame:
    events = event_triples(spark, d)
    left = match_each(events, patterns(["?a_?p_?a1"]), keep=["seq"]).select(
        "seq", F.map_filter("bindings", lambda k, _: k != "?a1").alias("l")
    )
    right = match_each(events, patterns(["?s_?p_?v"]), keep=["seq"]).select(
        "seq", F.map_filter("bindings", lambda k, _: k != "?s").alias("r")
    )
    both = left.join(right, "seq")
    return both.select("seq", render_map(merge_bindings(F.col("l"), F.col("r"))).alias("merged"))


@query(
    "set1_value_sets",
    f"""WITH {STAR}
SELECT subj AS v FROM star WHERE pred = 'soldBy' INTERSECT SELECT subj FROM star WHERE pred = 'placedBy' AND obj LIKE 'C1%'""",
)
def _value_sets(spark: SparkSession, d: str) -> DataFrame:
    sold, placed = matched_star(spark, d, ["?v_soldBy_?s", "?v_placedBy_?c"])
    return sold.select("v").intersect(placed.where(F.col("c").startswith("C1")).select("v"))


_DOMAIN = f"""WITH {STAR},
s AS (SELECT DISTINCT subj AS v FROM star), o AS (SELECT DISTINCT obj AS v FROM star),
p AS (SELECT DISTINCT pred AS v FROM star),
sizes AS (
  SELECT 'o' AS variable, count(*) AS n_values FROM s
  UNION ALL SELECT 'c', count(*) FROM (SELECT v FROM s INTERSECT SELECT v FROM o)
  UNION ALL SELECT 'k', count(*) FROM p)"""
_DOMAIN_PATTERNS = patterns(["?o_placedBy_?c", "?c_?k_N7"])


@query("agg5_domain", f"{_DOMAIN} SELECT CAST(product(n_values) AS BIGINT) AS n_rows FROM sizes")
def _domain(spark: SparkSession, d: str) -> DataFrame:
    return domain_cardinality(star_triples(spark, d), _DOMAIN_PATTERNS).select("n_rows")


@query("agg5_variable_domains", f"{_DOMAIN} SELECT variable, n_values FROM sizes")
def _variable_domains(spark: SparkSession, d: str) -> DataFrame:
    return variable_domains(star_triples(spark, d), _DOMAIN_PATTERNS)


@query("agg5_sketched_domains", f"{_DOMAIN} SELECT variable, n_values FROM sizes")
def _sketched_domains(spark: SparkSession, d: str) -> DataFrame:
    """Exact as long as no position has more than 65,536 values."""
    return sketched_domains(star_triples(spark, d), _DOMAIN_PATTERNS).select("variable", "n_values")
