"""Matching one or many patterns, and counting the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.registry import EVENTS, query
from tripleflow.functions.text import render_map
from tripleflow.operators.counts import (
    collect_timed,
    count_each,
    count_matches,
    count_packed,
    count_patterns,
    render,
)
from tripleflow.operators.match import (
    match,
    match_each,
    match_packed,
    match_shared,
    match_streams,
)
from tripleflow.operators.pattern_table import match_table
from tripleflow.patterns import pattern, patterns
from tripleflow.sources.tables import event_triples

# Nine patterns: equal ones up to names (0, 6), a repeated variable (5), none at all (4),
# one nothing matches (7), one everything matches (8).
NINE = patterns(
    [
        "?a_click_?b",
        "7_?p_?v",
        "?u_view_12",
        "7_purchase_?v",
        "8_click_5",
        "?x_?y_?x",
        "?c_click_?d",
        "?a_nosuch_?b",
        "?s_?p_?o",
    ]
)

_PLAIN = EVENTS.replace("'U' || user_id", "CAST(user_id AS VARCHAR)")
_NINE_ROWS = f"""WITH {_PLAIN}, nine AS (
  SELECT seq, 0 AS pattern_id, '{{?a=' || subj || ', ?b=' || obj || '}}' AS bindings, 2 AS vars FROM ev WHERE pred = 'click'
  UNION ALL SELECT seq, 1, '{{?p=' || pred || ', ?v=' || obj || '}}', 2 FROM ev WHERE subj = '7'
  UNION ALL SELECT seq, 2, '{{?u=' || subj || '}}', 1 FROM ev WHERE pred = 'view' AND obj = '12'
  UNION ALL SELECT seq, 3, '{{?v=' || obj || '}}', 1 FROM ev WHERE subj = '7' AND pred = 'purchase'
  UNION ALL SELECT seq, 4, '{{}}', 0 FROM ev WHERE subj = '8' AND pred = 'click' AND obj = '5'
  UNION ALL SELECT seq, 5, '{{?x=' || subj || ', ?y=' || pred || '}}', 2 FROM ev WHERE subj = obj
  UNION ALL SELECT seq, 6, '{{?c=' || subj || ', ?d=' || obj || '}}', 2 FROM ev WHERE pred = 'click'
  UNION ALL SELECT seq, 7, '{{?a=' || subj || ', ?b=' || obj || '}}', 2 FROM ev WHERE pred = 'nosuch'
  UNION ALL SELECT seq, 8, '{{?o=' || obj || ', ?p=' || pred || ', ?s=' || subj || '}}', 3 FROM ev)"""


def nine_triples(spark: SparkSession, d: str) -> DataFrame:
    """Event triples with bare user numbers, so that a subject can equal an object."""
    return event_triples(spark, d, prefix="")


@query("flt1_constant", f"WITH {EVENTS} SELECT subj, obj FROM ev WHERE pred = 'click'")
def _constant(spark: SparkSession, d: str) -> DataFrame:
    return match(event_triples(spark, d), pattern("?subj_click_?obj"))


@query("flt2_bind", f"WITH {EVENTS} SELECT subj AS who, pred AS did, obj AS what FROM ev")
def _bind(spark: SparkSession, d: str) -> DataFrame:
    return match(event_triples(spark, d), pattern("?who_?did_?what"))


@query("flt3_repeat", f"WITH {_PLAIN} SELECT subj AS a, pred AS p FROM ev WHERE subj = obj")
def _repeat(spark: SparkSession, d: str) -> DataFrame:
    return match(nine_triples(spark, d), pattern("?a_?p_?a"))


@query(
    "flt4_match",
    f"WITH {_PLAIN} SELECT subj AS a, seq FROM ev WHERE pred = 'view' AND subj = obj",
)
def _match(spark: SparkSession, d: str) -> DataFrame:
    return match(nine_triples(spark, d), pattern("?a_view_?a"), keep=["seq"])


@query("flt5_each", f"{_NINE_ROWS} SELECT seq, pattern_id, bindings FROM nine")
def _each(spark: SparkSession, d: str) -> DataFrame:
    tagged = match_each(nine_triples(spark, d), NINE, keep=["seq"])
    return tagged.withColumn("bindings", render_map(F.col("bindings")))


@query(
    "flt6_packed",
    f"""{_NINE_ROWS}
SELECT seq, string_agg(pattern_id || ':' || bindings, ' ' ORDER BY pattern_id) AS packed
FROM nine GROUP BY seq""",
)
def _packed(spark: SparkSession, d: str) -> DataFrame:
    packed = match_packed(nine_triples(spark, d), NINE, keep=["seq"])
    shown = F.transform(
        F.array_sort(F.map_keys("all_bindings")),
        lambda k: F.concat(k.cast("string"), F.lit(":"), render_map(F.col("all_bindings")[k])),
    )
    return packed.select("seq", F.concat_ws(" ", shown).alias("packed"))


@query(
    "flt7_streams",
    f"""WITH {EVENTS}
SELECT 0 AS stream, subj AS u, obj AS v, subj || obj AS "valuesAsString" FROM ev WHERE pred = 'click'
UNION ALL SELECT 1, subj, obj, subj || obj FROM ev WHERE pred = 'view'
UNION ALL SELECT 2, subj, NULL, subj FROM ev WHERE pred = 'purchase' AND obj = '12'""",
)
def _streams(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(["?u_click_?v", "?u_view_?v", "?u_purchase_12"])
    keys = [["u", "v"], ["u", "v"], ["u"]]
    frames = match_streams(event_triples(spark, d), pats, keys, key_text=True)
    tagged = [f.withColumn("stream", F.lit(i)) for i, f in frames.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2], allowMissingColumns=True)


@query("flt8_shared", f"{_NINE_ROWS} SELECT seq, pattern_id, bindings FROM nine")
def _shared(spark: SparkSession, d: str) -> DataFrame:
    tagged = match_shared(nine_triples(spark, d), NINE, keep=["seq"])
    return tagged.withColumn("bindings", render_map(F.col("bindings")))


@query(
    "flt8_shared_plain",
    f"""WITH {_PLAIN}
SELECT 0 AS pattern_id, count(*) AS n FROM ev WHERE subj = obj
UNION ALL SELECT 1, count(*) FROM ev WHERE subj = obj AND pred = 'click'
UNION ALL SELECT 2, count(*) FROM ev WHERE subj = obj""",
)
def _shared_plain(spark: SparkSession, d: str) -> DataFrame:
    pats = patterns(["?x_?p_?x", "?x_click_?x", "?a_?b_?a"])
    return count_each(match_shared(nine_triples(spark, d), pats))


def patterns_from_events(triples: DataFrame) -> DataFrame:
    """A pattern table as large as the data: per user, per pair of event type and object, and more."""

    def table(kind: str, columns: list[str], subj: str, pred: str, obj: str) -> DataFrame:
        ident = F.concat_ws(":", F.lit(kind), *columns)
        parts = [F.expr(e).alias(p) for e, p in ((subj, "subj"), (pred, "pred"), (obj, "obj"))]
        return triples.select(*columns).distinct().select(ident.alias("pattern_id"), *parts)

    return (
        table("user", ["subj"], "subj", "'?p'", "'?v'")
        .unionAll(table("pair", ["pred", "obj"], "'?u'", "pred", "obj"))
        .unionAll(table("pred", ["pred"], "'?b'", "pred", "'?a'"))
        .unionAll(table("twice", ["pred"], "'?x'", "pred", "'?x'"))
        .unionAll(table("whole", ["subj", "pred", "obj"], "subj", "pred", "obj").where("pred = 'error'"))
    )


def _pattern_rows(triples: str) -> str:
    return f"""WITH {triples}, found AS (
  SELECT seq, subj, 'user' AS kind, 'user:' || subj AS pattern_id, '{{?p=' || pred || ', ?v=' || obj || '}}' AS bindings FROM ev
  UNION ALL SELECT seq, subj, 'pair', 'pair:' || pred || ':' || obj, '{{?u=' || subj || '}}' FROM ev
  UNION ALL SELECT seq, subj, 'pred', 'pred:' || pred, '{{?a=' || obj || ', ?b=' || subj || '}}' FROM ev
  UNION ALL SELECT seq, subj, 'twice', 'twice:' || pred, '{{?x=' || subj || '}}' FROM ev WHERE subj = obj
  UNION ALL SELECT seq, subj, 'whole', 'whole:' || subj || ':' || pred || ':' || obj, '{{}}' FROM ev WHERE pred = 'error')"""


@query("flt8_table", f"{_pattern_rows(_PLAIN)} SELECT seq, pattern_id, bindings FROM found")
def _pattern_table(spark: SparkSession, d: str) -> DataFrame:
    triples = nine_triples(spark, d)
    tagged = match_table(triples, patterns_from_events(triples), keep=["seq"])
    return tagged.withColumn("bindings", render_map(F.col("bindings")))


_IDS = "(SELECT unnest(range(9)) AS pattern_id)"
_COUNTS = f"""{_NINE_ROWS}
SELECT CAST(i.pattern_id AS INTEGER) AS pattern_id, count(n.pattern_id) AS n
FROM {_IDS} i LEFT JOIN nine n ON n.pattern_id = i.pattern_id GROUP BY 1"""


@query("snk1_counts", _COUNTS)
def _counts(spark: SparkSession, d: str) -> DataFrame:
    return count_patterns(nine_triples(spark, d), NINE)


@query("snk1_counts_tagged", _COUNTS)
def _counts_tagged(spark: SparkSession, d: str) -> DataFrame:
    tagged = match_each(nine_triples(spark, d), NINE)
    return count_matches(tagged, "pattern_id", range(len(NINE)))


@query(
    "snk2_each",
    f"{_NINE_ROWS} SELECT pattern_id, count(*) AS n FROM nine GROUP BY pattern_id",
)
def _count_each(spark: SparkSession, d: str) -> DataFrame:
    return count_each(match_each(nine_triples(spark, d), NINE))


@query(
    "snk3_packed",
    f"{_NINE_ROWS} SELECT pattern_id, count(*) AS n FROM nine WHERE vars > 0 GROUP BY pattern_id",
)
def _count_packed(spark: SparkSession, d: str) -> DataFrame:
    return count_packed(match_packed(nine_triples(spark, d), NINE))


@query(
    "snk4_timed",
    f"WITH {EVENTS} SELECT subj AS u, obj AS v, true AS is_timed FROM ev WHERE pred = 'signup'",
)
def _timed(spark: SparkSession, d: str) -> DataFrame:
    timed = collect_timed(match(event_triples(spark, d), pattern("?u_signup_?v")))
    return timed.select("u", "v", F.col("received_at").isNotNull().alias("is_timed"))


@query(
    "snk5_render",
    f"WITH {EVENTS} SELECT '{{?p=' || pred || ', ?u=' || subj || ', ?v=' || obj || '}}' AS value FROM ev",
)
def _render(spark: SparkSession, d: str) -> DataFrame:
    return render(match(event_triples(spark, d), pattern("?u_?p_?v")))
