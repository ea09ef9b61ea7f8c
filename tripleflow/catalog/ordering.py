"""Order-dependent correlation, aggregates and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.registry import EVENTS, query
from tripleflow.operators.aggregate import (
    anova_oneway,
    first_and_last,
    means_by,
    numeric_mean,
    rollup_partials,
    sort_by_leading_number,
)
from tripleflow.operators.correlate import (
    bounded_join,
    bounded_multi_join,
    pair_up,
    pair_up_obj_subj,
    threshold_reached,
)
from tripleflow.operators.match import match
from tripleflow.patterns import pattern
from tripleflow.sources.tables import event_triples, table

CAPACITY = {"key": 5, "stream": 50}
# Small enough that large keys are cut into stretches on the test tables too.
SPLIT = 1_000


def _bounded_sql(retain: str, per: str, capacity: int) -> str:
    part = "PARTITION BY u " if per == "key" else ""
    if retain == "first":
        left_kept = f"(l.nl < {capacity} OR l.nl = r.nl)"
        right_kept = f"(r.nr < {capacity} OR r.nr = l.nr)"
    else:
        left_kept, right_kept = f"l.nl > r.nl - {capacity}", f"r.nr > l.nr - {capacity}"
    return f"""WITH {EVENTS},
both_sides AS (
  SELECT subj AS u, obj AS v, seq, pred = 'click' AS is_left FROM ev WHERE pred IN ('click', 'view')),
numbered AS (
  SELECT *, sum(CASE WHEN is_left THEN 1 ELSE 0 END) OVER ({part}ORDER BY seq) AS nl,
            sum(CASE WHEN is_left THEN 0 ELSE 1 END) OVER ({part}ORDER BY seq) AS nr
  FROM both_sides)
SELECT l.u AS u, l.v AS v, r.v AS w, l.seq AS left_seq, r.seq AS right_seq
FROM numbered l JOIN numbered r ON l.u = r.u AND l.is_left AND NOT r.is_left
WHERE (l.seq < r.seq AND {left_kept}) OR (r.seq < l.seq AND {right_kept})"""


def clicks_and_views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = event_triples(spark, d)
    return (
        match(events, pattern("?u_click_?v"), keep=["seq"]),
        match(events, pattern("?u_view_?w"), keep=["seq"]),
    )


def _register_bounded(retain: str, per: str) -> None:
    capacity = CAPACITY[per]

    @query(f"jn6_bounded_{retain}_per_{per}", _bounded_sql(retain, per, capacity))
    def _bounded(spark: SparkSession, d: str) -> DataFrame:
        left, right = clicks_and_views(spark, d)
        return bounded_join(left, right, ["u"], "seq", capacity, retain, per, split_rows=SPLIT)


for _retain in ("first", "latest"):
    for _per in ("key", "stream"):
        _register_bounded(_retain, _per)


def _multi_sql(retain: str, per: str, capacity: int) -> str:
    """Three sides: every two rows of a combination that the latest row still meets in memory."""
    part = "PARTITION BY u " if per == "key" else ""

    def held(row: str, by: str, n: str) -> str:
        kept = f"({row}.{n} < {capacity} OR {row}.{n} = {by}.{n})" if retain == "first" else f"{row}.{n} > {by}.{n} - {capacity}"
        return f"{row}.seq < {by}.seq AND {kept}"

    own = {"a": "n1", "b": "n2", "c": "n3"}
    latest = " OR ".join(
        "(" + " AND ".join(held(row, by, own[row]) for row in own if row != by) + ")" for by in own
    )
    return f"""WITH {EVENTS},
sides AS (SELECT subj AS u, obj AS v, seq, pred FROM ev WHERE pred IN ('click', 'view', 'purchase')),
numbered AS (SELECT *, count(*) FILTER (pred = 'click') OVER ({part}ORDER BY seq) AS n1,
  count(*) FILTER (pred = 'view') OVER ({part}ORDER BY seq) AS n2,
  count(*) FILTER (pred = 'purchase') OVER ({part}ORDER BY seq) AS n3 FROM sides)
SELECT a.u AS u, a.v AS v, b.v AS w, c.v AS x, a.seq AS seq_1, b.seq AS seq_2, c.seq AS seq_3
FROM numbered a JOIN numbered b ON a.u = b.u AND b.pred = 'view' JOIN numbered c ON a.u = c.u AND c.pred = 'purchase'
WHERE a.pred = 'click' AND ({latest})"""


def _register_multi(retain: str, per: str) -> None:
    capacity = {"key": 3, "stream": 40}[per]

    @query(f"jn6_multi_{retain}_per_{per}", _multi_sql(retain, per, capacity))
    def _multi(spark: SparkSession, d: str) -> DataFrame:
        events = event_triples(spark, d)
        sides = [
            match(events, pattern(p), keep=["seq"]) for p in ("?u_click_?v", "?u_view_?w", "?u_purchase_?x")
        ]
        return bounded_multi_join(sides, ["u"], "seq", capacity, retain, per, split_rows=SPLIT)


for _retain in ("first", "latest"):
    for _per in ("key", "stream"):
        _register_multi(_retain, _per)


_PAIRS = f"""WITH {EVENTS}, numbered AS (
  SELECT subj, seq, row_number() OVER (PARTITION BY subj ORDER BY seq) AS nth FROM ev)
SELECT subj, seq FROM numbered WHERE nth % 2 = 0"""


@query("jn7_pair_up", _PAIRS)
def _pair_up(spark: SparkSession, d: str) -> DataFrame:
    return pair_up(event_triples(spark, d).select("subj", "seq"), "subj")


@query(
    "jn7_pair_up_hot_keys",
    f"""WITH {EVENTS}, numbered AS (
  SELECT pred, seq, row_number() OVER (PARTITION BY pred ORDER BY seq) AS nth FROM ev)
SELECT pred, seq FROM numbered WHERE nth % 2 = 0""",
)
def _pair_up_hot(spark: SparkSession, d: str) -> DataFrame:
    # Five predicates share all events, so every key is large.
    return pair_up(event_triples(spark, d).select("pred", "seq"), "pred", split_rows=SPLIT)


def subjects_with_objects(events: DataFrame) -> DataFrame:
    """Event triples whose errors have no object, so that the subject stands in."""
    return events.select(
        "subj", "seq", F.when(F.col("pred") != "error", F.col("obj")).alias("obj")
    )


@query(
    "jn8_obj_subj",
    f"""WITH {EVENTS}, lettered AS (
  SELECT seq, coalesce(CASE WHEN pred <> 'error' THEN obj END, subj) AS letter FROM ev), numbered AS (
  SELECT letter, seq, row_number() OVER (PARTITION BY letter ORDER BY seq) AS nth FROM lettered)
SELECT letter, seq FROM numbered WHERE nth % 2 = 0""",
)
def _obj_subj(spark: SparkSession, d: str) -> DataFrame:
    return pair_up_obj_subj(subjects_with_objects(event_triples(spark, d)))


def _threshold_sql(n: int) -> str:
    return f"""WITH {EVENTS}, flagged AS (
  SELECT subj, obj, seq, row_number() OVER (PARTITION BY subj ORDER BY seq) AS nth,
         CASE WHEN row_number() OVER (PARTITION BY subj, obj ORDER BY seq) = 1 THEN 1 ELSE 0 END AS is_new
  FROM ev), counted AS (
  SELECT subj, seq, nth, sum(is_new) OVER (PARTITION BY subj ORDER BY seq) AS values_so_far FROM flagged),
reached AS (SELECT subj, seq FROM counted WHERE values_so_far = {n} AND nth > 1)"""


@query("jn9_threshold", f"{_threshold_sql(10)} SELECT subj, seq FROM reached")
def _threshold(spark: SparkSession, d: str) -> DataFrame:
    return threshold_reached(event_triples(spark, d), "subj", "obj")


@query("jn9_threshold_one", f"{_threshold_sql(1)} SELECT subj, seq FROM reached")
def _threshold_one(spark: SparkSession, d: str) -> DataFrame:
    return threshold_reached(event_triples(spark, d), "subj", "obj", n=1)


@query(
    "jn9_threshold_once",
    f"{_threshold_sql(10)} SELECT subj, min(seq) AS seq FROM reached GROUP BY subj",
)
def _threshold_once(spark: SparkSession, d: str) -> DataFrame:
    return threshold_reached(event_triples(spark, d), "subj", "obj", once=True)


def counter_lines(spark: SparkSession, d: str) -> DataFrame:
    events = event_triples(spark, d, prefix="")
    reported = F.concat(
        F.lit("CounterTerminal"), "subj", F.lit(": partialCount="), "obj"
    )
    return events.select(
        F.when(F.col("pred") == "error", F.concat(F.lit("no count for "), "subj"))
        .otherwise(reported)
        .alias("line")
    )


@query(
    "agg1_rollup",
    """SELECT user_id AS id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup_partials(counter_lines(spark, d))


def number_lines(spark: SparkSession, d: str) -> DataFrame:
    """Event values as text lines per user; errors are no numbers."""
    events = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.lit("x")).otherwise(F.col("value").cast("string"))
    name = F.concat(F.lit("summary_"), F.col("user_id").cast("string"))
    return events.select(name.alias("file"), text.alias("line"))


@query(
    "agg2_mean",
    """SELECT round(avg(value), 3) AS mean FROM events WHERE event_type <> 'error'""",
)
def _mean(spark: SparkSession, d: str) -> DataFrame:
    return numeric_mean(number_lines(spark, d))


@query(
    "agg3_means_by_file",
    """SELECT 'summary_' || user_id AS file,
  round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), 'NaN'::DOUBLE), 3) AS mean
FROM events GROUP BY user_id""",
)
def _means_by_file(spark: SparkSession, d: str) -> DataFrame:
    return means_by(number_lines(spark, d)).select("file", "mean")


_ANOVA = """WITH g AS (
  SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, var_pop(l_quantity) * count(*) AS inside
  FROM lineitem GROUP BY l_returnflag), t AS (
  SELECT sum(n * mean) / sum(n) AS grand FROM g), s AS (
  SELECT count(*) AS k, sum(n) AS total, sum(inside) AS sw, sum(n * pow(mean - grand, 2)) AS sb FROM g, t)"""


@query(
    "agg4_anova",
    f"""{_ANOVA}, f AS (
  SELECT (sb / (k - 1)) / (sw / (total - k)) AS f, k - 1 AS dfb, total - k AS dfw FROM s)
SELECT round(f, 6) AS f, CAST(dfb AS BIGINT) AS df_between, CAST(dfw AS BIGINT) AS df_within,
       round(pow(1 + 2 * f / dfw, -dfw / 2.0), 6) AS p
FROM f""",
)
def _anova(spark: SparkSession, d: str) -> DataFrame:
    # With three groups the tail of F has the closed form the check uses.
    result = anova_oneway(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return result.select(
        F.round("f", 6).alias("f"), "df_between", "df_within", F.round("p", 6).alias("p")
    )


def mean_lines(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    text = F.format_string("%d %s", F.floor("value"), F.col("event_type"))
    return events.select(F.col("event_id").alias("pos"), text.alias("line"))


_RANKED = """SELECT event_id AS pos, CAST(floor(value) AS BIGINT) || ' ' || event_type AS line,
  row_number() OVER (ORDER BY floor(value), event_id) AS place FROM events"""


@query("ord1_ranked", _RANKED)
def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return sort_by_leading_number(mean_lines(spark, d), "pos", rank="place", split_rows=100)


@query(
    "ord1_order",
    "SELECT event_id AS pos, CAST(floor(value) AS BIGINT) || ' ' || event_type AS line FROM events",
)
def _order(spark: SparkSession, d: str) -> DataFrame:
    return sort_by_leading_number(mean_lines(spark, d), "pos")


@query(
    "ord2_first_last",
    f"""WITH {EVENTS}
SELECT subj AS file, arg_min(pred || ' ' || obj, seq) FILTER (pred = 'signup') AS first,
       arg_max(pred || ' ' || obj, seq) FILTER (pred = 'click') AS last
FROM ev GROUP BY subj""",
)
def _first_last(spark: SparkSession, d: str) -> DataFrame:
    events = event_triples(spark, d)
    lines = events.select(
        F.col("subj").alias("file"), F.col("seq").alias("pos"), F.concat_ws(" ", "pred", "obj").alias("line")
    )
    started, clicked = F.col("line").startswith("signup"), F.col("line").startswith("click")
    return first_and_last(lines, "file", "pos", started, clicked)
