"""Sources, parsing and generated triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.registry import EVENTS, UNIVERSE, query
from tripleflow.operators.counts import publish
from tripleflow.operators.match import match
from tripleflow.patterns import pattern
from tripleflow.sources.lines import clean_lines, read_lines
from tripleflow.sources.tables import event_triples, table
from tripleflow.sources.triples import (
    kv_triples,
    parse_kv,
    parse_triples,
    parse_words,
    parse_words_int,
    triple_universe,
    validate_triples,
)
from tripleflow.sources.workdir import fresh_folder

_TRIM = "'^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'"


@query(
    "src1_lines",
    f"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents),
trimmed AS (SELECT doc_id, regexp_replace(line, {_TRIM}) AS line FROM pieces)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, max(line) AS last_line
FROM trimmed WHERE length(line) > 0 GROUP BY doc_id
""",
)
def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = clean_lines(table(spark, d, "documents").select("doc_id", "text"), "text")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).cast("bigint").alias("n_chars"),
        F.max("line").alias("last_line"),
    )


def odd_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as triple lines: signups with stray delimiters, errors cut short, views too long."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    whole = F.floor("value").cast("bigint").cast("string")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.concat(F.lit("_U"), user, F.lit("__"), kind, F.lit("_"), whole, F.lit("_")))
        .when(kind == "error", F.concat(F.lit("U"), user, F.lit("_"), kind))
        .when(kind == "view", F.concat(F.lit("U"), user, F.lit("_"), kind, F.lit("_"), whole, F.lit("_x")))
        .otherwise(F.concat(F.lit("U"), user, F.lit("_"), kind, F.lit("_"), whole))
        .alias("line"),
    )


_ODD = """odd AS (
  SELECT event_id AS seq, CASE event_type
    WHEN 'signup' THEN '_U' || user_id || '__' || event_type || '_' || CAST(floor(value) AS BIGINT) || '_'
    WHEN 'error' THEN 'U' || user_id || '_' || event_type
    WHEN 'view' THEN 'U' || user_id || '_' || event_type || '_' || CAST(floor(value) AS BIGINT) || '_x'
    ELSE 'U' || user_id || '_' || event_type || '_' || CAST(floor(value) AS BIGINT) END AS line
  FROM events),
cut AS (SELECT seq, line, list_filter(string_split(line, '_'), lambda x: x <> '') AS parts FROM odd)"""


@query(
    "src2_parse",
    f"WITH {_ODD} SELECT seq, parts[1] AS subj, parts[2] AS pred, parts[3] AS obj FROM cut WHERE len(parts) = 3",
)
def _parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_triples(odd_lines(spark, d), mode="quarantine")[0]


@query("src2_quarantine", f"WITH {_ODD} SELECT seq, line FROM cut WHERE len(parts) <> 3")
def _quarantine(spark: SparkSession, d: str) -> DataFrame:
    return parse_triples(odd_lines(spark, d), mode="quarantine")[1]


@query(
    "src2_strict",
    f"""WITH {EVENTS} SELECT seq, subj, pred, obj FROM ev""",
)
def _strict(spark: SparkSession, d: str) -> DataFrame:
    rows = event_triples(spark, d)
    lines = rows.select("seq", F.concat_ws("_", "subj", "pred", "obj").alias("line"))
    return parse_triples(lines)


@query(
    "src3_validate",
    f"WITH {_ODD} SELECT len(parts) = 3 AS is_triple, count(*) AS n FROM cut GROUP BY 1",
)
def _validate(spark: SparkSession, d: str) -> DataFrame:
    return validate_triples(odd_lines(spark, d))


@query(
    "src4_words",
    f"WITH {EVENTS} SELECT seq, subj, obj FROM ev WHERE pred = 'purchase'",
)
def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = event_triples(spark, d)
    lines = rows.select("seq", F.concat_ws(" ", "subj", "pred", "obj").alias("line"))
    return parse_words(lines, "purchase")


@query(
    "src5_words_int",
    f"WITH {EVENTS} SELECT seq, subj FROM ev WHERE CAST(obj AS INTEGER) = 12",
)
def _words_int(spark: SparkSession, d: str) -> DataFrame:
    rows = event_triples(spark, d)
    return parse_words_int(rows.select("seq", F.concat_ws(" ", "subj", "obj").alias("line")), 12)


@query("src6_universe", f"WITH {UNIVERSE} SELECT subj, pred, obj FROM uni")
def _universe(spark: SparkSession, d: str) -> DataFrame:
    return triple_universe(spark, table(spark, d, "part").select("p_partkey"))


@query(
    "src7_kv",
    """
SELECT s.subj, 'foo' AS pred, CAST(p_partkey AS VARCHAR) AS obj
FROM part, (VALUES ('a'), ('b'), ('c'), ('d')) s(subj)
""",
)
def _kv(spark: SparkSession, d: str) -> DataFrame:
    return parse_kv(kv_triples(spark, table(spark, d, "part").select("p_partkey")))


@query(
    "snk5_publish",
    f"WITH {EVENTS} SELECT '{{?u=' || subj || ', ?v=' || obj || '}}' AS line FROM ev WHERE pred = 'purchase'",
)
def _publish(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "published")
    publish(match(event_triples(spark, d), pattern("?u_purchase_?v")), folder)
    return read_lines(spark, folder)
