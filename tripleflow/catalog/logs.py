"""Run logs: the events written out as the lines a run of each user would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.registry import query
from tripleflow.operators import runlogs
from tripleflow.sources.tables import table

# One file per user; ten users make an experiment.  Signups start a run, clicks acknowledge,
# errors throw, views open a result, purchases report a count.  Each user also announces the
# count to expect, which leaves out purchases of 150 and more, so some runs are not in order.
_FILE = "'nodes' || (user_id // 10) || '-' || user_id"
_LOGS = f"""logs AS (
  SELECT {_FILE} AS file, event_id AS pos, CASE event_type
    WHEN 'signup' THEN (event_id * 1000) || ' main "startup"'
    WHEN 'click' THEN (event_id * 1000) || ' Acking message ' || CAST(floor(value) AS BIGINT)
    WHEN 'error' THEN CASE WHEN value < 20 THEN 'java.lang.RuntimeException: value' ELSE 'Emit FAILED once' END
    WHEN 'view' THEN CASE WHEN value > 100 THEN '<result>' ELSE 'Results_OK' END
    ELSE 'CounterTerminal0: partialCount=' || CAST(floor(value) AS BIGINT) END AS line
  FROM events
  UNION ALL
  SELECT {_FILE}, -1, 'ExpectedResultSize0=' || CAST(sum(CASE WHEN event_type = 'purchase' AND value < 150
    THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT)
  FROM events GROUP BY user_id)"""


def run_logs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    ms = (F.col("event_id") * 1000).cast("string")
    whole = F.floor("value").cast("bigint")
    kind = F.col("event_type")
    name = F.concat(
        F.lit("nodes"), F.floor(F.col("user_id") / 10).cast("string"), F.lit("-"), F.col("user_id").cast("string")
    )
    line = (
        F.when(kind == "signup", F.concat(ms, F.lit(' main "startup"')))
        .when(kind == "click", F.concat(ms, F.lit(" Acking message "), whole.cast("string")))
        .when((kind == "error") & (F.col("value") < 20), F.lit("java.lang.RuntimeException: value"))
        .when(kind == "error", F.lit("Emit FAILED once"))
        .when((kind == "view") & (F.col("value") > 100), F.lit("<result>"))
        .when(kind == "view", F.lit("Results_OK"))
        .otherwise(F.concat(F.lit("CounterTerminal0: partialCount="), whole.cast("string")))
    )
    lines = events.select(name.alias("file"), F.col("event_id").alias("pos"), line.alias("line"))
    counted = F.when((kind == "purchase") & (F.col("value") < 150), whole).otherwise(F.lit(0))
    announced = events.groupBy(name.alias("file")).agg(F.sum(counted).alias("_n")).select(
        "file",
        F.lit(-1).cast("bigint").alias("pos"),
        F.concat(F.lit("ExpectedResultSize0="), F.col("_n").cast("string")).alias("line"),
    )
    return lines.unionByName(announced)


_SPAN = """span AS (
  SELECT file, arg_min(CAST(split_part(line, ' ', 1) AS BIGINT), pos) FILTER (line LIKE '%"startup"%') AS first_emit,
         arg_max(CAST(split_part(line, ' ', 1) AS BIGINT), pos) FILTER (line LIKE '%Acking%') AS last_ack
  FROM logs WHERE line LIKE '%"startup"%' OR line LIKE '%Acking%' GROUP BY file)"""
_CHECK = """got AS (
  SELECT file, sum(CAST(split_part(line, '=', 2) AS BIGINT)) AS total FROM logs
  WHERE line LIKE 'CounterTerminal0: partialCount%' GROUP BY file),
want AS (
  SELECT file, CAST(split_part(line, '=', 2) AS BIGINT) AS expected FROM logs WHERE line LIKE 'ExpectedResultSize0=%'),
verdicts AS (
  SELECT want.file AS file, CASE WHEN total = expected THEN 1 ELSE 0 END AS n_correct
  FROM want LEFT JOIN got ON got.file = want.file)"""


@query(
    "log1_span",
    f"WITH {_LOGS}, {_SPAN} SELECT file, first_emit, last_ack, (last_ack - first_emit) / 1000.0 AS seconds FROM span",
)
def _span(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.run_span(run_logs(spark, d))


@query(
    "log1_event_span",
    """SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS started,
  max(event_id) FILTER (event_type = 'click') AS ended,
  max(event_id) FILTER (event_type = 'click') - min(event_id) FILTER (event_type = 'signup') AS span
FROM events GROUP BY user_id""",
)
def _event_span(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return runlogs.first_last_span(
        table(spark, d, "events"), "user_id", kind == "signup", kind == "click", "event_id"
    )


@query("log2_exceptions", f"WITH {_LOGS} SELECT file, pos, line FROM logs WHERE line LIKE '%Exception%'")
def _exceptions(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.exception_lines(run_logs(spark, d))


_BLOCK = f"""WITH {_LOGS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS line_no FROM logs), opened AS (
  SELECT *, max(CASE WHEN line LIKE '%<result%' THEN line_no END) OVER (PARTITION BY file ORDER BY pos) AS opened_at FROM numbered)
SELECT file, pos, line FROM opened WHERE line_no - opened_at <= 3"""


@query("log3_block", _BLOCK)
def _block(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.result_block(run_logs(spark, d), 2)


@query(
    "log4_check",
    f"""WITH {_LOGS}, {_CHECK}
SELECT file, CAST(n_correct AS BIGINT) AS n_correct,
       CASE n_correct WHEN 1 THEN 'results OK' ELSE 'results are NOT ok!' END AS verdict FROM verdicts""",
)
def _check(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.result_check(run_logs(spark, d), 1)


@query(
    "log4_totals",
    f"""WITH {_LOGS}, {_CHECK} SELECT file, CAST(0 AS BIGINT) AS id, CAST(total AS BIGINT) AS total FROM got""",
)
def _totals(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.counter_totals(run_logs(spark, d))


@query(
    "log5_latencies",
    """SELECT 'summary_' || user_id AS file, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS line
FROM events WHERE event_type = 'click'""",
)
def _latencies(spark: SparkSession, d: str) -> DataFrame:
    whole = F.floor("value").cast("bigint").cast("string")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("lastack-firstemit="), whole))
    summaries = table(spark, d, "events").select(
        F.concat(F.lit("summary_"), F.col("user_id").cast("string")).alias("file"),
        text.otherwise(F.concat(F.lit("ITERATION="), whole)).alias("line"),
    )
    return runlogs.latencies(summaries)


@query("log6_failed", f"WITH {_LOGS} SELECT DISTINCT file FROM logs WHERE lower(line) LIKE '%fail%'")
def _failed(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.failed_files(run_logs(spark, d))


@query(
    "log7_by_experiment",
    f"""WITH {_LOGS}, {_SPAN}, {_CHECK}, trouble AS (
  SELECT file, count(*) FILTER (line LIKE '%Exception%') AS n_exceptions FROM logs GROUP BY file)
SELECT split_part(t.file, '-', 1) AS experiment, t.file AS file,
       (last_ack - first_emit) / 1000.0 AS seconds, n_exceptions,
       CAST(n_correct AS BIGINT) AS n_correct,
       CASE n_correct WHEN 1 THEN 'results OK' ELSE 'results are NOT ok!' END AS verdict
FROM trouble t LEFT JOIN span ON span.file = t.file LEFT JOIN verdicts v ON v.file = t.file""",
)
def _by_experiment(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.summarise_by_experiment(run_logs(spark, d), 1)


@query("log8_ok", f"WITH {_LOGS} SELECT file, pos, line FROM logs WHERE line LIKE '%Results_OK%'")
def _ok(spark: SparkSession, d: str) -> DataFrame:
    return runlogs.ok_marker(run_logs(spark, d))
