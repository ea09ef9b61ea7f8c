"""The events table followed as a stream; each query ends when all of it is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog.matching import _COUNTS, NINE, _pattern_rows, patterns_from_events
from tripleflow.catalog.ordering import (
    _PAIRS,
    CAPACITY,
    _bounded_sql,
    _threshold_sql,
    subjects_with_objects,
)
from tripleflow.catalog.registry import EVENTS, SQL, query
from tripleflow.functions.text import render_map
from tripleflow.operators.counts import publish
from tripleflow.operators.match import match
from tripleflow.patterns import pattern, patterns
from tripleflow.sources.lines import enqueue_lines, queue_lines, read_lines
from tripleflow.sources.tables import (
    SCHEMAS,
    event_stream,
    event_stream_in_batches,
    event_triples,
    events_as_triples,
    table,
)
from tripleflow.sources.triples import parse_triples, to_lines
from tripleflow.sources.workdir import fresh_folder
from tripleflow.streaming import (
    delta_schema,
    read_count_table,
    read_output,
    run_to_end,
    stream_bgp,
    stream_bgp_delta,
    stream_bounded_join,
    stream_collect,
    stream_count_table,
    stream_match_each,
    stream_match_table,
    stream_pair_up,
    stream_pair_up_obj_subj,
    stream_queries,
    stream_row_counts,
    stream_threshold,
    stream_window_counts,
)


def _collected(df: DataFrame, timed: bool = False) -> DataFrame:
    spark = df.sparkSession
    folder = fresh_folder(spark, "stream")
    run_to_end(stream_collect(df, f"{folder}/rows", f"{folder}/checkpoint", timed))
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query("str1_match", f"WITH {EVENTS} SELECT subj AS u, obj AS v FROM ev WHERE pred = 'click'")
def _stream_match(spark: SparkSession, d: str) -> DataFrame:
    return _collected(match(event_stream(spark, d, 1), pattern("?u_click_?v")))


@query("str1_each", SQL["flt5_each"])
def _stream_each(spark: SparkSession, d: str) -> DataFrame:
    tagged = stream_match_each(event_stream(spark, d, 1, prefix=""), NINE, keep=["seq"])
    return _collected(tagged).withColumn("bindings", render_map(F.col("bindings")))


_JOINED = """FROM ev a JOIN ev b ON a.subj = b.subj AND a.obj = b.obj JOIN ev c ON c.subj = a.subj
WHERE a.pred = 'click' AND b.pred = 'view' AND c.pred = 'purchase'"""
_JOIN_PATTERNS = patterns(["?u_click_?v", "?u_view_?v", "?u_purchase_?w"])


@query("str2_bgp", f"WITH {EVENTS} SELECT a.subj AS u, a.obj AS v, c.obj AS w {_JOINED}")
def _stream_bgp(spark: SparkSession, d: str) -> DataFrame:
    return _collected(stream_bgp(event_stream_in_batches(spark, d), _JOIN_PATTERNS))


@query("str2_delta", f"WITH {EVENTS} SELECT a.subj AS u, a.obj AS v, c.obj AS w {_JOINED}")
def _stream_bgp_delta(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d)
    run_to_end(stream_bgp_delta(events, _JOIN_PATTERNS, folder, buckets=8))
    return read_output(events, folder, delta_schema(_JOIN_PATTERNS))


_STANDING = {
    "bought": _JOIN_PATTERNS,
    "failed": patterns(["?u_error_?w", "?u_view_?w"]),
    "shown": patterns(["?u_click_?v", "?u_view_?v"]),
}


@query(
    "str2_shared_read",
    f"""WITH {EVENTS}
SELECT 'bought' AS query, a.subj AS u, a.obj AS x {_JOINED}
UNION ALL SELECT 'failed', a.subj, a.obj FROM ev a JOIN ev b ON a.subj = b.subj AND a.obj = b.obj
WHERE a.pred = 'error' AND b.pred = 'view'
UNION ALL SELECT 'shown', a.subj, a.obj FROM ev a JOIN ev b ON a.subj = b.subj AND a.obj = b.obj
WHERE a.pred = 'click' AND b.pred = 'view'""",
)
def _stream_shared_read(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d)
    run_to_end(stream_queries(events, _STANDING, folder, buckets=8))
    found = [
        read_output(events, f"{folder}/{name}", delta_schema(pats)).select(
            F.lit(name).alias("query"), "u", F.col("w" if name == "failed" else "v").alias("x")
        )
        for name, pats in _STANDING.items()
    ]
    return reduce(DataFrame.unionAll, found)


@query(
    "str7_changing_patterns",
    f"""{_pattern_rows(EVENTS)}, half AS (SELECT (min(event_id) + max(event_id)) // 2 AS middle FROM events)
SELECT seq, pattern_id, bindings, CAST(CASE WHEN seq <= middle THEN 1 ELSE 2 END AS BIGINT) AS version FROM found, half
WHERE CASE WHEN seq <= middle THEN kind <> 'pred' ELSE kind <> 'user' OR length(subj) <> 2 END""",
)
def _changing_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns by predicate come, and those of users of one digit go, between the halves of the stream."""
    folder = fresh_folder(spark, "stream")
    events = table(spark, d, "events")
    half = events.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]
    pats = patterns_from_events(event_triples(spark, d)).withColumn("removed", F.lit(False))
    by_pred = F.col("pattern_id").startswith("pred:")
    of_one_digit = F.col("pattern_id").startswith("user:") & (F.length("subj") == 2)
    second = pats.where(by_pred).unionByName(pats.where(of_one_digit).withColumn("removed", F.lit(True)))
    later = F.col("event_id") > half
    steps = [(pats.where(~by_pred), events.where(~later)), (second, events.where(later))]
    stream = spark.readStream.schema(SCHEMAS["events"]).option("recursiveFileLookup", "true")
    for version, (changes, rows) in enumerate(steps, start=1):
        changes.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{folder}/log")
        rows.write.parquet(f"{folder}/events/{version}")
        triples = events_as_triples(stream.parquet(f"{folder}/events"))
        run_to_end(stream_match_table(triples, lambda s: s.read.parquet(f"{folder}/log"), folder, ["seq"]))
    schema = "seq bigint, pattern_id string, bindings map<string,string>, version bigint"
    return read_output(triples, folder, schema).withColumn("bindings", render_map(F.col("bindings")))


@query("str3_counts", _COUNTS.replace("LEFT JOIN", "JOIN"))
def _stream_counts(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    tagged = stream_match_each(event_stream_in_batches(spark, d, prefix=""), NINE)
    run_to_end(stream_count_table(tagged, f"{folder}/counts", f"{folder}/checkpoint"))
    return read_count_table(spark, f"{folder}/counts")


@query("str3_counts_listed", _COUNTS)
def _stream_counts_listed(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    tagged = stream_match_each(event_stream_in_batches(spark, d, prefix=""), NINE)
    every = spark.range(len(NINE)).select(F.col("id").cast("int").alias("pattern_id"))
    run_to_end(stream_count_table(tagged, f"{folder}/counts", f"{folder}/checkpoint", listed=every))
    return read_count_table(spark, f"{folder}/counts")


# Errors are stamped with the time twelve days before they arrive.  A row is late when its
# window ended before what the batches up to the last but one had reached.
_WINDOWS = """WITH bounds AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id) + 4) // 4 AS width FROM events),
stamped AS (
  SELECT event_type AS pred, (event_id - low) // width AS batch,
         CASE WHEN event_type = 'error' THEN ts - INTERVAL 12 DAY ELSE ts END AS happened
  FROM events, bounds),
reached AS (
  SELECT batch, max(max(happened)) OVER (ORDER BY batch) - INTERVAL 1 DAY AS mark FROM stamped GROUP BY batch),
dealt AS (
  SELECT s.pred, time_bucket(INTERVAL 6 HOUR, s.happened) AS begun, r.mark
  FROM stamped s LEFT JOIN reached r ON r.batch = s.batch - 2)
SELECT pred, strftime(begun, '%Y-%m-%d %H:%M') AS begun, count(*) AS n FROM dealt
WHERE (mark IS NULL OR begun + INTERVAL 6 HOUR > mark)
  AND begun + INTERVAL 6 HOUR <= (SELECT max(mark) FROM reached)
GROUP BY 1, 2"""


@query("str3_windows", _WINDOWS)
def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    reported = F.when(F.col("pred") == "error", F.col("ts") - F.expr("INTERVAL 12 DAYS")).otherwise(F.col("ts"))
    events = event_stream_in_batches(spark, d).withColumn("ts", reported)
    counts = stream_window_counts(events, "ts", "6 hours", "1 day", ["pred"])
    return _collected(counts).select("pred", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("begun"), "n")


@query("str3_join_counts", f"WITH {EVENTS} SELECT a.subj AS u, count(*) AS n {_JOINED} GROUP BY a.subj")
def _stream_join_counts(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    joined = stream_bgp(event_stream_in_batches(spark, d), _JOIN_PATTERNS)
    run_to_end(stream_row_counts(joined, f"{folder}/partials", f"{folder}/checkpoint", ["u"]))
    partials = spark.read.schema("u string, n bigint").parquet(f"{folder}/partials")
    return partials.groupBy("u").agg(F.sum("n").alias("n"))


@query("str4_bounded_first", _bounded_sql("first", "key", CAPACITY["key"]))
def _stream_bounded_first(spark: SparkSession, d: str) -> DataFrame:
    return _stream_bounded(spark, d, "first")


@query("str4_bounded_latest", _bounded_sql("latest", "key", CAPACITY["key"]))
def _stream_bounded_latest(spark: SparkSession, d: str) -> DataFrame:
    return _stream_bounded(spark, d, "latest")


@query("str4_bounded_first_per_stream", _bounded_sql("first", "stream", CAPACITY["stream"]))
def _stream_bounded_first_per_stream(spark: SparkSession, d: str) -> DataFrame:
    return _stream_bounded(spark, d, "first", "stream")


@query("str4_bounded_latest_per_stream", _bounded_sql("latest", "stream", CAPACITY["stream"]))
def _stream_bounded_latest_per_stream(spark: SparkSession, d: str) -> DataFrame:
    return _stream_bounded(spark, d, "latest", "stream")


def _stream_bounded(spark: SparkSession, d: str, retain: str, per: str = "key") -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d)
    clicks = match(events, pattern("?u_click_?v"), keep=["seq"])
    views = match(events, pattern("?u_view_?w"), keep=["seq"])
    run_to_end(
        stream_bounded_join(clicks, views, ["u"], folder, "seq", CAPACITY[per], retain, per=per, buckets=8)
    )
    schema = "u string, v string, w string, left_seq bigint, right_seq bigint"
    return read_output(events, folder, schema)


@query("str5_pair_up", _PAIRS)
def _stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d).select("subj", "seq")
    run_to_end(stream_pair_up(events, "subj", folder, buckets=8))
    return read_output(events, folder, "subj string, seq bigint")


@query("str5_pair_up_obj_subj", SQL["jn8_obj_subj"])
def _stream_obj_subj(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d)
    run_to_end(stream_pair_up_obj_subj(subjects_with_objects(events), folder, buckets=8))
    return read_output(events, folder, "letter string, seq bigint")


@query("str5_threshold", f"{_threshold_sql(10)} SELECT subj, seq FROM reached")
def _stream_threshold(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    events = event_stream_in_batches(spark, d)
    run_to_end(stream_threshold(events, "subj", "obj", folder, buckets=8))
    return read_output(events, folder, "subj string, seq bigint")


@query(
    "str6_publish",
    f"WITH {EVENTS} SELECT '{{?u=' || subj || ', ?v=' || obj || '}}' AS line FROM ev WHERE pred = 'view'",
)
def _stream_publish(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_folder(spark, "stream")
    views = match(event_stream_in_batches(spark, d), pattern("?u_view_?v"))
    run_to_end(publish(views, f"{folder}/lines", f"{folder}/checkpoint"))
    return read_lines(spark, f"{folder}/lines")


@query("src8_queue", f"WITH {EVENTS} SELECT subj, pred, obj FROM ev")
def _queue(spark: SparkSession, d: str) -> DataFrame:
    """All events go through a queue folder in three messages and come back as triples."""
    folder = fresh_folder(spark, "queue")
    events = event_triples(spark, d)
    for k in range(3):
        enqueue_lines(to_lines(events.where(F.col("seq") % 3 == k)), folder, str(k))
    return _collected(parse_triples(queue_lines(spark, folder, files_per_batch=1)))
