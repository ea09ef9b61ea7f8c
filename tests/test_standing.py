"""Patterns as a table, queries over one read of a stream, windows of event time."""

import glob
import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import as_stream, bag
from tripleflow.functions.text import render_map
from tripleflow.operators.match import match_each
from tripleflow.operators.pattern_table import match_table, patterns_at
from tripleflow.patterns import DEFAULT_QUERY, patterns
from tripleflow.plans.bgp import bgp
from tripleflow.sources.lines import enqueue_lines, queue_lines
from tripleflow.sources.tables import event_triples
from tripleflow.sources.triples import triple_universe
from tripleflow.sources.workdir import fresh_folder
from tripleflow.streaming import (
    delta_schema,
    read_count_table,
    read_output,
    run_to_end,
    stream_collect,
    stream_count_table,
    stream_match_each,
    stream_match_table,
    stream_queries,
    stream_window_counts,
)

LOG = "pattern_id string, version bigint, subj string, pred string, obj string, removed boolean"
EVERY_KIND = [
    "A_p_1", "A_p_?x", "A_?x_1", "?x_p_1", "A_?x_?y", "?x_p_?y", "?x_?y_1", "?x_?y_?z",
    "A_?x_?x", "?x_p_?x", "?x_?x_1", "?x_?x_?x", "?x_?x_?y", "?x_?y_?x", "?y_?x_?x", "?a_p_?b",
]


def rendered(df):
    return bag(df.withColumn("bindings", render_map(F.col("bindings"))))


def pattern_rows(spark, pats):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pats)], "pattern_id int, subj string, pred string, obj string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_every_kind_of_pattern(spark, limit):
    parts = ["A", "p", "1"]
    triples = spark.createDataFrame([(s, p, o) for s in parts for p in parts for o in parts] * 2 + [("A", None, "1")], "subj string, pred string, obj string")
    pats = patterns(EVERY_KIND)
    table = pattern_rows(spark, pats).unionByName(spark.createDataFrame([(99, "?x", None, "1")], "pattern_id int, subj string, pred string, obj string"))
    got = match_table(triples.where("pred IS NOT NULL"), table, broadcast_bytes=limit)
    assert rendered(got) == rendered(match_each(triples.where("pred IS NOT NULL"), pats))
    # A NULL part of a triple equals no constant.
    odd = {r["pattern_id"] for r in match_table(triples.where("pred IS NULL"), table).collect()}
    assert odd <= {i for i, p in enumerate(pats) if p[1].startswith("?")}


def test_empty_pattern_table(spark):
    triples = triple_universe(spark, 2)
    assert match_table(triples, pattern_rows(spark, patterns(["?x_foo_?y"])).where("false")).count() == 0


def test_ten_thousand_patterns(spark):
    triples = spark.range(20_000).selectExpr("concat('s', id) AS subj", "'p' AS pred", "cast(id % 7 AS string) AS obj", "id")
    table = spark.range(10_000).selectExpr("id AS pattern_id", "concat('s', 2 * id) AS subj", "'?p' AS pred", "'?o' AS obj")
    got = match_table(triples, table, keep=["id"])
    assert got.where("id = 2 * pattern_id").count() == got.count() == 10_000


def test_patterns_at_a_version(spark):
    log = spark.createDataFrame(
        [("a", 1, "?x", "p", "?y", None), ("b", 1, "?x", "q", "?y", False), ("a", 2, "?x", "p", "1", False),
         ("b", 3, "?x", "q", "?y", True), ("b", 5, "?x", "r", "?y", False)], LOG)

    def at(version):
        return {tuple(r) for r in patterns_at(log, version).collect()}

    a1, b1, a2 = ("a", "?x", "p", "?y"), ("b", "?x", "q", "?y"), ("a", "?x", "p", "1")
    assert [at(v) for v in (None, 0, 1, 2, 3, 4)] == [set(), set(), {a1, b1}, {a2, b1}, {a2}, {a2}]
    assert at(9) == {a2, ("b", "?x", "r", "?y")}


def _run_changing(spark, place, folder, n, rows, changes):
    spark.createDataFrame(rows, "subj string, pred string, obj string").coalesce(1).write.parquet(f"{place}/{n}")
    if changes:
        spark.createDataFrame(changes, LOG).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema("subj string, pred string, obj string").option("recursiveFileLookup", "true").parquet(place)
    run_to_end(stream_match_table(stream, lambda s: s.read.schema(LOG).parquet(f"{folder}/log"), folder))
    schema = "pattern_id string, bindings map<string,string>, version bigint"
    out = read_output(stream, folder, schema).withColumn("bindings", render_map(F.col("bindings")))
    return Counter((r["pattern_id"], r["bindings"], r["version"]) for r in out.collect())


def test_patterns_come_and_go_while_a_stream_runs(spark):
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    rows = [("A", "p", "1"), ("A", "q", "1")]
    first = [("a", 1, "?x", "p", "?y", False)]
    second = [("a", 2, "?x", "p", "?y", True), ("b", 2, "?x", "q", "?y", False)]
    spark.createDataFrame([], LOG).write.parquet(f"{folder}/log")
    assert not _run_changing(spark, place, folder, 0, rows, [])
    one = ("a", "{?x=A, ?y=1}", 1)
    assert _run_changing(spark, place, folder, 1, rows, first) == Counter([one])
    two = ("b", "{?x=A, ?y=1}", 2)
    assert _run_changing(spark, place, folder, 2, rows, second) == Counter([one, two])
    # A batch that is repeated keeps the version it began with.
    for name in ("2", ".2.crc"):
        os.remove(f"{folder}/checkpoint/commits/{name}")
    third = [("b", 3, "?x", "q", "?y", True)]
    assert _run_changing(spark, place, folder, 3, rows, third) == Counter([one, two])


def test_queries_share_one_read(spark):
    n = 6
    universe = triple_universe(spark, n)
    stream = as_stream(universe, fresh_folder(spark, "source"))
    folder = fresh_folder(spark, "out")
    queries = {"all": patterns(DEFAULT_QUERY), "two": patterns(["?s_foo_?o", "?s_bar_?o"]), "same": patterns(["?a_foo_?a2", "B_?p_2"])}
    running = stream_queries(stream, queries, folder, buckets=4, allow_cross=True)
    run_to_end(running)
    progress = running.recentProgress
    assert all(len(p.sources) == 1 for p in progress)
    assert sum(p.numInputRows for p in progress) == 6 * n
    for name, pats in queries.items():
        got = read_output(stream, f"{folder}/{name}", delta_schema(pats))
        assert bag(got) == bag(bgp(universe, pats, allow_cross=True))
    with pytest.raises(ValueError):
        stream_queries(stream, {}, fresh_folder(spark, "out"))


def test_counts_with_listed_ids_and_versions(spark, small):
    events = event_triples(spark, small)
    pats = patterns(["?u_click_?v", "?u_nosuch_?v", "?u_view_?v"])
    folder = fresh_folder(spark, "out")
    tagged = stream_match_each(as_stream(events, fresh_folder(spark, "source"), "seq"), pats)
    every = spark.range(len(pats)).selectExpr("cast(id AS int) AS pattern_id")
    run_to_end(stream_count_table(tagged, f"{folder}/n", f"{folder}/checkpoint", listed=every))
    got = {r["pattern_id"]: r["n"] for r in read_count_table(spark, f"{folder}/n").collect()}
    assert got == {0: events.where("pred = 'click'").count(), 1: 0, 2: events.where("pred = 'view'").count()}
    assert len([p for p in os.listdir(f"{folder}/n") if p.startswith("version=")]) == 2


def test_windows_close_once_and_drop_late_rows(spark):
    """Each run ends with an empty batch that closes windows, up to 10:50, 12:50 and 14:50."""
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    day = datetime(2024, 1, 1)
    batches = [
        [("a", 9, 10), ("a", 10, 5), ("b", 11, 0)],
        [("a", 9, 30), ("a", 10, 20), ("b", 13, 0)],   # 9:30 is late, 10:20 is not
        [("a", 9, 40), ("a", 11, 30), ("b", 15, 0)],   # both are late
    ]
    for n, rows in enumerate(batches):
        timed = [(k, day + timedelta(hours=h, minutes=m)) for k, h, m in rows]
        spark.createDataFrame(timed, "k string, at timestamp").coalesce(1).write.parquet(f"{place}/{n}")
        stream = spark.readStream.schema("k string, at timestamp").option("recursiveFileLookup", "true").parquet(place)
        counts = stream_window_counts(stream, "at", "1 hour", "10 minutes", ["k"])
        run_to_end(stream_collect(counts, f"{folder}/rows", f"{folder}/checkpoint"))
    got = {(r["k"], r["window_start"].hour): r["n"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {("a", 9): 1, ("a", 10): 2, ("b", 11): 1, ("b", 13): 1}
    assert spark.read.parquet(f"{folder}/rows").count() == len(got)


def test_windows_of_a_table(spark):
    rows = [("a", datetime(2024, 1, 1, h)) for h in (0, 1, 5)]
    counts = stream_window_counts(spark.createDataFrame(rows, "k string, at timestamp"), "at", "2 hours", "1 hour", slide="1 hour")
    assert sorted(r["n"] for r in counts.collect()) == [1, 1, 1, 1, 2]


def test_a_queue_is_emptied_after_commits_and_delivers_each_line_once(spark):
    """The second batch fails once; its files are still there and come again."""
    folder, out = fresh_folder(spark, "queue"), fresh_folder(spark, "out")
    lines = [f"A_foo_{i}" for i in range(6)]
    for k in range(3):
        part = spark.createDataFrame([(x,) for x in lines[2 * k:2 * k + 2]], "line string").coalesce(1)
        enqueue_lines(part, folder, str(k))
        enqueue_lines(part, folder, str(k))  # a repeated step changes nothing
    failures = []

    def run(fail_at):
        def on_batch(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
            if batch_id == fail_at and not failures:
                failures.append(batch_id)
                raise RuntimeError("killed")

        stream = queue_lines(spark, folder, files_per_batch=1)
        return (
            stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True).start()
        )

    with pytest.raises(Exception):
        run(1).awaitTermination()
    assert failures == [1]
    assert len(glob.glob(f"{folder}/*/part-*")) >= 2  # what was not committed is still there
    run(None).awaitTermination()
    enqueue_lines(spark.createDataFrame([("B_foo_1",)], "line string").coalesce(1), folder, "3")
    run(None).awaitTermination()
    got = sorted(r["line"] for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [*lines, "B_foo_1"]
    assert len(glob.glob(f"{folder}/*/part-*")) <= 2
