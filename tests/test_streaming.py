"""Every stream operator, over several micro-batches, equals its batch twin."""

import glob
import os
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import simulate
from tests.test_correlate import random_arrivals
from tripleflow.operators.correlate import bounded_join, pair_up, pair_up_obj_subj, threshold_reached
from tripleflow.operators.counts import publish
from tripleflow.operators.match import match, match_each, match_shared
from tripleflow.patterns import DEFAULT_QUERY, pattern, patterns
from tripleflow.plans.bgp import bgp
from tripleflow.sources.lines import read_lines
from tripleflow.sources.tables import event_triples
from tripleflow.sources.triples import triple_universe
from tripleflow.sources.workdir import fresh_folder
from tripleflow.streaming.fold import Folders, State, bucket_of
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
    stream_pair_up,
    stream_pair_up_obj_subj,
    stream_row_counts,
    stream_threshold,
)

BATCHES = 3


def bag(df, *columns):
    names = columns or sorted(df.columns)
    return Counter(map(tuple, df.select(*names).collect()))


def as_stream(df, folder, order=None):
    """``df`` laid down in files and read back one file per micro-batch."""
    spark = df.sparkSession
    frame = df.toPandas() if order is None else df.toPandas().sort_values(order)
    size = -(-len(frame) // BATCHES)
    for i in range(BATCHES):
        part = spark.createDataFrame(frame.iloc[i * size:(i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(folder)
    )


@pytest.fixture(scope="module")
def events(spark, small):
    return event_triples(spark, small).cache()


@pytest.fixture
def source(events, spark):
    return as_stream(events, fresh_folder(spark, "source"), "seq")


def collected(spark, df, timed=False):
    folder = fresh_folder(spark, "out")
    query = stream_collect(df, f"{folder}/rows", f"{folder}/checkpoint", timed)
    run_to_end(query)
    assert len(query.recentProgress) >= BATCHES
    return spark.read.parquet(f"{folder}/rows")


def test_stream_match(spark, events, source):
    p = pattern("?u_click_?v")
    got = collected(spark, match(source, p), timed=True)
    assert bag(got.drop("received_at")) == bag(match(events, p))
    assert got.where("received_at IS NULL").count() == 0
    assert got.select("received_at").distinct().count() == BATCHES


def test_stream_match_shared(spark, events, source):
    pats = patterns(["?u_click_?v", "?a_click_?b", "?x_?p_12", "U7_?p_?v"])
    streamed = collected(spark, match_shared(source, pats, keep=["seq"]))
    assert bag(streamed.select("seq", "pattern_id")) == bag(match_each(events, pats, keep=["seq"]).select("seq", "pattern_id"))


def test_stream_default_query(spark):
    n = 6
    stream = as_stream(triple_universe(spark, n), fresh_folder(spark, "source"))
    got = collected(spark, stream_bgp(stream, patterns(DEFAULT_QUERY)))
    assert bag(got) == bag(bgp(triple_universe(spark, n), patterns(DEFAULT_QUERY)))
    assert got.count() == 36 * n


def test_stream_cross_product(spark):
    stream = as_stream(triple_universe(spark, 4), fresh_folder(spark, "source"))
    got = collected(spark, stream_bgp(stream, patterns(["A_foo_?x", "B_foo_?y"]), allow_cross=True))
    assert got.count() == 16 == got.distinct().count()


def test_stream_variable_free_pattern(spark):
    stream = as_stream(triple_universe(spark, 4), fresh_folder(spark, "source"))
    query = patterns(["?x_foo_2", "A_bar_1"])
    got = collected(spark, stream_bgp(stream, query))
    assert bag(got) == bag(bgp(triple_universe(spark, 4), query)) and got.count() == 3


def test_stream_with_time_bound(spark, events, source):
    pats = patterns(["?u_click_?v", "?u_view_?w"])
    got = collected(spark, stream_bgp(source, pats, "ts", "1 hours", salt=(2, 2)))
    expected = stream_bgp(events, pats, "ts", "1 hours")
    assert bag(got) == bag(expected) and got.count() > 0
    assert got.count() < bgp(events, pats).count()


def test_stream_counts(spark, events, source):
    pats = patterns(["?u_click_?v", "?u_view_?v"])
    folder = fresh_folder(spark, "out")
    run_to_end(stream_count_table(match_each(source, pats), f"{folder}/n", f"{folder}/checkpoint"))
    got = {r["pattern_id"]: r["n"] for r in read_count_table(spark, f"{folder}/n").collect()}
    assert got == {i: match(events, p).count() for i, p in enumerate(pats)}


def test_stream_counts_after_join(spark, events, source):
    pats = patterns(["?u_click_?v", "?u_view_?w"])
    folder = fresh_folder(spark, "out")
    run_to_end(stream_row_counts(stream_bgp(source, pats, salt=(3, 2)), f"{folder}/n", f"{folder}/checkpoint", ["u"]))
    got = spark.read.parquet(f"{folder}/n").groupBy("u").agg(F.sum("n").alias("n"))
    assert bag(got, "u", "n") == bag(bgp(events, pats).groupBy("u").agg(F.count("*").alias("n")), "u", "n")


@pytest.mark.parametrize(("retain", "capacity"), [("first", 3), ("latest", 2)])
def test_stream_bounded_join(spark, retain, capacity):
    arrivals = random_arrivals(capacity, 240, 6)
    df = spark.createDataFrame([(n, k, s, f"{n}{s}") for n, k, s in arrivals], "side string, k string, seq bigint, v string")
    stream = as_stream(df, fresh_folder(spark, "source"), "seq")
    left = stream.where("side = 'l'").selectExpr("k", "seq", "v AS lv")
    right = stream.where("side = 'r'").selectExpr("k", "seq", "v AS rv")
    folder = fresh_folder(spark, "out")
    run_to_end(stream_bounded_join(left, right, ["k"], folder, "seq", capacity, retain, split_rows=20))
    got = read_output(stream, folder, "k string, lv string, rv string, left_seq bigint, right_seq bigint")
    found = Counter((r["k"], r["left_seq"], r["right_seq"]) for r in got.collect())
    assert found == simulate.bounded_join_per_key(arrivals, capacity, retain)
    batch = bounded_join(
        df.where("side = 'l'").selectExpr("k", "seq", "v AS lv"),
        df.where("side = 'r'").selectExpr("k", "seq", "v AS rv"),
        ["k"], "seq", capacity, retain,
    )
    assert bag(got) == bag(batch)


def test_stream_pair_up(spark, events, source):
    folder = fresh_folder(spark, "out")
    run_to_end(stream_pair_up(source.select("subj", "seq"), "subj", folder, split_rows=10))
    got = read_output(source, folder, "subj string, seq bigint")
    assert bag(got, "subj", "seq") == bag(pair_up(events, "subj"), "subj", "seq")


def test_stream_pair_up_obj_subj(spark, events, source):
    def some_missing(df):
        return df.select("subj", "seq", F.when(F.col("pred") != "error", F.col("obj")).alias("obj"))

    folder = fresh_folder(spark, "out")
    run_to_end(stream_pair_up_obj_subj(some_missing(source), folder))
    got = read_output(source, folder, "letter string, seq bigint")
    assert bag(got) == bag(pair_up_obj_subj(some_missing(events)))


@pytest.mark.parametrize("n", [1, 4])
def test_stream_threshold(spark, events, source, n):
    folder = fresh_folder(spark, "out")
    run_to_end(stream_threshold(source, "pred", "obj", folder, n=n))
    got = read_output(source, folder, "pred string, seq bigint")
    assert bag(got, "pred", "seq") == bag(threshold_reached(events, "pred", "obj", n=n), "pred", "seq")
    folder = fresh_folder(spark, "out")
    run_to_end(stream_threshold(source, "subj", "obj", folder, n=n))
    got = read_output(source, folder, "subj string, seq bigint")
    assert bag(got, "subj", "seq") == bag(threshold_reached(events, "subj", "obj", n=n), "subj", "seq")


def test_stream_publish(spark, events, source):
    folder = fresh_folder(spark, "out")
    run_to_end(publish(match(source, pattern("?u_view_?v")), f"{folder}/lines", f"{folder}/checkpoint"))
    assert read_lines(spark, f"{folder}/lines").count() == match(events, pattern("?u_view_?v")).count()
    with pytest.raises(ValueError):
        publish(source.select("subj"), f"{folder}/x")


def test_fold_goes_on_after_a_restart(spark, events):
    """A second run picks up new files with the state the first one left."""
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    first = as_stream(events.where("seq < 500"), place, "seq").select("subj", "seq")
    run_to_end(stream_pair_up(first, "subj", folder))
    events.where("seq >= 500").coalesce(1).write.parquet(f"{place}/later")
    run_to_end(stream_pair_up(first, "subj", folder))
    got = read_output(first, folder, "subj string, seq bigint")
    assert bag(got, "subj", "seq") == bag(pair_up(events, "subj"), "subj", "seq")


def _bucket_files(spark, folder):
    """Folder of each bucket as the last manifest names it, and what lies there."""
    last = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{folder}/manifest/batch=*"))
    schema = spark.createDataFrame([], "subj string").schema
    state = State.after(spark, Folders(folder), schema, last)
    return {b: (p, sorted(os.listdir(p))) for b, p in state.files().items()}


def test_untouched_buckets_keep_their_files(spark):
    """Keys come in one batch each; a later batch rewrites its own keys' buckets only."""
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    keys = [[f"k{i}" for i in range(40)], ["k0"], ["k1"], ["k1", "new"]]
    arrivals, seen = [], []
    for n, batch in enumerate(keys):
        rows = [(k, 100 * n + i) for i, k in enumerate(batch)]
        arrivals += rows
        spark.createDataFrame(rows, "subj string, seq bigint").coalesce(1).write.parquet(f"{place}/{n}")
        stream = spark.readStream.schema("subj string, seq bigint").option("recursiveFileLookup", "true").parquet(place)
        run_to_end(stream_pair_up(stream, "subj", folder, buckets=16))
        seen.append(_bucket_files(spark, folder))
    bucket = {
        r.subj: r.b
        for r in spark.createDataFrame([(k,) for b in keys for k in b], "subj string").select("subj", bucket_of(["subj"], 16).alias("b")).collect()
    }
    assert len(seen[0]) > 8
    for before, after, batch in zip(seen, seen[1:], keys[1:]):
        touched = {bucket[k] for k in batch}
        assert {b: f for b, f in before.items() if b not in touched} == {b: f for b, f in after.items() if b not in touched}
        assert all(before.get(b) != after.get(b) for b in touched)
    got = read_output(stream, folder, "subj string, seq bigint")
    assert Counter(map(tuple, got.collect())) == Counter(simulate.pair_up(arrivals))


def test_a_repeated_batch_leaves_the_same_result(spark):
    """Batch 1 is run again from the manifest of batch 0, as after a failure before its commit."""
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    arrivals = [("a", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6), ("a", 7)]
    for n, rows in enumerate((arrivals[:3], arrivals[3:5], arrivals[5:])):
        if n == 2:  # forget that batch 1 was committed
            for name in ("1", ".1.crc"):
                os.remove(f"{folder}/checkpoint/commits/{name}")
        spark.createDataFrame(rows, "subj string, seq bigint").coalesce(1).write.parquet(f"{place}/{n}")
        stream = spark.readStream.schema("subj string, seq bigint").option("recursiveFileLookup", "true").parquet(place)
        run_to_end(stream_pair_up(stream, "subj", folder, buckets=4))
    got = read_output(stream, folder, "subj string, seq bigint")
    assert Counter(map(tuple, got.collect())) == Counter(simulate.pair_up(arrivals))


@pytest.mark.parametrize(("retain", "capacity"), [("first", 3), ("latest", 4)])
def test_stream_bounded_join_with_one_memory(spark, retain, capacity):
    arrivals = random_arrivals(capacity, 150, 4)
    df = spark.createDataFrame([(n, k, s, f"{n}{s}") for n, k, s in arrivals], "side string, k string, seq bigint, v string")
    stream = as_stream(df, fresh_folder(spark, "source"), "seq")
    left = stream.where("side = 'l'").selectExpr("k", "seq", "v AS lv")
    right = stream.where("side = 'r'").selectExpr("k", "seq", "v AS rv")
    folder = fresh_folder(spark, "out")
    run_to_end(stream_bounded_join(left, right, ["k"], folder, "seq", capacity, retain, per="stream"))
    got = read_output(stream, folder, "k string, lv string, rv string, left_seq bigint, right_seq bigint")
    found = Counter((r["k"], r["left_seq"], r["right_seq"]) for r in got.collect())
    assert found == simulate.bounded_join(arrivals, capacity, retain)


@pytest.mark.parametrize(
    "query",
    [["?u_click_?v", "?u_view_?v", "?u_purchase_?w"], ["?u_click_?v"], ["?u_click_?v", "U7_view_?x", "?u_view_?x"], ["?u_click_3", "U7_view_12"]],
)
def test_delta_evaluation(spark, events, source, query):
    folder = fresh_folder(spark, "out")
    pats = patterns(query)
    run_to_end(stream_bgp_delta(source, pats, folder, buckets=4, allow_cross=True))
    got = read_output(source, folder, delta_schema(pats))
    assert bag(got) == bag(bgp(events, pats, allow_cross=True))


def test_delta_of_the_default_query_goes_on_after_a_restart(spark):
    """Each batch joins its own rows with the memories; the source's earlier files are gone by then."""
    place, folder = fresh_folder(spark, "source"), fresh_folder(spark, "out")
    pats, universe = patterns(DEFAULT_QUERY), triple_universe(spark, 5)
    schema = universe.schema
    for n, part in enumerate(universe.randomSplit([1.0] * 4, 5)):
        part.coalesce(1).write.parquet(f"{place}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(place)
        run_to_end(stream_bgp_delta(stream, pats, folder, buckets=4))
        shutil.rmtree(f"{place}/{n}")
    got = read_output(universe, folder, delta_schema(pats))
    assert bag(got) == bag(bgp(triple_universe(spark, 5), pats)) and got.count() == 180
