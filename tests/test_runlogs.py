import pytest

from tripleflow.operators import runlogs
from tripleflow.sources.lines import read_log

GOOD = """0 preparing
1234 main "startup" now
1300 main "startup" again
java.lang.RuntimeException: late
2000 Acking message 1
5678 Acking message 2
5700 done
<result>
row 1
row 2
</result>
after
CounterTerminal0: partialCount=12
CounterTerminal0: partialCount=24
CounterTerminal1: partialCount=5
  CounterTerminal1: partialCount=100 is not at the start
ExpectedResultSize0=36
ExpectedResultSize1=5
Results_OK
"""
BAD = """10 main "startup"
Emit FAILED
CounterTerminal0: partialCount=360
ExpectedResultSize0=36
"""


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "nodes7_a-1").write_text(GOOD)
    (folder / "nodes7_a-2").write_text(BAD)
    return read_log(spark, str(folder))


def test_span_is_first_start_to_last_ack(logs, rows):
    assert rows(runlogs.run_span(logs)) == [
        ("nodes7_a-1", 1234, 5678, 4.444),
        ("nodes7_a-2", 10, None, None),
    ]


def test_lines_with_marks(logs, rows):
    assert rows(runlogs.exception_lines(logs), "line") == [("java.lang.RuntimeException: late",)]
    assert rows(runlogs.ok_marker(logs), "file") == [("nodes7_a-1",)]
    assert rows(runlogs.failed_files(logs)) == [("nodes7_a-2",)]


@pytest.mark.parametrize("split_rows", [3, 10**6])
def test_result_block(logs, rows, split_rows):
    got = [r["line"] for r in sorted(runlogs.result_block(logs, 2, split_rows).collect(), key=lambda r: r["pos"])]
    assert got == ["<result>", "row 1", "row 2", "</result>"]


def test_overlapping_blocks_give_lines_once(spark):
    texts = ["<result>", "a", "<result>", "b", "c", "d", "e"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, pos bigint, line string")
    assert sorted(r["pos"] for r in runlogs.result_block(df, 1).collect()) == [0, 1, 2, 3, 4]


def test_check_is_exact(logs, rows):
    assert rows(runlogs.counter_totals(logs)) == [
        ("nodes7_a-1", 0, 36), ("nodes7_a-1", 1, 5), ("nodes7_a-2", 0, 360),
    ]
    assert rows(runlogs.result_check(logs)) == [
        ("nodes7_a-1", 2, "results OK"), ("nodes7_a-2", 0, "results are NOT ok!"),
    ]
    assert rows(runlogs.result_check(logs, 1), "verdict") == [("results are NOT ok!",)] * 2


def test_summary_by_experiment(logs, rows):
    assert rows(runlogs.summarise_by_experiment(logs)) == [
        ("nodes7_a", "nodes7_a-1", 4.444, 1, 2, "results OK"),
        ("nodes7_a", "nodes7_a-2", None, 0, 0, "results are NOT ok!"),
    ]


def test_latencies_of_summaries(spark, tmp_path, rows):
    (tmp_path / "summary_x").write_text("ITERATION=1\nlastack-firstemit=4.444\nlastack-firstemit=2\n\nresults OK\n")
    found = runlogs.latencies(read_log(spark, str(tmp_path)))
    assert rows(found) == [("summary_x", "2"), ("summary_x", "4.444")]
    (tmp_path / "summary_y").write_text("lastack-firstemit=\n")
    means = runlogs.means_by_file(spark, str(tmp_path))
    assert rows(means, "report") == [("3.222 summary_x",), ("NaN summary_y",)]
