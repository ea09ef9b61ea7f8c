"""Analysis of run logs held as ``file, pos, line`` rows (see `read_log`).

Every result is a per-file aggregate or a filter; no file is read whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.functions.ordered import SPLIT_ROWS, arrival_number, running
from tripleflow.operators.aggregate import means_by, rollup_partials
from tripleflow.sources.lines import read_log

# What the lines of a run log look like, and the verdicts.
STARTUP = '"startup"'
ACKED = "Acking"
EXCEPTION = "Exception"
FAILURE = "fail"
OK_MARKER = "Results_OK"
RESULT_OPEN = "<result"
LATENCY = "lastack-firstemit="
EXPECTED = "ExpectedResultSize([0-9]*)=([0-9]+)"
TERMINAL_COUNT = "^CounterTerminal[0-9]*: partialCount"
VERDICT_OK = "results OK"
VERDICT_BAD = "results are NOT ok!"


def has(text: str) -> Column:
    return F.col("line").contains(text)


def first_last_span(
    df: DataFrame, key: str, start: Column, end: Column, time: str, pos: str | None = None
) -> DataFrame:
    """Per key from the first ``start`` row to the last ``end`` row.

    First and last go by ``pos``, or by ``time`` itself when no ``pos`` is given:
    ``key, started, ended, span``; ``span`` is NULL while one of them is missing.
    """
    order = F.col(pos or time)
    ends = df.groupBy(key).agg(
        F.min_by(F.when(start, F.col(time)), F.when(start, order)).alias("started"),
        F.max_by(F.when(end, F.col(time)), F.when(end, order)).alias("ended"),
    )
    return ends.withColumn("span", F.col("ended") - F.col("started"))


def run_span(logs: DataFrame) -> DataFrame:
    """Seconds from the first start-up line to the last acknowledgement, per file.

    ``file, first_emit, last_ack, seconds``; the lines lead with milliseconds.
    """
    timed = logs.where(has(STARTUP) | has(ACKED)).withColumn(
        "_ms", F.split(F.trim("line"), "\\s+").getItem(0).try_cast("bigint")
    )
    span = first_last_span(timed, "file", has(STARTUP), has(ACKED), "_ms", "pos")
    return span.select(
        "file",
        F.col("started").alias("first_emit"),
        F.col("ended").alias("last_ack"),
        (F.col("span") / 1000).alias("seconds"),
    )


def exception_lines(logs: DataFrame) -> DataFrame:
    return logs.where(has(EXCEPTION))


def ok_marker(logs: DataFrame) -> DataFrame:
    return logs.where(has(OK_MARKER))


def failed_files(logs: DataFrame) -> DataFrame:
    """Names of the files with "fail" in any case."""
    return logs.where(F.lower("line").contains(FAILURE)).select("file").distinct()


def result_block(logs: DataFrame, n: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Lines that open a result, each with the ``n + 1`` lines that follow it.

    Overlapping blocks give every line once.
    """
    numbered = arrival_number(logs, ["file"], "pos", "_line_no", split_rows)
    opened = running(
        numbered,
        ["file"],
        "_line_no",
        maxima={"_opened": F.when(has(RESULT_OPEN), F.col("_line_no"))},
        split_rows=split_rows,
    )
    in_block = F.col("_line_no") - F.col("_opened") <= n + 1
    return opened.where(in_block).drop("_line_no", "_opened")


def counter_totals(logs: DataFrame) -> DataFrame:
    """Sum of the partial counts per file and counter: ``file, id, total``."""
    return rollup_partials(logs.where(F.col("line").rlike(TERMINAL_COUNT)), by=("file",))


def expected_sizes(logs: DataFrame) -> DataFrame:
    """Expected result sizes the runs announced: ``file, id, expected``."""
    announced = logs.where(F.col("line").rlike(EXPECTED))
    return announced.select(
        "file",
        F.regexp_extract("line", EXPECTED, 1).try_cast("bigint").alias("id"),
        F.regexp_extract("line", EXPECTED, 2).cast("bigint").alias("expected"),
    ).distinct()


def result_check(logs: DataFrame, n_correct: int | None = None) -> DataFrame:
    """Do the counts of a run equal what it expected?  ``file, n_correct, verdict``.

    A counter is correct when its total equals the size announced under its id.
    The run is in order when ``n_correct`` counters are correct, or, without that
    number, when every announced size was met.
    """
    met = expected_sizes(logs).join(counter_totals(logs), ["file", "id"], "left")
    correct = F.count_if(F.col("total") == F.col("expected"))
    needed = F.lit(n_correct) if n_correct is not None else F.count(F.lit(1))
    per_file = met.groupBy("file").agg(correct.alias("n_correct"), needed.alias("_needed"))
    verdict = F.when(F.col("n_correct") == F.col("_needed"), VERDICT_OK).otherwise(VERDICT_BAD)
    return per_file.select("file", "n_correct", verdict.alias("verdict"))


def latencies(summaries: DataFrame) -> DataFrame:
    """What follows ``lastack-firstemit=`` in each such line: ``file, line``."""
    values = F.split("line", "=").getItem(1)
    return summaries.where(has(LATENCY)).select("file", values.alias("line"))


def means_by_file(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Mean latency of each summary file: ``file, mean, report``."""
    return means_by(latencies(read_log(spark, paths)))


def summarise_by_experiment(logs: DataFrame, n_correct: int | None = None) -> DataFrame:
    """One row per run: its experiment, latency, exceptions and verdict.

    The experiment is the file name up to the first ``-``.
    """
    trouble = logs.groupBy("file").agg(F.count_if(has(EXCEPTION)).alias("n_exceptions"))
    runs = trouble.join(run_span(logs).select("file", "seconds"), "file", "left")
    runs = runs.join(result_check(logs, n_correct), "file", "left")
    return runs.select(
        F.substring_index("file", "-", 1).alias("experiment"),
        "file",
        "seconds",
        "n_exceptions",
        F.coalesce("n_correct", F.lit(0)).alias("n_correct"),
        F.coalesce("verdict", F.lit(VERDICT_BAD)).alias("verdict"),
    )
