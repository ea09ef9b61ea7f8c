"""Counts of a stream by windows of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_window_counts(
    rows: DataFrame,
    event_time: str,
    width: str,
    late: str,
    by: Sequence[str] = (),
    slide: str | None = None,
) -> DataFrame:
    """Rows per window of event time and values of ``by``: ``window_start, window_end, n``.

    Written in append mode, a window is put out once, when it closes: when the latest event
    time of all earlier micro-batches, less ``late``, has reached its end.  A row that comes
    for a window already put out is dropped; one that is late but whose window is still
    open counts.  Only open windows are kept, so memory is bounded by ``late`` and ``width``.
    Windows that have not closed when a stream stops are not put out.  On a table, not a
    stream, all windows are there and nothing is late.
    """
    timed = rows.withWatermark(event_time, late)
    counted = timed.groupBy(F.window(event_time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n"
    )
