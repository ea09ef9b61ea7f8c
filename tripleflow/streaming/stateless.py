"""Matching, joining and counting on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleflow.operators.joins import CELLS, bound_within, shared_columns, spread
from tripleflow.operators.match import MATCHED, match, match_each
from tripleflow.patterns import Pattern, numbered, output_names
from tripleflow.plans.bgp import bgp
from tripleflow.streaming.fold import AVAILABLE_NOW, Trigger, drop_folder

stream_match = match
stream_match_each = match_each


def stream_bgp(
    triples: DataFrame,
    pats: Sequence[Pattern],
    event_time: str | None = None,
    max_gap: str | None = None,
    allow_cross: bool = False,
    salt: tuple[int, int] | None = None,
) -> DataFrame:
    """A continuous conjunctive query: each new triple joins all that came before.

    Joins are stream-stream joins in written order.  Without ``event_time`` they
    remember everything.  With ``event_time`` and ``max_gap`` (such as ``"10
    minutes"``) a result's triples lie within ``max_gap`` of the first pattern's
    triple, and Spark drops what can no longer join; ``event_time`` of the first
    pattern stays in the result.  A stream join keeps a key in one task; ``salt``
    spreads every key over a grid of them (see `spread`).
    """
    if event_time is None:
        return bgp(triples, pats, allow_cross=allow_cross, salt=salt)
    if max_gap is None:
        raise ValueError("event_time needs max_gap")
    pats, inner = numbered(pats)
    outer = output_names([*inner, event_time])
    timed = triples.withWatermark(event_time, max_gap) if triples.isStreaming else triples
    acc = match(timed, pats[0], keep=[event_time]).drop(MATCHED)
    for i, pat in enumerate(pats[1:], start=1):
        right = match(timed, pat, keep=[event_time]).drop(MATCHED)
        right = right.withColumnRenamed(event_time, "_t")
        shared = shared_columns(acc, right)
        if not shared:
            raise ValueError(f"pattern {i} shares no variable with those before it")
        if salt:
            acc, right = spread(acc, right, salt)
            shared = [*shared, *CELLS]
        renamed = right.withColumnsRenamed({c: "_r_" + c for c in shared})
        condition = bound_within(acc[event_time], renamed["_t"], max_gap)
        for c in shared:
            condition = condition & (acc[c] == renamed["_r_" + c])
        acc = acc.join(renamed, condition).drop("_t", *CELLS, *["_r_" + c for c in shared])
    user = {plan_name: outer[v] for v, plan_name in inner.items()}
    return acc.select(*[F.col(f"`{c}`").alias(user.get(c, c)) for c in acc.columns])


def stream_counts(tagged: DataFrame, by: str = "pattern_id") -> DataFrame:
    """Running number of rows per value of ``by``; write in update or complete mode."""
    return tagged.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def stream_count_table(
    tagged: DataFrame,
    path: str,
    checkpoint: str,
    by: str = "pattern_id",
    trigger: Trigger = AVAILABLE_NOW,
    listed: DataFrame | None = None,
) -> StreamingQuery:
    """`stream_counts` kept as a table, a version of it per micro-batch; see `read_count_table`.

    ``listed`` has the values of ``by`` that are always in the table, with 0 for those
    without rows.  The last two versions stay, so a reader of one is not cut off.
    """

    def on_batch(counts: DataFrame, batch_id: int) -> None:
        if listed is not None:
            every = listed.select(by).distinct()
            counts = every.join(counts, by, "full").select(by, F.coalesce("n", F.lit(0)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id > 1:
            drop_folder(counts.sparkSession, f"{path}/version={batch_id - 2}")

    return (
        stream_counts(tagged, by)
        .writeStream.outputMode("complete")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_count_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a count table; a version being written cannot be seen."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).drop("version")


def stream_row_counts(
    results: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = (),
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Running counts of the rows of a joined stream, kept as one partial per micro-batch.

    Each micro-batch replaces its own partial, so a repeated batch is not counted
    twice; the sum over ``path`` is the count so far.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        results.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_collect(
    df: DataFrame, path: str, checkpoint: str, timed: bool = False, trigger: Trigger = AVAILABLE_NOW
) -> StreamingQuery:
    """Append the rows of a stream to a parquet folder, on request with ``received_at``."""
    rows = df.withColumn("received_at", F.current_timestamp()) if timed else df
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
