"""Ends of a query: counting, time-stamping and publishing result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.functions.text import render_bindings
from tripleflow.operators.match import MATCHED, condition
from tripleflow.patterns import Pattern


def count_matches(df: DataFrame, by: str, ids: Sequence[int] | None = None) -> DataFrame:
    """Rows per value of ``by``: ``by, n``; with ``ids`` those without rows report 0."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    if ids is None:
        return counted
    listed = df.sparkSession.createDataFrame([(i,) for i in ids], f"{by} int")
    return listed.join(counted, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def count_patterns(triples: DataFrame, pats: Sequence[Pattern]) -> DataFrame:
    """Matches of each pattern, zeros included: ``pattern_id, n``.

    One scan and one aggregate for all patterns; no row is copied per match.
    """
    names = [f"p{i}" for i in range(len(pats))]
    counted = triples.agg(*[F.count_if(condition(p)).alias(c) for p, c in zip(pats, names)])
    rows = F.array(
        *[F.struct(F.lit(i).alias("pattern_id"), F.col(c).alias("n")) for i, c in enumerate(names)]
    )
    return counted.select(F.inline(rows))


def count_each(tagged: DataFrame, pattern_id: int | None = None) -> DataFrame:
    """Rows of `match_each` per pattern, or of one; rows without bindings count."""
    if pattern_id is None:
        return count_matches(tagged, "pattern_id")
    return tagged.where(F.col("pattern_id") == pattern_id).agg(F.count(F.lit(1)).alias("n"))


def count_packed(packed: DataFrame, pattern_id: int | None = None) -> DataFrame:
    """Rows of `match_packed` per pattern that bind at least one variable."""
    rows = packed.select(F.explode("all_bindings").alias("pattern_id", "bindings"))
    return count_each(rows.where(F.size("bindings") > 0), pattern_id)


def collect_timed(df: DataFrame) -> DataFrame:
    """Result rows with ``received_at``: the time of the query, or of each micro-batch."""
    return df.withColumn("received_at", F.current_timestamp())


def render(df: DataFrame) -> DataFrame:
    """Each row of bindings as one text: ``{?a=A, ?b=1}``."""
    names = [c for c in df.columns if c != MATCHED]
    return df.select(render_bindings(names).alias("value"))


def publish(
    df: DataFrame,
    path: str,
    checkpoint: str | None = None,
    fmt: str = "text",
    trigger: Mapping[str, object] | None = None,
    **options: str,
):
    """Write rendered rows to a text folder or another sink.

    For a stream this returns the started query; it needs a ``checkpoint`` folder
    and processes what is available, then stops, unless ``trigger`` says otherwise.
    """
    rendered = render(df)
    if not df.isStreaming:
        rendered.write.format(fmt).options(**options).mode("append").save(path)
        return None
    if not checkpoint:
        raise ValueError("publishing a stream needs a checkpoint folder")
    return (
        rendered.writeStream.format(fmt)
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
