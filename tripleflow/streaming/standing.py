"""Standing queries over one read of a stream, and patterns that change while it runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleflow.operators.match import condition, fits_any
from tripleflow.operators.pattern_table import match_table, patterns_at
from tripleflow.patterns import Pattern, canonical
from tripleflow.streaming.delta import DeltaQuery
from tripleflow.streaming.fold import AVAILABLE_NOW, BUCKETS, Folders, Trigger

_FITS = "_fits"


def flagged(triples: DataFrame, pats: Sequence[Pattern]) -> tuple[DataFrame, dict[Pattern, int]]:
    """The triples that some pattern wants, each once, with the numbers of the forms it fits.

    Patterns equal up to the names of their variables are one form, tested once.
    """
    forms = {f: i for i, f in enumerate(dict.fromkeys(canonical(p) for p in pats))}
    tests = [F.when(condition(f), F.lit(i)) for f, i in forms.items()]
    return fits_any(triples, list(forms)).withColumn(_FITS, F.array_compact(F.array(*tests))), forms


def dealt(rows: DataFrame, forms: Mapping[Pattern, int], pats: Sequence[Pattern]) -> dict[Pattern, DataFrame]:
    """Each pattern's own triples out of `flagged` ones; stands for the triples in whole queries."""
    return {
        p: rows.where(F.array_contains(_FITS, forms[canonical(p)])).drop(_FITS) for p in pats
    }


def stream_queries(
    triples: DataFrame,
    queries: Mapping[str, Sequence[Pattern]],
    base: str,
    allow_cross: bool = False,
    names: Mapping[str, dict[str, str]] | None = None,
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Any number of conjunctive queries on one stream, which is read once for all of them.

    Of a micro-batch every triple that some pattern of some query wants is kept once, with
    the set of patterns it fits, and dealt from there to all joins.  Each query goes on by
    differences, as `stream_bgp_delta` does, below ``base/<its name>``, where `read_output`
    finds its rows.  The queries must stay the same for the life of ``base``; a new one
    takes a new base.
    """
    standing = {
        name: DeltaQuery(pats, f"{base}/{name}", allow_cross, (names or {}).get(name), buckets)
        for name, pats in queries.items()
    }
    if not standing:
        raise ValueError("there is no query")
    wanted = list(dict.fromkeys(p for query in standing.values() for p in query.pats))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows, forms = flagged(batch, wanted)
        held = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parts = dealt(held, forms, wanted)
            for query in standing.values():
                query.take(parts, batch_id)
        finally:
            held.unpersist()

    return (
        triples.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def stream_match_table(
    triples: DataFrame,
    read_log: Callable[[SparkSession], DataFrame],
    base: str,
    keep: Sequence[str] = (),
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Match a stream against patterns that are added and removed while it runs.

    ``read_log`` reads the log of changes (see `patterns_at`) anew in every micro-batch; the
    batch goes by the newest version that the log has at its start and notes it under
    ``base/versions`` before anything else, so that a repeated batch takes the same patterns
    however the log has grown.  All rows of a version must be in the log before those of a
    later one.  Result rows have ``pattern_id, bindings``, the ``version`` and the columns in
    ``keep``; `read_output` reads them.
    """
    spark = triples.sparkSession
    noted = f"{base}/versions"
    schema = "version bigint, batch bigint"
    # There is a folder to look into from the first batch on.
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").json(f"{noted}/batch=-1")

    def version_of(session: SparkSession, log: DataFrame, batch_id: int) -> int | None:
        known = session.read.schema(schema).json(noted).where(F.col("batch") == batch_id).first()
        if known is not None:
            return known["version"]
        version = log.agg(F.max("version")).first()[0]
        row = session.createDataFrame([(version,)], "version bigint").coalesce(1)
        row.write.mode("overwrite").option("ignoreNullFields", False).json(f"{noted}/batch={batch_id}")
        return version

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        log = read_log(session)
        version = version_of(session, log, batch_id)
        found = match_table(batch, patterns_at(log, version), keep)
        found = found.withColumn("version", F.lit(version).cast("bigint"))
        found.write.mode("overwrite").parquet(f"{Folders(base).output}/batch={batch_id}")

    return (
        triples.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", Folders(base).checkpoint)
        .trigger(**trigger)
        .start()
    )
