"""Relational tables seen as triples.

A triple view is a ``UNION ALL`` of two-column projections with a literal predicate.
A pattern with a constant predicate leaves only the branches that carry it, and a
query whose predicates are all constant can ask for just those branches.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.patterns import Pattern, is_var
from tripleflow.sources.workdir import fresh_folder

# Columns of the tables.  Declared, so that building a plan reads no file.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


class View(NamedTuple):
    """One branch of the star view: which two columns make which predicate."""

    pred: str
    table: str
    subj_prefix: str
    subj: str
    obj_prefix: str
    obj: str


STAR_VIEWS = (
    View("inRegion", "nation", "N", "n_nationkey", "R", "n_regionkey"),
    View("inNation", "customer", "C", "c_custkey", "N", "c_nationkey"),
    View("segment", "customer", "C", "c_custkey", "", "c_mktsegment"),
    View("inNation", "supplier", "S", "s_suppkey", "N", "s_nationkey"),
    View("placedBy", "orders", "O", "o_orderkey", "C", "o_custkey"),
    View("status", "orders", "O", "o_orderkey", "", "o_orderstatus"),
    View("soldBy", "lineitem", "O", "l_orderkey", "S", "l_suppkey"),
    View("hasPart", "lineitem", "O", "l_orderkey", "P", "l_partkey"),
    View("brand", "part", "P", "p_partkey", "", "p_brand"),
    View("type", "part", "P", "p_partkey", "", "p_type"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _term(prefix: str, column: str) -> str:
    return f"concat('{prefix}', {column})" if prefix else f"cast({column} AS string)"


def _facts(spark: SparkSession, folder: str, view: View) -> DataFrame:
    present = f"{view.subj} IS NOT NULL AND {view.obj} IS NOT NULL"
    return table(spark, folder, view.table).where(present).selectExpr(
        f"{_term(view.subj_prefix, view.subj)} AS subj",
        f"'{view.pred}' AS pred",
        f"{_term(view.obj_prefix, view.obj)} AS obj",
    )


def star_triples(
    spark: SparkSession, folder: str, pats: Iterable[Pattern] | None = None
) -> DataFrame:
    """The star schema as triples with prefixed keys: N nation, R region, C, S, O, P.

    Given the patterns of a query, branches that none of them can match are left out.
    """
    wanted = None if pats is None else {p[1] for p in pats}
    views = [
        v
        for v in STAR_VIEWS
        if wanted is None or v.pred in wanted or any(is_var(pred) for pred in wanted)
    ]
    if not views:
        raise ValueError(f"no table carries any of {sorted(wanted)}")
    return reduce(DataFrame.unionAll, [_facts(spark, folder, v) for v in views])


def events_as_triples(events: DataFrame, prefix: str = "U") -> DataFrame:
    """``user event_type floor(value)`` with the arrival number ``seq`` and time ``ts``."""
    present = "user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL"
    return events.where(present).selectExpr(
        f"{_term(prefix, 'user_id')} AS subj",
        "event_type AS pred",
        "cast(cast(floor(value) AS bigint) AS string) AS obj",
        "event_id AS seq",
        "cast(ts AS timestamp) AS ts",
    )


def event_triples(spark: SparkSession, folder: str, prefix: str = "U") -> DataFrame:
    return events_as_triples(table(spark, folder, "events"), prefix)


def event_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, prefix: str = "U"
) -> DataFrame:
    """The events table followed as a stream, file by file, straight from where it lies.

    The path is written as a glob, which a file source takes for a single file as well
    as for a folder of files.
    """
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return events_as_triples(reader.parquet(f"{folder}/events.parque[t]"), prefix)


def event_stream_in_batches(spark: SparkSession, folder: str, batches: int = 4, prefix: str = "U") -> DataFrame:
    """The events table followed as a stream in several micro-batches.

    The table is first laid down in the shared folder in files of ascending ``event_id``, one
    after the other; the stream then takes a file at a time.
    """
    events = table(spark, folder, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    place = fresh_folder(spark, "events")
    if low is None:
        events.coalesce(1).write.parquet(f"{place}/0")
        low, high, batches = 0, -1, 0
    width = -(-(high - low + 1) // batches) if batches else 0
    for k in range(batches):
        part = events.where(F.col("event_id").between(low + k * width, low + (k + 1) * width - 1))
        part.coalesce(1).write.parquet(f"{place}/{k}")
    reader = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
    return events_as_triples(reader.option("recursiveFileLookup", "true").parquet(place), prefix)
