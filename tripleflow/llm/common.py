"""Helpers shared by the operators: columns, tables written for later steps, worker caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.sources.workdir import fresh_folder

# The white space and the word of the contracts, as Java and Python regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside."""
    old = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to the shared folder and read back.

    Cuts the lineage: later steps start from files that outlive any executor, and a
    frame used several times is computed once.  The write's shuffle files go when it is done;
    else they stay until the driver happens to collect its garbage.
    """
    path = fresh_folder(frame.sparkSession, purpose)
    with settings(frame.sparkSession, {CLEANUP: "true"}):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table from `written` whose last reader is done."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def before(name: str) -> Column:
    """Turns "smallest" into "greatest" for a long column, without overflow at its ends."""
    return F.bitwise_not(F.col(name))


@lru_cache(maxsize=32)
def per_worker(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, built once in each Python worker (tokenizers, memos)."""
    return make(*args)
