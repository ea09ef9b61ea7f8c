"""Order-dependent operators on a stream: fold each micro-batch into a state table.

The state is a table in hash buckets of the operator's key.  A micro-batch reads and
rewrites the buckets its own keys fall into and leaves the files of all others alone; a
manifest names the batch that wrote each bucket last.  Inside, a micro-batch is an ordinary
batch job: shuffled, skew-split and spilled by Spark, with nothing held in Python and no key
bound to one task.  Arrival order is (micro-batch, ``seq``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]]
Trigger = Mapping[str, object]

BUCKETS = 64
BUCKET = "_bucket"
# Take what there is, then stop.  ``{"processingTime": "10 seconds"}`` keeps a stream running.
AVAILABLE_NOW: Trigger = {"availableNow": True}


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its key; without a key there is one bucket."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def in_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(keys, buckets))


def touched_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The buckets that hold a key of ``df``: at most ``buckets`` numbers."""
    found = df.select(bucket_of(keys, buckets).alias(BUCKET)).distinct().collect()
    return sorted(row[BUCKET] for row in found)


def write_buckets(bucketed: DataFrame, path: str) -> None:
    """Write a folder per bucket; a bucket too large for a task is dealt to several."""
    bucketed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


@dataclass(frozen=True)
class Folders:
    """What a folded stream writes, all below one shared folder."""

    base: str

    @property
    def output(self) -> str:
        return f"{self.base}/output"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def written_by(self, batch_id: int) -> str:
        """The buckets that a batch wrote."""
        return f"{self.base}/state/batch={batch_id}"

    def manifest(self, batch_id: int) -> str:
        return f"{self.base}/manifest/batch={batch_id}"


class State:
    """The state table as one batch left it."""

    def __init__(self, spark: SparkSession, folders: Folders, schema: T.StructType, live: Mapping[int, int]):
        self.spark, self.folders, self.schema, self.live = spark, folders, schema, dict(live)

    @classmethod
    def after(cls, spark: SparkSession, folders: Folders, schema: T.StructType, batch_id: int) -> State:
        if batch_id < 0:
            return cls(spark, folders, schema, {})
        rows = spark.read.schema(f"{BUCKET} int, batch bigint").json(folders.manifest(batch_id)).collect()
        return cls(spark, folders, schema, {row[BUCKET]: row["batch"] for row in rows})

    def files(self) -> dict[int, str]:
        """The folder that each bucket lives in."""
        return {b: f"{self.folders.written_by(n)}/{BUCKET}={b}" for b, n in self.live.items()}

    def read(self, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets; other buckets' files are not looked at."""
        paths = [path for b, path in sorted(self.files().items()) if b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self.read(list(self.live))

    def replaced(self, buckets: Sequence[int], rows: DataFrame, keys: Sequence[str], total: int, batch_id: int) -> State:
        """This state with some buckets rewritten as ``rows``; writes the files, then the manifest."""
        write_buckets(in_buckets(rows, keys, total), self.folders.written_by(batch_id))
        # A bucket that is empty now has no folder.
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        written = self.spark.read.schema(schema).parquet(self.folders.written_by(batch_id))
        full = [row[BUCKET] for row in written.select(BUCKET).distinct().collect()]
        live = {b: n for b, n in self.live.items() if b not in set(buckets)} | dict.fromkeys(full, batch_id)
        names = self.spark.createDataFrame(sorted(live.items()), f"{BUCKET} int, batch bigint").coalesce(1)
        names.write.mode("overwrite").json(self.folders.manifest(batch_id))
        return State(self.spark, self.folders, self.schema, live)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _drop_unnamed(before: State, now: State, earlier: State) -> None:
    """Delete bucket folders that neither the last manifest nor the one before names.

    The one before stays, as a repeated batch starts from it.
    """
    named = {*before.files().values(), *now.files().values()}
    for path in set(earlier.files().values()) - named:
        drop_folder(now.spark, path)


def fold_batches(
    stream: DataFrame,
    step: Step,
    state_schema: T.StructType | str,
    base: str,
    keys: Sequence[str] = (),
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Run ``step(batch, state, batch_id) -> (output, new_state)`` on every micro-batch.

    ``step`` sees the state rows of the buckets that the batch's ``keys`` fall into, and
    gives back all rows of those.  Batch n reads the buckets that the manifest of batch
    n-1 names and overwrites its own output partition, its own bucket folders and its own
    manifest, so a batch that is repeated after a failure leaves the same result once.
    ``buckets`` must stay the same for the life of the state.
    """
    spark = stream.sparkSession
    folders = Folders(base)
    keys = list(keys)
    if isinstance(state_schema, str):
        state_schema = spark.createDataFrame([], state_schema).schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = State.after(session, folders, state_schema, batch_id - 1)
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = touched_buckets(held, keys, buckets)
            output, new_state = step(held, before.read(touched), batch_id)
            now = before.replaced(touched, new_state, keys, buckets, batch_id)
            output.write.mode("overwrite").parquet(f"{folders.output}/batch={batch_id}")
            if batch_id > 1:
                _drop_unnamed(before, now, State.after(session, folders, state_schema, batch_id - 2))
        finally:
            held.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", folders.checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an available-now query and raise what made it fail."""
    query.awaitTermination()


def read_output(stream: DataFrame, base: str, schema: T.StructType | str) -> DataFrame:
    """All rows a folded stream has put out so far."""
    read = stream.sparkSession.read.schema(schema).parquet(Folders(base).output)
    return read.drop("batch")
