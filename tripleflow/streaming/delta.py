"""Continuous conjunctive queries by differences, with kept memories.

Every pattern, and every partial join of the patterns so far, has a memory: the rows it
has had up to now, as a table in hash buckets of the variables it is joined on.  Of a
micro-batch only the differences are joined: new partial rows with all rows of the next
pattern, and the remembered partial rows with the next pattern's new rows.  Neither reads
a file of the source again, and of a memory only the buckets that the difference touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripleflow.operators.joins import natural_join, shared_columns
from tripleflow.operators.match import MATCHED, Triples, match
from tripleflow.patterns import Pattern, connected_order, numbered, output_names, variables
from tripleflow.streaming.fold import (
    AVAILABLE_NOW,
    BUCKET,
    BUCKETS,
    Trigger,
    in_buckets,
    touched_buckets,
    write_buckets,
)

_BATCH = "_batch"


class Memory:
    """All rows that a pattern or a partial join has had, by batch and by bucket of ``keys``."""

    def __init__(self, path: str, keys: Sequence[str], buckets: int):
        self.path, self.keys, self.buckets = path, list(keys), buckets

    def add(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Remember a batch's rows, in place of what an earlier try of it left, and read them back."""
        place = f"{self.path}/{_BATCH}={batch_id}"
        write_buckets(in_buckets(rows, self.keys, self.buckets), place)
        return rows.sparkSession.read.schema(self._schema(rows)).parquet(place).drop(BUCKET)

    def touched_by(self, difference: DataFrame, batch_id: int) -> list[int]:
        return touched_buckets(difference, self.keys, self.buckets) if batch_id else []

    def before(self, like: DataFrame, batch_id: int, buckets: Sequence[int]) -> DataFrame | None:
        """The remembered rows of earlier batches in some buckets; None if there can be none."""
        if not buckets:
            return None
        schema = T.StructType([*self._schema(like).fields, T.StructField(_BATCH, T.LongType())])
        stored = like.sparkSession.read.schema(schema).parquet(self.path)
        return stored.where((F.col(_BATCH) < batch_id) & F.col(BUCKET).isin(list(buckets))).drop(BUCKET, _BATCH)

    @staticmethod
    def _schema(rows: DataFrame) -> T.StructType:
        return T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])


class DeltaQuery:
    """One conjunctive query, its memories and its output, all below ``base``."""

    def __init__(
        self,
        pats: Sequence[Pattern],
        base: str,
        allow_cross: bool = False,
        names: dict[str, str] | None = None,
        buckets: int = BUCKETS,
    ):
        self.pats, self.base, self.buckets = list(pats), base, buckets
        if not self.pats:
            raise ValueError("a query needs at least one pattern")
        self.inner, self.plan_names = numbered(self.pats)
        binding = [p for p in self.inner if variables(p)]
        parts = connected_order([variables(p) for p in binding])
        if len(parts) > 1 and not allow_cross:
            raise ValueError("the patterns fall into parts that share no variable; pass allow_cross=True to build their product")
        self.order = [binding[i] for part in parts for i in part] + [p for p in self.inner if not variables(p)]
        self.outer = output_names(self.plan_names, names)

    def _memories(self, k: int, left: DataFrame, right: DataFrame) -> tuple[Memory, Memory]:
        on = shared_columns(left, right)
        place = f"{self.base}/memory"
        return Memory(f"{place}/joined-{k - 1}", on, self.buckets), Memory(f"{place}/pattern-{k}", on, self.buckets)

    def take(self, triples: Triples, batch_id: int) -> None:
        """Remember a micro-batch and write the rows it completes."""
        if not isinstance(triples, DataFrame):
            triples = {i: triples[p] for i, p in zip(self.inner, self.pats, strict=True)}
        found = match(triples, self.order[0])
        for k, pat in enumerate(self.order[1:], start=1):
            right = match(triples, pat)
            joined, seen = self._memories(k, found, right)
            new_left, new_right = joined.add(found, batch_id), seen.add(right, batch_id)
            old_right = seen.before(right, batch_id, joined.touched_by(new_left, batch_id))
            old_left = joined.before(found, batch_id, seen.touched_by(new_right, batch_id))
            every_right = new_right if old_right is None else new_right.unionByName(old_right)
            found = natural_join(new_left, every_right)
            if old_left is not None:
                found = found.unionByName(natural_join(old_left, new_right))
        if self.plan_names:
            found = found.select(*[F.col(c).alias(self.outer[v]) for v, c in self.plan_names.items()])
        found.write.mode("overwrite").parquet(f"{self.base}/output/batch={batch_id}")


def stream_bgp_delta(
    triples: DataFrame,
    pats: Sequence[Pattern],
    base: str,
    allow_cross: bool = False,
    names: dict[str, str] | None = None,
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """The rows of `bgp` over all triples so far, each put out in the batch that completes it.

    Patterns are joined left-deep; one that shares nothing with those before it waits for a
    later one that does, and variable-free ones come last.  Parts that share no variable give
    a product and need ``allow_cross``.  What each batch adds is a folder of ``base/output``,
    which a repeated batch overwrites; `read_output` reads them all.  ``buckets`` and the
    patterns must stay the same for the life of ``base``.
    """
    query = DeltaQuery(pats, base, allow_cross, names, buckets)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            query.take(held, batch_id)
        finally:
            held.unpersist()

    return (
        triples.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def delta_schema(pats: Sequence[Pattern], names: dict[str, str] | None = None) -> str:
    """Schema of what `stream_bgp_delta` puts out, for `read_output`."""
    _, plan_names = numbered(list(pats))
    columns = output_names(plan_names, names).values()
    return ", ".join(f"`{c}` string" for c in columns) or f"{MATCHED} int"
