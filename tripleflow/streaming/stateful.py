"""Order-dependent correlation on a stream; each equals its batch twin over all batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripleflow.functions.ordered import SPLIT_ROWS, arrival_number, running
from tripleflow.operators.correlate import (
    DEFAULT_CAPACITY,
    DEFAULT_THRESHOLD,
    flatten_pairs,
    present,
    remembered_pairs,
    tag_sides,
)
from tripleflow.streaming.fold import AVAILABLE_NOW, BUCKETS, Trigger, fold_batches


def _field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType)


def stream_pair_up(
    stream: DataFrame,
    key: str,
    base: str,
    seq: str = "seq",
    split_rows: int = SPLIT_ROWS,
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """`pair_up` on a stream.  The state is the keys still waiting for a partner."""
    schema = T.StructType([_field(stream, key)])

    def step(batch: DataFrame, state: DataFrame, batch_id: int):
        rows = present(batch, [key])
        waiting = state.withColumn("_waits", F.lit(1))
        numbered = arrival_number(rows, [key], seq, "_nth", split_rows)
        pairs = numbered.join(waiting, key, "left").where(
            (F.col("_nth") + F.coalesce("_waits", F.lit(0))) % 2 == 0
        )
        arrived = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        total = F.coalesce("_n", F.lit(0)) + F.coalesce("_waits", F.lit(0))
        still = arrived.join(waiting, key, "full").where(total % 2 == 1).select(key)
        return pairs.drop("_nth", "_waits"), still

    return fold_batches(stream, step, schema, base, [key], buckets, trigger)


def stream_pair_up_obj_subj(
    stream: DataFrame,
    base: str,
    subj: str = "subj",
    obj: str = "obj",
    seq: str = "seq",
    split_rows: int = SPLIT_ROWS,
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """`pair_up_obj_subj` on a stream."""
    keyed = stream.select(F.coalesce(F.col(obj), F.col(subj)).alias("letter"), seq)
    return stream_pair_up(keyed, "letter", base, seq, split_rows, buckets, trigger)


def stream_threshold(
    stream: DataFrame,
    key: str,
    value: str,
    base: str,
    seq: str = "seq",
    n: int = DEFAULT_THRESHOLD,
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """`threshold_reached` on a stream.

    The state is the n+1 earliest distinct values of each key, each with its first
    arrival; nothing more can change what is put out.
    """
    schema = T.StructType(
        [
            _field(stream, key),
            _field(stream, value),
            T.StructField(
                "_first",
                T.StructType(
                    [T.StructField("batch", T.LongType()), _field(stream, seq, "at")]
                ),
            ),
        ]
    )

    def step(batch: DataFrame, state: DataFrame, batch_id: int):
        at = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col(seq).alias("at"))
        rows = present(batch, [key, value]).select(key, value, seq, at.alias("_at"))
        appeared = rows.groupBy(key, value).agg(F.min("_at").alias("_first")).unionByName(state)
        appeared = appeared.groupBy(key, value).agg(F.min("_first").alias("_first"))
        in_order = W.partitionBy(key).orderBy("_first")
        earliest = appeared.withColumn("_d", F.row_number().over(in_order)).where(F.col("_d") <= n + 1)
        spans = earliest.groupBy(key).agg(
            F.min("_first").alias("_begin"),
            F.max(F.when(F.col("_d") == n, F.col("_first"))).alias("_from"),
            F.max(F.when(F.col("_d") == n + 1, F.col("_first"))).alias("_until"),
        )
        within = (
            (F.col("_at") >= F.col("_from"))
            & (F.col("_at") > F.col("_begin"))
            & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
        )
        reached = rows.join(spans, key).where(within).select(key, seq)
        return reached, earliest.drop("_d")

    return fold_batches(stream, step, schema, base, [key], buckets, trigger)


def stream_bounded_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    base: str,
    seq: str = "seq",
    capacity: int = DEFAULT_CAPACITY,
    retain: str = "first",
    split_rows: int = SPLIT_ROWS,
    per: str = "key",
    buckets: int = BUCKETS,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """`bounded_join` on two streams of one source.

    The state is exactly the remembered rows, at most ``capacity`` per side and key, or per
    side with ``per="stream"``, whose state is one bucket.  The newest row of a side is always
    remembered, so the arrival counts go on from the highest rank in the state.
    """
    if per not in ("key", "stream"):
        raise ValueError(f"per must be 'key' or 'stream', not {per!r}")
    on = list(on)
    memory_of = on if per == "key" else []
    both = tag_sides(left, right, on, seq)
    counters = [T.StructField("n_l", T.LongType()), T.StructField("n_r", T.LongType())]
    schema = T.StructType([*both.schema.fields, *counters])

    def step(batch: DataFrame, state: DataFrame, batch_id: int):
        carried = state.groupBy(*memory_of).agg(
            _own_rank("is_left", "n_l").alias("_l0"), _own_rank("not is_left", "n_r").alias("_r0")
        )
        is_left = F.col("is_left")
        numbered = running(
            batch,
            memory_of,
            "at",
            {"n_l": is_left.cast("bigint"), "n_r": (~is_left).cast("bigint")},
            split_rows=split_rows,
        )
        new = _with_memory(numbered, carried, memory_of).withColumns(
            {
                "n_l": F.col("n_l") + F.coalesce("_l0", F.lit(0)),
                "n_r": F.col("n_r") + F.coalesce("_r0", F.lit(0)),
            }
        ).drop("_l0", "_r0")
        rows = state.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        pairs = remembered_pairs(rows, on, capacity, retain, F.col("_new"))

        latest = rows.groupBy(*memory_of).agg(
            _own_rank("is_left", "n_l").alias("_l1"), _own_rank("not is_left", "n_r").alias("_r1")
        )
        rank = F.when(is_left, F.col("n_l")).otherwise(F.col("n_r"))
        count = F.when(is_left, F.col("_l1")).otherwise(F.col("_r1"))
        if retain == "first":
            remembered = (rank < capacity) | (rank == count)
        else:
            remembered = rank > count - capacity
        kept = _with_memory(rows, latest, memory_of).where(remembered).select(*[f.name for f in schema.fields])
        return flatten_pairs(pairs, left, right, on, seq), kept

    return fold_batches(both, step, schema, base, memory_of, buckets, trigger)


def _with_memory(rows: DataFrame, counts: DataFrame, memory_of: Sequence[str]) -> DataFrame:
    """Each row with the counts of its memory; of a whole stream's memory there is one row."""
    if memory_of:
        return rows.join(counts, list(memory_of), "left")
    return rows.crossJoin(F.broadcast(counts))


def _own_rank(side: str, counter: str) -> Column:
    return F.max(F.when(F.expr(side), F.col(counter)))
