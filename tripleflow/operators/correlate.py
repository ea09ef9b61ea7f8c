"""Correlation by arrival order: bounded joins, pairing and thresholds.

``seq`` is the arrival order throughout: a column without ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripleflow.functions.ordered import SPLIT_ROWS, arrival_number, running

# Rows a join side remembers, and distinct values that make a key known.
DEFAULT_CAPACITY = 10_000
DEFAULT_THRESHOLD = 10


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in which none of ``columns`` is NULL; the test reaches the scan."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns], F.lit(True)))


def bounded_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    seq: str = "seq",
    capacity: int = DEFAULT_CAPACITY,
    retain: str = "first",
    per: str = "key",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Symmetric join in which each side remembers at most ``capacity`` rows.

    A row pairs with what the other side remembers when it arrives.
    ``retain="first"``: a full memory gives up its newest row, so it holds the first
    ``capacity - 1`` rows and the latest one.  ``retain="latest"``: the oldest goes.
    ``per="key"`` keeps one memory per value of ``on``, ``per="stream"`` one for all.

    Both sides carry ``seq``, unique over both.  The result has ``on``, the other
    columns of both sides, and ``left_seq`` and ``right_seq``.
    """
    numbered = number_sides(left, right, on, seq, per, split_rows)
    pairs = remembered_pairs(numbered, on, capacity, retain)
    return flatten_pairs(pairs, left, right, on, seq)


def number_sides(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    seq: str,
    per: str,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Both sides in one frame with ``n_l`` and ``n_r``: arrivals of each side so far."""
    if per not in ("key", "stream"):
        raise ValueError(f"per must be 'key' or 'stream', not {per!r}")
    both = tag_sides(left, right, on, seq)
    return running(
        both,
        list(on) if per == "key" else [],
        "at",
        {
            "n_l": F.col("is_left").cast("bigint"),
            "n_r": (~F.col("is_left")).cast("bigint"),
        },
        split_rows=split_rows,
    )


def tag_sides(left: DataFrame, right: DataFrame, on: Sequence[str], seq: str) -> DataFrame:
    on = list(on)
    clash = {*left.columns, *right.columns} & {"at", "is_left", "n_l", "n_r"} - {seq}
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        others = [c for c in df.columns if c not in (*on, seq)]
        mine = F.struct(*others) if others else F.struct(F.lit(1).alias("_none"))
        held = {"left_row": mine} if is_left else {"right_row": mine}
        return present(df, on).select(
            *on,
            F.col(seq).alias("at"),
            F.lit(is_left).alias("is_left"),
            *[c.alias(n) for n, c in held.items()],
        )

    return side(left, True).unionByName(side(right, False), allowMissingColumns=True)


def remembered_pairs(
    numbered: DataFrame,
    on: Sequence[str],
    capacity: int,
    retain: str,
    arriving: Column | None = None,
) -> DataFrame:
    """Pairs of numbered rows of opposite sides that meet in memory.

    With ``rank`` a row's own arrival number and ``seen`` how many rows of its side
    had arrived when the other row came, the earlier row is still remembered if
    ``rank > seen - capacity`` (latest), or if ``rank < capacity or rank = seen``
    (first).  Instead of testing all pairs of a key, remembered rows are filed under
    slots and each arriving row looks into the one or two slots that matter to it.
    Both roles read all columns of ``numbered``, so it is shuffled once for both.
    ``arriving`` limits the later row of a pair, for a stream that carries old rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if retain not in ("first", "latest"):
        raise ValueError(f"retain must be 'first' or 'latest', not {retain!r}")
    is_left = F.col("is_left")
    own = F.when(is_left, F.col("n_l")).otherwise(F.col("n_r"))
    other = F.when(is_left, F.col("n_r")).otherwise(F.col("n_l"))
    slot_of, slots_to_see, meets = (_first_slots if retain == "first" else _latest_slots)(capacity)

    held = numbered.select(
        *on,
        (~is_left).alias("_for_left"),
        own.alias("rank"),
        F.struct("at", "left_row", "right_row").alias("_held"),
    ).withColumn("_slot", slot_of)
    probe = numbered.where(F.lit(True) if arriving is None else arriving).select(
        *on,
        is_left.alias("_for_left"),
        other.alias("seen"),
        F.struct("at", "left_row", "right_row").alias("_probe"),
    ).where(F.col("seen") > 0)
    looks = probe.withColumn("_slot", F.explode(slots_to_see))
    met = held.join(looks, [*on, "_for_left", "_slot"]).where(meets)

    left = F.when(F.col("_for_left"), F.col("_probe")).otherwise(F.col("_held"))
    right = F.when(F.col("_for_left"), F.col("_held")).otherwise(F.col("_probe"))
    return met.select(
        *on,
        left["at"].alias("left_seq"),
        right["at"].alias("right_seq"),
        left["left_row"].alias("left_row"),
        right["right_row"].alias("right_row"),
    )


def _latest_slots(capacity: int) -> tuple[Column, Column, Column]:
    """Slots are blocks of ``capacity`` ranks; a look-back touches two of them at most."""
    rank, seen = F.col("rank"), F.col("seen")
    oldest = F.greatest(F.lit(1), seen - capacity + 1)
    blocks = F.array_distinct(
        F.array(F.floor((oldest - 1) / capacity), F.floor((seen - 1) / capacity))
    )
    return F.floor((rank - 1) / capacity), blocks, (rank <= seen) & (rank > seen - capacity)


def _first_slots(capacity: int) -> tuple[Column, Column, Column]:
    """Slot 0 holds the lasting rows; any other row lies alone under its rank."""
    rank, seen = F.col("rank"), F.col("seen")
    lasting = F.lit(0).cast("bigint")
    slot_of = F.when(rank < capacity, lasting).otherwise(rank)
    wanted = F.when(seen < capacity, F.array(lasting)).otherwise(F.array(lasting, seen))
    return slot_of, wanted, rank <= seen


def flatten_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, on: Sequence[str], seq: str
) -> DataFrame:
    def fields(df: DataFrame, row: str) -> list[Column]:
        return [F.col(row)[c].alias(c) for c in df.columns if c not in (*on, seq)]

    taken = fields(left, "left_row") + fields(right, "right_row")
    return pairs.select(*on, *taken, "left_seq", "right_seq")


def bounded_multi_join(
    sides: Sequence[DataFrame],
    on: Sequence[str],
    seq: str = "seq",
    capacity: int = DEFAULT_CAPACITY,
    retain: str = "first",
    per: str = "key",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """`bounded_join` of any number of sides: an arrival joins what every other side remembers.

    A combination of one row per side comes out when its latest row arrives, if each other row
    is still remembered by then.  For every side the rows arriving there look the others up,
    one after the other, in the slots of `remembered_pairs`.  The result has ``on``, the other
    columns of all sides, and ``seq_1``, ``seq_2`` ... of their rows.
    """
    sides, on = list(sides), list(on)
    if len(sides) < 2:
        raise ValueError("a join has at least two sides")
    if per not in ("key", "stream"):
        raise ValueError(f"per must be 'key' or 'stream', not {per!r}")
    if capacity < 1 or retain not in ("first", "latest"):
        raise ValueError("capacity is at least 1, retain 'first' or 'latest'")
    others = [c for side in sides for c in side.columns if c not in (*on, seq)]
    if len({c.lower() for c in others}) < len(others):
        raise ValueError("columns other than the key and the order need different names on all sides")
    numbers = range(1, len(sides) + 1)

    def tagged(k: int, side: DataFrame) -> DataFrame:
        own = [c for c in side.columns if c not in (*on, seq)]
        held = F.struct(*own) if own else F.struct(F.lit(1).alias("_none"))
        return present(side, on).select(*on, F.col(seq).alias("at"), F.lit(k).alias("side"), held.alias(f"row_{k}"))

    both = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [tagged(k, side) for k, side in zip(numbers, sides, strict=True)],
    )
    counted = running(
        both, on if per == "key" else [], "at",
        {f"n_{k}": (F.col("side") == k).cast("bigint") for k in numbers}, split_rows=split_rows,
    )
    slot_of, slots_to_see, meets = (_first_slots if retain == "first" else _latest_slots)(capacity)

    def held_on(k: int) -> DataFrame:
        mine = counted.where(F.col("side") == k)
        ranked = mine.select(*on, F.col("at").alias(f"seq_{k}"), F.col(f"row_{k}"), F.col(f"n_{k}").alias("rank"))
        return ranked.withColumn("_slot", slot_of)

    def arriving_on(k: int) -> DataFrame:
        seen = [f"n_{j}" for j in numbers if j != k]
        out = counted.where(F.col("side") == k).select(*on, F.col("at").alias(f"seq_{k}"), f"row_{k}", *seen)
        for j in numbers:
            if j == k:
                continue
            looks = out.withColumnRenamed(f"n_{j}", "seen").where(F.col("seen") > 0).withColumn("_slot", F.explode(slots_to_see))
            out = held_on(j).join(looks, [*on, "_slot"]).where(meets).drop("_slot", "rank", "seen")
        return out

    met = reduce(DataFrame.unionByName, [arriving_on(k) for k in numbers])
    taken = [
        F.col(f"row_{k}")[c].alias(c)
        for k, side in zip(numbers, sides, strict=True)
        for c in side.columns
        if c not in (*on, seq)
    ]
    return met.select(*on, *taken, *[f"seq_{k}" for k in numbers])


def pair_up(
    df: DataFrame, key: str, seq: str = "seq", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Every second arrival of a key; the first of each two only waits."""
    numbered = arrival_number(present(df, [key]), [key], seq, "_nth", split_rows)
    return numbered.where(F.col("_nth") % 2 == 0).drop("_nth")


def pair_up_obj_subj(
    df: DataFrame,
    subj: str = "subj",
    obj: str = "obj",
    seq: str = "seq",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """`pair_up` on the object, or on the subject where there is no object: ``letter``."""
    keyed = df.withColumn("letter", F.coalesce(F.col(obj), F.col(subj)))
    return pair_up(keyed, "letter", seq, split_rows).select("letter", seq)


def threshold_reached(
    df: DataFrame,
    key: str,
    value: str,
    seq: str = "seq",
    n: int = DEFAULT_THRESHOLD,
    once: bool = False,
) -> DataFrame:
    """Arrivals of a key at which it has had exactly ``n`` distinct values: ``key, seq``.

    The very first arrival of a key never counts.  Until value n+1 shows up every
    further arrival counts again; ``once`` keeps only the first of them.

    Those arrivals lie between the first appearances of value n and value n+1, so
    each key needs only its n+1 earliest values (picked before the shuffle) and one
    range per key is joined back.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = present(df, [key, value]).select(key, value, seq)
    appeared = rows.groupBy(key, value).agg(F.min(seq).alias("_first"))
    in_order = W.partitionBy(key).orderBy("_first")
    earliest = appeared.withColumn("_d", F.row_number().over(in_order)).where(F.col("_d") <= n + 1)
    spans = earliest.groupBy(key).agg(
        F.min("_first").alias("_begin"),
        F.max(F.when(F.col("_d") == n, F.col("_first"))).alias("_from"),
        F.max(F.when(F.col("_d") == n + 1, F.col("_first"))).alias("_until"),
    ).where(F.col("_from").isNotNull())
    within = (
        (F.col(seq) >= F.col("_from"))
        & (F.col(seq) > F.col("_begin"))
        & (F.col("_until").isNull() | (F.col(seq) < F.col("_until")))
    )
    reached = rows.select(key, seq).join(spans, key).where(within).select(key, seq)
    if once:
        return reached.groupBy(key).agg(F.min(seq).alias(seq))
    return reached
