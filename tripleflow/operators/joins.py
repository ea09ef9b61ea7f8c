"""Natural joins of bindings: bag semantics, inner, on all variables in common."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.functions.ordered import list_if_few
from tripleflow.operators.match import MATCHED

COPIES = "_copies"
# Cell of a row whose key is spread over a grid of tasks.
CELLS = ("_cell_l", "_cell_r")
_CHUNK = 65_536
# Most parts one side of a hot key is cut into, and so the most copies made of the other.
MAX_PARTS = 256


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns and c != MATCHED]


def collapse_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies; combined before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def expand_copies(df: DataFrame, copies: str = COPIES) -> DataFrame:
    """Repeat each row ``copies`` times, in chunks so that no array grows with the data."""
    chunk, last = F.col("_chunk"), F.col(copies) - 1
    return (
        df.where(F.col(copies) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / _CHUNK))))
        .withColumn(
            "_one",
            F.explode(
                F.array_repeat(
                    F.lit(1), F.least(F.lit(_CHUNK), F.col(copies) - chunk * _CHUNK).cast("int")
                )
            ),
        )
        .drop("_chunk", "_one", copies)
    )


def _without_marker(df: DataFrame) -> DataFrame:
    return df.drop(MATCHED) if len(df.columns) > 1 else df


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row, for sides that share no variable.

    The result is the product of the sizes by definition, so keep one side small.
    Two streams are joined on a constant, the only form Spark runs for them.
    """
    if MATCHED in left.columns and MATCHED in right.columns:
        right = right.withColumnRenamed(MATCHED, "_m2")
    if left.isStreaming and right.isStreaming:
        paired = left.withColumn("_k", F.lit(0)).join(right.withColumn("_k", F.lit(0)), "_k").drop("_k")
    else:
        paired = left.crossJoin(right)
    return _without_marker(paired.drop("_m2"))


def times_matches(bindings: DataFrame, matches: DataFrame) -> DataFrame:
    """Repeat every row once per row of ``matches``, which binds no variable.

    ``matches`` is counted to a single row first, so nothing but that number is sent.
    """
    if bindings.isStreaming:
        return cross(bindings, matches)
    number = matches.agg(F.count(F.lit(1)).alias(COPIES))
    return _without_marker(expand_copies(bindings.crossJoin(F.broadcast(number))))


def natural_join(
    left: DataFrame,
    right: DataFrame,
    hot_rows: int | None = None,
    salt: tuple[int, int] | None = None,
) -> DataFrame:
    """Inner equi-join on all columns in common; without any it is `cross`.

    Spark chooses broadcast, hash or sort-merge and splits skewed partitions of a
    batch join at run time.  ``hot_rows`` adds an explicit split for batch joins whose
    hot keys are known to be a problem: see `split_join`.  ``salt`` spreads every key,
    unmeasured, and so serves streams, whose joins are not split at run time: see
    `spread`.
    """
    shared = shared_columns(left, right)
    if not shared:
        return cross(left, right)
    every = {*left.columns, *right.columns}
    if len({c.lower() for c in every}) < len(every):
        raise ValueError(f"Spark cannot tell columns apart that differ in case only: {sorted(every)}")
    if hot_rows and not (left.isStreaming or right.isStreaming):
        return split_join(left, right, shared, hot_rows)
    right = right.drop(MATCHED)
    if salt:
        left, right = spread(left, right, salt)
        return left.join(right, [*shared, *CELLS], "inner").drop(*CELLS)
    return left.join(right, shared, "inner")


def spread(
    left: DataFrame, right: DataFrame, parts: tuple[int, int]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell columns to join on as well, so that a key fills many tasks.

    With ``parts = (a, b)`` a left row goes to one of a lines and all b columns of a
    grid, a right row to all lines and one column; each pair meets in exactly one
    cell.  ``(a, 1)`` spreads the left side and copies the right one a times.
    """
    a, b = parts

    def placed(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        cell = F.pmod(F.xxhash64(*df.columns), F.lit(n_own)).cast("int")
        return df.withColumns({own: cell}).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    line, column = CELLS
    return placed(left, line, a, column, b), placed(right, column, b, line, a)


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame:
    """Equi-join in which a key over ``hot_rows`` rows is cut into a grid of parts.

    A small job first counts the keys that are over the limit on either side (the
    counts are combined before they are shuffled).  All other keys are joined as
    usual.  A hot key with l left and r right rows gets ceil(l/hot_rows) x
    ceil(r/hot_rows) cells, though no more than MAX_PARTS lines or columns; each left row goes to one line of cells, each right row
    to one column, so every pair meets exactly once.  Copies of a hot row are counted
    before and expanded after: what is placed is distinct, and placing by hash is
    both even and repeatable when a task is run again.
    """
    on = list(on)
    left, right = left.drop(MATCHED), right.drop(MATCHED)

    def over_limit(side: DataFrame, name: str) -> DataFrame:
        sizes = side.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        return sizes.where(F.col("_n") > hot_rows).select(
            *on,
            F.least(F.lit(MAX_PARTS), F.ceil(F.col("_n") / hot_rows)).cast("int").alias("_parts_" + name),
        )

    hot = over_limit(left, "l").join(over_limit(right, "r"), on, "full").fillna(
        1, ["_parts_l", "_parts_r"]
    )
    hot, found = list_if_few(hot)
    if found == []:
        return left.join(right, on)

    def placed(side: DataFrame, name: str, other: str) -> DataFrame:
        distinct = collapse_copies(side.join(hot, on, "left_semi"))
        own = [c for c in distinct.columns if c != COPIES]
        return (
            distinct.join(hot, on)
            .withColumn("_cell_" + name, F.pmod(F.xxhash64(*own), F.col("_parts_" + name)).cast("int"))
            .withColumn("_cell_" + other, F.explode(F.sequence(F.lit(0), F.col("_parts_" + other) - 1)))
            .drop("_parts_l", "_parts_r")
            .withColumnRenamed(COPIES, "_copies_" + name)
        )

    met = placed(left, "l", "r").join(placed(right, "r", "l"), [*on, *CELLS])
    from_hot = expand_copies(met.withColumn(COPIES, F.col("_copies_l") * F.col("_copies_r")))
    from_rest = left.join(hot, on, "left_anti").join(right.join(hot, on, "left_anti"), on)
    return from_rest.unionByName(from_hot.drop(*CELLS, "_copies_l", "_copies_r"))


def multi_join(
    frames: Sequence[DataFrame],
    hot_rows: int | None = None,
    salt: tuple[int, int] | None = None,
) -> DataFrame:
    """Natural join of any number of frames, left to right."""
    if not frames:
        raise ValueError("nothing to join")
    return reduce(lambda a, b: natural_join(a, b, hot_rows, salt), frames)


def bound_within(left_time: Column, right_time: Column, gap: str) -> Column:
    """Range condition letting a stream join forget rows more than ``gap`` apart."""
    width = F.expr(f"INTERVAL {gap}")
    return (right_time >= left_time - width) & (right_time <= left_time + width)
