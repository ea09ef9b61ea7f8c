"""Exact running totals in arrival order that no single task has to carry.

A plain window ``PARTITION BY key ORDER BY seq`` puts every row of a key into one
task.  When a key is large, `running` cuts its rows into consecutive stretches of
``seq``, accumulates inside each stretch, and adds what the earlier stretches came
to.  The only whole-key window left runs over one row per stretch.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with more rows than this is cut into stretches.
SPLIT_ROWS = 1_000_000
# Most stretches of one key, and so the most rows its whole-key window sees.
MAX_STRETCHES = 4_096
# Broadcast a helper table only up to this many rows; beyond it Spark chooses.
BROADCAST_ROWS = 200_000
# Most large keys that are listed in the plan; more of them stay a distributed table.
LISTED_KEYS = 10_000

_ALL, _BIG, _STRETCH, _AT = "_all", "_big", "_stretch", "_at"


def list_if_few(groups: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """``groups`` as a broadcast list with its rows, or as it is and None if it is long.

    A listed table is computed once, so its parts of a plan cannot disagree.
    """
    found = groups.limit(LISTED_KEYS + 1).collect()
    if len(found) > LISTED_KEYS:
        return groups, None
    return F.broadcast(groups.sparkSession.createDataFrame(found, groups.schema)), found


def _broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right["_r_" + key])
    return condition


def _left_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on NULL-safe keys that adds only the non-key columns of ``right``."""
    renamed = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    return left.join(renamed, _same_keys(left, renamed, keys), "left").drop(
        *["_r_" + k for k in keys]
    )


def _plain(df: DataFrame, keys: Sequence[str], seq: str, totals, maxima) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns(
        {n: F.sum(c).over(w) for n, c in totals.items()}
        | {n: F.max(c).over(w) for n, c in maxima.items()}
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    totals: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Add running sums (``totals``) and running maxima, inclusive of the row itself.

    ``seq`` must be unique within a key and castable to double without changing
    its order.  With no ``keys`` the whole frame is one sequence.  Two small jobs
    run while the plan is built: the key sizes, pre-aggregated, of which only the
    keys over ``split_rows`` come back, and if there are any, the cut points of ``seq``.
    """
    totals, maxima = dict(totals or {}), dict(maxima or {})
    keys = list(keys)
    if not keys:
        whole = df.withColumn(_ALL, F.lit(0))
        return running(whole, [_ALL], seq, totals, maxima, split_rows).drop(_ALL)

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big, found = list_if_few(sizes.where(F.col("_n") > split_rows))
    if found == []:
        return _plain(df, keys, seq, totals, maxima)
    if found is None:
        big_rows, n_big = sizes.where(F.col("_n") > split_rows).agg(F.sum("_n"), F.count("_n")).first()
    else:
        big_rows, n_big = sum(row["_n"] for row in found), len(found)
    if keys == [_ALL]:
        marked = df.withColumn(_BIG, F.lit(True))
    else:
        marked = _left_lookup(df, big.select(*keys, F.lit(True).alias(_BIG)), keys)

    # Cut so that no stretch has more than about half of `split_rows` rows of all large
    # keys together, however a key's rows clump.  A NULL position sorts first.
    stretches = min(MAX_STRETCHES, max(2, math.ceil(2 * big_rows / split_rows)))
    at = F.coalesce(F.col(seq).cast("double"), F.lit(-math.inf))
    positioned = marked.withColumn(_AT, at)
    cuts = positioned.where(F.col(_BIG)).approxQuantile(
        _AT, [i / stretches for i in range(1, stretches)], 1.0 / (4 * stretches)
    )
    splits = [-math.inf, *sorted(set(cuts) - {-math.inf}), math.inf]
    if len(splits) == 2:  # no position to cut at
        return _plain(df, keys, seq, totals, maxima)
    cut = Bucketizer(splits=splits, inputCol=_AT, outputCol=_STRETCH).transform(positioned)
    rows = cut.withColumn(
        _STRETCH, F.when(F.col(_BIG), F.col(_STRETCH).cast("int")).otherwise(F.lit(-1))
    ).drop(_AT)

    inner = _plain(rows, [*keys, _STRETCH], seq, totals, maxima)

    per_stretch = rows.where(F.col(_BIG)).groupBy(*keys, _STRETCH).agg(
        *[F.sum(c).alias("_before_" + n) for n, c in totals.items()],
        *[F.max(c).alias("_before_" + n) for n, c in maxima.items()],
    )
    earlier = W.partitionBy(*keys).orderBy(_STRETCH).rowsBetween(W.unboundedPreceding, -1)
    before = per_stretch.withColumns(
        {"_before_" + n: F.sum("_before_" + n).over(earlier) for n in totals}
        | {"_before_" + n: F.max("_before_" + n).over(earlier) for n in maxima}
    )
    joined = _left_lookup(
        inner, _broadcast_if(before, n_big * stretches), [*keys, _STRETCH]
    )
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col("_before_" + n), F.lit(0)) for n in totals}
        | {n: F.greatest(F.col(n), F.col("_before_" + n)) for n in maxima}
    ).drop(_BIG, _STRETCH, *["_before_" + n for n in [*totals, *maxima]])


def arrival_number(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Number the rows of each key 1, 2, 3, … in ``seq`` order."""
    return running(df, keys, seq, {name: F.lit(1).cast("bigint")}, split_rows=split_rows)
