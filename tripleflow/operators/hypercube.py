"""Natural joins of many relations, cyclic ones too, in one shuffle of each relation.

Every join variable with a share is an axis of a grid.  A row is placed by the hashes of the
variables it has and copied along the axes it lacks; rows that join meet in exactly one cell,
where all joins are local.  A chain of ordinary joins shuffles its partial results at every
step, and on a cycle these can be far larger than input and output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import AbstractContextManager
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.operators.joins import shared_columns
from tripleflow.operators.match import MATCHED
from tripleflow.patterns import connected_order
from tripleflow.sources.workdir import fresh_folder, setting

CELL = "_cell"
# Off, a join may rely on a partitioning by some of its keys: here, by the cell.
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
# Rows dealt by join keys: hash buckets whose rows are counted, and the rows, in all and as
# a multiple of the mean, beyond which those of a bucket are spread over the grid.
BUCKETS = 4096
CROWDED_ROWS = 100_000
CROWDED_TIMES = 8


def even_shares(relations: Sequence[DataFrame], cells: int) -> dict[str, int]:
    """The same share for every variable of two relations or more, at most ``cells`` cells in all."""
    held = [set(r.columns) - {MATCHED} for r in relations]
    joining = sorted(v for v in set().union(*held) if sum(v in h for h in held) > 1)
    if not joining:
        raise ValueError("the relations share no variable")
    share = max(1, int(cells ** (1 / len(joining)) + 1e-9))
    return dict.fromkeys(joining, share)


def place_in_cells(relation: DataFrame, shares: Mapping[str, int], spread: Column | None = None) -> DataFrame:
    """The rows with their cells: one for each combination of places on the axes they lack.

    With ``spread`` only rows for which it holds are placed, all others in cell -1.
    """
    strides, step = {}, 1
    for axis, share in shares.items():
        strides[axis], step = step, step * share
    own = [a for a in shares if a in relation.columns]
    lacking = [a for a in shares if a not in relation.columns]
    placed = reduce(
        lambda cell, a: cell + F.pmod(F.xxhash64(F.lit(a), F.col(a)), F.lit(shares[a])).cast("int") * strides[a], own, F.lit(0)
    )
    offsets = [sum(n * strides[a] for a, n in zip(lacking, at, strict=True)) for at in product(*[range(shares[a]) for a in lacking])]
    at = F.array(*[placed + o for o in offsets])
    if spread is not None:
        return relation.withColumn(CELL, F.explode(F.when(spread, at).otherwise(F.array(F.lit(-1)))))
    return relation.withColumn(CELL, placed if offsets == [0] else F.explode(at))


def crowded_buckets(relations: Sequence[DataFrame], on: Sequence[str]) -> list[int]:
    """Hash buckets of ``on`` with far more rows than others; one job, whose tasks send one count a bucket."""
    hashed = [r.select(_bucket(on).alias("b")) for r in relations]
    counts = reduce(DataFrame.unionAll, hashed).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    most = max(CROWDED_ROWS, CROWDED_TIMES * sum(r.n for r in counts) // BUCKETS)
    return sorted(r.b for r in counts if r.n > most)


def _bucket(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int")


def joins_by_keys(relations: Sequence[DataFrame], shares: Mapping[str, int], tasks: int, distinct: bool = False) -> DataFrame:
    """Joins in the given order, each relation dealt once, by what it is joined on.

    No row is copied but those of crowded values of the first join, over the axes it lacks.
    """
    def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        there = rows.repartition(tasks, *keys) if keys else rows
        return there.distinct() if distinct else there

    if len(relations) == 1:
        return dealt(relations[0], [])
    pair = relations[:2]
    on = shared_columns(*pair)
    if crowded := crowded_buckets(pair, on):
        # an axis that neither has would place, and so join, every row several times
        axes = {a: n for a, n in shares.items() if any(a in r.columns for r in pair)}
        pair = [place_in_cells(r, axes, _bucket(on).isin(crowded)) for r in pair]
        on = [CELL, *on]
    joined = dealt(pair[0], on).join(dealt(pair[1], on), on).drop(CELL)
    for rows in relations[2:]:
        keys = shared_columns(joined, rows)
        joined = joined.join(dealt(rows, keys), keys)
    return joined


def local_joins(relations: Sequence[DataFrame], shares: Mapping[str, int], distinct: bool = False) -> DataFrame:
    """The plan of the join.  Within `co_partitioned` it has one exchange for each relation.

    With fewer cells than the session's shuffle partitions a cell would be the work of one task,
    however large: then rows are dealt by the variables of their join and partial results are
    shuffled, so copies for the cells would meet nothing more; see `joins_by_keys`.  ``distinct``
    takes every relation as a set; its rows lose their copies where they are dealt to, without
    an exchange of its own.
    """
    cells = prod(shares.values())
    orders = connected_order([set(r.columns) - {MATCHED} for r in relations])
    if len(orders) != 1:
        raise ValueError("the relations fall into parts that share no variable")
    ordered = [relations[i].drop(MATCHED) for i in orders[0]]
    tasks = int(relations[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cells < tasks:
        return joins_by_keys(ordered, shares, tasks, distinct)
    dealt = [place_in_cells(rows, shares).repartition(cells, CELL) for rows in ordered]
    return reduce(
        lambda a, b: a.join(b, shared_columns(a, b)), [r.distinct() for r in dealt] if distinct else dealt
    ).drop(CELL)


def co_partitioned(spark: SparkSession) -> AbstractContextManager[None]:
    return setting(spark, _CO_PARTITION, "false")


def one_shuffle_join(
    relations: Sequence[DataFrame],
    shares: Mapping[str, int] | None = None,
    cells: int = 64,
    distinct: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Natural join of connected relations, bag semantics, with one exchange for each relation.

    ``shares`` gives the number of places on each axis; their product is the number of cells.
    A relation is copied as often as the shares of the variables it lacks multiply to, so give
    a variable that only small relations lack a large share; the default is `even_shares`.  A
    hot value of one variable still spreads along the other axes.  ``distinct`` takes the
    relations as sets.  ``keep`` names the columns wanted, of as many rows; others travel no
    further than the last join that needs them.  With fewer cells than shuffle partitions see
    `local_joins`.  The result is written to the shared folder, as the plan needs a setting
    that holds for its own run alone.
    """
    relations = list(relations)
    spark = relations[0].sparkSession
    with co_partitioned(spark):
        joined = local_joins(relations, shares or even_shares(relations, cells), distinct)
        if keep is not None:
            joined = joined.select(*keep)
        path = fresh_folder(spark, "one-shuffle")
        joined.write.parquet(path)
    return spark.read.schema(joined.schema).parquet(path)
