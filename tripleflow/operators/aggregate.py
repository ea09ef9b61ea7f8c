"""Aggregates and statistics over result and measurement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.functions.ordered import SPLIT_ROWS, arrival_number, running
from tripleflow.functions.stats import f_upper_tail
from tripleflow.functions.text import leading_number, number_or_null

# Fixed value: form of the line a counter leaves in a run log.
PARTIAL_COUNT = "CounterTerminal([0-9]+): partialCount=([0-9]+)"


def partial_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    """The lines that report a partial count: other columns, ``id``, ``partial``."""
    others = [c for c in lines.columns if c != col]
    found = lines.where(F.col(col).rlike(PARTIAL_COUNT))
    return found.select(
        *others,
        F.regexp_extract(col, PARTIAL_COUNT, 1).cast("bigint").alias("id"),
        F.regexp_extract(col, PARTIAL_COUNT, 2).cast("bigint").alias("partial"),
    )


def rollup_partials(
    lines: DataFrame, col: str = "line", by: tuple[str, ...] = (), strict: bool = False
) -> DataFrame:
    """Sum of the partial counts per counter: ``by, id, total``.

    ``strict`` fails on a line that reports no count; otherwise such lines are skipped.
    """
    if strict:
        checked = F.when(F.col(col).rlike(PARTIAL_COUNT), F.col(col)).otherwise(
            F.raise_error(F.concat(F.lit("no counter id in: "), F.coalesce(F.col(col), F.lit("NULL"))))
        )
        lines = lines.withColumn(col, checked)
    return partial_counts(lines, col).groupBy(*by, "id").agg(F.sum("partial").alias("total"))


def _mean_or_nan(number: Column) -> Column:
    return F.round(F.coalesce(F.avg(number), F.lit(float("nan"))), 3)


def numeric_mean(df: DataFrame, col: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, to 3 decimals, of the values of ``col`` that are numbers; NaN without any."""
    return df.groupBy(*by).agg(_mean_or_nan(number_or_null(F.col(col))).alias("mean"))


def means_by(latencies: DataFrame, by: str = "file", col: str = "line") -> DataFrame:
    """`numeric_mean` per file, and the line ``mean file`` that reports it."""
    means = numeric_mean(latencies, col, (by,))
    return means.withColumn("report", F.concat(F.format_string("%.3f ", "mean"), F.col(by)))


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: ``f, df_between, df_within, p``.

    Each group is reduced to size, mean and variance in one pass, and those rows to
    one.  That row alone comes to the driver, where p is worked out.
    """
    groups = (
        df.where(F.col(value).isNotNull())
        .groupBy(group)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("inside"),
        )
    )
    grand = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    sums = groups.crossJoin(F.broadcast(grand)).agg(  # `grand` is one row
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum("inside").alias("within"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
    )
    between_df = (F.col("k") - 1).cast("bigint")
    within_df = (F.col("total") - F.col("k")).cast("bigint")
    ratio = F.try_divide(
        F.try_divide(F.col("between"), between_df), F.try_divide(F.col("within"), within_df)
    )
    row = sums.select(
        F.coalesce(ratio, F.lit(float("nan"))).alias("f"),
        between_df.alias("df_between"),
        within_df.alias("df_within"),
    ).first()
    p = f_upper_tail(row["f"], row["df_between"], row["df_within"])
    return df.sparkSession.createDataFrame(
        [(*row, p)], "f double, df_between bigint, df_within bigint, p double"
    )


def sort_by_leading_number(
    df: DataFrame,
    pos: str,
    col: str = "line",
    rank: str | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Lines ordered by their first token as a number; ``pos`` keeps equal ones in order.

    With ``rank`` the place in that order is added as a column, computed without
    bringing all lines to one task.
    """
    keyed = df.withColumn("_number", leading_number(F.col(col)))
    if rank is None:
        return keyed.orderBy("_number", pos).drop("_number")
    # Lines with one number are numbered among themselves, after all smaller numbers.
    sizes = keyed.groupBy("_number").agg(F.count(F.lit(1)).alias("_size"))
    upto = _rows_below(sizes, "_number", "_size", split_rows)
    within = arrival_number(keyed, ["_number"], pos, "_nth", split_rows)
    placed = within.join(upto, within["_number"].eqNullSafe(upto["_value"]))
    return placed.withColumn(rank, F.col("_below") + F.col("_nth")).drop(
        "_number", "_nth", "_value", "_below"
    )


def _rows_below(sizes: DataFrame, value: str, size: str, split_rows: int) -> DataFrame:
    """``_value, _below``: how many rows have a smaller value."""
    summed = running(sizes, [], value, {"_upto": F.col(size)}, split_rows=split_rows)
    return summed.select(F.col(value).alias("_value"), (F.col("_upto") - F.col(size)).alias("_below"))


def first_and_last(df: DataFrame, by: str, pos: str, first: Column, last: Column) -> DataFrame:
    """Per group the first row that fulfils ``first`` and the last that fulfils ``last``."""
    others = [c for c in df.columns if c not in (by, pos)]
    row = F.struct(*others) if len(others) > 1 else F.col(others[0])
    return df.groupBy(by).agg(
        F.min_by(F.when(first, row), F.when(first, F.col(pos))).alias("first"),
        F.max_by(F.when(last, row), F.when(last, F.col(pos))).alias("last"),
    )
