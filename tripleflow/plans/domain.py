"""Size estimate of a query from the values each variable could take."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.operators.match import condition
from tripleflow.patterns import POSITIONS, Pattern, is_var, var_name, variables

# Sketches keep 65,536 value hashes of each position.
LOG_SIZE = 16


def _positions_by_variable(pats: Sequence[Pattern]) -> dict[str, set[int]]:
    held: dict[str, set[int]] = {}
    for pat in pats:
        for i, part in enumerate(pat):
            if is_var(part):
                held.setdefault(var_name(part), set()).add(i)
    return held


def variable_domains(triples: DataFrame, pats: Sequence[Pattern]) -> DataFrame:
    """One row per variable: ``variable, n_values``, the values found at all its positions.

    Each value is reduced to the set of positions it occurs at, combined before the
    one shuffle there is; all variables are then counted in a single pass over that.
    """
    held = _positions_by_variable(pats)
    used = sorted(set().union(*held.values()))
    at = F.explode(
        F.array(*[F.struct(F.col(POSITIONS[i]).alias("value"), F.lit(1 << i).alias("at")) for i in used])
    )
    values = (
        triples.select(at.alias("_v")).select("_v.*").groupBy("value").agg(F.bit_or("at").alias("at"))
    )

    def everywhere(positions: set[int]) -> Column:
        mask = sum(1 << i for i in positions)
        return F.count_if(F.col("at").bitwiseAND(mask) == mask)

    names = sorted(held)
    counted = values.agg(*[everywhere(held[n]).alias(n) for n in names])
    rows = F.array(
        *[F.struct(F.lit(n).alias("variable"), F.col(n).alias("n_values")) for n in names]
    )
    return counted.select(F.inline(rows))


def sketched_domains(triples: DataFrame, pats: Sequence[Pattern], log_size: int = LOG_SIZE) -> DataFrame:
    """``variable, n_values, error``: `variable_domains` by sketches, in one pass.

    Each position of a triple feeds one theta sketch, made before the one exchange of the
    plan, so a task sends a few sketches instead of its distinct values; a variable's sketch
    is the intersection of those of its positions.  Up to ``2 ** log_size`` values at a
    position all counts are exact (``error`` 0).  Beyond that a sketch keeps a uniform sample of
    the value hashes, of a share of at least ``2 ** log_size`` over the largest number of values
    at one of the variable's positions, so the count is off by three standard deviations,
    ``error``, at most in 99.7 % of cases.  Values are compared as strings; nulls count nowhere.
    """
    held = _positions_by_variable(pats)
    used, names = sorted(set().union(*held.values())), sorted(held)
    sketches = triples.agg(
        *[F.theta_sketch_agg(F.col(POSITIONS[i]).cast("string"), log_size).alias(POSITIONS[i]) for i in used]
    )

    def row(name: str) -> Column:
        own = [F.col(POSITIONS[i]) for i in sorted(held[name])]
        sizes = [F.theta_sketch_estimate(c).cast("double") for c in own]
        largest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        n = F.theta_sketch_estimate(reduce(F.theta_intersection, own)).cast("bigint")
        error = F.when(largest <= 2.0**log_size, 0.0).otherwise(3 * F.sqrt(largest * F.greatest(n, F.lit(1)) / 2.0**log_size))
        return F.struct(F.lit(name).alias("variable"), n.alias("n_values"), error.alias("error"))

    return sketches.select(F.inline(F.array(*[row(n) for n in names])))


def domain_cardinality(
    triples: DataFrame, pats: Sequence[Pattern], log_size: int | None = None
) -> DataFrame:
    """Product over the variables of how many values each can take.

    With ``log_size`` these numbers come from `sketched_domains`, else they are exact.

    ``n_rows`` is NULL when the product exceeds a BIGINT; ``estimate`` is always
    there.  A variable with no value at all makes the product 0.  A query without
    variables has one row if every one of its triples exists, else none.
    """
    if any(variables(p) for p in pats):
        by_variable = variable_domains(triples, pats) if log_size is None else sketched_domains(triples, pats, log_size)
        domains = by_variable.agg(F.collect_list("n_values").alias("sizes"))
        exact = F.aggregate(
            "sizes", F.lit(1).cast("bigint"), lambda acc, n: F.try_multiply(acc, n)
        )
        exact = F.when(F.array_contains("sizes", F.lit(0).cast("bigint")), 0).otherwise(exact)
        rough = F.aggregate("sizes", F.lit(1.0), lambda acc, n: acc * n.cast("double"))
        return domains.select(exact.cast("bigint").alias("n_rows"), rough.alias("estimate"))
    present = reduce(
        Column.__and__,
        [F.coalesce(F.bool_or(condition(p)), F.lit(False)) for p in pats],
    )
    found = triples.agg(present.cast("bigint").alias("n_rows"))
    return found.select("n_rows", F.col("n_rows").cast("double").alias("estimate"))
