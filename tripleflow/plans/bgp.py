"""Conjunctive queries: all patterns of a query joined on their variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.operators.joins import cross, multi_join, times_matches
from tripleflow.operators.match import Triples, condition, fits_any, match
from tripleflow.patterns import (
    Pattern,
    connected_order,
    group_by_shared_vars,
    is_var,
    numbered,
    output_names,
    part_products,
    variables,
)

WEIGHT = "_w"
# Rows of a pattern up to which it is sent to all tasks, and beyond which it never is.
FEW_ROWS = 10_000
MANY_ROWS = 200_000


def _require(pats: Sequence[Pattern]) -> list[Pattern]:
    pats = list(pats)
    if not pats:
        raise ValueError("a query needs at least one pattern")
    return pats


def _planned(triples: Triples, pats: Sequence[Pattern]) -> tuple[Triples, list[Pattern], dict[str, str]]:
    """Triples and patterns under the plan's own variable names, and those names."""
    pats = _require(pats)
    inner, names = numbered(pats)
    if not isinstance(triples, DataFrame):
        triples = {i: triples[p] for i, p in zip(inner, pats, strict=True)}
    return triples, inner, names


def _named(rows: DataFrame, inner: Mapping[str, str], names: dict[str, str] | None) -> DataFrame:
    """The user's names, given back at the very end, in the order in which they are written."""
    outer = output_names(inner, names)
    others = [c for c in rows.columns if c not in inner.values()]
    return rows.select(*[F.col(c).alias(outer[v]) for v, c in inner.items()], *others)


def _sizes(triples: Triples, pats: Sequence[Pattern]) -> dict[Pattern, int]:
    """The patterns that fix a subject or object, with their numbers of rows.

    One job counts them, in one scan of the triples.
    """
    asked = [p for p in dict.fromkeys(pats) if variables(p) and not (is_var(p[0]) and is_var(p[2]))]
    frames = [triples] if isinstance(triples, DataFrame) else [triples[p] for p in asked]
    if len(pats) < 2 or not asked or any(f.isStreaming for f in frames):
        return {}
    if isinstance(triples, DataFrame):
        found = fits_any(triples, asked).agg(*[F.count_if(condition(p)).alias(f"n{i}") for i, p in enumerate(asked)]).first()
        numbers = dict(enumerate(found))
    else:
        counts = [match(triples, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, p in enumerate(asked)]
        numbers = dict(map(tuple, reduce(DataFrame.unionAll, counts).collect()))
    return {p: numbers[i] for i, p in enumerate(asked)}


def _hinted(rows: DataFrame, number: int | None) -> DataFrame:
    """Few rows are sent to all tasks, many never; where the number is not known, Spark picks the join.

    A join on a variable of few values would deal all other rows to as many tasks, and a
    filtered table that looks small in its file may not be.
    """
    if number is None or FEW_ROWS < number <= MANY_ROWS:
        return rows
    return F.broadcast(rows) if number <= FEW_ROWS else rows.hint("merge")


def _assemble(
    triples: Triples,
    pats: Sequence[Pattern],
    parts: list[DataFrame],
    allow_cross: bool,
) -> DataFrame:
    """Join the connected parts, then multiply by the patterns that bind nothing."""
    if len(parts) > 1 and not allow_cross:
        raise ValueError(
            "the patterns fall into parts that share no variable, so the result is their "
            "product; pass allow_cross=True to build it, or use count_bgp to count it"
        )
    constant = [match(triples, p) for p in pats if not variables(p)]
    if not parts:
        parts, constant = constant[:1], constant[1:]
    joined = reduce(cross, parts)
    return reduce(times_matches, constant, joined)


def bgp(
    triples: Triples,
    pats: Sequence[Pattern],
    allow_cross: bool = False,
    hot_rows: int | None = None,
    salt: tuple[int, int] | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """All bindings that satisfy every pattern, joined left-deep in written order.

    A pattern sharing nothing with those before it waits for a later one that does.
    Patterns that fix a subject or object are counted first, in a job of their own, and
    sent to all tasks if they have few rows.  ``hot_rows`` and ``salt`` are passed on to
    `natural_join`; with them nothing is counted.  Variables are exact strings; ``names``
    gives columns of other names, as needed by variables that differ in case only.
    """
    triples, pats, inner = _planned(triples, pats)
    binding = [p for p in pats if variables(p)]
    sizes = {} if hot_rows or salt else _sizes(triples, binding)
    parts = [
        multi_join([_hinted(match(triples, binding[i]), sizes.get(binding[i])) for i in order], hot_rows, salt)
        for order in connected_order([variables(p) for p in binding])
    ]
    return _named(_assemble(triples, pats, parts, allow_cross), inner, names)


def bgp_grouped(
    triples: Triples,
    pats: Sequence[Pattern],
    allow_cross: bool = False,
    hot_rows: int | None = None,
    salt: tuple[int, int] | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """The rows of `bgp` from a bushy plan: each group of patterns first, then the groups.

    Of a group whose product other groups restrict, a part waits: see `part_products`.
    """
    triples, pats, inner = _planned(triples, pats)
    binding = [p for p in pats if variables(p)]
    sizes = {} if hot_rows or salt else _sizes(triples, binding)
    groups = part_products(binding, group_by_shared_vars(binding)) if binding else []

    def joined_group(group: list[int]) -> DataFrame:
        rows = multi_join([_hinted(match(triples, binding[i]), sizes.get(binding[i])) for i in group], hot_rows, salt)
        most = prod(sizes.get(binding[i], FEW_ROWS + 1) for i in group)
        return F.broadcast(rows) if most <= FEW_ROWS and all(binding[i] in sizes for i in group) else rows

    joined = [joined_group(group) for group in groups]
    bound = [set().union(*(variables(binding[i]) for i in group)) for group in groups]
    parts = [
        multi_join([joined[g] for g in order], hot_rows, salt)
        for order in connected_order(bound)
    ]
    return _named(_assemble(triples, pats, parts, allow_cross), inner, names)


def count_bgp(
    triples: Triples,
    pats: Sequence[Pattern],
    by: Sequence[str] = (),
    eager: str = "patterns",
    allow_cross: bool = False,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """How many rows `bgp` has, in total or per value of the variables in ``by``: ``rows``.

    No row is built that is only going to be counted.  A variable that appears in
    one pattern alone and not in ``by`` is counted away in that pattern, before any
    shuffle, so a hot key enters a join as one row with a weight.  Parts that share
    no variable are counted apart and their numbers multiplied; grouped by variables of
    several such parts the result is a product and needs ``allow_cross``.  ``eager="joins"``
    also sums after each join that used a variable for the last time; this pays
    when few distinct values remain, and costs a shuffle otherwise.  A variable called
    ``rows`` needs another name in ``names``.
    """
    if eager not in ("patterns", "joins"):
        raise ValueError(f"unknown mode {eager!r}")
    triples, pats, inner = _planned(triples, pats)
    unknown = set(by) - set(inner)
    if unknown:
        raise ValueError(f"no pattern binds {sorted(unknown)}")
    outer = output_names(by, names)
    if any(column.lower() == "rows" for column in outer.values()):
        raise ValueError("a column 'rows' holds the counts; rename the variable with names=")
    wanted = [inner[v] for v in outer]
    binding = [p for p in pats if variables(p)]

    totals = [
        match(triples, p).agg(F.count(F.lit(1)).alias(WEIGHT)) for p in pats if not variables(p)
    ]
    grouped_parts = 0
    for order in connected_order([variables(p) for p in binding]):
        own = [c for c in wanted if any(c in variables(binding[i]) for i in order)]
        totals.append(_count_part(triples, [binding[i] for i in order], own, eager))
        grouped_parts += bool(own)
    if grouped_parts > 1 and not allow_cross:
        raise ValueError(
            "the variables to group by stand in parts that share none, so the result is a "
            "product; pass allow_cross=True to build it"
        )

    def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
        # All but the frames grouped by a wanted variable have exactly one row.
        paired = a.withColumnRenamed(WEIGHT, "_a").crossJoin(b.withColumnRenamed(WEIGHT, "_b"))
        return paired.withColumn(WEIGHT, F.col("_a") * F.col("_b")).drop("_a", "_b")

    result = reduce(multiply, totals).withColumnRenamed(WEIGHT, "rows")
    if wanted:
        result = result.where(F.col("rows") > 0)
    columns = [F.col(inner[v]).alias(column) for v, column in outer.items()]
    return result.select(*columns, "rows")


def _count_part(
    triples: Triples, pats: Sequence[Pattern], by: Sequence[str], eager: str
) -> DataFrame:
    """Weighted left-deep join of connected patterns, summed at the end."""

    def needed_after(i: int) -> set[str]:
        return set(by).union(*(variables(p) for p in pats[i + 1:]))

    def weighted(i: int) -> DataFrame:
        rows = match(triples, pats[i])
        elsewhere = set(by).union(*(variables(p) for j, p in enumerate(pats) if j != i))
        kept = [c for c in rows.columns if c in elsewhere]
        if len(kept) < len(rows.columns):
            return rows.groupBy(*kept).agg(F.count(F.lit(1)).alias(WEIGHT))
        return rows.withColumn(WEIGHT, F.lit(1).cast("bigint"))

    acc = weighted(0)
    for i in range(1, len(pats)):
        right = weighted(i).withColumnRenamed(WEIGHT, "_wr")
        on = [c for c in acc.columns if c in right.columns]
        acc = acc.join(right, on).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_wr")).drop("_wr")
        kept = [c for c in acc.columns if c in needed_after(i)]
        dropped = len(kept) < len(acc.columns) - 1
        if dropped and eager == "joins" and i < len(pats) - 1:
            acc = acc.groupBy(*kept).agg(F.sum(WEIGHT).alias(WEIGHT))
        elif dropped:
            acc = acc.select(*kept, WEIGHT)
    total = F.coalesce(F.sum(WEIGHT), F.lit(0).cast("bigint")).alias(WEIGHT)
    return acc.groupBy(*by).agg(total)
