"""Acyclic conjunctive queries with every relation first reduced to the rows that take part.

A join tree comes from removing ears: a pattern whose shared variables all lie in one other
pattern hangs below it.  Semi-joins up the tree and down again leave in every relation
exactly the rows that some result has, so no partial join holds rows that a later one
throws away, whatever the order of joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tripleflow.operators.joins import multi_join, shared_columns, times_matches
from tripleflow.operators.match import Triples, match
from tripleflow.patterns import Pattern, connected_order, variables
from tripleflow.plans.bgp import _named, _planned
from tripleflow.sources.workdir import fresh_folder


def join_tree(var_sets: Sequence[set[str]]) -> list[tuple[int, int | None]] | None:
    """``(ear, parent)`` in the order of removal; None if the query is cyclic.

    The last ear of each connected part has no parent.
    """
    left = dict(enumerate(map(set, var_sets)))
    tree: list[tuple[int, int | None]] = []
    while left:
        for ear in reversed(left):
            others = {i: s for i, s in left.items() if i != ear}
            shared = left[ear] & set().union(*others.values())
            parent = next((i for i, s in others.items() if shared and shared <= s), None)
            if parent is not None or not shared:
                tree.append((ear, parent))
                del left[ear]
                break
        else:
            return None
    return tree


def _semi(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows that have a partner; only distinct keys of the other side are sent."""
    on = shared_columns(rows, other)
    return rows.join(other.select(*on).distinct(), on, "left_semi").select(*rows.columns)


def _staged(rows: DataFrame) -> DataFrame:
    path = fresh_folder(rows.sparkSession, "reduced")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def reduce_relations(relations: Sequence[DataFrame]) -> list[DataFrame]:
    """The relations of an acyclic natural join, each reduced to the rows that take part in it.

    Copies stay.  A relation that others hang below is written once on the way up and once
    on the way down, every other one once; nothing is computed twice.
    """
    tree = join_tree([set(r.columns) for r in relations])
    if tree is None:
        raise ValueError("the relations form a cycle, which semi-joins cannot reduce fully; use one_shuffle_join or bgp")
    reduced = list(relations)
    below: dict[int, list[int]] = {}
    for ear, parent in tree:  # an ear's own ears have been removed before it
        for child in below.get(ear, []):
            reduced[ear] = _semi(reduced[ear], reduced[child])
        if ear in below:
            reduced[ear] = _staged(reduced[ear])
        if parent is not None:
            below.setdefault(parent, []).append(ear)
    for ear, parent in reversed(tree):
        if parent is not None:
            reduced[ear] = _staged(_semi(reduced[ear], reduced[parent]))
    return reduced


def bgp_reduced(triples: Triples, pats: Sequence[Pattern], names: dict[str, str] | None = None) -> DataFrame:
    """The rows of `bgp` for an acyclic query without separate parts, reduced first.

    Pays where many triples match a pattern but find no partner later: partial results then
    are no larger than the result's own projections.
    """
    triples, pats, inner = _planned(triples, pats)
    binding = [p for p in pats if variables(p)]
    orders = connected_order([variables(p) for p in binding])
    if len(orders) != 1:
        raise ValueError("the patterns fall into parts that share no variable, or bind none")
    relations = reduce_relations([match(triples, p) for p in binding])
    joined = multi_join([relations[i] for i in orders[0]])
    for constant in (p for p in pats if not variables(p)):
        joined = times_matches(joined, match(triples, constant))
    return _named(joined, inner, names)
