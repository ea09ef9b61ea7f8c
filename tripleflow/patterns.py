"""Triple patterns: tuples of three parts, each a constant or a ``?variable``.

Patterns are a handful of strings held by the driver while a DataFrame plan is
being built.  No data flows through this module.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

Pattern = tuple[str, str, str]

POSITIONS = ("subj", "pred", "obj")

# Notation of patterns and triple lines, and the default query.
VAR_MARK = "?"
PART_DELIM = "_"
PATTERN_DELIM = "^"
DEFAULT_QUERY = (
    "?a_foo_?b",
    "A_bar_?b",
    "A_?c_?b",
    "B_?d_?b",
    "?e_?d_1",
    "?e_?d_2",
    "?e_?d_3",
)
DEFAULT_SUBJECTS = ("A", "B", "C")
DEFAULT_PREDICATES = ("foo", "bar")


def pattern(parts: str | Sequence[str], delim: str = PART_DELIM) -> Pattern:
    """Accept ``"?a_foo_?b"`` or ``("?a", "foo", "?b")`` and check the arity."""
    if isinstance(parts, str):
        parts = [p for p in parts.split(delim) if p]
    if len(parts) != len(POSITIONS):
        raise ValueError(f"a pattern has 3 parts, got {len(parts)}: {parts!r}")
    return tuple(parts)


def patterns(query: str | Iterable[str | Sequence[str]]) -> list[Pattern]:
    """A whole query: a ``^``-separated string or a list of patterns."""
    if isinstance(query, str):
        query = [q for q in query.split(PATTERN_DELIM) if q]
    parsed = [pattern(q) for q in query]
    if not parsed:
        raise ValueError("a query needs at least one pattern")
    return parsed


def is_var(part: str) -> bool:
    return part.startswith(VAR_MARK)


def var_name(part: str) -> str:
    """Column name of a variable: the part without its marker."""
    return part[len(VAR_MARK):]


def variable_positions(pat: Pattern) -> dict[str, list[str]]:
    """Variable name -> the positions it holds, in order of first appearance."""
    held: dict[str, list[str]] = {}
    for position, part in zip(POSITIONS, pat):
        if is_var(part):
            held.setdefault(var_name(part), []).append(position)
    return held


def variables(pat: Pattern) -> set[str]:
    return set(variable_positions(pat))


def canonical(pat: Pattern) -> Pattern:
    """The pattern with each variable renamed to the first position it holds.

    Two patterns accept the same triples exactly when their canonical forms are
    equal, whatever their variables are called.
    """
    first = {v: held[0] for v, held in variable_positions(pat).items()}
    return tuple(VAR_MARK + first[var_name(p)] if is_var(p) else p for p in pat)


def group_by_shared_vars(pats: Sequence[Pattern]) -> list[list[int]]:
    """Indexes of the patterns, grouped for a bushy join.

    A pattern enters the first group in which it has one and the same non-empty
    set of variables in common with every member; otherwise it opens a group.
    """
    groups: list[list[int]] = []
    for index, pat in enumerate(pats):
        for group in groups:
            overlaps = {frozenset(variables(pat) & variables(pats[m])) for m in group}
            if len(overlaps) == 1 and frozenset() not in overlaps:
                group.append(index)
                break
        else:
            groups.append([index])
    return groups


def part_products(pats: Sequence[Pattern], groups: Sequence[Sequence[int]]) -> list[list[int]]:
    """The groups, cut where joining one first builds pairs that another group then tells apart.

    Members with different variables in common with other groups meet inside their own group
    on its shared variables alone, all with all.  The first such member stays; the others
    follow after all groups, one by one, where they join on everything they share.  That opens
    a cycle of groups at the first one written; the others of the cycle stay whole.
    """
    kept = [list(group) for group in groups]
    after: list[list[int]] = []
    for at, group in enumerate(groups):
        outside = set().union(*(variables(pats[i]) for other in kept if other is not kept[at] for i in other))
        reaching: set[str] = set()
        for i in group:
            within = set().union(*(variables(pats[j]) for j in group if j != i))
            reach = (variables(pats[i]) & outside) - within
            if reach and reaching:
                kept[at].remove(i)
                after.append([i])
            reaching |= reach
    return kept + after


def connected_order(var_sets: Sequence[set[str]]) -> list[list[int]]:
    """Join orders of inputs given by their variables, one list per connected part.

    Inside a part the written order is kept, except that an input sharing nothing
    with those before it waits for the first later one that does.
    """
    waiting = list(range(len(var_sets)))
    parts: list[list[int]] = []
    while waiting:
        order = [waiting.pop(0)]
        bound = set(var_sets[order[0]])
        while True:
            following = next((i for i in waiting if var_sets[i] & bound), None)
            if following is None:
                break
            waiting.remove(following)
            order.append(following)
            bound |= var_sets[following]
        parts.append(order)
    return parts


def numbered(pats: Sequence[Pattern]) -> tuple[list[Pattern], dict[str, str]]:
    """The patterns with variables named ``v0``, ``v1``, ... and the new name of each old one.

    Plans work on these names: Spark resolves columns without regard to case, and some
    names, such as those of counts and markers, it uses itself.
    """
    new: dict[str, str] = {}
    for pat in pats:
        for name in variable_positions(pat):
            new.setdefault(name, f"v{len(new)}")
    return [tuple(VAR_MARK + new[var_name(x)] if is_var(x) else x for x in p) for p in pats], new


def output_names(wanted: Iterable[str], names: dict[str, str] | None = None) -> dict[str, str]:
    """Column of each variable in a result: its own name, or the one that ``names`` gives."""
    out = {v: (names or {}).get(v, v) for v in wanted}
    known: dict[str, str] = {}
    for v, column in out.items():
        other = known.setdefault(column.lower(), v)
        if other != v:
            raise ValueError(
                f"variables {other!r} and {v!r} give columns that Spark cannot tell apart; rename one with names="
            )
    return out
