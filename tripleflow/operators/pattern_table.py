"""Patterns as rows of a table: matched by a join, and changed version by version.

A pattern table has the columns ``pattern_id, subj, pred, obj``, where a part that starts
with ``?`` is a variable.  It may hold any number of patterns; none of them passes through
the driver.  A pattern with a NULL part fits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.patterns import POSITIONS, VAR_MARK

# Pairs of positions that a repeated variable can hold, by their bit in ``equal``.
_PAIRS = ((1, "subj", "pred"), (2, "subj", "obj"), (4, "pred", "obj"))
# A pattern table is broadcast up to this many bytes of text.
BROADCAST_BYTES = 64 << 20


def _sum_of(bits: Sequence[tuple[int, Column]]) -> Column:
    return reduce(Column.__add__, [F.when(test, F.lit(bit)).otherwise(F.lit(0)) for bit, test in bits])


def _all(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def pattern_forms(table: DataFrame) -> DataFrame:
    """The patterns with what a triple is looked up by and what it binds.

    ``mask`` has a bit per constant part, ``c_*`` are the constants, ``equal`` has a bit per
    pair of parts that hold one variable, ``n_*`` name a variable at its first part.
    """
    variable = {p: F.col(p).startswith(VAR_MARK) for p in POSITIONS}
    same = {
        (a, b): variable[a] & variable[b] & (F.col(a) == F.col(b)) for _, a, b in _PAIRS
    }
    repeated = {
        "subj": F.lit(False),
        "pred": same["subj", "pred"],
        "obj": same["subj", "obj"] | same["pred", "obj"],
    }
    return table.where(_all([F.col(p).isNotNull() for p in POSITIONS])).select(
        "pattern_id",
        _sum_of([(1 << i, ~variable[p]) for i, p in enumerate(POSITIONS)]).alias("mask"),
        _sum_of([(bit, same[a, b]) for bit, a, b in _PAIRS]).alias("equal"),
        *[F.when(~variable[p], F.col(p)).alias("c_" + p) for p in POSITIONS],
        *[F.when(variable[p] & ~repeated[p], F.col(p)).alias("n_" + p) for p in POSITIONS],
    )


def match_table(
    triples: DataFrame,
    table: DataFrame,
    keep: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`match_each` for a table of patterns: ``pattern_id, bindings`` and the columns in ``keep``.

    A triple is looked up once per kind of pattern in the table that it can fit: which parts
    are constant, which hold one variable.  There are at most 15 kinds, so the work per triple
    depends on the number of its matches, not of patterns; the join makes result rows only.
    A small job, run while the plan is built, finds the kinds and the size of the table,
    which is broadcast up to ``broadcast_bytes`` of text; beyond that Spark picks the join
    and splits what is skewed.
    """
    forms = pattern_forms(table)
    named = [c for c in forms.columns if c.startswith(("c_", "n_"))]
    size = F.sum(F.lit(32) + F.coalesce(F.octet_length(F.concat_ws("", "pattern_id", *named)), F.lit(0)))
    found = forms.agg(F.collect_set(F.struct("mask", "equal")).alias("kinds"), size.alias("bytes")).first()
    if (found["bytes"] or 0) <= broadcast_bytes:
        forms = F.broadcast(forms)

    probes = [_probe(kind["mask"], kind["equal"]) for kind in sorted(found["kinds"])]
    nothing = F.expr("CAST(array() AS array<struct<mask:int,equal:int,k_subj:string,k_pred:string,k_obj:string>>)")
    wanted = F.array_compact(F.array(*probes)) if probes else nothing
    looked = triples.select(*keep, *POSITIONS, F.explode(wanted).alias("_probe")).select(*keep, *POSITIONS, "_probe.*")
    fits = _all([looked[c] == forms[c] for c in ("mask", "equal")])
    fits = fits & _all([looked["k_" + p].eqNullSafe(forms["c_" + p]) for p in POSITIONS])
    bound = [
        F.when(forms["n_" + p].isNotNull(), F.struct(forms["n_" + p].alias("name"), looked[p].alias("value")))
        for p in POSITIONS
    ]
    bindings = F.map_from_entries(F.array_compact(F.array(*bound)))
    return looked.join(forms, fits).select(
        *[looked[c] for c in keep], forms["pattern_id"], bindings.alias("bindings")
    )


def _probe(mask: int, equal: int) -> Column:
    """What a triple looks up patterns of one kind by; NULL if its parts do not agree."""
    agrees = _all([F.col(a) == F.col(b) for bit, a, b in _PAIRS if equal & bit])
    keys = [
        (F.col(p) if mask >> i & 1 else F.lit(None).cast("string")).alias("k_" + p)
        for i, p in enumerate(POSITIONS)
    ]
    return F.when(agrees, F.struct(F.lit(mask).alias("mask"), F.lit(equal).alias("equal"), *keys))


def patterns_at(log: DataFrame, version: int | None) -> DataFrame:
    """The pattern table that a log of changes amounts to at a version.

    The log has a row per change: ``pattern_id, version, subj, pred, obj, removed``.  The
    newest row of a pattern up to ``version`` holds, unless it says removed; of several with
    one version a removal comes last, then the largest parts.  Without a version there is none.
    """
    reached = log.where(F.col("version") <= F.lit(version).cast("bigint"))
    change = F.struct("version", F.coalesce("removed", F.lit(False)).alias("removed"), *POSITIONS)
    last = reached.groupBy("pattern_id").agg(F.max(change).alias("_last"))
    return last.where(~F.col("_last.removed")).select("pattern_id", *["_last." + p for p in POSITIONS])
