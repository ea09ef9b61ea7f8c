"""Matching triples against one pattern or many.

Bindings are one string column per variable.  Where rows of different patterns
share a frame they travel as ``bindings MAP<STRING,STRING>`` with the ``?`` kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleflow.patterns import (
    POSITIONS,
    VAR_MARK,
    Pattern,
    canonical,
    is_var,
    var_name,
    variable_positions,
    variables,
)
from tripleflow.sources.workdir import fresh_folder, setting

# Stands in for the columns of a pattern that has no variable, so that its rows count.
MATCHED = "_m"

# Triples as one frame, or as `share_scan` leaves them: a frame per pattern.
Triples = DataFrame | Mapping[Pattern, DataFrame]


def condition(pat: Pattern) -> Column:
    """Constants equal their part; a repeated variable holds one value."""
    tests = [F.col(pos) == F.lit(part) for pos, part in zip(POSITIONS, pat) if not is_var(part)]
    for held in variable_positions(pat).values():
        tests += [F.col(held[0]) == F.col(other) for other in held[1:]]
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def _no_bindings() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def bindings_map(pat: Pattern) -> Column:
    """The bindings of one pattern as a map, names sorted and marked."""
    held = sorted(variable_positions(pat).items())
    if not held:
        return _no_bindings()
    return F.create_map(
        *[c for name, pos in held for c in (F.lit(VAR_MARK + name), F.col(pos[0]))]
    )


def match(triples: Triples, pat: Pattern, keep: Sequence[str] = ()) -> DataFrame:
    """The triples that fit, as one column per variable, plus the columns in ``keep``."""
    if not isinstance(triples, DataFrame):
        triples = triples[pat]
    bound = [F.col(pos[0]).alias(name) for name, pos in variable_positions(pat).items()]
    if not bound:
        bound = [F.lit(1).alias(MATCHED)]
    return triples.where(condition(pat)).select(*bound, *keep)


def _tagged(pats: Sequence[Pattern]) -> Column:
    """Array of ``(pattern_id, bindings)`` per pattern, NULL for those that do not fit."""
    entries = [
        F.when(
            condition(p),
            F.struct(F.lit(i).alias("pattern_id"), bindings_map(p).alias("bindings")),
        )
        for i, p in enumerate(pats)
    ]
    return F.array(*entries)


def fits_any(triples: DataFrame, pats: Sequence[Pattern]) -> DataFrame:
    """The triples at least one pattern wants; a test on constants that reaches the scan."""
    return triples.where(reduce(Column.__or__, [condition(p) for p in pats], F.lit(False)))


def share_scan(
    triples: DataFrame, pats: Sequence[Pattern], folder: str | None = None
) -> dict[Pattern, DataFrame]:
    """Read ``triples`` once for all patterns of a query: each pattern's own triples.

    For a source that is dear to read, such as lines that have to be parsed: one pass
    writes the wanted triples to a table partitioned by pattern, patterns equal up to
    names sharing a part, and each pattern then reads its part alone.  The result
    stands for the triples in `match` and in whole queries.
    """
    spark = triples.sparkSession
    folder = folder or fresh_folder(spark, "shared-scan")
    forms = list(dict.fromkeys(canonical(p) for p in pats))
    fitting = F.array(*[F.when(condition(f), F.lit(i)) for i, f in enumerate(forms)])
    parted = fits_any(triples, forms).withColumn("_part", F.explode(fitting))
    # a file open for each part: otherwise every task would first sort its rows by part
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(len(forms))):
        parted.where(F.col("_part").isNotNull()).write.partitionBy("_part").parquet(folder)
    # The partition column is in the folder names: a pattern's filter on it prunes the rest.
    stored = spark.read.schema(
        T.StructType([*triples.schema.fields, T.StructField("_part", T.IntegerType())])
    ).parquet(folder)
    return {
        p: stored.where(F.col("_part") == forms.index(canonical(p))).drop("_part") for p in pats
    }


def match_each(triples: DataFrame, pats: Sequence[Pattern], keep: Sequence[str] = ()) -> DataFrame:
    """One row per triple and fitting pattern: ``pattern_id, bindings``.  One scan for all."""
    tagged = fits_any(triples, pats).select(*keep, F.explode(_tagged(pats)).alias("_hit"))
    return tagged.where(F.col("_hit").isNotNull()).select(*keep, "_hit.*")


def match_packed(
    triples: DataFrame, pats: Sequence[Pattern], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per triple that fits at least one pattern: ``all_bindings`` by pattern id."""
    packed = F.map_from_entries(F.array_compact(_tagged(pats))).alias("all_bindings")
    return fits_any(triples, pats).select(*keep, packed)


def match_streams(
    triples: DataFrame,
    pats: Sequence[Pattern],
    keys: Sequence[Sequence[str]] | None = None,
    key_text: bool = False,
) -> dict[int, DataFrame]:
    """One frame of bindings per pattern.

    ``keys[i]`` names the routing variables of pattern i.  With ``key_text`` their
    values are also given concatenated as ``valuesAsString``, for display only:
    joins use the columns.
    """
    frames = {}
    for i, pat in enumerate(pats):
        frame = match(triples, pat)
        if key_text:
            routing = sorted(set(keys[i] if keys else ()) & variables(pat))
            frame = frame.withColumn(
                "valuesAsString", F.concat(F.lit(""), *[F.col(k) for k in routing])
            )
        frames[i] = frame
    return frames


_FORM_SCHEMA = T.StructType(
    [
        T.StructField("mask", T.IntegerType(), False),
        *[T.StructField("c_" + p, T.StringType()) for p in POSITIONS],
        T.StructField("equal", T.IntegerType(), False),
        T.StructField("bound", T.IntegerType(), False),
        T.StructField("uses", T.ArrayType(T.StructType([
            T.StructField("pattern_id", T.IntegerType(), False),
            *[T.StructField("n_" + p, T.StringType()) for p in POSITIONS],
        ])), False),
    ]
)
# Pairs of positions a repeated variable can hold, by their bit in ``equal``.
_PAIRS = {1: ("subj", "pred"), 2: ("subj", "obj"), 4: ("pred", "obj")}


def _bits(flags: Sequence[bool]) -> int:
    return sum(1 << i for i, flag in enumerate(flags) if flag)


def _forms(pats: Sequence[Pattern]) -> list[tuple]:
    """One row per canonical pattern, listing who uses it and under which names.

    ``mask`` has a bit per constant position, ``equal`` one per pair of positions that
    must agree, ``bound`` one per position that first holds a variable.
    """
    users: dict[Pattern, list[int]] = {}
    for i, pat in enumerate(pats):
        users.setdefault(canonical(pat), []).append(i)
    rows = []
    for form, ids in users.items():
        held = variable_positions(form).values()
        first = {positions[0] for positions in held}
        uses = [
            (i, *[VAR_MARK + var_name(part) if pos in first else None
                  for pos, part in zip(POSITIONS, pats[i])])
            for i in ids
        ]
        rows.append(
            (
                _bits([not is_var(part) for part in form]),
                *[None if is_var(part) else part for part in form],
                sum(bit for bit, pair in _PAIRS.items() if any(set(pair) <= set(h) for h in held)),
                _bits([pos in first for pos in POSITIONS]),
                uses,
            )
        )
    return rows


def match_shared(
    triples: DataFrame,
    pats: Sequence[Pattern],
    keep: Sequence[str] = (),
    broadcast_patterns: int = 200_000,
) -> DataFrame:
    """`match_each` for many patterns: equal ones up to names are evaluated once.

    Each triple is looked up once per combination of constant positions in use (at
    most 8) by a hash join on those constants, so the work per triple does not grow
    with the number of patterns.  Up to ``broadcast_patterns`` canonical patterns
    are broadcast; beyond that Spark picks the join.
    """
    rows = _forms(pats)
    forms = triples.sparkSession.createDataFrame(rows, _FORM_SCHEMA)
    if len(rows) <= broadcast_patterns:
        forms = F.broadcast(forms)

    masks = sorted({r[0] for r in rows})
    probes = triples.select(*keep, *POSITIONS, F.explode(F.lit(masks)).alias("mask")).withColumns(
        {
            "k_" + pos: F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(pos))
            for i, pos in enumerate(POSITIONS)
        }
    )
    lookup = probes["mask"] == forms["mask"]
    for pos in POSITIONS:
        lookup = lookup & probes["k_" + pos].eqNullSafe(forms["c_" + pos])
    agrees = reduce(
        Column.__and__,
        [
            (F.col("equal").bitwiseAND(bit) == 0) | (F.col(a) == F.col(b))
            for bit, (a, b) in _PAIRS.items()
        ],
    )
    hits = probes.join(forms, lookup).where(agrees)
    used = hits.select(*keep, *POSITIONS, "bound", F.inline("uses"))

    bindings = F.when(F.col("bound") == 0, _no_bindings())
    for bound in sorted({r[5] for r in rows} - {0}):
        entries = [
            c
            for i, pos in enumerate(POSITIONS)
            if bound >> i & 1
            for c in (F.col("n_" + pos), F.col(pos))
        ]
        bindings = bindings.when(F.col("bound") == bound, F.create_map(*entries))
    return used.select(*keep, "pattern_id", bindings.alias("bindings"))
