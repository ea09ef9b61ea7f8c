"""Triples out of lines, and generated triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tripleflow.functions.text import tokens
from tripleflow.patterns import DEFAULT_PREDICATES, DEFAULT_SUBJECTS, PART_DELIM, POSITIONS

ARITY = len(POSITIONS)
# Subjects and predicate of the key=value generator.
KV_SUBJECTS = ("a", "b", "c", "d")
KV_PREDICATE = "foo"


def _pieces(col: str, delim: str) -> Column:
    return tokens(F.col(col), delim)


def parse_triples(
    df: DataFrame,
    col: str = "line",
    delim: str = PART_DELIM,
    mode: str = "strict",
):
    """Turn ``col`` into ``subj, pred, obj``; the other columns are kept.

    ``strict`` fails the job on the first line that is not a triple.
    ``quarantine`` returns ``(triples, bad_rows)``.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in df.columns if c != col]
    split = df.withColumn("_parts", _pieces(col, delim))
    good = F.size("_parts") == ARITY
    if mode == "strict":
        complaint = F.concat(F.lit("Line is not a triple: "), F.coalesce(F.col(col), F.lit("NULL")))
        checked = split.withColumn(
            "_parts", F.when(good, F.col("_parts")).otherwise(F.raise_error(complaint))
        )
        return _spread(checked, others)
    bad = split.where(~good | good.isNull()).drop("_parts")
    return _spread(split.where(good), others), bad


def _spread(df: DataFrame, others: Sequence[str]) -> DataFrame:
    parts = [F.col("_parts").getItem(i).alias(name) for i, name in enumerate(POSITIONS)]
    return df.select(*others, *parts)


def validate_triples(df: DataFrame, col: str = "line", delim: str = PART_DELIM) -> DataFrame:
    """Number of lines that are triples and of those that are not: ``is_triple, n``."""
    good = F.coalesce(F.size(_pieces(col, delim)) == ARITY, F.lit(False))
    return df.groupBy(good.alias("is_triple")).agg(F.count(F.lit(1)).alias("n"))


def to_lines(df: DataFrame, delim: str = PART_DELIM) -> DataFrame:
    """Triples back to lines."""
    others = [c for c in df.columns if c not in POSITIONS]
    return df.select(*others, F.concat_ws(delim, *POSITIONS).alias("line"))


def _words(df: DataFrame, col: str, mode: str, complete: Column, complaint: str) -> DataFrame:
    """``df`` with its lines cut at single spaces; incomplete lines fail or are left out."""
    if mode not in ("strict", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    words = df.withColumn("_words", F.split(F.col(col), " "))
    complete = F.coalesce(complete, F.lit(False))
    if mode == "skip":
        return words.where(complete)
    message = F.concat(F.lit(complaint + ": "), F.coalesce(F.col(col), F.lit("NULL")))
    return words.withColumn("_words", F.when(complete, F.col("_words")).otherwise(F.raise_error(message)))


def parse_words(df: DataFrame, pred: str, col: str = "line", mode: str = "strict") -> DataFrame:
    """``subj, obj`` of the lines whose second space-separated word is ``pred``.

    A line of fewer than three words fails the job, or in ``skip`` mode is left out.
    """
    others = [c for c in df.columns if c != col]
    words = _words(df, col, mode, F.size("_words") >= 3, "fewer than three words")
    return words.where(F.get("_words", 1) == pred).select(
        *others, F.get("_words", 0).alias("subj"), F.get("_words", 2).alias("obj")
    )


def parse_words_int(
    df: DataFrame, obj: int, col: str = "line", mode: str = "strict"
) -> DataFrame:
    """``subj`` of the lines whose second word is the integer ``obj``.

    A second word that is no integer fails the job, or in ``skip`` mode drops the line.
    """
    others = [c for c in df.columns if c != col]
    number = F.get("_words", 1).try_cast("int")
    words = _words(df, col, mode, number.isNotNull(), "second word is not an integer")
    return words.where(number == obj).select(*others, F.get("_words", 0).alias("subj"))


def _objects(spark: SparkSession, objects: int | DataFrame) -> DataFrame:
    """A one-column frame of object texts from a count or from the caller's own frame."""
    if isinstance(objects, DataFrame):
        return objects.select(F.col(objects.columns[0]).cast("string").alias("obj"))
    return spark.range(objects).select(F.col("id").cast("string").alias("obj"))


def triple_universe(
    spark: SparkSession,
    objects: int | DataFrame,
    subjects: Sequence[str] = DEFAULT_SUBJECTS,
    predicates: Sequence[str] = DEFAULT_PREDICATES,
) -> DataFrame:
    """Every subject with every predicate with every object.

    Subjects and predicates are short lists; each object row fans out to all their
    pairs where it stands, so there is no join and no shuffle.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("subj"), F.lit(p).alias("pred"))
            for s in subjects
            for p in predicates
        ]
    )
    return (
        _objects(spark, objects)
        .withColumn("_pair", F.explode(pairs))
        .select("_pair.subj", "_pair.pred", "obj")
    )


def kv_triples(
    spark: SparkSession, objects: int | DataFrame, subjects: Sequence[str] = KV_SUBJECTS
) -> DataFrame:
    """Lines ``subj=a pred=foo obj=0`` for every subject and object."""
    named = F.explode(F.array(*[F.lit(s) for s in subjects]))
    return (
        _objects(spark, objects)
        .withColumn("_s", named)
        .select(F.format_string(f"subj=%s pred={KV_PREDICATE} obj=%s", "_s", "obj").alias("line"))
    )


def parse_kv(df: DataFrame, col: str = "line") -> DataFrame:
    """Read ``key=value`` lines back into ``subj, pred, obj``."""
    others = [c for c in df.columns if c != col]
    pairs = df.withColumn("_kv", F.str_to_map(F.col(col), F.lit(" "), F.lit("=")))
    return pairs.select(*others, *[F.col("_kv").getItem(p).alias(p) for p in POSITIONS])


def stream_lines(
    spark: SparkSession, path: str | None = None, fmt: str = "text", **options: str
) -> DataFrame:
    """A stream of lines: a folder of text files, or any streaming source by ``fmt``.

    With ``fmt="kafka"`` (where that connector is installed) the message value is the line.
    """
    reader: DataStreamReader = spark.readStream.format(fmt).options(**options)
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("line"))


def stream_triples(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "text",
    delim: str = PART_DELIM,
    mode: str = "strict",
    **options: str,
):
    """A stream of triples parsed from `stream_lines`."""
    return parse_triples(stream_lines(spark, path, fmt, **options), "line", delim, mode)
