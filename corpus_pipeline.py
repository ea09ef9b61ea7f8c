"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it left and returns them with the same
columns, except the last, which returns the pieces of packed sequences.  ``run`` writes
every stage's result as Parquet into the shared folder and goes on from the files.  Stages
other than packing keep rows without a ``doc_id``; columns other than ``text`` and its
length pass through untouched, whatever their names.  Empty tables pass through as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from tripleflow.llm.common import documents, written
from tripleflow.llm.queries import END_ID, tokenizer_file


def _with_text(joined: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs``, ``text`` replaced, and ``n_chars`` where the text changed."""
    out = []
    for name in docs.columns:
        column = docs[f"`{name}`"]
        if name == "text":
            column = text
        elif name == "n_chars":
            kind = dict(docs.dtypes)[name]
            column = F.when(changed, F.char_length(text).cast(kind)).otherwise(column)
        out.append(column.alias(name))
    return joined.select(*out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(model)(F.col("text")) < toxicity.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document left without lines keeps its row."""
    gone = line_dedup.repeated_lines(docs).groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.collect_set("line").alias("gone_lines")
    )
    joined = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left")
    lines, removed = F.split(docs["text"], "\n"), gone["gone_lines"]
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    changed = removed.isNotNull() & docs["text"].isNotNull()
    return _with_text(joined, docs, F.when(changed, text).otherwise(docs["text"]), changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints, the one with the smallest ``doc_id`` stays."""
    near = simhash.near_duplicates(docs)
    others = near.where("doc_id <> component_id").select(F.col("doc_id").alias("other_id")).distinct()
    return docs.join(others, docs["doc_id"] == others["other_id"], "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 100 bytes that also starts earlier go."""
    stretches = suffix_dedup.stretches_by_document(docs).withColumnsRenamed(
        {"doc_id": "cut_id", "stretches": "cut_at"}
    )
    joined = docs.join(stretches, docs["doc_id"] == stretches["cut_id"], "left")
    changed = stretches["cut_at"].isNotNull() & docs["text"].isNotNull()
    cut = suffix_dedup.without_stretches(docs["text"], stretches["cut_at"])
    return _with_text(joined, docs, cut, changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pieces_with_digest(docs, tokenizer_file("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

# Hashing, suffix ranks and tokenizers have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
