"""Text lines: from files, batch or stream, and from a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.functions.text import LINE_BREAKS, trim_blanks

# Spark numbers the rows of one task in the lower 33 bits of its row ids.
_TASK_ROWS = 1 << 33


def clean_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """Split column ``col`` into its lines, trim them and drop the empty ones.

    The other columns stay; the lines take the place of ``col`` under the name ``line``.
    """
    others = [c for c in df.columns if c != col]
    pieces = df.select(*others, F.explode(F.split(F.col(col), LINE_BREAKS)).alias("line"))
    return pieces.withColumn("line", trim_blanks(F.col("line"))).where(F.length("line") > 0)


def read_lines(
    spark: SparkSession, path: str | list[str], stream: bool = False, **options: str
) -> DataFrame:
    """Trimmed, non-empty lines of text files as column ``line``."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    raw = reader.text(path)
    return raw.select(trim_blanks(F.col("value")).alias("line")).where(F.length("line") > 0)


def queue_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder used as a queue of text files, as a stream of its lines; see `enqueue_lines`.

    Files are taken oldest first, at most ``files_per_batch`` in a micro-batch.  The stream's
    checkpoint holds what has been taken: after a failure the same files come again as the
    same batch.  A file is deleted only after the batch that took it has been committed, at
    the latest by the second batch after it, so nothing is lost with a reader that dies.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "delete")
    raw = reader.text(f"{folder}/*")
    return raw.select(trim_blanks(F.col("value")).alias("line")).where(F.length("line") > 0)


def enqueue_lines(lines: DataFrame, folder: str, name: str) -> None:
    """Put the column ``line`` of a table into a queue folder, as one message folder ``name``.

    A name that is complete already is not written again, so a writer that repeats a step
    under the same name, such as a micro-batch under its number, delivers it once.
    """
    spark = lines.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return
    lines.select("line").write.mode("overwrite").text(f"{folder}/{name}")


def read_log(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Lines of log files as ``file, pos, line``, untrimmed.

    ``pos`` orders the lines of one file: the byte offset of the split a line was
    read from, then the row's place inside the read task.  Files may be split over
    any number of tasks; nothing is numbered globally.
    """
    raw = spark.read.options(**options).text(path)
    row_in_task = F.monotonically_increasing_id().bitwiseAND(_TASK_ROWS - 1)
    split_at = F.col("_metadata.file_block_start").cast("decimal(19,0)")
    return raw.select(
        F.col("_metadata.file_name").alias("file"),
        (split_at * F.lit(_TASK_ROWS).cast("decimal(11,0)") + row_in_task).alias("pos"),
        F.col("value").alias("line"),
    )
