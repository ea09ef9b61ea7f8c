"""Token ids in binary files: framed records in document order, and an index of offsets.

One record holds one document.  Layout, all numbers little-endian:

    length of the payload   8 bytes
    masked crc32 of these   4 bytes
    payload                 doc_id 8, whether it is known 1, bytes per id 1, number of ids 4, then the ids
    masked crc32 of it      4 bytes

A file ends with one line feed.  A checksum is masked (rotated and shifted by a constant) so
that a checksum of data that holds checksums stays meaningful.  The content of each file is
one value for Spark's own text writer, whose commit protocol leaves no half file behind when
an executor is lost or a task is tried twice.  Readers go by the lengths, never by line feeds.

The index is a Parquet table beside the files: where each record lies and how many ids lie
before it.  A shuffled reader takes its rows in any order and seeks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleflow.llm.common import discard, id_and_text, per_worker, settings, written
from tripleflow.llm.wordmemo import WordMemo
from tripleflow.sources.workdir import fresh_folder

HEAD = struct.Struct("<QI")
ITEM = struct.Struct("<q?BI")
FOOT = struct.Struct("<I")
# The names that Spark's writer gives: the number of the task, and of the file in it.
FILE = r"^part-(\d+)-.*-c(\d+)"
BATCH = 500  # texts at a time
SMALL_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
OPEN_FILES = 64  # that a task of a shuffled read holds open
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, record_offset long, record_bytes long"
RECORD = "doc_id long, record_offset long, record_bytes long, n_tokens long, ids binary, file string"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record."""
    payload = ITEM.pack(doc_id or 0, doc_id is not None, width, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def record_at(view: memoryview, at: int) -> tuple[int | None, int, int, bytes]:
    """``(doc_id, bytes, bytes per id, ids)`` of the record that starts there.

    Raises ``ValueError`` where a length or a payload disagrees with its checksum.
    """
    if len(view) < at + HEAD.size:
        raise ValueError(f"damaged length at byte {at}")
    length, check = HEAD.unpack_from(view, at)
    end = at + HEAD.size + length
    if masked(bytes(view[at : at + 8])) != check or end + FOOT.size > len(view):
        raise ValueError(f"damaged length at byte {at}")
    payload = bytes(view[at + HEAD.size : end])
    if masked(payload) != FOOT.unpack_from(view, end)[0]:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, known, width, n = ITEM.unpack_from(payload)
    return doc_id if known else None, end + FOOT.size - at, width, payload[ITEM.size : ITEM.size + n * width]


def parse(content: bytes | pa.Buffer) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    """``(doc_id, offset, bytes, bytes per id, ids)`` of each record of a file."""
    at, view = 0, memoryview(content)
    if view[-1:] != b"\n":
        raise ValueError("a file without its end")
    while at < len(view) - 1:
        doc_id, size, width, ids = record_at(view[:-1], at)
        yield doc_id, at, size, width, ids
        at += size


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, bytes_per_file: int = 16 << 20
) -> None:
    """Encode whole texts and write them under ``folder`` in ascending ``doc_id`` order.

    File numbers (`FILE`) ascend in document order.  A file ends with the record that brings
    it to ``bytes_per_file``, so only one long document can make a long file.  Null texts are
    empty and hold the end id alone; documents without an id come before all others; rows
    with equal ids, or none, follow each other by a hash of their texts, and equal rows
    are spread over tasks.  No documents: no file with content.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = per_worker(WordMemo, tokenizer, "byte")
        end, width = np.array([end_id], memo.type).tobytes(), memo.type.itemsize
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                some = batch.slice(k, BATCH)
                ids = memo.ids(some.column(1).to_pylist())
                for doc_id, own in zip(some.column(0).to_pylist(), ids, strict=True):
                    held.append(frame(doc_id, own + end, width))
                    size += len(held[-1])
                    if size >= bytes_per_file:
                        yield _one_value(held)
                        size = 0
        if held:
            yield _one_value(held)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["doc_id", "text_hash", "spread"]
    table = (
        id_and_text(docs)
        .withColumn("text_hash", F.xxhash64("text"))
        .withColumn("spread", F.xxhash64(F.monotonically_increasing_id()) % 1024)
        .repartitionByRange(parts, *place)
        .sortWithinPartitions(*place)
        .select("doc_id", "text")
        .mapInArrow(encode, "value string")
    )
    # Long texts: the usual 4096 rows of a scan and 10000 of a batch are tens of megabytes a task.
    with settings(docs.sparkSession, dict.fromkeys(SMALL_BATCHES, str(BATCH))):
        table.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)


def _one_value(records: list[bytes]) -> pa.RecordBatch:
    """One row ``value`` of the records, which are taken out of the list.

    Bytes under the type of text, as they are for Spark's text writer: a cast in the plan would
    copy a whole file's content twice in the executor's heap, and Arrow's builder once here.
    """
    data = b"".join(records)
    records.clear()
    ends = pa.py_buffer(np.array([0, len(data)], np.int32))
    return pa.record_batch([pa.Array.from_buffers(pa.string(), 1, [None, ends, pa.py_buffer(data)])], ["value"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its place: ``doc_id, record_offset, record_bytes, n_tokens, ids, file``.

    ``ids`` are unsigned 32-bit little-endian whatever width the file has.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, data = path.rsplit("/", 1)[-1], content.as_buffer()
                rows: list[tuple] = []
                for doc_id, at, size, width, ids in parse(data) if data.size else ():
                    wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                    rows.append((doc_id, at, size, len(wide) // 4, wide, name))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    # Nothing stands between scan and Python: each expression there would copy whole files in the heap.
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(records, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, [c.split()[0] for c in RECORD.split(", ")])


def _number(place: str) -> Column:
    return F.regexp_extract("file", FILE, 1 if place == "part" else 2).cast("long")


def offset_index(records: DataFrame) -> DataFrame:
    """Where each record lies, and ``start``: the ids of all documents before it.

    The running sum is taken inside each file, over the files of each writing task, and over
    the totals of tasks, of which there are as many as shuffle partitions.
    """
    first = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, over: F.coalesce(F.sum(name).over(first(over)), F.lit(0))
    placed = records.withColumn("part", _number("part")).withColumn("number", _number("number"))
    files = placed.groupBy("part", "number").agg(F.sum("n_tokens").alias("of_file"))
    tasks = files.groupBy("part").agg(F.sum("of_file").alias("of_task")).select(
        "part", before("of_task", Window.orderBy("part")).alias("before_task")
    )
    starts = files.join(tasks, "part").select(
        "part", "number",
        (F.col("before_task") + before("of_file", Window.partitionBy("part").orderBy("number"))).alias("before_file"),
    )
    inside = Window.partitionBy("part", "number").orderBy("record_offset")
    return (
        placed.join(starts, ["part", "number"])
        .withColumn("start", F.col("before_file") + before("n_tokens", inside))
        .drop("part", "number", "before_file")
    )


def write_index(spark: SparkSession, folder: str, index: str) -> None:
    """Read every file back, check it, and write the index to the folder ``index``.

    ``doc_id, start, n_tokens, ids_crc32, file, record_offset, record_bytes``.
    """
    read = read_token_files(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    table = written(read, "token-index")
    offset_index(table).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "file", "record_offset", "record_bytes"
    ).write.parquet(index)
    discard(table)


def read_at(places: DataFrame, folder: str) -> DataFrame:
    """The records at some rows of the index, in the order of these rows in each partition.

    A shuffled read: order the index as wanted, then each task seeks the records of its rows,
    a read of ``record_bytes`` each.  Columns as of `read_token_files`.  The folder must be one
    that pyarrow's file systems open.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or ":/" in folder else (fs.LocalFileSystem(), folder)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = []
            for file, at, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file not in opened:
                    if len(opened) == OPEN_FILES:
                        opened.pop(next(iter(opened))).close()
                    opened[file] = system.open_input_file(f"{root}/{file}")
                doc_id, found, width, ids = record_at(memoryview(opened[file].read_at(size, at)), 0)
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                rows.append((doc_id, at, found, len(wide) // 4, wide, file))
                if len(rows) == 1000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        for file in opened.values():
            file.close()

    return places.select("file", "record_offset", "record_bytes").mapInArrow(records, RECORD)


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files and their index into the shared folder, read the files back.

    Returns ``doc_id, start, n_tokens, ids_crc32`` and the record's place, one row per row of
    ``docs``: null and empty texts have the end id alone, long texts are written whole, rows
    without an id come first, repeated rows one after the other; an empty table gives none,
    other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "token-files")
    write_token_files(docs, tokenizer, end_id, f"{folder}/records")
    write_index(spark, f"{folder}/records", f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")
