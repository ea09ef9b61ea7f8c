"""Removal of repeated byte strings, by suffix buckets with difference-cover ranks.

Every string of ``LENGTH`` bytes is a suffix cut at that depth.  Its bucket is the gram of
``GRAM`` bytes inside it whose hash is smallest, so equal strings share a bucket wherever
they stand.  Neighbouring strings mostly have the same gram; they travel as one *run* of
their common bytes instead of one by one.

1. Runs are counted by bucket.  A bucket met once holds no repeat, and most end here.
2. Equal runs of a bucket are one class.  All strings of a run that is not the first of
   its class are repeats.
3. The first runs of buckets with several classes hold what is left to compare.  Buckets
   are taken a block at a time: strings are sorted by their first and last ``PERIOD`` bytes;
   those that tie are resolved by ranks precomputed for a difference cover, a set of
   residues such that any two positions meet a sampled one after the same number of steps
   below the period.  Memory is bounded by the block, however long the repeated text is.
   Only ties matter here, so ranks are ordered by a fingerprint; bytes of equal ranks are
   compared, and order the strings where fingerprints meet.
4. Buckets with very many classes are taken string by string: a string whose fingerprint
   is met once is no repeat, the others are sorted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleflow.llm.common import discard, id_and_text, written

LENGTH = 100
GRAM = 32
PERIOD = 32
SLICE = 1 << 19  # bytes looked at together
BLOCK = 1 << 20  # bytes of runs sorted together
HOT_CLASSES = 4_000  # classes of a bucket from which it is taken string by string

U = np.uint64
STEP = 0x9E3779B97F4A7C15  # fixed value: an odd multiplier
BASE_INVERSE = pow(STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(STEP))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Rolling:
    """Hashes of any substrings of some bytes, from running sums."""

    powers = (_powers(STEP, 1), _powers(BASE_INVERSE, 1))

    def __init__(self, data: np.ndarray):
        if len(self.powers[0]) <= len(data):
            Rolling.powers = tuple(_powers(b, 2 * len(data) + 1) for b in (STEP, BASE_INVERSE))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE_VALUES[data] * self.powers[1][: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.powers[0][starts]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Parts of texts as ``(doc_ids, first bytes, bytes)``, about ``SLICE`` bytes at a time.

    Each part is ``(doc_id, offset in its document, its bytes)``; parts of a long document
    overlap, so every string lies in exactly one of them.
    """
    ids, offsets, parts, total = [], [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = np.frombuffer(text.as_py().encode(), np.uint8)
        for at in range(0, len(raw) - LENGTH + 1, SLICE):
            part = raw[at : at + SLICE + LENGTH - 1]
            ids.append(doc_id)
            offsets.append(at)
            parts.append(part)
            total += len(part)
            if total >= SLICE:
                yield ids, offsets, parts
                ids, offsets, parts, total = [], [], [], 0
    if ids:
        yield ids, offsets, parts


def runs_of(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """``(part, start in it, strings, bucket, class)`` of all runs of the parts."""
    data = np.concatenate(parts)
    lengths = np.array([len(p) for p in parts])
    begins = np.cumsum(lengths) - lengths
    rolling = Rolling(data)
    grams = mixed(rolling.at(np.arange(len(data) - GRAM + 1), GRAM))
    shift = int(len(data)).bit_length()
    low = U((1 << shift) - 1)
    # hash above, place below: the leftmost of equal grams is smallest
    least = (grams & ~low) | np.arange(len(grams), dtype=U)
    width, want = 1, LENGTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    ends = np.zeros(len(data) + 1, np.int64)
    ends[begins] += 1
    ends[begins + lengths - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ends[: len(least)]) > 0)
    anchors = (least[starts] & low).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(starts)))
    at = starts[first]
    classes = mixed(rolling.at(at, counts + (LENGTH - 1)) + counts.astype(U) * U(STEP))
    part = np.searchsorted(begins, at, side="right") - 1
    return part, at - begins[part], counts, grams[anchors[first]], classes


def runs(docs: DataFrame) -> DataFrame:
    """``h`` bucket, ``c`` class, ``doc_id``, ``sn``: 256 times the start plus the strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, parts in _pieces(batch):
                part, at, counts, h, c = runs_of(parts)
                sn = (np.array(offsets)[part] + at) * 256 + counts
                columns = [h.view(np.int64), c.view(np.int64), np.array(ids, np.int64)[part], sn]
                yield pa.record_batch([pa.array(x) for x in columns], ["h", "c", "doc_id", "sn"])

    known = id_and_text(docs).where("doc_id IS NOT NULL")
    return known.mapInArrow(cut, "h long, c long, doc_id long, sn long")


def cover(period: int) -> list[int]:
    """Residues with every difference below the period: 0 to r, then the multiples of r."""
    r = int(np.ceil(np.sqrt(period)))
    return sorted({*range(r), *range(r, period, r)})


def _ranks(rolling: Rolling, data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for places with equal next ``length`` bytes."""
    marks = rolling.at(places, length)
    order = np.argsort(marks, kind="stable")
    s = marks[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    for k in range(0, len(same), 1 << 17):
        x, y = places[order[same[k : k + (1 << 17)]]], places[order[same[k : k + (1 << 17)] + 1]]
        if (strings[x] != strings[y]).any():  # two strings share a fingerprint
            return np.unique(strings[places].view(f"V{length}").ravel(), return_inverse=True)[1].astype(np.int64)
    ranks = np.empty(len(places), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else s.astype(np.int64)
    return ranks


def repeats_in_block(data: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For strings at ``places``: does an equal one have a smaller ``order``?"""
    n, rolling = len(places), Rolling(data)
    heads, tails = np.split(_ranks(rolling, data, np.concatenate([places, places + LENGTH - PERIOD]), PERIOD), 2)
    _, ends, many = np.unique(heads * (2 * n) + tails, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(many[ends] > 1)
    out = np.zeros(n, bool)
    if not len(tied):
        return out
    # the middle, from a sampled place below the period onwards, joins head and tail
    middle, sampled = LENGTH - PERIOD + 1, np.zeros(PERIOD, bool)
    sampled[cover(PERIOD)] = True
    near = np.zeros(len(data) + 1, np.int64)
    np.add.at(near, places[tied], 1)
    np.add.at(near, places[tied] + PERIOD, -1)
    sample = np.flatnonzero((np.cumsum(near[:-1]) > 0) & sampled[np.arange(len(data)) % PERIOD])
    rank_at = np.full(len(data), -1, np.int64)
    rank_at[sample] = _ranks(rolling, data, sample, middle)
    for delta in range(PERIOD):
        here = tied[sampled[(places[tied] + delta) % PERIOD]]
        if len(here) < 2:
            continue
        keys = ends[here] * (len(sample) + 1) + rank_at[places[here] + delta]
        by = np.lexsort((order[here], keys))
        k, o = keys[by], order[here][by]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        least = o[np.flatnonzero(head)][np.cumsum(head) - 1]
        out[here[by]] |= o > least
    return out


def _strings(counts: np.ndarray) -> np.ndarray:
    """0 to count-1 for each count, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _compared(ids: np.ndarray, sn: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
    """Repeats among the strings of some whole buckets, as ``doc_id, sn``."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)
    counts = sn % 256
    inside = _strings(counts)
    places = np.repeat(np.cumsum(lengths) - lengths, counts) + inside
    starts, docs = np.repeat(sn // 256, counts) + inside, np.repeat(ids, counts)
    by = np.lexsort((starts, docs))
    moved = np.concatenate([[0], (docs[by][1:] != docs[by][:-1]) | (starts[by][1:] != starts[by][:-1])])
    order = np.empty(len(by), np.int64)
    order[by] = np.cumsum(moved)  # copies of a row have equal places
    hit = repeats_in_block(data, places, order)
    docs, starts, run = docs[hit], starts[hit], np.repeat(np.arange(len(sn)), counts)[hit]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    many = np.diff(np.append(first, len(docs)))
    return pa.record_batch([pa.array(docs[first]), pa.array(starts[first] * 256 + many)], ["doc_id", "sn"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, doc_id, sn, raw`` sorted by ``h``: blocks of whole buckets."""
    last, size, ids, sn, raw = None, 0, [], [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for h, doc_id, s, r in zip(*columns, strict=True):
            if h != last and size >= BLOCK:
                yield _compared(np.array(ids, np.int64), np.array(sn, np.int64), raw)
                size, ids, sn, raw = 0, [], [], []
            last = h
            ids.append(doc_id)
            sn.append(s)
            raw.append(r)
            size += len(r)
    if ids:
        yield _compared(np.array(ids, np.int64), np.array(sn, np.int64), raw)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, doc_id, sn, raw``: ``f, h, doc_id, sn, at`` with a fingerprint of each string, ``at`` in its run."""
    for batch in batches:
        for k in range(0, batch.num_rows, 5000):
            h, doc_id, sn = (batch.column(c).slice(k, 5000).to_numpy() for c in range(3))
            raw = batch.column(3).slice(k, 5000).to_pylist()
            lengths, counts = np.array([len(r) for r in raw], np.int64), sn % 256
            at = _strings(counts)
            places = np.repeat(np.cumsum(lengths) - lengths, counts) + at
            f = mixed(Rolling(np.frombuffer(b"".join(raw), np.uint8)).at(places, LENGTH)).view(np.int64)
            columns = [f, *(np.repeat(x, counts) for x in (h, doc_id, sn)), at]
            yield pa.record_batch([pa.array(x) for x in columns], ["f", "h", "doc_id", "sn", "at"])


def _strings_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, sn, raw, at``: ``doc_id, sn, raw`` of the strings ``at`` these places of their runs."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        rows = [
            (doc_id, (sn // 256 + i) * 256 + 1, raw[i : i + LENGTH])
            for doc_id, sn, raw, at in zip(*columns, strict=True) for i in sorted(set(at))
        ]
        for k in range(0, len(rows), 5000):
            some = zip(*rows[k : k + 5000], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(some, kinds, strict=True)], ["doc_id", "sn", "raw"])


def _after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, sn, raw`` sorted by ``raw`` and place: all but those at the first place of their bytes."""
    last, first = None, None
    for batch in batches:
        out = []
        for doc_id, sn, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if raw != last:
                last, first = raw, (doc_id, sn)
            elif (doc_id, sn) != first:
                out.append((doc_id, sn))
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["doc_id", "sn"])


def _with_bytes(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``h, hot, doc_id, sn, raw``: the bytes of runs, cut from their documents once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "hot", "doc_id", "sn", "raw"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, rows = text.as_py().encode(), []
                for run in wanted.as_py():
                    start, n = divmod(run["sn"], 256)
                    # a row that repeats the id with a shorter text does not reach as far
                    if start + n - 1 + LENGTH > len(raw):
                        continue
                    rows.append((run["h"], run["hot"], doc_id, run["sn"], raw[start : start + n - 1 + LENGTH]))
                for k in range(0, len(rows), 5000):
                    columns = zip(*rows[k : k + 5000], strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    wanted = first.groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot", "sn")).alias("wanted"))
    return id_and_text(docs).join(wanted, "doc_id").mapInArrow(
        cut, "h long, hot boolean, doc_id long, sn long, raw binary"
    )


def _repeats_of_crowded(run_bytes: DataFrame) -> DataFrame:
    """``doc_id, sn``: repeats among the strings of runs ``h, doc_id, sn, raw``, in buckets of any size."""
    marked = run_bytes.mapInArrow(_marked, "f long, h long, doc_id long, sn long, at long")
    met = marked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("f"))).where("n > 1")
    wanted = met.groupBy("h", "doc_id", "sn").agg(F.collect_list("at").alias("at"))
    strings = run_bytes.join(wanted, ["h", "doc_id", "sn"]).select("doc_id", "sn", "raw", "at").mapInArrow(
        _strings_at, "doc_id long, sn long, raw binary"
    )
    return (
        strings.repartition("raw").sortWithinPartitions("raw", "doc_id", "sn")
        .mapInArrow(_after_first, "doc_id long, sn long")
    )


def repeated_strings(docs: DataFrame) -> DataFrame:
    """``doc_id, sn``: stretches of string starts that also start earlier."""
    together = F.count(F.lit(1)).over(Window.partitionBy("h"))
    shared = written(runs(docs).withColumn("n", together).where("n > 1").drop("n"), "shared-runs")
    place = F.struct("doc_id", "sn")
    classes = written(
        shared.groupBy("h", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")),
        "run-classes",
    )
    later = (
        shared.join(classes.where("n > 1").select("h", "c", "first"), ["h", "c"])
        .where(place != F.col("first")).select("doc_id", "sn")
    )
    crowded = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    first = classes.join(crowded, "h").select(
        "h", (F.col("k") > HOT_CLASSES).alias("hot"), "first.doc_id", "first.sn"
    )
    texts = written(_with_bytes(docs, first), "run-bytes")
    compared = (
        texts.where("not hot").select("h", "doc_id", "sn", "raw")
        .repartition("h").sortWithinPartitions("h").mapInArrow(_compare, "doc_id long, sn long")
    )
    again = _repeats_of_crowded(texts.where("hot").select("h", "doc_id", "sn", "raw"))
    out = written(later.unionByName(compared).unionByName(again), "repeats")
    for table in (shared, classes, texts):
        discard(table)
    return out


def spans_of(stretches: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs ``[begin, end)`` from packed stretches."""
    if not len(stretches):
        return []
    begin = stretches // 256
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], (begin + stretches % 256 + LENGTH - 1)[by]
    reach = np.maximum.accumulate(end)
    head = np.concatenate([[True], begin[1:] > reach[:-1]])
    at = np.flatnonzero(head)
    return list(zip(begin[at].tolist(), reach[np.append(at[1:], len(end)) - 1].tolist(), strict=True))


def stretches_by_document(docs: DataFrame) -> DataFrame:
    """``doc_id, stretches``: one row per document that loses something."""
    return repeated_strings(docs).groupBy("doc_id").agg(F.collect_list("sn").alias("stretches"))


def _kept(raw: bytes, stretches: np.ndarray | None) -> tuple[list[tuple[int, int]], bytes]:
    spans = [] if stretches is None else spans_of(np.asarray(stretches))
    spans = [(b, min(e, len(raw))) for b, e in spans if b < len(raw)]
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return spans, b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def without_stretches(text: Column, stretches: Column) -> Column:
    """A text without the bytes of its stretches; characters cut in two go as a whole."""
    return F.pandas_udf(_texts_without, "string")(text, stretches)


def _texts_without(texts: pd.Series, stretches: pd.Series) -> pd.Series:
    return pd.Series(
        [
            t if t is None or s is None else _kept(t.encode(), s)[1].decode(errors="ignore")
            for t, s in zip(texts, stretches, strict=True)
        ],
        dtype=object,
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept``: one row per row.

    Removes each UTF-8 byte that is covered by a string of 100 bytes that also starts
    earlier, in a smaller ``doc_id`` or before in the same text.  ``kept`` holds the bytes
    that remain, ``spans`` the removed ``[begin, end)``.  Null and empty texts, and texts
    shorter than 100 bytes, are kept as they are.  Rows without ``doc_id`` have no place:
    nothing is removed from them and nothing because of them.  Rows that repeat a ``doc_id``
    stand at the same place, so they do not repeat each other.  No rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 4 + [span, pa.binary()]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some, rows = batch.slice(k, 200), []
                for doc_id, text, found in zip(some.column(0).to_pylist(), some.column(1), some.column(2), strict=True):
                    raw = text.as_py().encode()
                    spans, kept = _kept(raw, found.values.to_numpy() if found.is_valid else None)
                    pairs = [{"begin": b, "end": e} for b, e in spans]
                    rows.append((doc_id, len(raw), len(raw) - len(kept), len(spans), pairs, kept))
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return id_and_text(docs).join(stretches_by_document(docs), "doc_id", "left").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<begin:long,end:long>>, kept binary",
    )


def removal_digests(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` with the digest of the remaining bytes in their place."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
