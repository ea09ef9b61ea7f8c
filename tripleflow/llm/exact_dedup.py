"""Exact duplicates by a minimal perfect hash over the digests of what is already known.

The distinct digests of the history are cut into shards of bounded size.  A shard's hash
is a cascade of bit maps: a key takes its bit on the first level where no other key wants
it, and its slot is the number of bits before it, so n keys fill n slots exactly.  A slot
holds the full digest and the locator of the group's winner.  A looked-up digest always
reaches some slot; comparing all its bytes tells members from strangers.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import SPACE, before, written

DIGEST = 32  # bytes of a SHA-256
SHARD_KEYS = 100_000
LEVELS = 64
INDEX = "shard long, levels array<binary>, digests binary, keep_ids array<long>, keep_chars binary, sizes binary"
FOUND = "digest binary, member boolean, old_id long, old_chars long, old_size long"


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, chars``: digest of the text without white space, its original length."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(without_space(F.col("text")), 256)).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
    )


def winners(keys: DataFrame) -> DataFrame:
    """One row per digest: the longest original text, then the smallest ``doc_id``."""
    best = F.max(F.struct("chars", before("doc_id").alias("rest"))).alias("best")
    groups = keys.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size"))
    return groups.select(
        "digest", F.bitwise_not("best.rest").alias("keep_id"), F.col("best.chars").alias("chars"), "size"
    )


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.reshape(-1, DIGEST).view("<u8")
    return words[:, 0].copy(), words[:, 1] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit that each key wants on a level."""
    x = a + np.uint64(level) * b
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) % np.uint64(bits)


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests; ``levels`` are its bit maps, packed."""

    def __init__(self, levels: list[bytes]):
        self.bits = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in levels]
        sizes = np.cumsum([0, *(int(x.sum()) for x in self.bits)])
        self.rank = [at + np.cumsum(x, dtype=np.int64) - x for at, x in zip(sizes, self.bits, strict=False)]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = _halves(digests)
        levels: list[bytes] = []
        while len(a):
            if len(levels) == LEVELS:
                raise ValueError("digests are not distinct")
            bits = 8 * ceil(max(64, 2 * len(a)) / 8)
            want = _place(a, b, len(levels), bits)
            wanted = np.bincount(want.astype(np.int64), minlength=bits)
            levels.append(np.packbits(wanted == 1, bitorder="little").tobytes())
            again = wanted[want.astype(np.int64)] > 1
            a, b = a[again], b[again]
        made = cls(levels)
        made.packed = levels
        return made

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each member; some slot or -1 for a stranger."""
        a, b = _halves(digests)
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            want = _place(a[open_], b[open_], level, len(bits)).astype(np.int64)
            hit = bits[want] == 1
            out[open_[hit]] = rank[want[hit]]
            open_ = open_[~hit]
        return out


def _joined(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _joined(rows.digest)
    made = PerfectHash.build(digests)
    order = np.empty(len(rows), np.int64)
    order[made.slots(digests)] = np.arange(len(rows))
    in_slots = rows.iloc[order]
    keep = [None if pd.isna(k) else int(k) for k in in_slots.keep_id]
    return pd.DataFrame(
        {
            "shard": [int(rows["shard"].iloc[0])],
            "levels": [made.packed],
            "digests": [b"".join(in_slots.digest)],
            "keep_ids": [keep],
            "keep_chars": [in_slots.chars.to_numpy("<i8").tobytes()],
            "sizes": [in_slots["size"].to_numpy("<i8").tobytes()],
        }
    )


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """New groups of one shard against the shard's slots; members with the slot's winner."""
    n = len(new)
    member, size = np.zeros(n, bool), np.zeros(n, np.int64)
    keep: list[int | None] = [None] * n
    chars = np.full(n, -1, np.int64)
    if n and len(index):
        shard = index.iloc[0]
        slots = PerfectHash(list(shard.levels)).slots(_joined(new.digest))
        known = np.frombuffer(shard.digests, np.uint8).reshape(-1, DIGEST)
        wanted = _joined(new.digest).reshape(-1, DIGEST)
        member = (slots >= 0) & (known[slots] == wanted).all(axis=1)
        at = slots[member]
        size[member] = np.frombuffer(shard.sizes, "<i8")[at]
        chars[member] = np.frombuffer(shard.keep_chars, "<i8")[at]
        for k, slot in zip(np.flatnonzero(member), at, strict=True):
            keep[k] = shard.keep_ids[slot]
    keep = [None if k is None or pd.isna(k) else int(k) for k in keep]
    return pd.DataFrame(
        {"digest": new.digest, "member": member, "old_id": pd.array(keep, "Int64"), "old_chars": chars, "old_size": size}
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from ``winners``; a shard holds about ``SHARD_KEYS`` digests."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(_build, INDEX)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def look_up(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """`FOUND`: which digests the index has, and the winner and size that it holds for them."""
    return (
        _sharded(groups.select("digest"), shards).groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(_look_up, FOUND)
    )


def _answers(past: DataFrame, new: DataFrame) -> DataFrame:
    """``digest, member, keep_id, group_size, old_id`` of the new groups, those of the history merged in.

    A member's winner is the longer of its own and the history's, then the smaller id.
    """
    shards = max(1, ceil(max(new.count(), past.count()) / SHARD_KEYS))
    found = look_up(new, build_index(past, shards), shards)
    best = lambda chars, id_: F.struct(F.col(chars).alias("chars"), F.bitwise_not(id_).alias("rest"))
    winner = F.greatest(best("chars", "keep_id"), F.when(F.col("member"), best("old_chars", "old_id")))
    return new.join(found, "digest").select(
        "digest", "member", F.bitwise_not(winner["rest"]).alias("keep_id"),
        (F.col("size") + F.col("old_size")).alias("group_size"), "old_id",
    )


def _judged(keys: DataFrame, answers: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keys.join(answers.select("digest", "keep_id", "group_size"), "digest").select(
        "doc_id", "keep_id", "group_size", same.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def merged(history: DataFrame, new: DataFrame) -> DataFrame:
    """`dedup` of two parts of one table, both from `keyed`, as if they were looked at together.

    The hash is built over the digests of the first part, those of the second are looked up.
    Nonmembers group among themselves; groups in both have one winner.
    """
    past, fresh = written(winners(history), "exact-history"), written(winners(new), "exact-groups")
    answers = written(_answers(past, fresh), "exact-answers")
    only_past = past.join(answers.where("member"), "digest", "left_anti").select(
        "digest", "keep_id", F.col("size").alias("group_size")
    )
    return _judged(history.unionByName(new), answers.select("digest", "keep_id", "group_size").unionByName(only_past))


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Group equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row.

    Texts are equal if they are the same without ``[\\x20\\x09-\\x0D]``; null counts as empty.
    Without ``history``, the lower half of the ids (by approximate median) is the history of
    the rest, and both are judged alike: the row with the longest original text, then the
    smallest ``doc_id``, stays.  With it, a text that the history has is a repeat of the
    history's winner and goes, other texts group among themselves; a ``group_size`` counts
    both tables.  Rows that repeat a ``doc_id`` are counted as rows and share its ``kept``; a
    null id loses against any other of the same length, and stays (null ``keep_id``) only
    where a group has no other.  An empty table gives no rows; long texts are digested whole,
    other columns are not looked at.

    Digests are grouped before anything is looked up, so a text with a third of all rows is
    one lookup; bringing the answer back to its rows is an ordinary join on the digest, whose
    skew adaptive execution splits.
    """
    keys = written(keyed(docs), "exact-keys")
    if history is None:
        middle = keys.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
        return merged(keys.where(old), keys.where(~old))
    past, new = written(winners(keyed(history)), "exact-history"), written(winners(keys), "exact-groups")
    answers = _answers(past, new).withColumn("keep_id", F.when(F.col("member"), F.col("old_id")).otherwise(F.col("keep_id")))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keys.join(answers, "digest").select(
        "doc_id", "keep_id", "group_size", (same & ~F.col("member")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
