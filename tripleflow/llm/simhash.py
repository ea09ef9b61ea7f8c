"""Near duplicates by SimHash, found with Golay codes.

The perfect binary Golay code maps each 23-bit word to the one codeword within 3 bits of
it, 12 bits naming the codeword.  Two words at distance 2 or less have a word between them
at distance 1 or less of either, so the names met when each is decoded with up to one bit
flipped share one.  The 64 bits of a fingerprint are three segments (22, 21, 21; padded
with zeros).  Four differing bits leave, in some order of the segments, either

* at most one in each of two segments: one of them is looked up by its name with a flip,
  the other by its plain name, for one side; the other way round for the other side; or
* none, two and two: the untouched segment itself with the shared name of the next one.

So every pair within 4 bits shares a key, and a shared key is only a candidate: all bits
are compared before a link is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import WORD, id_and_text, per_worker, written
from tripleflow.llm.components import smallest_reachable

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


class Golay:
    """Decoding of all 2^23 words to 12-bit names, by syndrome."""

    def __init__(self) -> None:
        errors = np.zeros(1 << 11, np.uint32)
        flips = [1 << i for i in range(23)]
        for a in range(23):
            errors[self._syndromes(np.array([flips[a]], np.uint32))[0]] = flips[a]
            for b in range(a):
                two = flips[a] | flips[b]
                errors[self._syndromes(np.array([two], np.uint32))[0]] = two
                for c in range(b):
                    three = two | flips[c]
                    errors[self._syndromes(np.array([three], np.uint32))[0]] = three
        self.errors = errors
        self.around = np.array([0, *flips], np.uint32)

    @staticmethod
    def _syndromes(words: np.ndarray) -> np.ndarray:
        rest = words.astype(np.uint32)
        for i in range(22, 10, -1):
            rest = np.where(rest >> np.uint32(i) & np.uint32(1), rest ^ np.uint32(GENERATOR << (i - 11)), rest)
        return rest

    def name(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self._syndromes(words)]) >> np.uint32(11)

    def names_near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the word, name)`` for each distinct name within one flip."""
        names = self.name(words[:, None] ^ self.around[None, :])
        names.sort(axis=1)
        fresh = np.ones(names.shape, bool)
        fresh[:, 1:] = names[:, 1:] != names[:, :-1]
        return np.nonzero(fresh)[0], names[fresh]


def keys_of(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """``(index of the fingerprint, key)`` of all keys of the fingerprints (unsigned 64-bit)."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    plain = [golay.name(p).astype(np.uint64) for p in parts]
    near = [golay.names_near(p) for p in parts]
    rows, keys = [], []

    def add(kind: int, row: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        rows.append(row)
        keys.append(np.uint64(kind << 56) | high.astype(np.uint64) << np.uint64(12) | low.astype(np.uint64))

    for s in range(3):
        t = (s + 1) % 3
        row, name = near[s]
        add(s, row, name, plain[t][row])  # one side: flips in s
        row, name = near[t]
        add(s, row, plain[s][row], name)  # other side: flips in t
        add(3 + s, row, parts[s][row], name)
    return np.concatenate(rows), np.concatenate(keys)


def links_in(prints: np.ndarray, bits: int = MAX_BITS, small: int = 256) -> list[tuple[int, int]]:
    """Links that join whatever fingerprints of one key are within ``bits``.

    Few fingerprints are all compared.  Of many, those around a pivot hang on it, which needs
    one link each; then clusters that are not joined yet are compared until a link is found,
    leaving out those too far apart to have one.  No link between components is lost, and at
    most one per fingerprint is made.
    """
    prints = np.unique(prints)
    n = len(prints)
    if n < 2:
        return []
    if n <= small:
        x, y = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits, 1))
        return list(zip(prints[x].tolist(), prints[y].tolist(), strict=True))
    out, clusters, rest = [], [], prints
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= bits
        pivot, members = rest[0], rest[near]
        out += [(int(pivot), m) for m in members.tolist() if m != pivot]
        clusters.append(members)
        rest = rest[~near]
    root = list(range(len(clusters)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    pivots = np.array([c[0] for c in clusters])
    for a in range(len(clusters)):
        close = np.flatnonzero(np.bitwise_count(pivots[a + 1 :] ^ pivots[a]) <= 3 * bits) + a + 1
        for b in close.tolist():
            if find(a) == find(b):
                continue
            for print_ in clusters[a]:
                hit = np.bitwise_count(clusters[b] ^ print_) <= bits
                if hit.any():
                    out.append((int(print_), int(clusters[b][hit.argmax()])))
                    root[find(b)] = find(a)
                    break
    return out


class Printer:
    """SimHash fingerprints of texts by 64-bit xxHash of word shingles."""

    def __init__(self, words: int):
        import re

        self.words, self.split = words, re.compile(WORD.encode()).findall
        self.lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def fingerprint(self, text: str) -> int:
        from xxhash import xxh64_intdigest

        words = self.split(text.encode().translate(self.lower))
        if not words:
            return 0
        k = min(self.words, len(words))
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - k].tolist()]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 8192):
            some = np.array(hashes[at : at + 8192], "<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, print``: the 64 bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = per_worker(Printer, words)
        for batch in batches:
            found = np.array([printer.fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return id_and_text(docs).mapInArrow(compute, "doc_id long, print long")


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: verified links that connect all distinct fingerprints within ``bits``."""
    if bits > MAX_BITS:
        raise ValueError(f"three segments find at most {MAX_BITS} differing bits")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = per_worker(Golay)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.column(0).slice(k, 2000).to_numpy().view(np.uint64)
                row, key = keys_of(some, golay)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(some[row].view(np.int64))], ["k", "print"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: the fingerprints of a key come together, perhaps over batches."""
        held_k = np.zeros(0, np.int64)
        held_p = np.zeros(0, np.uint64)
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            p = np.concatenate([held_p, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            held_k, held_p = k[whole:], p[whole:]
            yield _link_batch(k[:whole], p[:whole], bits)
        yield _link_batch(held_k, held_p, bits)

    dealt = prints.select("print").distinct().mapInArrow(keys, "k long, print long")
    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(verify, "a long, b long").distinct()


def _link_batch(k: np.ndarray, p: np.ndarray, bits: int) -> pa.RecordBatch:
    if not len(k):
        return pa.record_batch([pa.array([], pa.int64())] * 2, ["a", "b"])
    edge = np.flatnonzero(np.diff(k)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]])
    sizes = ends - starts
    pairs = starts[sizes == 2]
    x, y = p[pairs], p[pairs + 1]
    near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
    a, b = x[near].tolist(), y[near].tolist()
    for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        for x, y in links_in(p[s:e], bits):
            a.append(x)
            b.append(y)
    columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)]
    return pa.record_batch(columns, ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row, the smallest id reachable.

    Shingles are of the words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, repeats
    included; a text with fewer words is one shingle, one without words (or null) has
    fingerprint zero.  Fingerprints with at most ``bits`` differing bits are linked.  Equal
    fingerprints are one node, so copies make no pairs.  Rows that repeat a ``doc_id`` are
    linked each by its own text; a null id gets the smallest id of its component, null only
    if there is none.  An empty table gives no rows.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = written(smallest_reachable(links(prints, bits)), "components")
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(of_root, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
