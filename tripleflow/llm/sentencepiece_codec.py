"""Encoding and decoding with a merge-type (BPE) sentencepiece vocabulary.

A chunk is a run of space marks with the text up to the next one.  If no piece of the
vocabulary has a mark after other text, merges never cross chunks.  If no piece joins
Latin letters with other characters either, they never cross the border between the two, and a
chunk is encoded by parts: an agenda holds all adjacent symbol pairs whose concatenation is a
piece, ordered by score and place; the best is merged, its neighbours make new pairs, and
what is left without a piece falls back to bytes.  Both properties are looked up in the
vocabulary when it is loaded.  Chunks and parts are remembered, and every chunk that enters
the memory is checked against the sentencepiece library, a slice's new chunks at a time.  If
one differs, the library's own encoding takes over.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripleflow.llm.common import id_and_text, per_worker

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Latin letters, and all else but the mark.
LETTERS = "[A-Za-zÀ-ɏ]"
OTHERS = f"[^A-Za-zÀ-ɏ{MARK}]"
PART = re.compile(f"{MARK}*{LETTERS}+|{MARK}*{OTHERS}+|{MARK}+")
CROSSING = re.compile(f"{LETTERS}{OTHERS}|{OTHERS}{LETTERS}")


class Memory(dict):
    """What ``make`` gives for each key.  A full generation becomes the old one; entries used
    again move back from it, so common keys outlive rare ones."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class MergeCodec:
    """``limit``: chunks, and parts, in a generation of the memory; it costs time only."""

    def __init__(self, path: str, limit: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: n for n, s in enumerate(scores)}
        self.id_of = pieces
        self.rank_of = {p: order[sp.get_score(i)] for p, i in pieces.items() if len(p) > 1}
        self.code = "H" if len(ids) <= 1 << 16 else "I"
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.exact = not any(MARK in p.lstrip(MARK) for p in pieces) and not any(map(sp.is_unused, ids))
        self.apart = not any(CROSSING.search(p) for p in pieces)
        self.parts = Memory(self.merged, limit)
        self.known = Memory(self._chunk, limit)
        self.new: list[str] = []

    def merged(self, chunk: str) -> bytes:
        """Ids of one chunk or part, by the agenda.

        An agenda entry is a pair's rank and the place of its left symbol in one number, so the
        best score comes first, and of equal ones the leftmost.  ``pair_rank`` is the rank of the
        pair that now begins at a place; an entry of another rank is out of date.
        """
        rank, n = self.rank_of.get, len(chunk)
        symbols, after, before = list(chunk), list(range(1, n + 1)), list(range(-1, n - 1))
        pair_rank = [rank(chunk[i : i + 2], -1) for i in range(n - 1)]
        pair_rank.append(-1)
        agenda = [r * n + i for i, r in enumerate(pair_rank) if r >= 0]
        heapify(agenda)
        while agenda:
            r, i = divmod(heappop(agenda), n)
            if pair_rank[i] != r:
                continue
            j = after[i]
            k, h = after[j], before[i]
            pair = symbols[i] = symbols[i] + symbols[j]
            symbols[j], pair_rank[j], after[i] = "", -1, k
            r = -1
            if k < n:
                before[k] = i
                r = rank(pair + symbols[k], -1)
                if r >= 0:
                    heappush(agenda, r * n + i)
            pair_rank[i] = r
            if h >= 0:
                r = pair_rank[h] = rank(symbols[h] + pair, -1)
                if r >= 0:
                    heappush(agenda, r * n + h)
        known, ids = self.id_of.get, []
        for symbol in symbols:
            if symbol:
                found = known(symbol)
                if found is None:
                    ids += [self.byte_ids[b] for b in symbol.encode()]
                else:
                    ids.append(found)
        return array(self.code, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that is not remembered; it is noted for the check."""
        self.new.append(chunk)
        if not self.apart:
            return self.merged(MARK + chunk)
        return b"".join(map(self.parts.__getitem__, PART.findall(MARK + chunk)))

    def _checked(self) -> bool:
        """Whether the library gives the same ids for the chunks new since the last check."""
        # the library puts a mark before each text, as chunks have one
        new = [c for c in self.new if c]
        self.new = []
        right = self.library.encode([c.replace(MARK, " ") for c in new], num_threads=1)
        for c, ids in zip(new, right, strict=True):
            if self.known[c] != array(self.code, ids).tobytes():
                print(f"merge codec: {c!r} differs from the library, which takes over", file=sys.stderr)
                return False
        return True

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if MARK + MARK in marked or marked[0] == MARK:
            return [c[1:] for c in CHUNK.findall(MARK + marked)]
        return marked.split(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.exact:
            known = self.known.__getitem__
            out = [np.frombuffer(b"".join(map(known, self.chunks(text))), self.code).tolist() for text in texts]
            self.exact = self._checked()
            self.known.turn()
            self.parts.turn()
            if self.exact:
                return out
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def _slices(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about so many characters at a time."""
    ids, texts, total = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py())
        total += len(texts[-1])
        if total >= chars:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids``: whole texts, without begin and end ids; null texts have no ids.

    One row for each input row, also for repeated rows and null ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(MergeCodec, model)
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                ids = pa.array(codec.encode(texts), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), ids], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(MergeCodec, model)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                texts = codec.decode([ids or [] for ids in some.column(1).to_pylist()])
                yield pa.record_batch([some.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode, decode, and keep digests of both: the same work as the two above in one pass.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per row of ``docs``.  Null texts are
    empty, and empty texts have no ids; rows without ``doc_id`` and repeated rows stand as they
    are; whole texts are encoded however long, so a task holds the ids of one of them; an empty
    table gives no rows, and other columns are not looked at.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(MergeCodec, model)
        decimal = [str(i) for i in range(codec.library.get_piece_size())].__getitem__
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                encoded = codec.encode(texts)
                rows = [
                    doc_ids,
                    [len(ids) for ids in encoded],
                    [sha256(",".join(map(decimal, ids)).encode()).hexdigest() for ids in encoded],
                    [sha256(t.encode()).hexdigest() for t in codec.decode(encoded)],
                ]
                yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return id_and_text(docs).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
