"""Token ids of whole texts from the tokenizers library, remembered by chunk and by word.

A pre-tokenizer never joins characters before white space with white space, so a text is
cut there and equal chunks get equal ids.  A chunk not yet known is cut into the words of
the vocabulary's own pattern, and a word not yet known goes to the library's BPE model.
Texts with characters outside a set whose classes are the same in every Unicode version,
or with white space other than space and line feed, go to the library as a whole, and so do
texts with the string of a special token, which the library takes for that token.  So does
a batch whose first text comes out differently.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np

# The split patterns of the two vocabularies, {L} and {N} standing for the
# letters and numbers among the plain characters.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+",
}
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Plain: ASCII, Latin without the one letter whose lower case has two, dashes and quotes.
ODD = re.compile("[^\n -~¡-įı-ɏ‐-‧‰-⁞€]")


def _of_category(kind: str) -> str:
    return "".join(
        re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind
    )


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordMemo:
    """``kind`` is "byte" (white space is kept) or "word" (lower case, white space dropped).

    ``limit``: entries of each memo; a full memo starts anew, which costs time only.
    """

    def __init__(self, path: str, kind: str, limit: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        # A character of all of them: most texts are told by it alone.
        self.mark = min(set.intersection(*map(set, self.special or [""])) - set(" abcdefghijklmnopqrstuvwxyz"), default="")
        self.model, self.kind, self.limit = self.tokenizer.model, kind, limit
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        classes = {"{L}": _of_category("L"), "{N}": _of_category("N")}
        self.words = re.compile(re.sub(r"\{[LN]\}", lambda m: classes[m[0]], PATTERNS[kind])).findall
        self.letters = _byte_letters()
        self.of_word: dict[str, bytes] = {}
        memo = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                found = self[chunk] = memo._chunk(chunk)
                return found

        self.of_chunk = Chunks()

    def _word(self, word: str) -> bytes:
        shown = word.translate(self.letters) if word.isascii() else "".join(
            [self.letters[b] for b in word.encode()]
        )
        ids = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.of_word) >= self.limit:
            self.of_word.clear()
        self.of_word[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        known = self.of_word.get
        return b"".join([known(w) or self._word(w) for w in self.words(chunk)])

    def _whole(self, text: str) -> bytes:
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(encoded.ids, self.type).tobytes()

    def _special(self, text: str) -> bool:
        lower = text.lower()
        return any(s in lower for s in self.special)

    def _plain(self, text: str) -> bytes:
        chunks = text.lower().split() if self.kind == "word" else CHUNK.findall(text)
        if len(self.of_chunk) >= self.limit:
            self.of_chunk.clear()
        return b"".join(map(self.of_chunk.__getitem__, chunks))

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian ids of each text, in ``self.type``, without special tokens."""
        found = []
        for text in texts:
            plain = not ODD.search(text) and not (self.mark in text and self._special(text))
            got = self._plain(text) if plain else self._whole(text)
            if plain and not found and got != self._whole(text):
                print("word memo: a text differs from the library's, which takes over", file=sys.stderr)
                self._plain = self._whole  # type: ignore[method-assign]
                got = self._whole(text)
            found.append(got)
        return found
