"""Plain Python versions of the operators' contracts, for small tables."""

import collections
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Smallest reachable id of each id."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits):
            a, b = sorted((find(i), find(ids[k + 1 + j])))
            root[b] = a
    return {i: find(i) for i in ids}


def removed_bytes(docs, length=100):
    """``doc_id -> boolean per byte`` of documents in ascending order of ``doc_id``."""
    seen, out = set(), {}
    for doc_id, text in docs:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            string = data[k : k + length]
            if string in seen:
                gone[k : k + length] = True
            seen.add(string)
        out[doc_id] = gone
    return out


def repeated_lines(docs):
    """``doc_id -> line numbers`` with an earlier line of Jaccard similarity 0.8 on five-word shingles."""
    earlier, where, out = [], collections.defaultdict(list), {}
    for doc_id, text in docs:
        out[doc_id] = []
        for number, line in enumerate(text.split("\n")):
            words = WORD.findall(line)
            own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            shared = collections.Counter(j for s in own for j in where[s])
            if any(10 * k >= 8 * (len(own) + len(earlier[j]) - k) for j, k in shared.items()):
                out[doc_id].append(number)
            for s in own:
                where[s].append(len(earlier))
            earlier.append(own)
    return out


def quality_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    found = collections.Counter(windows)
    again = {j for k, w in enumerate(windows) if found[w] > 1 for j in range(k, k + 5)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeats, len(again)
