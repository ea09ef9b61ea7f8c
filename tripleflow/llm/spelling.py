"""Spelling variants: words one edit apart, by composing automata over the vocabulary.

The vocabulary's acceptor, a transducer for exactly one inserted, deleted or replaced code
point, and the acceptor again compose to a machine that accepts the pairs wanted.  Before
the edit both acceptors read the same, so the machine's states are the prefixes of words;
after it, both must read the same rest.

The prefixes split the work.  Words start in blocks by their first code point; a block of
more than ``BLOCK`` words is split by a longer prefix, until none is too large.  Inside a
block a minimised acceptor is built and the composed machine enumerates its pairs.  An edit
that lies inside the prefix of a block leaves nothing to choose: those pairs share what is
left without the edited code point, and Spark joins on that.  Each pair is found once, at
the length of its common prefix.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import written
from tripleflow.llm.resampling import CRC, crc_sql

SHORTEST = 6
LEAST = 5
RATIO = 5
TYPO = 199
BLOCK = 50_000
_HELD = 200_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
# À to ÿ as they stand; A-Z are small by then
_RUN = "[a-zÀ-ÿ]{%d,}"


def word_counts(docs: DataFrame, shortest: int = SHORTEST, typo: int = TYPO) -> DataFrame:
    """``word, n``: the runs of letters of all texts after the contract's deletions.

    Shorter runs are left out; a deletion makes them no longer.  The hash of a run depends
    on its document and its letters alone, so it is taken once for all its occurrences.
    A row without ``doc_id`` counts with an empty one.  Tasks add up words before anything
    is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(_RUN % shortest).finditer
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = find(text.as_py().translate(_LOWER).decode())
                while own := Counter([m.group() for m in islice(runs, 100_000)]):
                    for run, n in own.items():
                        h = crc32(run.encode(), seed)
                        if h % typo == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                        total[run] += n
                    if len(total) > _HELD:
                        yield _rows(total)
        yield _rows(total)

    def _rows(total: Counter[str]) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    known = docs.where("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return known.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal automaton that accepts exactly the given words, which are sorted and distinct.

    States are numbered from the ends of words up; equal states are one.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.final.append(final)
                    self.arcs.append(arcs)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            shared = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            path += [(False, {}) for _ in word[shared:]]
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        final, arcs = path[0]
        self.start = len(self.arcs)
        self.final.append(final)
        self.arcs.append(arcs)


class OneEdit:
    """An acceptor composed with the one-edit transducer and itself."""

    def __init__(self, acceptor: Acceptor):
        self.final, self.arcs, self.start = acceptor.final, acceptor.arcs, acceptor.start
        self.alive: dict[tuple[int, int], bool] = {}
        self.edits: dict[int, list[tuple[str, str, int, int]]] = {}

    def _alive(self, p: int, q: int) -> bool:
        """Whether a rest exists that both states accept: the composed state after the edit is no dead end."""
        alive, arcs, final = self.alive, self.arcs, self.final
        todo = [(p, q)]
        while todo:
            p1, q1 = pair = todo[-1]
            if pair in alive:
                todo.pop()
                continue
            if final[p1] and final[q1] or p1 == q1:
                alive[pair] = True
                todo.pop()
                continue
            mine, other = arcs[p1], arcs[q1]
            following = [(t, other[s]) for s, t in mine.items() if s in other]
            if any(alive.get(f) for f in following):
                alive[pair] = True
                todo.pop()
                continue
            unknown = next((f for f in following if f not in alive), None)
            if unknown is None:
                alive[pair] = False
                todo.pop()
            else:
                todo.append(unknown)
        return alive[p, q]

    def _rests(self, p: int, q: int, not_first: str | None = None) -> Iterator[str]:
        """What both states accept; with ``not_first``, not beginning with it."""
        todo = [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if self.final[p] and self.final[q]:
                yield read
            other = self.arcs[q]
            for s, t in self.arcs[p].items():
                u = other.get(s)
                if u is not None and not (s == not_first and not read) and self._alive(t, u):
                    todo.append((t, u, read + s))

    def _edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """The edits that lead on from a state: symbols read on both sides, states reached."""
        found = self.edits.get(state)
        if found is None:
            arcs = list(self.arcs[state].items())
            found = self.edits[state] = [
                (a, b, p, q) for k, (a, p) in enumerate(arcs) for b, q in arcs[:k] if self._alive(p, q)
            ] + [(a, "", p, state) for a, p in arcs]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words one edit apart, once."""
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            for a, b, p, q in self._edits(state):
                for rest in self._rests(p, q, None if b else a):
                    yield read + a + rest, read + b + rest
            todo += [(t, read + s) for s, t in self.arcs[state].items()]


def _in_blocks(words: DataFrame, block: int) -> DataFrame:
    """``word, n, depth``: words with the length of the prefix that gives a block of at most ``block`` words.

    Each round counts the blocks of the words left and doubles the prefix of those too large,
    so there are as many rounds as doublings of the longest prefix.
    """
    left, depth, done = words, 1, None
    while True:
        prefix = F.substring("word", 1, depth)
        large = left.groupBy(prefix.alias("prefix")).count().where(F.col("count") > block).select("prefix")
        large = written(large, "spelling-large")
        marked = left.withColumn("prefix", prefix)
        small = marked.join(large, "prefix", "left_anti").select("word", "n", F.lit(depth).alias("depth"))
        done = small if done is None else done.unionByName(small)
        if not large.head(1):
            return written(done, "spelling-blocks")
        left = written(marked.join(large, "prefix", "left_semi").select("word", "n"), "spelling-left")
        depth *= 2


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of a block's words: number, and the commonest with its count."""
    n_of = dict(sorted(zip(rows["word"], rows["n"], strict=True)))
    near: dict[str, list] = {}

    def met(word: str, other: str) -> None:
        key = (-n_of[other], other)
        held = near.setdefault(word, [0, key])
        held[0] += 1
        if key < held[1]:
            held[1] = key

    for x, y in OneEdit(Acceptor(list(n_of))).pairs():
        met(x, y)
        met(y, x)
    return pd.DataFrame(
        [(w, k, best[0], best[1]) for w, (k, best) in near.items()], columns=["word", "n_near", "minus", "other"]
    ).astype({"n_near": "int64", "minus": "int64"})


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best``: words with near ones, their number, and ``best`` (``minus, other``): the
    commonest near word, the smallest among equally common ones, with its count negated."""
    blocks = _in_blocks(words, block)
    keyed = blocks.withColumn("prefix", F.expr("substring(word, 1, depth)"))
    inside = keyed.groupBy("depth", "prefix").applyInPandas(
        _within, "word string, n_near long, minus long, other string"
    ).select("word", "n_near", F.struct("minus", "other").alias("best"))

    # Edits inside the prefix: a word without its i-th code point meets words that differ there,
    # and the word that is just that.  No more rows share a rest than there are letters, and one.
    at = blocks.select("word", "n", F.explode(F.expr("sequence(0, least(depth, length(word)) - 1)")).alias("i"))
    holes = at.select(
        "i", F.expr("concat(substring(word, 1, i), substring(word, i + 2))").alias("rest"),
        F.struct(F.expr("substring(word, i + 1, 1)").alias("symbol"), "word", "n").alias("member"),
    )
    whole = blocks.select("word", "n", F.explode(F.expr("sequence(0, depth - 1)")).alias("i")).select(
        "i", F.col("word").alias("rest"), F.struct(F.lit("").alias("symbol"), "word", "n").alias("member")
    )
    met = holes.unionByName(whole).groupBy("i", "rest").agg(F.collect_list("member").alias("members"))
    met = met.where("size(members) > 1").withColumn("following", F.expr("substring(rest, i + 1, 1)"))
    others = F.expr(
        "filter(members, y -> y.symbol <> x.symbol AND (y.symbol <> '' OR x.symbol <> following) "
        "AND (x.symbol <> '' OR y.symbol <> following))"
    )
    pairs = met.select("members", "following", F.explode("members").alias("x")).select(
        F.col("x.word").alias("word"), F.explode(others).alias("y")
    )
    across = pairs.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("y.n")).alias("minus"), F.col("y.word").alias("other")).alias("best"))
    return inside.unionByName(across).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to their end.

    Each form is ``RATIO`` times as common as the word, so chains are short (log of the corpus
    size); a round doubles the length followed.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(roots.join(on, "root", "left").select("word", "root", "further"), "spelling-roots")
        roots = joined.select("word", F.coalesce("further", "root").alias("root"))
        if not joined.where("further IS NOT NULL").head(1):
            return roots


def group_variants(
    docs: DataFrame,
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
    typo: int = TYPO,
    block: int = BLOCK,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: one row per word of at least ``shortest`` code points and ``least`` occurrences.

    Null and empty texts have no words; rows without ``doc_id`` hash as if it were empty; repeated
    rows count as often as they stand there; of equally common near words the smallest in
    code-point order is the form; long texts are read in runs, whole; an empty table has no
    words; other columns are not looked at.
    """
    words = written(word_counts(docs, shortest, typo).where(F.col("n") >= least), "spelling-words")
    near = near_words(words, block)
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.minus")
    common = form_n >= ratio * F.col("n")
    formed = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best.other")).alias("form"), F.when(common, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


ORACLE = rf"""
WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
own AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS MATERIALIZED (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM own, crc_table),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2 :] ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS MATERIALIZED (SELECT word, i, word[1:i-1] || word[i+1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT x.word AS x, y.word AS y FROM holes x JOIN holes y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION SELECT x.word, y.word FROM holes x JOIN v y ON x.rest = y.word
      UNION SELECT y.word, x.word FROM holes x JOIN v y ON x.rest = y.word),
near AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-n, y)) AS best, max(n) AS best_n FROM p JOIN v ON v.word = y GROUP BY x),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
      CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM f
          UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) USING (word)
"""
