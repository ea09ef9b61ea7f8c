"""Documents drawn so that their words look like a target's, by hashed importance weights.

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes, so that
``bytes.split`` gives the words.  A feature is a run of words; its hash is the crc32 of the
run, extended a word at a time by passing the hash so far as seed.  Tasks count hashes in
Counters and reduce them to one row per bucket; only those rows are shuffled.  A document's
weight is the mean gain of its features' buckets, to which noise from its id is added; the
highest sums are drawn.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleflow.llm.common import written

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

# ASCII letters in lower case, digits and all bytes of longer characters stay; the rest is blank.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_BLOCK = 1 << 20
_HELD = 200_000


def word_blocks(text: bytes, size: int = _BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes at a time, so that long texts take bounded memory."""
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def feature_hashes(text: bytes, longest: int, size: int = _BLOCK) -> Iterator[list[int]]:
    """crc32 of every run of one to ``longest`` words, joined by one space, in several lists.

    The first list of each block holds single words.
    """
    tail: list[bytes] = []
    for words in word_blocks(text, size):
        run = tail + words
        hashes = list(map(crc32, run))
        yield hashes[len(tail) :]
        for length in range(2, longest + 1):
            spaced = [crc32(b" ", seed) for seed in hashes]
            hashes = [crc32(word, seed) for word, seed in zip(run[length - 1 :], spaced, strict=False)]
            yield hashes[max(0, len(tail) - length + 1) :]
        tail = run[-(longest - 1) :] if longest > 1 else []


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts by bucket; null texts have none."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for hashes in feature_hashes(text.as_py(), longest):
                    seen.update(hashes)
                if len(seen) > _HELD:
                    _reduce(seen, total)
        _reduce(seen, total)
        yield pa.record_batch(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"]
        )

    def _reduce(seen: Counter[int], total: Counter[int]) -> None:
        for value, n in seen.items():
            total[value % buckets] += n
        seen.clear()

    binary = texts.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    return binary.mapInArrow(reduced, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket, 1000 times the logarithm of its share in the target over that in all, floored."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((raw.get(b, 0) + 1.0) * (t_all + buckets))))
        for b in range(buckets)
    ]


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise in thousandths; between -3132 and 22,874."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: one row per row of ``docs``.

    Null and empty texts have no features and weight 0.  Rows without ``doc_id`` have no score.
    Repeated rows count as often as they stand there.  Two rows of bounded size, at most
    ``buckets`` each, come to the driver.
    """
    counted = [dict(map(tuple, bucket_counts(t, longest, buckets).collect())) for t in (docs, target)]
    gains = gains_of(*counted, buckets)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64(), "score": pa.int64()}

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Gains(dict):
            def __missing__(self, value: int) -> int:
                gain = self[value] = gains[value % buckets]
                return gain

        gain_of = Gains()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_words = n_features = total = 0
                for k, hashes in enumerate(feature_hashes(text.as_py(), longest)):
                    n_words += len(hashes) if k % longest == 0 else 0
                    n_features += len(hashes)
                    total += sum(map(gain_of.__getitem__, hashes))
                if len(gain_of) > _HELD:
                    gain_of.clear()
                weight = total // n_features if n_features else 0
                score = None if doc_id is None else weight + noise(doc_id, seed)
                for column, value in zip(rows, (doc_id, n_words, n_features, weight, score), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds.values(), strict=True)], list(kinds))

    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    return known.mapInArrow(weighed, ", ".join(f"{name} long" for name in kinds))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3 ... from the highest score down, null if not drawn.

    Of the rows with an id and ``least_words`` words, so many hundredths are drawn; equal
    scores go by ``doc_id``, repeated rows of one id by weight and length.  Scores are whole
    numbers whose noise spans 26,006 values and whose weight stays within the logarithm of
    the corpus size, so rows per score are few enough for the driver (at most some 100,000)
    and no score holds more than about 0.04 % of the rows: rows are only numbered within
    their score.
    """
    table = written(weighed, "weighed")
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = sorted(map(tuple, table.where(fit).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    above, taken = [], 0
    for score, n in counts:
        if taken >= wanted:
            break
        above.append((score, taken))
        taken += n
    if not above:
        return table.withColumn("rank", F.lit(None).cast("long"))
    last = above[-1][0]
    higher = F.broadcast(table.sparkSession.createDataFrame(above, "score long, above long"))  # a row per score
    chosen = fit & (F.col("score") >= last)
    order = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    ranked = table.where(chosen).withColumn("nth", F.row_number().over(order)).join(higher, "score")
    rank = F.col("above") + F.col("nth")
    drawn = ranked.select(*table.columns, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    others = table.where(F.coalesce(~chosen, F.lit(True)))
    return drawn.unionByName(others.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: one row per row of ``docs``, drawn or not.

    See `weigh` and `draw` for nulls, empty texts, ties and repeated rows; texts are read whole, a
    block at a time; empty tables give no rows, and an empty target gives every bucket the
    gain of an unseen one.  Columns of other names are not looked at.
    """
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


# crc32 in SQL: the table of its bytes, and a fold over the UTF-8 bytes of a text.
CRC = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b))"""


def crc_sql(text: str) -> str:
    """SQL for the crc32 of ``text``, where ``crc_table`` is among the tables."""
    digits = f"hex(encode({text}))"
    byte = f"CAST('0x' || {digits}[2 * i + 1 : 2 * i + 2] AS BIGINT)"
    return (
        f"xor(list_reduce(list_transform(range(len({digits}) // 2), lambda i: {byte}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    )


ORACLE = rf"""
WITH {CRC},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
h AS MATERIALIZED (SELECT w, {crc_sql("w")} % 10000 AS k FROM (SELECT w FROM f UNION SELECT w FROM b), crc_table),
s AS (SELECT k, count(*) AS n FROM f JOIN h USING (w) GROUP BY k),
g AS (SELECT k, count(*) AS n FROM b JOIN h USING (w) GROUP BY k),
a AS (SELECT (SELECT sum(n) FROM s) AS s_all, (SELECT sum(n) FROM g) AS t_all),
gain AS (SELECT k, CAST(floor(1000 * ln((coalesce(g.n, 0) + 1.0::DOUBLE) * (s_all + 10000) /
         ((coalesce(s.n, 0) + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN g USING (k), a),
v AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (w) JOIN gain USING (k) GROUP BY doc_id),
sc AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
       coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
       FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
