"""Lines that repeat an earlier line, by an exact set-similarity join.

A line's tokens are its distinct shingles of five words; a line of fewer words has its whole
word sequence as its one token.  Two lines of Jaccard similarity 0.8 or more share a token
among their first n - ceil(0.8 n) + 1 ones under any one order of all tokens (prefix
filter), and k of them among k - 1 more.  That is used twice:

1. All lines are cut into tokens once, and their prefixes taken in the order of the token
   hashes, which needs no knowledge of the corpus, with k a twelfth of a line's tokens.  A line
   of whose prefix too few tokens stand in other lines' prefixes has no partner and goes no
   further; no pair is made.
2. The tokens of the lines left are counted.  Tokens are ordered by these counts, the rarest
   first, so a shingle that very many lines hold comes last and makes no candidates.
   Candidates must agree in size (length filter) and have enough tokens left after the
   shared one (positional filter); all tokens are compared in the end.

DataFrame functions only.  Lines of equal tokens are one class before anything is joined.  A
line is first compared with the earliest line of each of its prefix tokens; only lines that
this leaves are compared with the others, so a group of like lines does not make all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import discard, id_and_text, written

WORDS = 5
# Similarity of at least SHARE_OF / 10.
SHARE_OF = 8

_LEAST = f"cast(ceil({SHARE_OF} * n / 10D) AS int)"
_PREFIX = f"n - {_LEAST} + 1"
# With one token in so many more in the prefix, as many must be shared; a partner has _LEAST tokens or more.
MORE = 12
_LONGER = f"n - {_LEAST} + cast(ceil(n / {MORE}D) AS int)"
_NEEDED = f"cast(ceil({_LEAST} / {MORE}D) AS int)"


def _words(line: str) -> Column:
    """The words of a line; white space of other kinds is made a blank only where there is any."""
    odd = "\t\r\x0b\f"
    some = " OR ".join(f"contains({line}, chr({ord(c)}))" for c in odd)
    plain = F.when(F.expr(some), F.translate(line, odd, " " * len(odd))).otherwise(F.col(line))
    return F.array_remove(F.split(plain, " "), "")


def _with_tokens(lines: DataFrame) -> DataFrame:
    """``line_text`` replaced by ``tokens``: distinct 64-bit hashes in ascending order.

    Words are hashed once, shingles are hashes of word hashes.
    """
    following = ", ".join(f"get(h, i + {k})" for k in range(1, WORDS))
    shingles = f"transform(slice(h, 1, size(h) - {WORDS - 1}), (x, i) -> xxhash64(x, {following}))"
    others = [c for c in lines.columns if c != "line_text"]
    hashed = lines.select(*others, _words("line_text").alias("w")).select(*others, F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    return hashed.select(
        *others,
        F.expr(
            f"CASE WHEN size(h) >= {WORDS} THEN sort_array(array_distinct({shingles})) "
            "WHEN size(h) > 0 THEN array(xxhash64(h)) ELSE cast(array() AS array<bigint>) END"
        ).alias("tokens"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, line_text``.

    An outer generator: for the plain one Spark infers a filter on the size of its array,
    which splits the text once more.
    """
    known = id_and_text(docs).where("doc_id IS NOT NULL")
    return known.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "line_text"))


def _met_twice(rows: DataFrame) -> DataFrame:
    """The rows (``t, doc_id, line, ...``) whose token stands in several, with their number ``m``.

    One shuffle serves both the counting and the join; the filter names the columns that
    would otherwise be pruned from one of its two uses.  At most one row per line has a given
    token, so a token's share of the rows is far below its share of the lines.
    """
    dealt = rows.repartition("t")
    others = [c for c in rows.columns if c != "t"]
    used = [F.max(c).alias(f"_{c}") for c in others]
    counts = dealt.groupBy("t").agg(F.count(F.lit(1)).alias("m"), *used)
    several = counts.where("m > 1 AND " + " AND ".join(f"_{c} IS NOT NULL" for c in others)).select("t", "m")
    return dealt.join(several.hint("shuffle_hash"), "t")


def _passes(x: str, y: str) -> Column:
    """Length and positional filter for two rows of a token."""
    return F.expr(
        f"10 * least({x}.n, {y}.n) >= {SHARE_OF} * greatest({x}.n, {y}.n) AND "
        f"{10 + SHARE_OF} * (least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos)) >= {SHARE_OF} * ({x}.n + {y}.n)"
    )


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``doc_id, line`` of the later lines of pairs that are similar enough."""
    side = lambda s: tokens.select(
        F.struct("doc_id", "line").alias(s), F.col("tokens").alias(f"{s}_tokens")
    )
    # (merge joins at every size: no side of these has a bound)
    both = pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), "y")
    shared = "size(array_intersect(x_tokens, y_tokens))"
    alike = f"10 * {shared} >= {SHARE_OF} * (size(x_tokens) + size(y_tokens) - {shared})"
    return both.where(F.expr(alike)).select("x.doc_id", "x.line").distinct()


def _met_enough(rows: DataFrame) -> DataFrame:
    """``doc_id, line, met, needed`` of the lines of which as many tokens stand in several lines as ``needed`` says.

    ``needed`` is summed up before it is compared: the filter on it would otherwise be pushed into
    one of the two uses of the shuffle in `_met_twice`, and all tokens be shuffled twice.
    """
    met = _met_twice(rows).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("met"), F.min("needed").alias("needed"))
    return met.where("met >= needed")


def _possible(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, line`` of lines with the tokens of an earlier line, and of the other lines that may have a partner."""
    place = F.struct("doc_id", "line")
    cut = _with_tokens(_lines(docs)).select("doc_id", "line", "tokens", F.size("tokens").alias("n"))
    table = written(
        cut.select("doc_id", "line", "n", F.xxhash64("tokens").alias("c"), F.expr(f"slice(tokens, 1, {_LONGER})").alias("prefix")),
        "line-prefixes",
    )
    # equal: the hash of all tokens, their number and the smallest token, 128 bits of hash
    # (filtered here: Spark would push a filter on computed tokens below, and compute them inside their own lambda)
    keyed = table.where("n > 0").withColumn("t0", F.get("prefix", F.lit(0)))
    key = ["c", "t0", "n"]
    first = written(
        keyed.groupBy(*key).agg(F.min(place).alias("place"), F.any_value("prefix").alias("prefix"), F.count(F.lit(1)).alias("m")),
        "line-classes",
    )
    repeated = first.where("m > 1").select(*key, "place")
    copies = written(
        keyed.select("doc_id", "line", *key).join(repeated.hint("merge"), key).where(place != F.col("place")).select("doc_id", "line").distinct(),
        "line-copies",
    )
    discard(table)
    rows = first.select(
        F.explode_outer("prefix").alias("t"), F.col("place.doc_id").alias("doc_id"), F.col("place.line").alias("line"),
        F.expr(_NEEDED).alias("needed"),
    )
    met = _met_enough(rows)
    possible = written(met.groupBy("doc_id").agg(F.collect_list("line").alias("wanted")), "line-possible")
    discard(first)
    return copies, possible


def _by_rarity(tokens: DataFrame) -> DataFrame:
    """``t, doc_id, line, n, pos, alone, prefix``: prefix tokens in the order of their number of lines, those
    met twice or more; each row has all of its line's, and the number ``alone`` of the others.

    A token of one line makes no candidate; it stands before all others, so the others'
    places follow from the line's number of them.
    """
    rows = tokens.select(F.explode_outer("tokens").alias("t"), "doc_id", "line", F.size("tokens").alias("n"))
    ranked = _met_twice(rows).groupBy("doc_id", "line", "n").agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("met"))
    alone = F.expr("n - size(met)")
    prefix = ranked.select(
        "doc_id", "line", "n", alone.alias("alone"), F.expr(f"slice(met, 1, greatest(0, {_PREFIX} - (n - size(met))))").alias("met")
    )
    spread = prefix.select(
        "doc_id", "line", "n", "alone", F.col("met.t").alias("prefix"), F.posexplode_outer("met.t").alias("k", "t")
    ).where("t IS NOT NULL")
    return spread.select("t", "doc_id", "line", "n", (F.col("alone") + F.col("k") + 1).alias("pos"), "alone", "prefix")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line``: lines (from 0) with an earlier line of similarity 0.8 or more."""
    copies, possible = _possible(docs)
    kept = id_and_text(docs).join(possible.hint("merge"), "doc_id").select("doc_id", "wanted", F.split("text", "\n").alias("lines"))
    chosen = kept.select("doc_id", "lines", F.explode_outer("wanted").alias("line")).select(
        "doc_id", "line", F.get("lines", F.col("line")).alias("line_text")
    )
    # rows that repeat a doc_id: a line is one place, whatever texts stand there
    tokens = written(_with_tokens(chosen), "line-tokens")
    shared = written(_by_rarity(tokens), "line-shared")
    row = F.struct("doc_id", "line", "n", "pos").alias("x")
    to_place = lambda s: F.struct(f"{s}.doc_id", f"{s}.line").alias(s)
    later = F.expr("struct(y.doc_id, y.line) < struct(x.doc_id, x.line)")

    # first round: of the earliest lines of its tokens, each line takes the one it meets most
    first = shared.groupBy("t").agg(F.min(F.struct("doc_id", "line", "n", "pos")).alias("y"), F.count(F.lit(1)).alias("m"))
    near = shared.select("t", row).join(first.where("m > 1").hint("merge"), "t").where(later & _passes("x", "y"))
    met = near.groupBy(to_place("x"), to_place("y")).agg(F.count(F.lit(1)).alias("k"))
    pairs = met.groupBy("x").agg(F.max_by("y", F.struct("k", "y")).alias("y"))
    found = written(_verified(pairs, tokens), "line-found")

    # second round: what is left against all lines of its tokens; a pair is made once, at the
    # first token that both prefixes share, and no more than the shared ones and the tokens after
    # the last of them can be shared
    wide = F.struct("doc_id", "line", "n", "pos", "alone", "prefix")
    left = shared.join(found, ["doc_id", "line"], "left_anti").select("t", wide.alias("x"))
    others = shared.select("t", wide.alias("y"))
    both = "array_intersect(x.prefix, y.prefix)"
    after = lambda s: f"{s}.n - {s}.alone - array_position({s}.prefix, element_at({both}, -1))"
    enough = F.expr(
        f"t = get({both}, 0) AND {10 + SHARE_OF} * (size({both}) + least({after('x')}, {after('y')})) >= {SHARE_OF} * (x.n + y.n)"
    )
    rest = left.join(others.hint("merge"), "t").where(later & _passes("x", "y") & enough)
    again = _verified(rest.select(to_place("x"), to_place("y")), tokens)
    return copies.unionByName(found).unionByName(again).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed, text``: one row per row, ``text`` without the lines.

    Lines end at line feeds; they are ordered by ``doc_id`` and place.  A line goes if any
    earlier line, itself removed or not, is similar enough; a line of fewer than five words if
    an earlier one has the same words.  Lines without a word stay.  Null texts are empty.  Rows without ``doc_id`` have no place and stay as they are; rows that repeat a
    ``doc_id`` stand at the same place, lose the same lines, and do not repeat each other.
    """
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    lines = F.split("text", "\n").alias("lines")
    joined = id_and_text(docs).join(gone, "doc_id", "left").select(
        "doc_id", "text", lines, F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )
    return joined.select(
        "doc_id", F.size("lines").alias("n_lines"), F.size("removed").alias("n_removed"), "removed",
        F.expr(
            "CASE WHEN size(removed) = 0 THEN text ELSE array_join(transform("
            "array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\n') END"
        ).alias("text"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: what ``dedup_lines`` removes, as text of numbers.

    One row per row of ``docs``, with the results `dedup_lines` states for nulls, empty and long
    texts, ties and repeated rows; an empty table gives none, other columns are not looked at.
    """
    counts = id_and_text(docs).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return counts.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line
  FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (SELECT doc_id, line, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS t
      FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, line, len(t) AS n, unnest(t) AS t FROM t),
p AS (SELECT x.doc_id, x.line, x.n AS nx, y.n AS ny, count(*) AS shared
      FROM e x JOIN e y ON x.t = y.t AND (y.doc_id, y.line) < (x.doc_id, x.line)
      GROUP BY x.doc_id, x.line, x.n, y.doc_id, y.line, y.n),
g AS (SELECT DISTINCT doc_id, line FROM p WHERE 10 * shared >= 8 * (nx + ny - shared)),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines,
       coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
