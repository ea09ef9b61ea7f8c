"""Conversations rendered by a compiled template into training texts, with the spans to learn.

Turns are put in order by ranges of (conversation, turn), so a conversation of any size
spreads over tasks and no task holds more than about ``PIECE`` characters of it.  A
conversation is one row of the result, or several pieces if it is longer than that or lies
on the border of two ranges.  Only such pieces are dealt out again, to number them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleflow.llm.chat_template import Escape, Template, TemplateError
from tripleflow.llm.common import written

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
CONTROLS = (OPEN, BODY, CLOSE)
CHAT = (
    "{% for message in messages %}" + OPEN + "{{ message.role | escape }}" + BODY
    + "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    + "{% else %}{{ message.text | escape }}{% endif %}" + CLOSE + "\n{% endfor %}"
)
PIECE = 1 << 20

_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
    ("text", pa.string()), ("loss", pa.list_(pa.int32())),
])


@lru_cache(maxsize=8)
def _template(source: str, controls: tuple[str, ...]) -> Template:
    return Template(source, controls=controls)


def format_conversations(
    conversations: DataFrame, template: str = CHAT, controls: tuple[str, ...] = CONTROLS, piece: int = PIECE
) -> DataFrame:
    """``conv_id, piece, n_pieces, n_turns, text, loss``: formatted conversations.

    ``text`` is the formatted text, or one of ``n_pieces`` to be joined in the order of ``piece``
    (from 0); pieces end where turns end.  ``loss`` lists the spans under the loss mask: start
    and end in code points of ``text``, in turn.

    Turns stand in the order of ``turn`` (null first), those of one ``turn`` in the order of role
    and of their text's hash; repeated rows are repeated turns.  Null roles and texts are
    empty.  Rows without ``conv_id`` are one conversation.  A text of any length is one turn.
    An empty table gives no rows; other columns are not looked at.
    """
    compiled = _template(template, controls)  # errors show here
    head, tail = compiled.head, compiled.tail
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "h", "row"]  # the last splits repeats among ranges
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _template(template, controls)
        out: list[tuple] = []
        state: dict = {}

        def flush(border: bool) -> None:
            if state:
                whole = not border and not state["border"] and state["nth"] == 0
                text, loss = "".join(state["texts"]), state["loss"]
                if whole:
                    text, loss = head + text + tail, [x + len(head) for x in loss]
                out.append((state["conv_id"], state["part"], state["nth"], whole, state["n"], text, loss))

        def begin(conv_id: int | None, part: int, nth: int, border: bool) -> None:
            state.clear()
            state.update(conv_id=conv_id, part=part, nth=nth, border=border, n=0, texts=[], loss=[], size=0)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENT, strict=True)]
            return pa.record_batch(columns, schema=_SEGMENT)

        for batch in batches:
            for conv_id, role, text, part in zip(*(batch.column(i) for i in range(4)), strict=True):
                conv_id, part = conv_id.as_py(), part.as_py()
                if not state:
                    begin(conv_id, part, 0, True)  # the range before may end with this one
                elif state["conv_id"] != conv_id:
                    flush(False)
                    begin(conv_id, part, 0, False)
                elif state["size"] >= piece:
                    flush(True)
                    begin(conv_id, part, state["nth"] + 1, True)
                if sum(len(r[5]) for r in out[-1:]) >= piece or len(out) >= 2000:
                    yield batch_of(out)
                    out.clear()
                shown, spans = compiled.turn({"role": role.as_py(), "text": text.as_py()})
                for a, b in spans:
                    state["loss"] += [state["size"] + a, state["size"] + b]
                state["texts"].append(shown)
                state["size"] += len(shown)
                state["n"] += 1
        flush(True)
        if out:
            yield batch_of(out)

    kinds = "conv_id long, part int, nth int, whole boolean, n_turns long, text string, loss array<int>"
    rows = ordered.select("conv_id", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(render, kinds)
    rendered = written(rows, "chat-rendered")
    whole = rendered.where("whole").select(
        "conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n_pieces"), "n_turns", "text", "loss"
    )
    # A conversation's pieces are about as many as it has megabytes.  The one beginning before and
    # the one ending after a range are known by the same order.
    own = Window.partitionBy("conv_id")
    nth = F.row_number().over(own.orderBy("part", "nth")).cast("long")
    pieces = rendered.where("NOT whole").withColumn("piece", nth - 1).withColumn("n_pieces", F.count(F.lit(1)).over(own))
    first, last = F.col("piece") == 0, F.col("piece") == F.col("n_pieces") - 1
    bordered = pieces.select(
        "conv_id", "piece", "n_pieces", "n_turns",
        F.concat(F.when(first, F.lit(head)).otherwise(""), "text", F.when(last, F.lit(tail)).otherwise("")).alias("text"),
        F.transform("loss", lambda x: x + F.when(first, F.lit(len(head))).otherwise(0)).alias("loss"),
    )
    return whole.unionByName(bordered)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a text that the template ``CHAT`` has made."""
    unescape, at = Escape.unescape, 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise TemplateError(f"no turn begins at {at}")
        body, close = text.find(BODY, at), text.find(CLOSE, at)
        if body < 0 or close < body or text[close + len(CLOSE) : close + len(CLOSE) + 1] != "\n":
            raise TemplateError(f"the turn at {at} is broken")
        yield unescape(text[at + len(OPEN) : body]), unescape(text[body + len(BODY) : close])
        at = close + len(CLOSE) + 1


def read_digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted conversations.

    All from the texts and spans: turns are taken apart and unescaped, and what the spans cover
    is unescaped.  Pieces of a conversation are read in turn, one at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        turns = loss = None
        for batch in batches:
            for conv_id, piece, text, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, spans = text.as_py(), spans.as_py()
                if piece.as_py() == 0:
                    turns, loss = sha256(), sha256()
                    rows.append([conv_id.as_py(), 0, "", 0, "", 0])
                row = rows[-1]
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    row[1] += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    learnt = Escape.unescape(text[a:b])
                    loss.update(learnt.encode())
                    row[3] += len(learnt)
                row[5] += len(text)
                row[2], row[4] = turns.hexdigest(), loss.hexdigest()
            if len(rows) > 2000:
                yield _batch(rows[:-1])
                rows = rows[-1:]
        if rows:
            yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch(columns, names)

    columns, types = ["conv_id", "piece", "text", "loss"], (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    single = formatted.where("n_pieces = 1").select(*columns)
    several = formatted.where("n_pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*columns)
    return single.mapInArrow(digest, types).unionByName(several.mapInArrow(digest, types))


def round_trip_digests(conversations: DataFrame) -> DataFrame:
    """Format with ``CHAT``, write, read back: one row per conversation, as `read_digests` gives it.

    `format_conversations` says what becomes of nulls, ties, repeated rows, long texts, empty
    tables and other columns.
    """
    return read_digests(written(format_conversations(conversations), "chat-formatted"))


# The conversation that the contract adds: it quotes control strings and an escape sign.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return own.unionByName(probe)


def _escaped_sql(text: str) -> str:
    sql = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
    return sql


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
  CAST(sum({len(OPEN + BODY + CLOSE) + 1} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
