"""Conversations as training text, by a compiled template.

Each turn is rendered where its row lies: no conversation is gathered for it, however many turns it has. A formatted conversation is the concatenation of its
pieces: the head, its turns in order, the tail. Each piece says which of its characters the model is to generate (the loss mask).

``digests`` reads the output back. A digest of a whole conversation needs its pieces in order, so these are dealt by conversation, sorted, and streamed through
hashes; a task holds one piece at a time, but the pieces of one conversation are hashed one after the other, as SHA-256 is no sum of parts.

Cases: null texts and roles are empty; a null conv_id is a conversation like any other, and null turns come first; turns that tie come in the order of what is written for
them, repeated rows as often as they stand; empty and very long texts and control strings in texts and roles come back as they were; columns beside conv_id, turn, role and text are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import partitions, small_batches
from ripplet.llm.template import Template, TemplateError, unescape

CONTROLS = ("###", "</turn>")
DEFAULT = (
    "{% for turn in turns %}### {{ turn.role | escape(':') }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
PIECES = "conv_id long, section int, turn long, piece string, starts array<int>, ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: A conversation whose texts hold control strings themselves.
PLANTED = (-7, "\\### Assistant: </turn> ok")


def template(source: str = DEFAULT, controls: tuple[str, ...] = CONTROLS) -> Template:
    return Template(source, controls)


def format_turns(conversations: DataFrame, form: Template | None = None) -> DataFrame:
    """conv_id, section (0 head, 1 turn, 2 tail), turn, piece, and the starts and ends of what is generated in it, in code points.

    Pieces in the order of section, turn and piece make up a conversation. No shuffle, but for the distinct ids where there is a head or a tail.
    """
    form = form or template()
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [form.write({"role": role, "text": text}) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ends = [pa.array([[span[k] for span in spans] for _, spans in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(found), pa.int32()), batch.column(1), pa.array([text for text, _ in found], pa.string()), *ends], names=["conv_id", "section", "turn", "piece", "starts", "ends"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    pieces = rows.mapInArrow(run, PIECES)
    none = F.array().cast("array<int>")
    for section, text in ((0, form.head), (2, form.tail)):
        if text:
            edge = rows.select("conv_id").distinct().select("conv_id", F.lit(section).alias("section"), F.lit(None).cast("long").alias("turn"), F.lit(text).alias("piece"), none.alias("starts"), none.alias("ends"))
            pieces = pieces.unionByName(edge)
    return pieces


class _Read:
    """One conversation as it is read back."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(pieces: DataFrame, form: Template | None = None) -> DataFrame:
    """One row a conversation, from its pieces alone: turns, digest of roles and texts, the text under the loss mask and its digest, and the length of the whole."""
    form = form or template()
    small_batches(pieces.sparkSession)
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = form.reader()
        now, done = None, []
        for b in batches:
            for conv_id, section, piece, starts, ends in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Read(conv_id)
                    if len(done) >= 4096:
                        yield batch(done)
                        done = []
                now.chars += len(piece)
                if section == 1:
                    m = reader.fullmatch(piece)
                    if m is None:
                        raise TemplateError(f"conversation {conv_id} can't be read back")
                    now.n += 1
                    now.turns.update(f"{unescape(m['role'])}\n{unescape(m['text'])}\n".encode())
                for a, e in zip(starts, ends, strict=True):
                    own = unescape(piece[a:e])
                    now.loss_chars += len(own)
                    now.loss.update(own.encode())
        if now is not None:
            done.append(now.row())
        if done:
            yield batch(done)

    ordered = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "section", "turn", "piece")
    return ordered.select("conv_id", "section", "piece", "starts", "ends").mapInArrow(run, DIGESTS)


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, both of whose texts hold control strings."""
    key, text = PLANTED
    more = conversations.sparkSession.createDataFrame([(key, 0, "user", text), (key, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


ORACLE = r"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length(text) + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = '\' or substr(text, i, 3) = '###' or substr(text, i, 7) = '</turn>')) as text_size,
    length(role) + len(list_filter(range(1, length(role) + 1), lambda i: substr(role, i, 1) in ('\', ':') or substr(role, i, 3) = '###' or substr(role, i, 7) = '</turn>')) as role_size from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(14 + role_size + text_size)::bigint as formatted_chars
from sized group by conv_id"""
