"""Chat templates: conversations as one text each, with the span of every turn found by rendering prefixes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_batches

Turn = tuple[str, str]
#: Conversations that go to Spark at once, and their characters (one conversation at least).
ROWS, CHARACTERS = 256, 4 << 20
SPAN = "struct<role: string, start: long, end: long, text_start: long, text_end: long, loss: boolean>"
SPAN_TYPE = pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())])


@dataclass(frozen=True)
class Template:
    """``render`` gives the text of some turns (role, text); nothing else is known of it. ``unescape`` undoes what
    it does to a text, and ``read`` gives role and text back from one turn's part of the output."""

    render: Callable[[Sequence[Turn]], str]
    unescape: Callable[[str], str]
    read: Callable[[str], Turn]


HEAD, END = "### ", "</turn>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(rf"{HEAD}((?:\\.|[^\\:])*): (.*){END}\n", re.DOTALL)


def escape(text: str) -> str:
    """The text without the template's control strings: ``##`` and ``</turn>`` get a backslash inside, a
    backslash becomes two. So three ``#`` never follow one another, nor does the end mark occur."""
    if "\\" in text or "##" in text or END in text:
        text = text.replace("\\", "\\\\").replace("##", "#\\#").replace(END, "<\\/turn>")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: Sequence[Turn]) -> str:
    """``### role: text</turn>`` and a line feed for each turn; a colon in a role gets a backslash."""
    return "".join(f"{HEAD}{escape(role).replace(':', f'{chr(92)}:')}: {escape(text)}{END}\n" for role, text in turns)


def read(part: str) -> Turn:
    found = _TURN.fullmatch(part)
    if not found:
        raise ValueError(f"no turn of this template: {part[:80]!r}")
    return unescape(found[1]), unescape(found[2])


MARKED = Template(render, unescape, read)


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def spans(turns: Sequence[Turn], template: Template, loss: frozenset[str]) -> tuple[str, list[dict], int | None]:
    """The rendered conversation, the span of each turn, and the first turn that rewrites what came before it.

    The turns are rendered one more at a time. As long as an output begins with the one before, what is
    new is the turn's span. Where its text lies in the span is found from two more outputs, whose
    last turn says ``a`` and ``b``: they agree up to the text and after it. A place that does not give the
    text back is none (null), and so is the loss there. From the first output that doesn't begin with the one
    before, history is rewritten, and spans found so far need not hold: there are none."""
    whole, found = template.render(turns[:0]), []
    for i, (role, text) in enumerate(turns):
        before, whole = whole, template.render(turns[: i + 1])
        probes = [template.render([*turns[:i], (role, x)]) for x in "ab"]
        if not all(x.startswith(before) for x in (whole, *probes)):
            return template.render(turns), [], i
        a, b = (x[len(before) :] for x in probes)
        head = common_prefix(a, b)
        tail = min(common_prefix(a[::-1], b[::-1]), len(a) - head)
        start, end = len(before) + head, len(whole) - tail
        located = start <= end and template.unescape(whole[start:end]) == text
        found.append({"role": role, "start": len(before), "end": len(whole), "text_start": start if located else None, "text_end": end if located else None, "loss": located and role in loss})
    return whole, found, None


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Turn]]]:
    """Conversations one after another, from rows (conv_id, role, text) in order."""
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now and turns:
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def formatted(turns: DataFrame, template: Template = MARKED, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, spans, rewritten_at): each conversation as ``template`` renders it, and its turns'
    spans in code points: role, the turn's start and end, its text's start and end, and
    whether the text counts for the loss (its role is one of ``loss_roles``).

    Turns go by number (null first), ties by role, then by the SHA-256 of role and text. Null roles and texts are empty.
    Repeated rows are turns of their own. Rows without a conversation are left out, other columns are not read.
    ``rewritten_at`` is the first turn (from 0) where the template changes what it gave for the turns before,
    or null; such a conversation has no spans and no loss. No rows: no rows.

    A black box is given whole conversations, so one conversation is in one task's memory at a time, with its
    output; prefixes take time that grows with the square of its turns. Conversations are dealt out by id
    and follow one another in a task, which holds one and a bounded batch of outputs."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", key)
    loss = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, said in conversations(batches):
            held.append((conv, *spans(said, template, loss)))
            size += len(held[-1][1])
            if len(held) >= ROWS or size >= CHARACTERS:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.list_(SPAN_TYPE), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", "formatted", "spans", "rewritten_at"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id long, formatted string, spans array<{SPAN}>, rewritten_at int")


def digests(found: DataFrame, template: Template = MARKED) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what
    ``formatted`` gave: turns from their spans, text of the loss from its mask. A conversation whose history
    the template rewrites has no turns here."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv, whole, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns, masked = hashlib.sha256(), hashlib.sha256()
            chars = 0
            for p in parts:
                turns.update("".join(f"{x}\n" for x in template.read(whole[p["start"] : p["end"]])).encode())
                if p["loss"]:
                    said = template.unescape(whole[p["text_start"] : p["text_end"]])
                    chars += len(said)
                    masked.update(said.encode())
            out.append((conv, len(parts), turns.hexdigest(), chars, masked.hexdigest(), len(whole)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(found.select("conv_id", "formatted", "spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", rows=64)
