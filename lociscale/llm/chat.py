"""Chat formatting through a template that is a black box.

``render(turns)`` is all that is known of a template. Successive prefixes of a conversation are rendered;
where one output continues the one before, what was added is the turn's span. An output that changes
what was there rewrites history, which is reported and leaves the conversation without a mask. A turn's
text is located inside its span by rendering two probes in its place: they differ just where it goes.

Defined cases: turns are in order of (turn, role, text), nulls last; repeated rows are turns of their own;
a null text or role is empty; very long texts and conversations are rendered whole; a row without a conv_id
belongs to no conversation and is formatted alone; an empty table gives no rows; columns besides the four are
not read. A conversation is one string in the result, so one task holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import small_batches, streamed_groups

Turn = tuple[str, str]

#: What a text's control characters become, and how a turn opens and closes.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
OPENS, NAMED, CLOSES = "### ", ": ", "</turn>\n"


_FORTH = str.maketrans(ESCAPES)


@lru_cache(maxsize=1024)
def _remembered(text: str) -> str:
    return text.translate(_FORTH)


def _escaped(text: str) -> str:
    """Escaped; those of short texts are remembered, which prefixes repeat."""
    return _remembered(text) if len(text) < 4096 else text.translate(_FORTH)


class MarkedTemplate:
    """Turns between control strings; texts are escaped so that they can't hold any, reversibly."""

    _back = {v[1]: k for k, v in ESCAPES.items()}

    def escape(self, text: str) -> str:
        return _escaped(text)

    def unescape(self, text: str) -> str:
        first, *rest = text.split("\\")
        out, i = [first], 0
        while i < len(rest):
            if rest[i]:
                out.append(self._back[rest[i][0]] + rest[i][1:])
                i += 1
            else:  # an escaped backslash; what follows is plain
                out.append("\\" + (rest[i + 1] if i + 1 < len(rest) else ""))
                i += 2
        return "".join(out)

    def render(self, turns: list[Turn]) -> str:
        return "".join([f"{OPENS}{self.escape(r)}{NAMED}{self.escape(t)}{CLOSES}" for r, t in turns])

    def read(self, span: str, start: int, end: int) -> Turn:
        """Role and text of a turn from its span, whose text is at ``start`` to ``end``."""
        return self.unescape(span[len(OPENS) : start - len(NAMED)]), self.unescape(span[start:end])


@dataclass
class Span:
    """Where a turn and its text are in the output; ``rewrites`` if earlier output was changed."""

    start: int
    end: int
    text_start: int
    text_end: int
    rewrites: bool = False


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over string comparisons."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[Span]]:
    """The formatted conversation, and a span for each turn, from the outputs of all prefixes.

    Every prefix is rendered whole at every length, so that no rewriting of history goes unseen; this
    costs the square of a conversation's length.
    """
    before = render([])
    spans = []
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        same = common_prefix(before, now)
        x, y = (render([*turns[:k], (role, probe)]) for probe in "xy")
        start = common_prefix(x, y)
        end = len(now) - (len(x) - start - 1)
        if end < start or now[:start] != x[:start] or now[end:] != x[start + 1 :]:
            start = end = len(now)  # the template doesn't hold the text in one piece
        spans.append(Span(same, len(now), start, end, same < len(before)))
        before = now
    return before, spans


def format_conversations(turns: DataFrame, template: MarkedTemplate | None = None, *, loss_role: str = "assistant", with_output: bool = True) -> DataFrame:
    """One row a conversation: conv_id, formatted, spans, rewrites_history and figures read back from
    the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256 (null where history was rewritten),
    formatted_chars."""
    own = template or MarkedTemplate()
    spark = turns.sparkSession
    small_batches(spark, 2000)
    text = [F.col(c).cast("string").alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    figures = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    schema = f"conv_id long, {figures}" + ", formatted string, spans array<struct<start:int,end:int,text_start:int,text_end:int>>" * with_output

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
        key, held = (), []
        for own, part in streamed_groups(batches, ["conv_id", "alone"], 10_000):
            if own != key and key:
                yield key[0], held
                held = []
            key = own
            held += [(r or "", t or "") for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
        if key:
            yield key[0], held

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            names = ["conv_id", *[x.split()[0] for x in figures.split(", ")], *["formatted", "spans"] * with_output]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            kinds += [pa.string(), pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "text_start", "text_end")]))] * with_output
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for conv, held in whole(batches):
            output, spans = locate(own.render, held)
            rewrites = any(s.rewrites for s in spans)
            every, masked, chars = hashlib.sha256(), hashlib.sha256(), 0
            for s in [] if rewrites else spans:
                role, said = own.read(output[s.start : s.end], s.text_start - s.start, s.text_end - s.start)
                every.update(f"{role}\n{said}\n".encode())
                if role == loss_role:
                    masked.update(said.encode())
                    chars += len(said)
            read = (None, None, None) if rewrites else (every.hexdigest(), chars, masked.hexdigest())  # spans of such an output say nothing
            row = (conv, len(spans), *read, len(output), rewrites)
            out.append((*row, output, [{"start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end} for s in spans]) if with_output else row)
            size += len(output) + 200
            if size > 1 << 22:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(formatted, schema)
