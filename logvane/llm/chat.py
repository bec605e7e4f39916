"""Chat formatting by incremental black-box rendering, with the span of every turn and a loss mask.

A template is a function from turns, a list of (role, text), to one string; nothing else is known
of it. Successive prefixes of a conversation are rendered and consecutive outputs compared: what an
output adds to the one before is the turn's span. An output that does not begin with the one before
shows that the template rewrites history; then spans are looked up in the last output. The text
within a span is found by rendering the turn once more with a sentinel instead of its text.

A conversation is cut into parts of `PART_TURNS` turns, each rendered from its own first turn, so a
conversation of a third of all rows is formatted by many tasks, and the work on prefixes grows with
the part, not with the conversation. Reading back streams the parts of a conversation in order.

Defined results: null text or role counts as empty. Turns are ordered by turn (null first), then
role, then text, so ties and repeated rows have one order; a null conv_id is a conversation of its
own. An empty table gives no rows. Texts are rendered whole, however long. Other columns are not
read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import placed

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns that are rendered together.
PART_TURNS = 32

# --- fixed values: control strings of the template ---
START, END = "<s>", "</s>"
ASK, ANSWER = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
CONTROLS = (START, END, ASK, ANSWER, SYSTEM, SYSTEM_END, ROLE, ROLE_END)
MARK = "\\"

_rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_rest})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_rest})")


def escape(text: str) -> str:
    """One more backslash into every control string, behind its first character."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def instruct(turns: list[Turn]) -> str:
    """The template of the query: every turn marked by its role, control strings in texts escaped."""
    out = [START]
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"{ASK} {text} {ANSWER}")
        elif role == "assistant":
            out.append(f" {text}{END}")
        elif role == "system":
            out.append(f"{SYSTEM}{text}{SYSTEM_END}")
        else:
            out.append(f"{ROLE}{escape(role)}{ROLE_END}{text}{END}")
    return "".join(out)


def role_of(marked: str) -> str:
    """The role that a turn's marks, as `instruct` writes them, stand for."""
    if marked.startswith(ROLE):
        return unescape(marked[len(ROLE) : -len(ROLE_END)])
    return {f"{ASK} ": "user", " ": "assistant", SYSTEM: "system"}[marked]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _sentinel(*texts: str) -> str:
    """A character of the private use area that stands in none of the texts."""
    private = chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))
    return next(chr(c) for c in private if not any(chr(c) in t for t in texts))


def _text_span(template: Template, turns: list[Turn], at: int, out: str) -> tuple[int, int] | None:
    """Where the text of turn `at` stands in `out`, the rendering of `turns`; None if it cannot be told."""
    mark = _sentinel(out)
    probe = template([*turns[:at], (turns[at][0], mark), *turns[at + 1 :]])
    if probe.count(mark) != 1:
        return None
    begin = probe.index(mark)
    tail = len(probe) - begin - 1
    end = len(out) - tail
    same = begin <= end and out.startswith(probe[:begin]) and out.endswith(probe[begin + 1 :])
    return (begin, end) if same else None


def render(turns: list[Turn], template: Template) -> tuple[str, list[dict], list[int]]:
    """The rendering of all turns, their spans, and the turns at which the template rewrote history.

    A span has the turn's `begin` and `end` and its text's `text_begin` and `text_end`, in characters.
    Where history was rewritten, a turn's span is its text's, all in the last output; a text that the
    last output does not hold as such has -1 throughout.
    """
    before = template([])
    spans, rewritten = [], []
    for k in range(len(turns)):
        out = template(turns[: k + 1])
        begin = len(before)
        if not out.startswith(before):
            rewritten.append(k)
            begin = _common(before, out)
        found = _text_span(template, turns[: k + 1], k, out) or (-1, -1)
        spans.append({"begin": begin, "end": len(out), "text_begin": found[0], "text_end": found[1]})
        before = out
    if rewritten:
        for k in range(len(turns)):
            begin, end = _text_span(template, turns, k, before) or (-1, -1)
            spans[k] = {"begin": begin, "end": end, "text_begin": begin, "text_end": end}
    return before, spans, rewritten


SPAN = "struct<begin:long, end:long, text_begin:long, text_end:long, in_loss:boolean>"
FORMATTED = f"conv_id long, part long, formatted string, spans array<{SPAN}>, rewritten array<int>"


def _in_parts(turns: DataFrame, part_turns: int) -> DataFrame:
    """Rows with `idx`, the turn's place in its conversation, and `part`, which run of turns it is in."""
    slim = turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")], F.rand(0).alias("salt")
    )
    ranked = placed(slim, "conv_id", ["turn", "role", "text", "salt"])
    return ranked.withColumn("part", F.expr(f"idx div {part_turns}"))


def format_chats(
    turns: DataFrame, template: Template = instruct, part_turns: int = PART_TURNS, loss_role: str = "assistant"
) -> DataFrame:
    """One row per part of a conversation: the formatted text, the spans of its turns with whether
    the text under them is in the loss, and the turns at which the template rewrote history."""
    parts = _in_parts(turns, part_turns).select("conv_id", "part", "idx", "role", "text")
    ordered = parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "idx")
    names = ["conv_id", "part", "formatted", "spans", "rewritten"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 256) for r in b.slice(k, 256).to_pylist())
        held: list[tuple] = []
        size = 0
        for (conv, part), own in groupby(rows, itemgetter("conv_id", "part")):
            said = [(r["role"], r["text"]) for r in own]
            out, spans, rewritten = render(said, template)
            for span, (role, _) in zip(spans, said):
                span["in_loss"] = role == loss_role and span["text_begin"] >= 0
            held.append((conv, part, out, spans, rewritten))
            size += len(out)
            if size > 1 << 22:
                yield _formatted(held, names)
                held, size = [], 0
        if held:
            yield _formatted(held, names)

    return ordered.mapInArrow(run, FORMATTED)


_SPANS = pa.list_(
    pa.struct([*[(c, pa.int64()) for c in ("begin", "end", "text_begin", "text_end")], ("in_loss", pa.bool_())])
)
_FORMATTED = (pa.int64(), pa.int64(), pa.string(), _SPANS, pa.list_(pa.int32()))


def _formatted(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _FORMATTED)], names=names)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, parts long, rewritten long"
)


def read_back(formatted: DataFrame, role: Callable[[str], str] = role_of, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Per conversation, from the formatted texts and spans alone: turns, their digest, and the loss text's.

    `role` tells a turn's role from the marks ahead of its text, `plain` undoes the escapes. The parts
    of a conversation are streamed in order; a task holds one of them at a time.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist())
        held: list[tuple] = []
        for conv, parts in groupby(rows, itemgetter("conv_id")):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = n_parts = rewritten = 0
            for part in parts:
                text = part["formatted"]
                for span in part["spans"]:
                    own = plain(text[span["text_begin"] : span["text_end"]])
                    said = role(text[span["begin"] : span["text_begin"]])
                    turns.update(f"{said}\n{own}\n".encode())
                    if span["in_loss"]:
                        loss.update(own.encode())
                        loss_chars += len(own)
                n, chars = n + len(part["spans"]), chars + len(text)
                n_parts, rewritten = n_parts + 1, rewritten + len(part["rewritten"])
            held.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_parts, rewritten))
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    return ordered.mapInArrow(run, DIGESTS)
