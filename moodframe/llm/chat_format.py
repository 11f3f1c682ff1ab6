"""Chat formatting with a grammar round trip (operator 3).

A turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. A deterministic
parser reads it back; control strings inside a text are a syntax error to it.
If the recovered turn isn't identical to the source, the text is escaped (a
backslash goes behind the first character of every control string, one more
where there are some) and the round trip is made again.

Rendering, parsing and escaping work turn by turn, wherever the row lies, so a
conversation with very many turns is spread over all tasks. Only digests need
the order of turns: rows are sorted within their conversation and streamed
through incremental digests that hold one turn at a time.
"""
from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED: strings that chat templates use for control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: a control string, with any number of backslashes behind its first character
_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))


class Malformed(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text lies in it."""
    head = f"{START}{role}\n"
    return f"{head}{text}{END}\n", len(head), len(head) + len(text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: role, text, and the place of the text as
    written. Raises Malformed for anything the grammar doesn't give."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise Malformed(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        if line < 0:
            raise Malformed("a role without an end")
        role = rendered[at + len(START):line]
        if _CONTROL.search(role):
            raise Malformed("a control string in a role")
        end = None
        for m in _CONTROL.finditer(rendered, line + 1):
            if m[0][1] == "\\":
                continue
            if m[0] != END:
                raise Malformed(f"{m[0]} in a text")
            end = m.start()
            break
        if end is None or rendered[end + len(END):end + len(END) + 1] != "\n":
            raise Malformed("a turn without an end")
        turns.append((unquote(role), unescape(rendered[line + 1:end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Render, read back, and escape what conflicts until the turn comes back
    identical."""
    safe_role = role if unquote(role) == role and "\n" not in role and not _CONTROL.search(role) else quote(role, safe="")
    for written in (text, escape(text)):
        rendered, a, b = render(safe_role, written)
        try:
            if parse(rendered) == [(role, text, a, b)]:
                return rendered, a, b
        except Malformed:
            pass
    raise Malformed("a turn that can't be read back")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, rendered, and the loss mask as [loss_start, loss_past)
    within ``rendered`` (null outside assistant turns), a row per turn. Null
    role or text counts as empty."""
    def run(batches):
        for b in batches:
            rows = [(*format_turn(r or "", t or ""), r) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] if x[3] == LOSS_ROLE else None for x in rows], pa.int64()), pa.array([x[2] if x[3] == LOSS_ROLE else None for x in rows], pa.int64())], ["conv_id", "turn", "rendered", "loss_start", "loss_past"])

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "conv_id long, turn long, rendered string, loss_start long, loss_past long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: conv_id, n_turns,
    turns_sha256 (role, newline, text, newline of each turn), loss_chars,
    loss_sha256 (the unescaped texts under the loss mask), formatted_chars.

    Turns go by (turn, rendered text): turns with one number have a defined
    order, repeated rows count as often as they come, a null turn number comes
    first. Rows without conv_id are one conversation. An empty table gives none.
    """
    def run(batches):
        now, state = None, None

        def closed():
            n, turns, chars, loss, size = state
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            out = []
            for conv, rendered, a, z in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or now != (conv,):
                    if state is not None:
                        out.append(closed())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, *_ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    under = unescape(rendered[a:z])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(rendered)
            yield _digests(out)
        if state is not None:
            yield _digests([closed()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_past").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)
