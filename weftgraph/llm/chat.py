r"""Chat formatting by columnar byte assembly.

The template gives every turn an opener and a closer of its own (``[INST]..[/INST]`` for users,
``<s>..</s>`` for assistants, ``<<SYS>>..<</SYS>>`` for the system, ``[ROLE]name[TEXT]..[/ROLE]`` for any
other role).  All control strings begin with ``<`` or ``[``; in texts these two and the escape
character are written ``\l``, ``\b`` and ``\\``, so no text can hold a control string and unescaping gives
it back.

A batch of turns becomes one Arrow buffer: segment lengths (opener, content, closer) give cumulative
offsets, scatter indices copy the content bytes to their places, and the conversation strings are
offsets into that buffer.  A conversation that spans several batches is several parts, so one that holds
a large share of all turns never has to fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import in_arrow, partitions
from weftgraph.llm.words import buffers, chunks

#: role -> opener, closer
TEMPLATE = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
PARTS = "conv_id long, part long, formatted string, turn_starts array<long>, loss_starts array<long>, loss_ends array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"\[INST\]([^<\[]*)\[/INST\]|<s>([^<\[]*)</s>|<<SYS>>([^<\[]*)<</SYS>>|\[ROLE\]([^<\[]*)\[TEXT\]([^<\[]*)\[/ROLE\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", "l": "<", "b": "["}
PROBE = "</s>[INST] ok [/INST]"


def escape(column: pa.Array) -> pa.Array:
    for plain, coded in ESCAPES:
        column = pc.replace_substring(column, plain, coded)
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> None:
    """Copy text i, ``data[offsets[i]:offsets[i+1]]``, to ``out[to[i]:]``, all in one indexed store."""
    out[np.arange(len(data)) + np.repeat(to - offsets[:-1], np.diff(offsets))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in a row, each turn's start (one more at the end), and its content's span."""
    names = roles.dictionary_encode() if not isinstance(roles, pa.DictionaryArray) else roles
    heads, tails = [], []
    for role in names.dictionary.to_pylist():
        opener, closer = TEMPLATE.get(role) or (None, None)
        if opener is None:
            opener, closer = OTHER[0] + escape(pa.array([role or ""]))[0].as_py() + OTHER[1], OTHER[2]
        heads.append(opener.encode())
        tails.append(closer.encode())
    kind = names.indices.to_numpy(zero_copy_only=False)
    data, offsets = buffers(escape(texts))
    lengths = np.diff(offsets)
    fixed = [np.frombuffer(b"".join(x), np.uint8) for x in (heads, tails)]
    at = [np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int64) for x in (heads, tails)]
    head, tail = (np.diff(a)[kind] for a in at)
    starts = np.concatenate([[0], np.cumsum(head + lengths + tail)])
    out = np.empty(starts[-1], np.uint8)
    scatter(out, data, offsets, starts[:-1] + head)
    for bytes_, first, size, to in ((fixed[0], at[0], head, starts[:-1]), (fixed[1], at[1], tail, starts[:-1] + head + lengths)):
        run = np.concatenate([[0], np.cumsum(size)])
        out[np.arange(run[-1]) + np.repeat(to - run[:-1], size)] = bytes_[np.arange(run[-1]) + np.repeat(first[kind] - run[:-1], size)]
    return out, starts, starts[:-1] + head, starts[:-1] + head + lengths


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in chunks(batches, "text"):
        n = batch.num_rows
        ids = batch.column("conv_id")
        roles = pc.fill_null(batch.column("role"), "").cast(pa.string())
        out, starts, begin, end = assemble(roles, batch.column("text"))
        values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(ids).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])
        first = np.append(np.flatnonzero(new), n)
        convs = [None if nulls[i] else int(values[i]) for i in first[:-1]]
        numbers = []
        for conv in convs:
            part = part + 1 if conv == last and last is not None or conv is None and last is None else 0
            last = conv
            numbers.append(part)
        text = pa.Array.from_buffers(pa.large_string(), len(convs), [None, pa.py_buffer(starts[first].astype(np.int64)), pa.py_buffer(out)])
        base = np.repeat(starts[first[:-1]], np.diff(first))
        loss = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
        held = np.concatenate([[0], np.cumsum(loss)])[first].astype(np.int32)
        lists = lambda where, values: pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(values, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(convs, pa.int64()),
                pa.array(numbers, pa.int64()),
                text.cast(pa.string()),
                lists(first.astype(np.int32), starts[:-1] - base),
                lists(held, (begin - base)[loss]),
                lists(held, (end - base)[loss]),
            ],
            names=["conv_id", "part", "formatted", "turn_starts", "loss_starts", "loss_ends"],
        )


def format_chat(turns: DataFrame) -> DataFrame:
    """Conversations of ``turns(conv_id, turn, role, text)`` in the template, in parts of ascending ``part``.

    ``turn_starts``, ``loss_starts`` and ``loss_ends`` are byte positions in the UTF-8 of ``formatted``; the
    loss spans hold the (escaped) assistant texts.  Null text is empty, null role is a role of empty
    name, null conv_id is a conversation of its own, rows of equal (conv_id, turn) follow by role, then
    text, and repeated rows stay.  Other columns are ignored.  Each task streams its sorted rows, of which it
    holds some 2 MB, or a single longer text, several times over.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(rows, _parts, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of one part, read back from the formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}: {formatted[at : at + 40]!r}")
        k = m.lastindex
        out.append((unescape(m[4]), unescape(m[5])) if k == 5 else (("user", "assistant", "system")[k - 1], unescape(m[k])))
        at = m.end()
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def row(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    for batch in batches:
        done = []
        for conv, part, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_starts", "loss_ends")), strict=True):
            if part == 0:
                if state:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            raw = text.encode()
            for a, b in zip(starts, ends, strict=True):
                said = unescape(raw[a:b].decode())
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, zip(*done) if done else [[]] * 6, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, row(state), strict=True)], names=names)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from the parts of ``format_chat``, wherever and in whatever order they were stored.

    A conversation's digests are sequential by definition, so one task streams its parts.
    """
    rows = parts.select("conv_id", "part", "formatted", "loss_starts", "loss_ends")
    rows = rows.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return in_arrow(rows, _digests, DIGEST)


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose two texts hold control strings of common templates."""
    own = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\<\[]')) AS coded FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(coded + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                   ELSE 19 + length(role) + len(regexp_extract_all(role, '[\\<\[]')) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
