"""Chat formatting by columnar byte assembly.

Each turn is written as ``<s>role``, a line break, the text, ``</s>`` and a
line break. Control strings inside roles and texts get a backslash after their
first character (one more if they already have some), which is undone when
reading. Lengths, cumulative offsets and scatter indices of all segments of a
block are computed in numpy, and headers, contents and tails are copied into
one preallocated buffer that backs the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import rows_of
from sparkloom.shipping import ship

TAIL = np.frombuffer(b"</s>\n", np.uint8)
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])(\\*)\\(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)
#: Bytes of input that are gathered before conversations are written.
BLOCK = 4 << 20

FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<int>, loss_stop array<int>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, _CONTROL, r"\1\2\\\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _escape_role(column: pa.Array) -> pa.Array:
    """Roles stand on one line: backslashes and line breaks are written as two characters."""
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return escape(column)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> None:
    """Copy each segment of ``data`` to its place in ``out``."""
    at = np.repeat(to - offsets[:-1], np.diff(offsets))
    at += np.arange(len(data))
    out[at] = data


def _assemble(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, in order of their rows, as one batch."""
    ids = table.column("conv_id").combine_chunks()
    key, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(fresh)
    role = pc.fill_null(table.column("role").combine_chunks().cast(pa.large_string()), "")
    text = pc.fill_null(table.column("text").combine_chunks().cast(pa.large_string()), "")
    head, head_at = _bytes(pc.binary_join_element_wise(pa.scalar("<s>", pa.large_string()), _escape_role(role), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
    body, body_at = _bytes(escape(text))
    head_n, body_n = np.diff(head_at), np.diff(body_at)
    sizes = head_n + body_n + len(TAIL)
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(start[-1], np.uint8)
    _scatter(out, head, head_at, start[:-1])
    _scatter(out, body, body_at, start[:-1] + head_n)
    out[(start[1:, None] - len(TAIL) + np.arange(len(TAIL))).ravel()] = np.tile(TAIL, len(sizes))

    ends = np.append(start[first], start[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
    # Code points before each byte, for the loss mask.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conv = np.cumsum(fresh) - 1
    loss = np.asarray(pc.equal(role, "assistant").fill_null(False))
    base = points[ends[:-1]][conv]
    begin = points[start[:-1] + head_n] - base
    stop = points[start[1:] - len(TAIL)] - base
    lists = np.concatenate([[0], np.cumsum(np.bincount(conv[loss], minlength=len(first)))]).astype(np.int32)
    as_list = lambda v: pa.ListArray.from_arrays(pa.array(lists), pa.array(v[loss].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(np.diff(np.append(first, len(key))).astype(np.int64)), formatted.cast(pa.string()) if len(out) < 2**31 else formatted, as_list(begin), as_list(stop)],
        ["conv_id", "n_turns", "formatted", "loss_start", "loss_stop"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column("conv_id")
        last = ids[-1]
        # The last conversation may go on in the next batch.
        other = pc.is_valid(ids) if not last.is_valid else pc.invert(pc.fill_null(pc.equal(ids, last), False))
        n = int(pc.sum(other).as_py() or 0)
        if n:
            yield _assemble(table.slice(0, n))
        held = table.slice(n).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held) if n else size
    if held:
        yield _assemble(pa.Table.from_batches(held))


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_start, loss_stop.

    Turns are in order of their number, null first, and rows that share one in
    order of role and text; repeated rows are turns of their own. Null texts
    and roles are empty. The loss mask covers the texts of assistant turns, in
    code points of ``formatted``. Rows with a null conv_id are one
    conversation. One conversation is one value, so that its turns meet in one
    task. Columns other than those named are ignored.
    """
    ship(turns.sparkSession)
    read = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return found


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            formatted = batch.column("formatted")[i].as_py()
            turns = read_back(formatted)
            spans = zip(batch.column("loss_start")[i].as_py(), batch.column("loss_stop")[i].as_py(), strict=True)
            loss = "".join(unescape(formatted[a:b]) for a, b in spans)
            joined = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((batch.column("conv_id")[i].as_py(), len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and a test conversation of control strings."""
    spark = turns.sparkSession
    words = "</s>[INST] ok [/INST]"
    more = rows_of(spark, [(-1, 0, "user", words), (-1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    every = turns.select("conv_id", "turn", "role", "text").unionAll(more)
    return format_conversations(every).mapInArrow(
        _report, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: The same in DuckDB's SQL, but for the formatted length, which counts the template and the escapes.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS x,
   regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + length(r) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
