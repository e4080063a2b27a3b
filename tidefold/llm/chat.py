"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn, then formatted a batch at a time: segment lengths give cumulative offsets,
offsets give scatter indices, and headers, escaped contents and footers are copied into one preallocated buffer, which
becomes the Arrow column as it is. A conversation may run over many batches; only its own output is ever held.

Template, with control strings that all begin with ``<`` or ``[``:

    user       <s>[INST] text [/INST]
    system     <s>[SYS] text [/SYS]
    assistant  <s>[ASST] text</s>
    any other  <s>[ROLE:role] text</s>

Inside roles (where ``]`` counts too) and texts every ``\\``, ``<`` and ``[`` is followed by an added ``\\``, so that no control string can occur
there; taking the added ones away again gives back the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headers and footers of the template.
HEADERS = {"user": b"<s>[INST] ", "system": b"<s>[SYS] ", "assistant": b"<s>[ASST] "}
FOOTERS = {"user": b" [/INST]", "system": b" [/SYS]", "assistant": b"</s>"}
OTHER_HEADER, OTHER_FOOTER = (b"<s>[ROLE:", b"] "), b"</s>"

_ESCAPE, _UNESCAPE = re.compile(rb"[\\<\[]"), re.compile(rb"([\\<\[])\\")
_ROLE_ESCAPE, _ROLE_UNESCAPE = re.compile(rb"[\\<\[\]]"), re.compile(rb"([\\<\[\]])\\")
_SPECIAL = np.zeros(256, dtype=bool)
_SPECIAL[list(rb"\<[")] = True
_TURN = re.compile(rb"<s>\[(INST|SYS|ASST|ROLE:((?:[^\\<\[\]]|[\\<\[\]]\\)*))\] ((?:[^\\<\[]|[\\<\[]\\)*)( \[/INST\]| \[/SYS\]|</s>)")
_NAMES = {b"INST": b"user", b"SYS": b"system", b"ASST": b"assistant"}


def escape(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: m[0] + b"\\", raw)


def unescape(raw: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", raw)


def _role_parts(role: str) -> tuple[bytes, bytes]:
    if role in HEADERS:
        return HEADERS[role], FOOTERS[role]
    return OTHER_HEADER[0] + _ROLE_ESCAPE.sub(lambda m: m[0] + b"\\", role.encode()) + OTHER_HEADER[1], OTHER_FOOTER


def assemble(roles: list[str], texts: pa.Array, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Format turns into one byte buffer behind `lead` free bytes: (buffer, offsets of turns, starts and ends of the escaped contents)."""
    n = len(texts)
    heads, feet = zip(*[_role_parts(r) for r in roles]) if n else ((), ())
    data = texts.cast(pa.large_binary())
    _, offsets_buffer, values = data.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[data.offset : data.offset + n + 1] if n else np.zeros(1, np.int64)
    content = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None and n else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    special = _SPECIAL[content]
    added = np.concatenate(([0], np.cumsum(special)))  # escapes before each byte
    in_len, esc_len = np.diff(at), np.diff(at) + np.diff(added[at])
    head_len, foot_len = np.array([len(h) for h in heads], dtype=np.int64), np.array([len(f) for f in feet], dtype=np.int64)
    ends = lead + np.cumsum(head_len + esc_len + foot_len)
    starts = ends - head_len - esc_len - foot_len
    begin = starts + head_len
    out = np.full(int(ends[-1]) if n else lead, ord("\\"), dtype=np.uint8)
    where = np.arange(len(content)) - np.repeat(at[:-1], in_len) + np.repeat(begin, in_len) + added[:-1] - np.repeat(added[at[:-1]], in_len)
    out[where] = content
    for parts, lens, first in ((heads, head_len, starts), (feet, foot_len, ends - foot_len)):
        joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
        out[np.repeat(first - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(len(joined))] = joined
    return out, np.concatenate((starts, ends[-1:])) if n else np.full(1, lead, np.int64), begin, begin + esc_len


FORMATTED = "conv_id long, formatted binary, loss_starts array<long>, loss_ends array<long>"


SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.binary()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


#: Bytes that a value of a row can have.
LARGEST = 2**31 - 1


def _rows(keys: list, buffer: np.ndarray, cuts: np.ndarray, marks: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
    """Conversations that stand one after another in a buffer: the buffer itself becomes the Arrow column."""
    if cuts[-1] > LARGEST:
        raise ValueError(f"a conversation takes {cuts[-1]} bytes; a row holds {LARGEST} at most")
    formatted = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(buffer)])
    return pa.record_batch([pa.array(keys, pa.int64()), formatted, *[pa.array([m[k] for m in marks], SCHEMA.field("loss_starts").type) for k in (0, 1)]], schema=SCHEMA)


def _joined(pieces: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)


def _format(batches):
    """Sorted turns to a row per conversation: its bytes, and where the assistant's contents stand in them.

    Of a conversation that goes on in the next batch its bytes so far are kept, and copied to the front of the buffer in which it ends.
    """
    key, open_, pieces, marks = None, False, [], ([], [])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if open_ and ids[0] != key:
            whole = _joined(pieces)
            yield _rows([key], whole, np.array([0, len(whole)]), [marks])
            open_, pieces, marks = False, [], ([], [])
        firsts = [0, *[i for i in range(1, n) if ids[i] != ids[i - 1]]]
        ends_here = len(firsts) > 1  # the first conversation ends in this batch
        lead = sum(map(len, pieces)) if ends_here else 0
        before = 0 if ends_here else sum(map(len, pieces))
        buffer, offsets, begin, end = assemble(roles, batch.column(2), lead)
        if ends_here:
            buffer[:lead] = _joined(pieces)
        cuts = offsets[firsts].copy()
        cuts[0] = 0
        found = [marks if open_ else ([], []), *[([], []) for _ in firsts[1:]]]
        at = 0
        for i in range(n):
            at += at + 1 < len(firsts) and firsts[at + 1] == i
            if roles[i] == "assistant":
                shift = before - int(cuts[at])
                found[at][0].append(int(begin[i]) + shift)
                found[at][1].append(int(end[i]) + shift)
        if ends_here:
            yield _rows([ids[i] for i in firsts[:-1]], buffer, cuts, found[:-1])
            pieces = []
        key, open_, marks = ids[-1], True, found[-1]
        pieces.append(buffer[cuts[-1] :])
    if open_:
        whole = _joined(pieces)
        yield _rows([key], whole, np.array([0, len(whole)]), [marks])


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: `conv_id`, its bytes `formatted`, `loss_starts` and `loss_ends` in bytes.

    Input columns conv_id, turn, role, text; others are ignored. A text is assembled whole, however long; a conversation of
    over 2 GiB, more than a row can hold, is an error. Rows stand by turn, null turns first, ties by role and
    text; repeated rows stay. A null text or role counts as empty; rows with a null conv_id form one conversation with a
    null id. An empty table gives no rows. The loss mask covers assistant contents, still escaped.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """Read the turns back from formatted bytes."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        role = _NAMES[m[1]] if m[2] is None else _ROLE_UNESCAPE.sub(rb"\1", m[2])
        out.append((role.decode(), unescape(m[3]).decode()))
        at = m.end()
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for conv, formatted, starts, ends in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_starts"], pdf["loss_ends"]):
            formatted = bytes(formatted)
            turns, loss, every = parse(formatted), hashlib.sha256(), hashlib.sha256()
            for role, text in turns:
                every.update(f"{role}\n{text}\n".encode())
            chars = 0
            for s, e in zip(starts, ends):
                raw = unescape(formatted[s:e])
                loss.update(raw)
                chars += len(raw.decode())
            rows.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(formatted.decode())))
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out["conv_id"] = out["conv_id"].astype("Int64")
        yield out


def query(spark, sf_dir: str) -> DataFrame:
    """`op6_chat_format`: every conversation, and one of control strings, read back from the formatted bytes."""
    from .common import materialize, small_batches, table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    with small_batches(spark):
        return materialize(format_conversations(turns.unionByName(planted)).mapInPandas(_digest, DIGESTS), "digests")


def _duck() -> str:
    wrap = {"user": len("<s>[INST]  [/INST]"), "system": len("<s>[SYS]  [/SYS]"), "assistant": len("<s>[ASST] </s>")}
    extra = "length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '[', ''))"
    size = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in wrap.items()) + " END"
    return (
        "WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
        " UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"
        " SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,"
        " coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,"
        " sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,"
        f" sum(length(text) + {extra} + {size})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"
    )


ORACLE_SQL = _duck()
