"""Chat records of any known layout as canonical turns, formatted by one template with a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, partitions, written

#: Strings that steer common chat models; none of them survives inside an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
_INSIDE = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    return _INSIDE.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. ``each``: path of a list of messages with ``role`` and ``text`` inside it;
    otherwise ``fixed``: (role, path) for single fields, in order. ``roles`` renames roles, ``calls`` names a
    message's field of tool calls, which become a turn of role ``tool_call`` in JSON."""

    fixed: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    calls: str = "tool_calls"


_SHARE = {"human": "user", "gpt": "assistant", "prompter": "user", "bot": "assistant"}
#: Fields that say something about a record or message and nothing in it; layouts are told apart without them.
ASIDE = frozenset(("id", "_id", "uuid", "timestamp", "created", "created_at", "date", "lang", "language", "source", "model", "score", "rating", "tags", "metadata", "meta", "name", "weight", "tool_call_id"))
_PARTS = (("content[].text", "content[].type"),)
_CALLS = (("tool_calls[].function.arguments",), ("tool_calls[].type",))


def _messages(path: str, role: str, text: str, optional: tuple[tuple[str, ...], ...] = ()) -> tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]:
    return (f"{path}[].{role}", f"{path}[].{text}"), tuple(tuple(f"{path}[].{p}" for p in group) for group in optional)


#: Layouts: paths that must be there, groups of paths that may be, and where the turns are. A list is one step "[]".
LAYOUTS: tuple[tuple[tuple[str, ...], tuple[tuple[str, ...], ...], Mapping], ...] = (
    (("role", "text"), (), Mapping(fixed=(("@role", "text"),))),
    (("content", "role"), (), Mapping(fixed=(("@role", "content"),))),
    (("content[].text", "content[].type", "role"), (), Mapping(fixed=(("@role", "content"),))),
    (*_messages("messages", "role", "content", (*_PARTS, *_CALLS)), Mapping(each="messages")),
    (("messages[].role", "messages[].content[].text", "messages[].content[].type"), (), Mapping(each="messages")),
    (("messages[]",), (), Mapping(each="messages")),
    (*_messages("conversations", "from", "value"), Mapping(each="conversations", role="from", text="value", roles=_SHARE)),
    (("conversations[]",), (), Mapping(each="conversations")),
    (*_messages("conversation", "role", "content"), Mapping(each="conversation")),
    (*_messages("turns", "role", "text"), Mapping(each="turns", text="text")),
    (("completion", "prompt"), (("system",),), Mapping(fixed=(("system?", "system"), ("user", "prompt"), ("assistant", "completion")))),
    (("prompt", "response"), (("system",),), Mapping(fixed=(("system?", "system"), ("user", "prompt"), ("assistant", "response")))),
    (("answer", "question"), (("context",),), Mapping(fixed=(("user", "context+question"), ("assistant", "answer")))),
    (("instruction", "output"), (("input",), ("system",)), Mapping(fixed=(("system?", "system"), ("user", "instruction+input"), ("assistant", "output")))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record's scalars without those aside; elements of a list share one path, and an empty
    list is a path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items() if k not in ASIDE)) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    """A layout's name: the hash of its sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def mapped_layouts(layouts=LAYOUTS) -> dict[str, Mapping]:
    """Fingerprint to mapping: one for the paths a layout must have with every choice of those it may have."""
    out: dict[str, Mapping] = {}
    for required, optional, mapping in layouts:
        for n in range(len(optional) + 1):
            for groups in combinations(optional, n):
                out.setdefault(fingerprint({*required, *(p for g in groups for p in g)}), mapping)
    return out


MAPPINGS: dict[str, Mapping] = mapped_layouts()


def _said(x) -> str:
    """A value as text: null is empty, parts of a content list stand on lines of their own, other values are JSON."""
    if x is None or isinstance(x, str):
        return x or ""
    if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in x):
        return "\n".join(p["text"] for p in x)
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def turns_of(record: dict, mappings: dict[str, Mapping] = MAPPINGS) -> tuple[str, list[Turn] | None]:
    """(fingerprint, canonical turns, or None for a layout that has no mapping). Null values are empty texts. A list of
    scalars has the path of an empty list and no mapping."""
    name = fingerprint(field_paths(record))
    mapping = mappings.get(name)
    if mapping is None or (mapping.each is not None and not all(isinstance(m, dict) for m in record[mapping.each])):
        return name, None
    turns = []
    if mapping.each is not None:
        for m in record[mapping.each]:
            role, calls = _said(m.get(mapping.role)), m.get(mapping.calls)
            if m.get(mapping.text) is not None or not calls:
                turns.append(Turn(mapping.roles.get(role, role), _said(m.get(mapping.text))))
            if calls:
                turns.append(Turn("tool_call", json.dumps(calls, ensure_ascii=False, sort_keys=True)))
        return name, turns
    for role, path in mapping.fixed:
        parts = [_said(record.get(p)) for p in path.split("+")]
        if role.endswith("?"):
            if path not in record:
                continue
            role = role[:-1]
        role = _said(record.get(role[1:])) if role.startswith("@") else role
        turns.append(Turn(mapping.roles.get(role, role), "\n\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]))
    return name, turns


def formatted(turn: Turn) -> tuple[str, int, int]:
    """The turn in the template, and the code points of it under the loss mask (none: 0, 0)."""
    role = escape(turn.role).replace("\n", "\\\n")  # a line feed ends a role, so one inside is escaped
    head, body = f"<|turn|>{role}\n", escape(turn.text)
    mask = (len(head), len(head) + len(body)) if turn.role == "assistant" else (0, 0)
    return f"{head}{body}<|end|>\n", *mask


def parsed(text: str) -> list[Turn]:
    """Turns of a formatted text: ``formatted`` taken back."""
    return [Turn(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def canonical_turns(records: DataFrame, mappings: dict[str, Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, seq, part, layout, role, text) from ``records`` (conv_id long, seq long, record: JSON string).

    Every record's layout is the fingerprint of its field paths; its mapping gives the turns, ``part`` numbers
    them from 0. Records without a mapping, and null or broken ones, give one row with part -1, the layout (null if broken)
    and null role and text, so nothing vanishes unseen; a record whose list of messages is empty gives none. Broken are
    records that are no JSON object, nested deeper than Python follows, or with half of a surrogate pair. Null
    ids stay; repeated rows each give their turns; other columns are not read; an empty table gives no rows.
    """
    schema = "conv_id long, seq long, part int, layout string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, seq, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = json.loads(raw) if raw is not None else None
                    name, turns = turns_of(record, mappings) if isinstance(record, dict) else (None, None)
                    for turn in turns or ():
                        turn.role.encode(), turn.text.encode()
                except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
                    name, turns = None, None
                out += [(conv, seq, i, name, t.role, t.text) for i, t in enumerate(turns)] if turns is not None else [(conv, seq, -1, name, None, None)]
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "seq", "part", "layout", "role", "text"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "record").mapInArrow(freed(run), schema)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, part, piece, loss_start, loss_end): every turn of ``turns`` (as ``canonical_turns`` gives them) in
    the template. A conversation's text is its pieces by seq, part, end to end; offsets are code points of the
    piece and cover assistant texts only. Records without a mapping (part -1) have an empty piece and stay to be
    counted. Null roles and texts are empty; repeated rows are formatted each; an empty table gives no rows."""
    schema = "conv_id long, seq long, part int, piece string, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [formatted(Turn(r or "", t or "")) if part >= 0 else ("", 0, 0) for part, r, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            pieces, starts, ends = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pieces, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "seq", "part", "piece", "loss_start", "loss_end"])

    return turns.select("conv_id", "seq", "part", "role", "text").mapInArrow(freed(run), schema)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unmapped), read back from formatted
    pieces; ``n_unmapped`` counts records whose layout no mapping knows.

    Conversations stream through sorted partitions; a task holds a batch of rows and two running digests,
    however long a conversation is. Rows without conv_id are one conversation; rows that share seq and part go by
    their piece; an empty table gives no rows.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unmapped long"
    names = [s.split()[0] for s in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        out: list[tuple] = []

        def close() -> None:
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for conv, piece, start, end, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for turn in parsed(piece):
                    now[1] += 1
                    now[2].update(f"{turn.role}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(piece[start:end])
                now[3] += len(masked)
                now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(piece)
                now[6] += part < 0
            if out:
                yield flush()
        if now is not None:
            close()
            yield flush()

    dealt = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq", "part", "piece")
    return dealt.select("conv_id", "piece", "loss_start", "loss_end", "part").mapInArrow(freed(run), schema)


def with_fixed_conversation(conversations: DataFrame, conv_id: int = -1, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with one more: a user's and an assistant's row saying ``text``."""
    spark = conversations.sparkSession
    rows = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(rows)


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = with_fixed_conversation(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    records = rows.select("conv_id", F.col("turn").alias("seq"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat_digests(written(format_chats(canonical_turns(records)), "chats"))
