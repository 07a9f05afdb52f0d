"""Chat formatting: records of any known layout become canonical turns, and turns become one marked text.

A record's layout is the set of its nested field paths. Its fingerprint, a hash of the sorted paths, selects a
declarative mapping; a layout met for the first time is matched with each mapping once and remembered.

The template puts `<|im_start|>role\\n` before each text and `<|im_end|>\\n` after it. Inside texts and roles each `<|`,
whatever backslashes stand between the two characters, gets one more backslash, so control strings never occur there
and the change can be taken back; a role's line feeds and backslashes are escaped as well.

Edge cases: a null text or role is empty; turns of equal number are kept, ordered by their marked form; null turn numbers
come first; rows of a null conversation form one conversation; fields that a mapping doesn't read are ignored; an unknown
layout, and one that two mappings claim, gives no turns and `layout` is null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm.runtime import free, lean, ship

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Mapping:
    """How to read turns from a layout. turns: (role, path) pairs in order, for flat layouts; or `each`: the path of a
    list, with the names of its role and text fields. Fields of `needs` must occur, those of `may` can be missing."""

    name: str
    needs: frozenset[str]
    may: frozenset[str] = frozenset()
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""


def _flat(name: str, *turns: tuple[str, str], may: tuple[str, ...] = ()) -> Mapping:
    return Mapping(name, frozenset(p for _, p in turns if p not in may), frozenset(may), turns)


def _listed(name: str, each: str, role: str, text: str, may: tuple[str, ...] = ()) -> Mapping:
    return Mapping(name, frozenset({f"{each}[].{role}", f"{each}[].{text}"} - set(may)), frozenset(may) | {each, f"{each}[]"}, (("system", "system"),) if "system" in may else (), each, role, text)


MAPPINGS = (
    Mapping("turn", frozenset(), frozenset({"role", "text"}), (("$role", "text"),)),
    _flat("prompt_completion", ("system", "system"), ("user", "prompt"), ("assistant", "completion"), may=("system",)),
    _flat("prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response"), may=("system",)),
    _flat("instruction", ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"), may=("system", "input")),
    _flat("question_answer", ("user", "context"), ("user", "question"), ("assistant", "answer"), may=("context",)),
    _listed("messages", "messages", "role", "content", may=("system",)),
    _listed("conversations", "conversations", "from", "value", may=("system",)),
    _listed("nested_messages", "data.messages", "author.role", "content.parts[]", may=("data", "data.messages[].author", "data.messages[].content")),
)
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def paths(value, at: str = "") -> set[str]:
    """Paths of the leaves and lists of a parsed record; nulls count as missing. `[]` stands for any list item."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        inner = {p for v in value for p in paths(v, f"{at}[]")}
        return inner or {at}
    return set() if value is None else {at}


def fingerprint(found: Iterable[str]) -> int:
    """Layout number: a hash of the sorted paths."""
    return xxhash.xxh64_intdigest("\x1f".join(sorted(found)))


_KNOWN: dict[int, Mapping | None] = {}


def _choose(found: set[str]) -> Mapping | None:
    """The mapping that reads most of a layout; fields that it doesn't read play no part. One without needed fields counts
    where no other fits, also for records of nulls alone. None where two conflict: each reads a field that the other one doesn't."""
    fits = [m for m in MAPPINGS if m.needs <= found and (m.needs or not found or m.may & found)]
    fits = [m for m in fits if m.needs] or fits
    reads = [(m.needs | m.may) & found for m in fits]
    best = max(range(len(fits)), key=lambda i: len(reads[i]), default=None)
    return fits[best] if best is not None and all(r <= reads[best] for r in reads) else None


def mapping(record) -> tuple[int, Mapping | None]:
    """Fingerprint of a record and the mapping of its layout."""
    found = paths(record)
    print_ = fingerprint(found)
    if not isinstance(record, dict):
        return print_, None
    if print_ not in _KNOWN:
        _KNOWN[print_] = _choose(found)
    return print_, _KNOWN[print_]


def _get(value, path: str):
    for name in path.split("."):
        parts = name.endswith("[]")
        value = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
        if parts:
            value = "\n".join(str(x) for x in value or () if x is not None)
    return value


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)


def turns(record, m: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns. Optional flat turns that are missing are left out; neighbouring user parts join."""
    out: list[tuple[str, str]] = []
    for role, path in m.turns:
        text = _get(record, path)
        if role == "$role":
            out.append((_text(record.get("role")), _text(text)))
        elif text is not None or path in m.needs:
            if out and out[-1][0] == role:
                out[-1] = (role, f"{out[-1][1]}\n{_text(text)}")
            else:
                out.append((role, _text(text)))
    for item in (_get(record, m.each) or ()) if m.each else ():
        role = _text(_get(item, m.role))
        out.append((ROLES.get(role, role), _text(_get(item, m.text))))
    return out


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<{m[1]}\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text) if "<" in text else text


def write_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The marked turn, and the span of it that counts in training: the text of an assistant's turn."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == "assistant" else None


def read_turn(marked: str) -> tuple[str, str]:
    """Role and text of a marked turn."""
    head, _, body = marked.removeprefix(START).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body[: -len(END) - 1])


def split_turns(marked: str) -> Iterator[str]:
    """The marked turns of a formatted conversation."""
    for part in marked.split(START)[1:]:
        yield START + part


def format_record(record) -> tuple[int, str | None, str, list[tuple[int, int]]]:
    """(fingerprint, layout, marked text, loss spans) of one record."""
    print_, m = mapping(record)
    out, spans, at = [], [], 0
    for role, text in turns(record, m) if m else ():
        marked, span = write_turn(role, text)
        out.append(marked)
        if span:
            spans.append((at + span[0], at + span[1]))
        at += len(marked)
    return print_, m and m.name, "".join(out), spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(df: DataFrame, record: str, fingerprint: str = "layout_id", layout: str = "layout", marked: str = "formatted", loss: str = "loss_spans") -> DataFrame:
    """All columns of df plus layout number and name, marked text and loss spans of each JSON record. Broken JSON and
    null have no layout and an empty text."""
    ship(df.sparkSession)

    @F.arrow_udf("struct<layout_id: bigint, layout: string, formatted: string, spans: array<struct<start: bigint, end: bigint>>>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for x in column:
            try:
                got = format_record(json.loads(x.as_py() or "null"))
            except ValueError:
                got = (None, None, "", [])
            rows.append(got)
        ids = pa.array([None if r[0] is None else r[0] - (1 << 64 if r[0] >> 63 else 0) for r in rows], pa.int64())
        spans = pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], _SPANS)
        return pa.StructArray.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), spans], ["layout_id", "layout", "formatted", "spans"])

    (made,) = free(df, "made")
    out = df.withColumn(made, run(F.col(record)))
    for name, field in ((fingerprint, "layout_id"), (layout, "layout"), (marked, "formatted"), (loss, "spans")):
        out = out.withColumn(name, F.col(made)[field])
    return out.drop(made)


def conversations(df: DataFrame) -> DataFrame:
    """Reads back the formatted conversations of rows (conv_id, turn, role, text): per conversation n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Marked turns are dealt by conversation, sorted on disk where
    needed and read as a stream, so a conversation of any length takes the memory of one batch."""
    ship(df.sparkSession)
    record = F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    rows = format_records(df.select("conv_id", "turn", "role", "text", record.alias("record")), "record")
    dealt = rows.select("conv_id", "turn", "formatted", "loss_spans").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_spans")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state, type_ = None, None, None

        def close():
            n, whole, chars, loss, size = state
            values = [[now], [n], [whole.hexdigest()], [chars], [loss.hexdigest()], [size]]
            kinds = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        done = []
        for b in batches:
            type_ = b.column(0).type
            for conv, marked, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        done.append(close())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for part in split_turns(marked):
                    role, text = read_turn(part)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(marked)
                for s in spans:
                    lost = unescape(marked[s["start"] : s["end"]])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield close()

    return ordered.mapInArrow(lean(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
