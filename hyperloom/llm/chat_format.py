"""Chat formatting by schema fingerprints.

A record is JSON. Those of its nested field paths (array steps as ``[]``) that
some layout knows are hashed; the fingerprint selects a declarative mapping,
which turns the layout into canonical (role, text) turns. So fields that no
layout knows don't matter, and optional ones may be missing. A fingerprint that
is met for the first time is resolved once: of the layouts whose required paths
the record has, that with the most, the first on ties. The template marks turns as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and escapes control strings inside roles and texts reversibly: a backslash is
doubled, and a backslash goes in after the first character of every control
string. ``read_back`` inverts it.

Records are one turn per row (``conversations``) or whole conversations; turns
are streamed in order, so a conversation of any length takes the memory of one
Arrow batch.

Defined results: null text is empty, null role is the empty role; turns of one
conversation follow turn, then role, then text (null turn first); rows of a null
conv_id are one conversation; a record of unknown layout (and a null one) yields
one turn of role ``unmapped`` with its JSON as text, as does an item of a list of
turns that is no object; a payload that is no JSON yields one turn of role
``malformed`` with the payload as text; an empty list of turns yields none; a
missing role or text is empty, one that is no string is its JSON, a list of
parts with texts is these texts; half of a surrogate pair becomes U+FFFD; very
long texts and repeated rows are no special case; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\\n\\/")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return unescape(role.replace("\\\\n\\/", "\n"))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _turn.finditer(formatted)]


def field_paths(record) -> set[str]:
    """Nested field paths of parsed JSON, array steps as []."""
    out, left = set(), [("", record)]
    while left:
        at, x = left.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                out.add(path := f"{at}.{k}" if at else k)
                left.append((path, v))
        elif isinstance(x, list):
            left += [(f"{at}[]", v) for v in x]
    return out


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Layouts: the field paths that one needs and may have, and how turns are read. ``each``: the
#: list that holds a turn per item, and the names under which an item has its role and its text;
#: ``roles`` renames; ``turns``: fixed (role, fields), a role that begins with $ being a field.
LAYOUTS = [
    {"paths": ("role", "text"), "turns": [("$role", ("text",))]},
    {"paths": ("role", "content"), "turns": [("$role", ("content",))]},
    {"paths": ("messages",), "may": ("messages[].role", "messages[].content", "messages[].content[].text", "messages[].text", "system"), "first": ("system", "system"), "each": ("messages", ("role",), ("content", "text"))},
    {"paths": ("conversations",), "may": ("conversations[].from", "conversations[].value", "conversations[].role", "conversations[].content", "system"), "first": ("system", "system"), "each": ("conversations", ("from", "role"), ("value", "content")), "roles": {"human": "user", "gpt": "assistant"}},
    {"paths": ("instruction", "output"), "may": ("input", "system"), "turns": [("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))]},
    {"paths": ("instruction", "response"), "may": ("input", "context", "system"), "turns": [("system", ("system",)), ("user", ("instruction", "input", "context")), ("assistant", ("response",))]},
    {"paths": ("prompt", "completion"), "may": ("system",), "turns": [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))]},
    {"paths": ("prompt", "response"), "may": ("system",), "turns": [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))]},
    {"paths": ("question", "answer"), "may": ("context", "system"), "turns": [("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))]},
]


class Registry:
    """Layouts by the fingerprints of the paths that they know."""

    def __init__(self, layouts: list[dict]):
        self.layouts = layouts
        self.known = {p for x in layouts for p in (*x["paths"], *x.get("may", ()))}
        self.by_print: dict[str, dict | None] = {}

    def select(self, record) -> dict | None:
        """The layout of a record, or None."""
        own = field_paths(record) & self.known
        mark = fingerprint(own)
        if mark not in self.by_print:
            fits = [x for x in self.layouts if own >= set(x["paths"])]
            self.by_print[mark] = max(fits, key=lambda x: len(own & {*x["paths"], *x.get("may", ())}), default=None)
        return self.by_print[mark]


REGISTRY = Registry(LAYOUTS)


def _as_text(v) -> str:
    if isinstance(v, list) and v and all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in v):
        return "".join(x["text"] for x in v)
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def canonical(record, registry: Registry | None = None) -> list[tuple[str, str]]:
    """Turns of one parsed record."""
    how = (registry or REGISTRY).select(record) if isinstance(record, dict) else None
    if how is None or ("each" in how and not isinstance(record[how["each"][0]], list)):
        return [("unmapped", json.dumps(record, ensure_ascii=False))]
    out = []
    if "each" in how:
        items, roles, texts = how["each"]
        if "first" in how and record.get(how["first"][1]) is not None:
            out.append((how["first"][0], _as_text(record[how["first"][1]])))
        for m in record[items]:
            if not isinstance(m, dict):
                out.append(("unmapped", json.dumps(m, ensure_ascii=False)))
                continue
            role, text = (next((_as_text(m[n]) for n in names if m.get(n) is not None), "") for names in (roles, texts))
            out.append((how.get("roles", {}).get(role, role), text))
        return out
    for role, fields in how["turns"]:
        if role.startswith("$") or any(f in how["paths"] or record.get(f) is not None for f in fields):  # an optional turn needs its field
            out.append((_as_text(record[role[1:]]) if role.startswith("$") else role, "\n".join(t for t in (_as_text(record.get(f)) for f in fields) if t)))
    return out


def turns_of(payload: str | None, registry: Registry | None = None) -> list[tuple[str, str]]:
    """Turns of one record as it stands."""
    try:
        got = canonical(None if payload is None else json.loads(payload), registry)
    except (ValueError, RecursionError):
        got = [("malformed", payload)]
    return [tuple(x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in turn) for turn in got]


def format_records(records: DataFrame, registry: Registry | None = None) -> DataFrame:
    """records(conv_id, turn, payload JSON) -> conv_id, turn, part, role, text, formatted.

    One row per turn; ``part`` numbers the turns of one record. The formatted
    conversation is the concatenation of ``formatted`` in (turn, part) order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, turn, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for part, (role, text) in enumerate(turns_of(payload, registry)):
                    out.append((conv, turn, part, role, text, format_turn(role, text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=names)

    names, types = ["conv_id", "turn", "part", "role", "text", "formatted"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "payload").mapInArrow(run, "conv_id long, turn long, part int, role string, text string, formatted string")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output says when read back, per conversation.

    Turns are sorted within partitions and hashed as they stream by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close(s):
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss"], s["mask"].hexdigest(), s["chars"])

        for b in batches:
            done = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        done.append(close(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(), "chars": 0}
                state["chars"] += len(text)
                for role, said, *_ in read_back(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                    if role == "assistant":
                        state["loss"] += len(said)
                        state["mask"].update(said.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=cols)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(close(state), types, strict=True)], names=cols)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text").select("conv_id", "formatted")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as one JSON record per turn."""
    payload = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select("conv_id", "turn", payload.alias("payload"))
