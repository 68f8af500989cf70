"""Chat formatting: records of many layouts become canonical turns, and turns a text with a loss mask.

A record's layout is told by a fingerprint: the hash of the nested paths of its fields that hold a value ([] for the
elements of a list), of those paths that any mapping knows. A fingerprint selects a declarative mapping, which lists
where turns come from. Where a record has known paths of several mappings and no fingerprint fits, the mapping goes
that finds most paths of its own, all that it must have among them; of equals the first. Records are JSON objects (turns_of_json), or the rows of a table (turns_of_table), whose
schema gives the paths.

Each turn is formatted by itself, so nothing is shuffled and a conversation of any length is a set of rows; the
conversation's text is its segments in the order of turns. Within texts "<|" is written "<\\|", and where there are
backslashes between, one more, so no text can hold a control string and reading back restores it.

Null text is the empty text, a null role the empty role; a turn number that repeats orders by the segment's text; a
repeated row is a turn again. Rows with a null conversation id form one conversation with that id. A record of no
known layout, or that is no JSON object (broken, nested too deep), keeps a row with a null layout and no turns. Lone
surrogates become U+FFFD, as UTF-8 has no form for them. A text may be a list of parts: their texts are joined.
Other columns are ignored, also those whose names another layout knows."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Field:
    """A turn of a fixed role from one path; further paths are put after it, two line ends between."""

    role: str
    path: str
    more: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [self.path]

    def optional(self) -> list[str]:
        return list(self.more)


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list, its role and text below the element; roles pass through a table of names."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]

    def optional(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Mapping:
    """Turns in order; those under optional come if their path is there."""

    name: str
    turns: tuple[Field | Each, ...]
    optional: tuple[Field, ...] = ()

    def sets(self) -> Iterator[frozenset[str]]:
        """Every set of paths with a value that this mapping stands for."""
        must = {p for t in self.turns for p in t.paths()}
        may = sorted({p for t in self.turns for p in t.optional()} | {p for t in self.optional for p in t.paths()})
        for n in range(len(may) + 1):
            for some in itertools.combinations(may, n):
                yield frozenset(must | set(some))


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
_SYSTEM = (Field("system", "system"),)
MAPPINGS = (
    Mapping("messages", (Each("messages", "role", "content", _NAMES),), _SYSTEM),
    Mapping("messages-parts", (Each("messages", "role", "content[].text", _NAMES),), _SYSTEM),
    Mapping("messages-text", (Each("messages", "role", "text", _NAMES),), _SYSTEM),
    Mapping("messages-author", (Each("messages", "author.role", "content.text", _NAMES),), _SYSTEM),
    Mapping("from-value", (Each("conversations", "from", "value", _NAMES),), _SYSTEM),
    Mapping("instruction", (Field("user", "instruction", ("input",)), Field("assistant", "output")), _SYSTEM),
    Mapping("prompt-completion", (Field("user", "prompt"), Field("assistant", "completion")), _SYSTEM),
    Mapping("prompt-response", (Field("user", "prompt"), Field("assistant", "response")), _SYSTEM),
    Mapping("question-answer", (Field("user", "question", ("context",)), Field("assistant", "answer")), _SYSTEM),
    Mapping("history", (Each("history", "role", "text", _NAMES), Field("user", "prompt"), Field("assistant", "response")), _SYSTEM),
)
#: A table with a row for each turn: the names of conversation, turn, role and text.
ROW_LAYOUTS = {"rows": ("conv_id", "turn", "role", "text"), "rows-message": ("conversation_id", "index", "role", "content"), "rows-thread": ("thread_id", "position", "speaker", "utterance")}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


_KNOWN = frozenset(p for m in MAPPINGS for s in m.sets() for p in s)
_BY_FINGERPRINT: dict[str, Mapping] = {}
for _m in MAPPINGS:
    for _s in _m.sets():
        _BY_FINGERPRINT.setdefault(fingerprint(_s), _m)


def paths_of(value, at: str = "") -> Iterator[str]:
    """The paths of all leaves of a parsed record that hold a value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths_of(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from paths_of(v, f"{at}[]")
    elif value is not None:
        yield at


def _get(record, path: str):
    for k in path.split("."):
        if isinstance(record, list):  # the parts of a text
            record = [x.get(k) for x in record if isinstance(x, dict)]
        else:
            record = record.get(k.removesuffix("[]")) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _SURROGATE.search(value) else value
    if isinstance(value, list) and value:  # the parts of a text
        parts = [x.get("text") if isinstance(x, dict) and x.get("type") else x for x in value]
        if all(isinstance(x, str) or x is None for x in parts):
            return "".join(_text(x) for x in parts)
    return "" if value is None else _text(json.dumps(value, ensure_ascii=False))


_SURROGATE = re.compile("[\ud800-\udfff]")


def _mapping(paths: frozenset[str]) -> Mapping | None:
    """The mapping of a fingerprint, or that which finds most of its paths among them."""
    if found := _BY_FINGERPRINT.get(fingerprint(paths)):
        return found
    fits = [(len(s & paths), -k, m) for k, m in enumerate(MAPPINGS) if (s := max(m.sets(), key=len)) and min(m.sets(), key=len) <= paths]
    return max(fits, key=lambda f: f[:2])[2] if fits else None


def canonical(text: str | None) -> tuple[str | None, list[dict]]:
    """The layout of a JSON record and its turns."""
    try:
        record = json.loads(text) if text else None
        if not isinstance(record, dict):
            return None, []
        mapping = _mapping(_KNOWN.intersection(paths_of(record)))
    except (ValueError, RecursionError):
        return None, []
    if mapping is None:
        return None, []
    out = []
    for t in (*(f for f in mapping.optional if _get(record, f.path) is not None), *mapping.turns):
        if isinstance(t, Field):
            out.append({"role": t.role, "text": "\n\n".join(_text(_get(record, p)) for p in (t.path, *t.more) if _get(record, p) is not None)})
        else:
            names = dict(t.names)
            for x in _get(record, t.path):
                role = _text(_get(x, t.role))
                content = _get(x, t.text.split("[]")[0])
                out.append({"role": names.get(role, role), "text": _text(_get(x, t.text) if isinstance(content, list) else content)})
    return mapping.name, out


def turns_of_json(df: DataFrame, id: str, record: str) -> DataFrame:
    """(conv_id, layout, turns) for every record."""
    kind = df.schema[id].dataType
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [canonical(x) for x in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], arrow)], names=["conv_id", "layout", "turns"])

    return df.select(F.col(id).alias("conv_id"), F.col(record).cast("string").alias("record")).mapInArrow(run, f"conv_id {kind.simpleString()}, layout string, turns {TURNS}")


def turns_of_table(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with a row for each turn, by the layout that its schema's fingerprint
    selects; of other columns only the names that a layout knows count."""
    known = {c for layout in ROW_LAYOUTS.values() for c in layout}
    by_print = {fingerprint(layout): layout for layout in ROW_LAYOUTS.values()}
    layout = by_print.get(fingerprint(known.intersection(df.columns)))
    layout = layout or next((x for x in ROW_LAYOUTS.values() if set(x) <= set(df.columns)), None)
    if layout is None:
        raise ValueError(f"no known layout has the columns {sorted(df.columns)}")
    return df.select(*[F.col(a).alias(b) for a, b in zip(layout, ROW_LAYOUTS["rows"], strict=True)])


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _plain(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _plain_role(role: str) -> str:
    return _plain(role.replace("%0A", "\n").replace("%25", "%"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) for rows (conv_id, turn, role, text): the text of each turn, and
    the stretch of it under the loss mask in code points (empty but for the assistant's texts)."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), _escaped_role(role), F.lit("\n"))
    start = F.char_length(head)
    end = F.when(role == LOSS_ROLE, start + F.char_length(text)).otherwise(start)
    return turns.select("conv_id", "turn", F.concat(head, text, F.lit(f"{END}\n")).alias("segment"), start.alias("loss_start"), end.alias("loss_end"))


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    if m is None or END in m[2] or START in m[2]:
        raise ValueError(f"not a turn: {segment[:80]!r}")
    return _plain_role(m[1]), _plain(m[2])


class _Reader:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        role, text = parsed(segment)
        under = _plain(segment[start:end])
        self.turns += 1
        self.chars += len(segment)
        self.loss_chars += len(under)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(under.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each formatted conversation.

    Segments pass sorted through one task a conversation, which keeps running digests and no text, so that a
    conversation of any length takes no more memory than another."""
    kind = segments.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, segment, start, end in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.add(segment, start, end)
            if len(done) >= 10_000:
                yield _batch(done)
                done = []
        yield _batch([*done, now.row()] if now is not None else done)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    schema = T.StructType([T.StructField("conv_id", kind)] + [T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names[1:]])
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, schema)


def exploded(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of records (conv_id, layout, turns)."""
    return records.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
