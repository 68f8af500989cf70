"""Secret scans: patterns, and a linear-chain conditional random field that finds what patterns miss.

Tokens are runs without white space, tagged B (a secret begins), I (goes on) or O (outside). A token's score for a tag
sums weights of hashed features: its own shape, length, kinds of characters, spread of characters and first letters;
its neighbours' words and shapes; and features of the file (shares of digits and signs). Tags follow by Viterbi over
those scores and the transitions. A token whose O outweighs B and I by more than any transitions can return is O on
every best path; only the stretches between such tokens need the recursion, so long texts cost little more than a look
at each token.

Runs of more than LONG characters, such as minified code, are cut after quotes, commas, brackets and the like, and each
part is a token of its own, so features always speak of the whole of a token.

The field is fitted in one task, on windows from at most SAMPLE documents, the first by a hash of their id (the
bound is the parameter sample): windows around what the patterns find, windows without, and the latter with invented
keys written into them. Every document is scanned, by its whole text.

The patterns' spans always stay; of the field's spans what no pattern covers, if it holds a letter or a digit.

Null text counts as empty: no spans. Rows are independent, so repeated ids are no matter. Other columns stay."""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.arrow import extended, lean, slices

SAMPLE = 20_000
BUCKETS = 1 << 15
AROUND, PER_KIND, STEPS, RATE, PENALTY = 12, 600, 60, 0.1, 1e-4
MEMO_TOKENS = 250_000
OUT, BEGIN, INSIDE = 0, 1, 2
#: Characters that a span of the field has at least, as the patterns ask for too.
LEAST = 12
#: Characters from which on a run without white space is cut at separators.
LONG = 64

#: The patterns, each with the least length of what counts (fixed values of the contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
_HEX_MARKS = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))

SPANS = "array<struct<kind: string, start: int, end: int>>"
_MARKS = ".,;:!?()[]{}<>*#%&$|\"'-\u2026\u00ab\u00bb"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by start, then kind as listed."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in text.encode().translate(_HEX_MARKS):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_PARTS = re.compile(r"""[^"'`,;&?|(){}\[\]<>]*["'`,;&?|(){}\[\]<>]*""")


def tokens_of(text: str) -> list[str]:
    """The tokens of a text: its runs without white space, long ones in parts."""
    runs = text.split()
    if len(text) < LONG or max(map(len, runs), default=0) <= LONG:
        return runs
    return [t for run in runs for t in ([run] if len(run) <= LONG else filter(None, _PARTS.findall(run)))]


def places_of(text: str) -> list[tuple[int, int]]:
    """Where those tokens start and end."""
    out = []
    for m in re.finditer(r"\S+", text):
        if m.end() - m.start() <= LONG:
            out.append(m.span())
        else:
            out += [(m.start() + p.start(), m.start() + p.end()) for p in _PARTS.finditer(m[0]) if p[0]]
    return out


def _shape(token: str) -> str:
    """Kinds of characters, each run of one kind as one letter; of many runs the first and the last."""
    out = []
    for c in token:
        k = "d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "=:_-+/.\"'" else "s"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out if len(out) <= 12 else out[:9] + out[-3:])


def _own(token: str) -> list[str]:
    word = token.strip(_MARKS)
    if word.isalpha() and (word.islower() or word.istitle() or word.isupper()):
        return ["plain", f"plain{min(len(word), 60) // 10}"]
    digits, upper = sum(map(str.isdigit, token)), sum(map(str.isupper, token))
    letters = sum(map(str.isalpha, token))
    spread = min(1.0, len(set(token)) / max(1, min(len(token), 64)))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return [
        f"shape={_shape(token)}", f"n{min(len(token), 80) // 4}", f"digits{min(4, 5 * digits // len(token))}", f"upper{min(4, 5 * upper // len(token))}", f"signs{min(4, 5 * (len(token) - digits - letters) // len(token))}",
        f"spread{int(5 * spread)}", f"turns{min(turns, 9)}", f"turns{min(turns, 9)}n{min(len(token), 80) // 8}", f"first={token[:3]}", "key" if ("=" in token or ":" in token) else "nokey", _word(token) if letters == len(token) else "noword",
    ]


def _word(token: str) -> str:
    return f"word={token.lower()[:24]}"


def _beside(token: str) -> list[str]:
    plain = token.strip(_MARKS).isalpha()
    return [_word(token) if plain or len(token) <= 3 else "noword", "plain" if plain else f"shape={_shape(token)}", "ends" + (token[-1:] if token[-1:] in "=:\"'" else "")]


def file_features(text: str) -> list[str]:
    raw = text.encode()
    n = max(1, len(raw))
    digits, signs = (len(raw) - len(raw.translate(None, own)) for own in (b"0123456789", b"=:_/\"'{}"))
    return [f"file-digits{min(6, 100 * digits // n)}", f"file-signs{min(6, 100 * signs // n)}"]


def _ids(prefix: str, features: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest((prefix + f).encode()) % BUCKETS for f in features]


@dataclass
class Field:
    weights: np.ndarray  # BUCKETS x 3
    moves: np.ndarray  # 3 x 3
    words: frozenset = frozenset()  # the word features seen in training; others have no weight

    def margin(self) -> float:
        """What a path can gain by its transitions at most from having one token other than O."""
        return 2 * float(self.moves.max() - self.moves.min())


def viterbi(score: np.ndarray, moves: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
    """The best tags for scores (n x 3), between given tags if there are any."""
    best = score[0] + (moves[before] if before is not None else 0)
    back = np.zeros(score.shape, dtype=np.int8)
    for i in range(1, len(score)):
        ways = best[:, None] + moves
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + score[i]
    if after is not None:
        best = best + moves[:, after]
    tags = np.empty(len(score), dtype=np.int8)
    tags[-1] = best.argmax()
    for i in range(len(score) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


class _Rows(dict):
    """The row of each token: what tokens of the same features add to scores."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, token: str) -> int:
        row = self[token] = self.tagger.row(token)
        return row


class Tagger:
    """A field with a memo of what each token adds to its own scores and to those of its neighbours. Tokens of the same
    features share a row; words that training has not seen have no weight of their own, so prose needs few rows."""

    def __init__(self, field: Field, most: int = MEMO_TOKENS):
        self.field, self.most, self.files = field, most, {}
        self._fresh()

    def _fresh(self) -> None:
        self.of: dict[tuple, int] = {}
        self.parts = np.zeros((1024, 3, 3), dtype=np.float64)  # own, as the one before, as the one after
        self.at = _Rows(self)
        self._add((), ("edge",))

    def row(self, token: str) -> int:
        seen = self.field.words
        known = lambda features: tuple(f for f in features if not f.startswith("word=") or f in seen)
        word = token.strip(_MARKS)
        if word.isalpha() and (word.islower() or word.istitle() or word.isupper()) and _word(token) not in seen:
            last = token[-1] if token[-1] in "=:\"'" else ""
            key = (len(word) if len(word) < 60 else 60) // 10, last
            if (row := self.of.get(key)) is None:
                row = self.of[key] = self._add(known(_own(token)), known(_beside(token)))
            return row
        key = known(_own(token)), known(_beside(token))
        if (row := self.of.get(key)) is None:
            row = self.of[key] = self._add(*key)
        return row

    def _add(self, own: tuple, beside: tuple) -> int:
        i = len(self.of) + (0 if not own else 1)
        if i >= len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        w = self.field.weights
        self.parts[i, 0] = w[_ids("", list(own))].sum(axis=0) if own else 0
        self.parts[i, 1] = w[_ids("<", list(beside))].sum(axis=0)
        self.parts[i, 2] = w[_ids(">", list(beside))].sum(axis=0)
        return i

    def scores(self, tokens: list[str], file: list[str]) -> np.ndarray:
        if len(self.at) and len(self.at) + len(tokens) > self.most:
            self._fresh()
        ids = np.fromiter(map(self.at.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        p, key = self.parts, tuple(file)
        if (bias := self.files.get(key)) is None:
            bias = self.files[key] = self.field.weights[_ids("", file)].sum(axis=0)
        out = p[ids, 0] + bias
        out[1:] += p[ids[:-1], 1]
        out[0] += p[0, 1]
        out[:-1] += p[ids[1:], 2]
        out[-1] += p[0, 2]
        return out

    def tags(self, tokens: list[str], file: list[str]) -> np.ndarray:
        """The best path, found stretch by stretch between tokens that are O on every best path."""
        tags = np.zeros(len(tokens), dtype=np.int8)
        if not tokens:
            return tags
        score = self.scores(tokens, file)
        open_at = np.flatnonzero(score[:, 1:].max(axis=1) - score[:, 0] > -self.field.margin())
        if len(open_at):
            for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
                i, j = int(run[0]), int(run[-1]) + 1
                tags[i:j] = viterbi(score[i:j], self.field.moves, OUT if i else None, OUT if j < len(tokens) else None)
        return tags

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of tokens tagged B and I, of LEAST characters at least."""
        tags = self.tags(tokens_of(text), file_features(text))
        if not tags.any():
            return []
        out, places = [], places_of(text)
        for k in np.flatnonzero(tags).tolist():
            start, end = places[k]
            if tags[k] == INSIDE and k and tags[k - 1] != OUT:
                out[-1] = ("crf", out[-1][1], end)
            else:
                out.append(("crf", start, end))
        return [s for s in out if s[2] - s[1] >= LEAST]

    def all_spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """The patterns' spans, and of the field's what they leave uncovered, by start, then kind as listed."""
        if not text:
            return []
        base = base_spans(text)
        more = [s for s in uncovered(self.spans(text), base) if any(map(str.isalnum, text[s[1] : s[2]]))]
        return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def uncovered(spans: list[tuple[str, int, int]], by: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts of spans that no span of by covers; both are sorted by start, and one sweep goes over both."""
    merged: list[list[int]] = []
    for _, start, end in by:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, k = [], 0
    for kind, start, end in spans:
        while k < len(merged) and merged[k][1] <= start:
            k += 1
        i = k
        while i < len(merged) and merged[i][0] < end:
            if start < merged[i][0]:
                out.append((kind, start, merged[i][0]))
            start = max(start, merged[i][1])
            i += 1
        if start < end:
            out.append((kind, start, end))
    return out


def tagged(text: str) -> tuple[list[str], list[int]]:
    """The tokens of a text, and their tags by the patterns."""
    tokens, tags, spans, k = [], [], base_spans(text), 0
    ends = np.maximum.accumulate([e for _, _, e in spans]).tolist() if spans else []
    for start, end in places_of(text):
        tokens.append(text[start:end])
        while k < len(spans) and ends[k] <= start:
            k += 1
        own = k < len(spans) and spans[k][1] < end
        tags.append(OUT if not own else INSIDE if spans[k][1] < start else BEGIN)
    return tokens, tags


_KEYS = ("password", "passwort", "pwd", "auth", "bearer", "credential", "client_secret", "access-key", "private_key", "apikey", "sk", "key")
_LETTERS = string.ascii_letters + string.digits


def _invented(rng: np.random.Generator) -> list[str]:
    """The tokens of a made-up secret in one of several layouts."""
    letters = (_LETTERS, _LETTERS + "+/", string.digits + "abcdef", string.ascii_uppercase + string.digits)[rng.integers(4)]
    value = "".join(rng.choice(list(letters), int(rng.integers(20, 48))))
    key = _KEYS[rng.integers(len(_KEYS))]
    quote = ("", '"', "'")[rng.integers(3)]
    return ([f"{key}={quote}{value}{quote}"], [key, "=", f"{quote}{value}{quote}"], [f"{key}:", f"{quote}{value}{quote}"], [f"{key}_live_{value}"], [value])[rng.integers(5)]


def _ordinary(rng: np.random.Generator) -> list[str]:
    """A token that looks unlike prose and is no secret: an address, a path, a number, a date, a version, a code."""
    word = lambda: "".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(2, 9))))
    number = lambda n: "".join(rng.choice(list(string.digits), n))
    kind = int(rng.integers(9))
    if kind == 0:
        return [f"{word()}.{word()}{number(int(rng.integers(3)))}@{word()}.{('com', 'org', 'net')[rng.integers(3)]}"]
    if kind == 1:
        return [f"https://{('www.', '')[rng.integers(2)]}{word()}.com/{word()}/{word()}-{word()}{('.html', '?id=' + number(4), '')[rng.integers(3)]}"]
    if kind == 2:
        return [f"+{number(1)}", f"({number(3)})", f"{number(3)}-{number(4)}"]
    if kind == 3:
        return [number(int(rng.integers(1, 17)))]
    if kind == 4:
        return [f"{number(4)}-{number(2)}-{number(2)}"]
    if kind == 5:
        return [".".join(number(int(rng.integers(1, 4))) for _ in range(int(rng.integers(2, 5))))]
    if kind == 6:
        return [f"/{word()}/{word()}/{word()}.{word()[:3]}"]
    if kind == 7:
        return [f"{word()[:3].upper()}-{word()[:3].upper()}{('', number(2))[rng.integers(2)]}"]
    return [f"{word().upper()}{word()}", f"{word()}_{word()}"]


def fit(windows: list[tuple[list[str], list[int], list[str]]]) -> Field:
    """windows: tokens, tags and file features. Maximises the conditional likelihood, by full gradients."""
    if not windows:
        return Field(np.zeros((BUCKETS, 3)), np.zeros((3, 3)))
    n, longest = len(windows), max(len(t) for t, _, _ in windows)
    feature, place = array("i"), array("i")
    gold = np.zeros((n, longest), dtype=np.int64)
    there = np.zeros((n, longest), dtype=bool)
    for k, (tokens, tags, file) in enumerate(windows):
        gold[k, : len(tags)], there[k, : len(tags)] = tags, True
        of_file = _ids("", file)
        for i, token in enumerate(tokens):
            own = _ids("", _own(token)) + of_file
            own += _ids("<", _beside(tokens[i - 1]) if i else ["edge"])
            own += _ids(">", _beside(tokens[i + 1]) if i + 1 < len(tokens) else ["edge"])
            feature.extend(own)
            place.extend([k * longest + i] * len(own))
    feature, place = np.frombuffer(feature, dtype=np.int32), np.frombuffer(place, dtype=np.int32)
    w, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    total = there.sum()
    wanted = np.stack([np.bincount(feature, weights=((gold.ravel() == t) & there.ravel())[place], minlength=BUCKETS) for t in range(3)], axis=1)
    step_there = there[:, 1:]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:, :-1][step_there], gold[:, 1:][step_there]), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(place, weights=w[feature, t], minlength=n * longest) for t in range(3)], axis=1).reshape(n, longest, 3)
        score[~there] = 0
        ahead = np.zeros((n, longest, 3))
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            a = ahead[:, i - 1, :, None] + moves[None]
            top = a.max(axis=1)
            ahead[:, i] = np.where(there[:, i, None], score[:, i] + top + np.log(np.exp(a - top[:, None]).sum(axis=1)), ahead[:, i - 1])
        behind = np.zeros((n, longest, 3))
        expected_pairs = np.zeros((3, 3))
        z = ahead[:, -1]
        z = z.max(axis=1) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
        for i in range(longest - 2, -1, -1):
            b = moves[None] + (score[:, i + 1] + behind[:, i + 1])[:, None]
            top = b.max(axis=2)
            behind[:, i] = np.where(there[:, i + 1, None], top + np.log(np.exp(b - top[..., None]).sum(axis=2)), 0)
            both = np.exp(np.minimum(ahead[:, i, :, None] + b - z[:, None, None], 0))
            expected_pairs += (both * there[:, i + 1, None, None]).sum(axis=0)
        chance = np.exp(np.minimum(ahead + behind - z[:, None, None], 0)) * there[..., None]
        expected = np.stack([np.bincount(feature, weights=chance.reshape(-1, 3)[place, t], minlength=BUCKETS) for t in range(3)], axis=1)
        for x, g, m, v in ((w, (expected - wanted) / total + PENALTY * w, *state[:2]), (moves, (expected_pairs - pairs) / total + PENALTY * moves, *state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    words = {_word(t) for tokens, _, _ in windows for t in tokens}
    return Field(w, moves, frozenset(words))


def train(df: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit on windows from the first sample rows by a hash of their id: up to PER_KIND around what the patterns find, twice as
    many without it, and those once more with an invented secret and with an invented token that is none. A document gives one window at most."""
    chosen = F.broadcast(df.select(F.col(id).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample))
    some = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                tokens, tags = tagged(text)
                if not tokens:
                    continue
                place = xxhash.xxh3_64_intdigest(text.encode())
                if hit := [i for i, t in enumerate(tags) if t == BEGIN]:
                    at = hit[place % len(hit)]
                elif place % 4 > 1:
                    continue  # texts without are many; their share of the sample is enough
                elif place % 4:
                    at = max(range(len(tokens)), key=lambda k: len(tokens[k]))  # what most looks like a secret and is none
                else:
                    at = place // 4 % len(tokens)
                i, j = max(0, at - AROUND), at + AROUND
                out.append((place % (1 << 62), bool(hit), tokens[i:j], tags[i:j], file_features(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["place", "hit", "tokens", "tags", "file"])

    found = some.mapInArrow(lean(run), "place long, hit boolean, tokens array<string>, tags array<int>, file array<string>")
    found = found.groupBy("hit", "place").agg(*[F.min(c).alias(c) for c in ("tokens", "tags", "file")])
    some = found.where("hit").orderBy("place", "tokens").limit(PER_KIND).unionByName(found.where("NOT hit").orderBy("place", "tokens").limit(2 * PER_KIND))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, none = [], []
        for batch in batches:
            for hit, *window in zip(*[batch.column(n).to_pylist() for n in ("hit", "tokens", "tags", "file")], strict=True):
                (own if hit else none).append(tuple(window))
        made = fit(own + none + _written_into(none[:PER_KIND]))
        yield pa.RecordBatch.from_arrays([pa.array([made.weights.tobytes()]), pa.array([made.moves.tobytes()]), pa.array([sorted(made.words)], pa.list_(pa.string()))], names=["weights", "moves", "words"])

    one = some.repartition(1).sortWithinPartitions("hit", "place", "tokens")  # at most 3 * PER_KIND rows
    got = one.mapInArrow(lean(fitted), "weights binary, moves binary, words array<string>").collect()
    if not got:  # no partition, so no row
        return fit([])
    weights, moves = (np.frombuffer(bytes(got[0][n]), dtype=np.float64).reshape(-1, 3) for n in ("weights", "moves"))
    return Field(weights, moves, frozenset(got[0]["words"]))


def _written_into(windows: list[tuple]) -> list[tuple]:
    """Each window once with an invented secret, and once with an invented token that is none."""
    rng, out = np.random.default_rng(11), []
    for tokens, tags, file in windows:
        at, secret = int(rng.integers(len(tokens) + 1)), _invented(rng)
        out.append((tokens[:at] + secret + tokens[at:], tags[:at] + [BEGIN] + [INSIDE] * (len(secret) - 1) + tags[at:], file))
        other = _ordinary(rng)
        out.append((tokens[:at] + other + tokens[at:], tags[:at] + [OUT] * len(other) + tags[at:], file))
    return out


def scan(df: DataFrame, field: Field, text: str = "text", spans: str = "secret_spans", redacted: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """df with its spans (kind, start, end in code points, end exclusive) and, if redacted names a column, the text
    with every span replaced by the mask; redacted may be the text's own column."""
    df = df.drop(spans) if redacted is None or redacted == text else df.drop(spans, redacted)
    schema = T.StructType(list(df.schema.fields))
    if redacted is not None and redacted != text:
        schema.add(redacted, T.StringType())
    names = [f.name for f in schema.fields]
    schema.add(spans, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(text).to_pylist()
                found = [tagger.all_spans(x) for x in texts]
                columns = {n: batch.column(n) for n in batch.schema.names}
                if redacted is not None:
                    columns[redacted] = pa.array([redact(x, s, mask) for x, s in zip(texts, found, strict=True)], pa.string())
                columns[spans] = pa.array([[{"kind": k, "start": b, "end": e} for k, b, e in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([columns[n] for n in [*names, spans]], names=[*names, spans])

    return df.mapInArrow(lean(run), schema)


def redact(text: str | None, spans: list[tuple[str, int, int]], mask: str) -> str | None:
    """The text with each stretch that spans cover replaced by the mask."""
    if not text or not spans:
        return text
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])
