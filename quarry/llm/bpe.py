"""Byte-level BPE: encoding by forced-boundary splitting, and decoding.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a text may be cut
between such bytes; the fragments are encoded independently and their ids concatenated, with the same result.
Pieces (what the pre-tokenizer's pattern yields) are cut at these boundaries, so that a piece of any length, such as
a line without spaces, falls into short fragments. Fragments' ids are kept in a bounded memo per Python worker.

Null text counts as the empty text: no ids, decoded as the empty text. Strings of added tokens inside a text become
those tokens, as the library does by default."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.arrow import Memo, extended, lean, slices

#: Pieces whose ids a worker remembers; past this the memo starts anew.
MEMO_PIECES = 300_000

#: The pre-tokenizer's pattern of byte-level BPE files with use_regex (fixed value, as published with the vocabulary).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a text that are cut into pieces at once; and how far beyond its end a piece may depend on what follows (a
#: contraction is told by three characters, white space by the next).
AHEAD, SIGHT = 512, 3

#: Characters whose letter, number and space classes have long been settled in all Unicode versions; a text with
#: others is cut by the tokenizer library itself, whose Unicode tables may be of another version.
UNSETTLED = regex.compile(r"[^\u0000-\u0557\u2000-\u206f\u20a0-\ua48c\uac00-\ud7a3]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from
    U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        byte_of = byte_letters()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [ranks[bytes(byte_of[c] for c in a + b)] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.bytes_of = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        #: Pairs of neighbouring bytes that some token holds, and the same as a table for long pieces.
        self.pairs = {pair for token in ranks for pair in zip(token, token[1:], strict=False)}
        self.inside = np.zeros((256, 256), dtype=bool)
        self.inside[tuple(np.array(sorted(self.pairs)).T)] = True
        self._merge = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._pieces = regex.compile(PIECE)
        self._text = text
        self._slow = None
        self._memo = Memo(self._piece, MEMO_PIECES)

    def fragments(self, raw: bytes) -> list[bytes]:
        """raw, cut at every forced boundary."""
        if len(raw) < 64 and self.pairs.issuperset(zip(raw, raw[1:], strict=False)):
            return [raw]
        b = np.frombuffer(raw, dtype=np.uint8)
        cuts = np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1
        edges = [0, *cuts.tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def _piece(self, piece: str) -> bytes:
        return b"".join(array("i", self._merge(fragment)).tobytes() for fragment in self.fragments(piece.encode()))

    def _library(self, text: str) -> list[tuple[int, int]]:
        """Where pieces start and end, by the tokenizer library."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._text).pre_tokenizer
        return [place for _, place in self._slow.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """What the pre-tokenizer makes of a text without added tokens."""
        if text.isascii() or not UNSETTLED.search(text):
            return self._pieces.findall(text)
        return [text[i:j] for i, j in self._library(text)]

    def scan(self, text: str, at: int = 0) -> Iterator[tuple[int, int]]:
        """Where pieces and added tokens start and end, one after the other from a place between two; as little of the
        text is looked at as the caller takes, whatever its script."""
        while at < len(text):
            places = [(k, -len(x)) for x in self.added if (k := text.find(x, at)) >= 0]
            stop, size = min(places, default=(len(text), 0))  # the first, and there the longest
            yield from self._stretch(text, at, stop)
            if size:
                yield stop, stop - size
            at = stop - size

    def _stretch(self, text: str, at: int, stop: int) -> Iterator[tuple[int, int]]:
        size = AHEAD
        while at < stop:
            part = text[at : min(stop, at + size)]
            # where the part ends within the text, only pieces stay that no character beyond it can change
            sure, begin = len(part) if at + size >= stop else len(part) - SIGHT, at
            settled = part.isascii() or not UNSETTLED.search(part)
            for i, j in (m.span() for m in self._pieces.finditer(part)) if settled else self._library(part):
                if j > sure:
                    break
                at = begin + j
                yield begin + i, at
            size = AHEAD if at > begin else 4 * size

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian int32."""
        if not text:
            return b""
        parts = self._added.split(text) if self._added and any(x in text for x in self.added) else [text]
        return b"".join(
            np.array([self.added[part]], dtype=np.int32).tobytes() if k % 2 else b"".join(map(self._memo.__getitem__, self.pieces(part)))
            for k, part in enumerate(parts)
        )

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


def _id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>) and, if decoded names one, a column of the text decoded from them.
    df's other columns stay; a column of the same name as a new one is replaced."""
    df = df.drop(ids, *([decoded] if decoded else []))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for batch in slices(whole, text):
                encoded = [c.encode(x) for x in batch.column(text).to_pylist()]
                new = {ids: _id_lists(encoded)}
                if decoded:
                    new[decoded] = pa.array([c.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in encoded], pa.string())
                yield extended(batch, new)

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with a column of the text its ids stand for. A null list is the empty text."""
    df = df.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            yield extended(batch, {decoded: pa.array([c.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))


def digest(ids: str) -> F.Column:
    """Lowercase hex SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
