"""Edit-aware token counts.

A document is kept with a segment tree over its pre-tokens: leaves of about LEAF characters, whole pre-tokens each,
and above them sums of characters and of tokens, in heap order. An edit finds its leaf by the sums of characters,
goes left until a whole pre-token that is no white space lies before the edit (nothing further left can see past it),
and cuts the new text into pre-tokens from there until a boundary meets that of an old leaf beyond the edit; pre-tokens
never look back, so all that follows stays as it was. Only this stretch is encoded anew, and only sums above its leaves
change. If it needs more leaves than it had, the tree is built again from its leaves, without encoding anything else.

Added tokens' strings are pieces like others; as an edit may complete one that begins before it, the stretch starts as
many characters further left as the longest of them has. This holds for every script.

Null text is the empty text. An edit's start and length are clamped to the text; null ones are 0, null insertions
empty. A null or empty list of edits changes nothing. Rows are independent. Other columns stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.arrow import extended, slices
from quarry.llm.bpe import SIGHT, Coder, coder

LEAF = 256
EDITS = "array<struct<start: int, deleted: int, inserted: string>>"


def _heap(leaves: list[int], width: int) -> np.ndarray:
    heap = np.zeros(2 * width, dtype=np.int64)
    heap[width : width + len(leaves)] = leaves
    level = width
    while level > 1:
        heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
        level //= 2
    return heap


class Document:
    """A text, the sums of its segment tree, and how many characters have been encoded."""

    def __init__(self, c: Coder, text: str, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.c, self.text, self.encoded = c, text, 0
        if chars is None:
            self._build(self._leaves(self._pieces(text)))
            self.encoded = len(text)
        else:
            self.chars, self.tokens = chars, tokens

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def _count(self, piece: str) -> int:
        return 1 if piece in self.c.added else len(self.c._memo[piece]) // 4

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """Characters and tokens of each pre-token and added token."""
        if not any(x in text for x in self.c.added):
            return [(len(p), self._count(p)) for p in self.c.pieces(text)]
        return [(j - i, self._count(text[i:j])) for i, j in self.c.scan(text)]

    def _leaves(self, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, chars, tokens = [], 0, 0
        for a, b in pieces:
            chars, tokens = chars + a, tokens + b
            if chars >= LEAF:
                out.append((chars, tokens))
                chars = tokens = 0
        return [*out, (chars, tokens)] if chars or not out else out

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        width = 1 << max(1, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = _heap([a for a, _ in leaves], width), _heap([b for _, b in leaves], width)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last leaf with characters if there is none."""
        width, node, start = len(self.chars) // 2, 1, 0
        place = min(place, max(0, int(self.chars[1]) - 1))
        while node < width:
            node *= 2
            if place - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + len(self.chars) // 2
        more, other = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += other
            node //= 2

    def _stands(self, text: str, begin: int, end: int) -> bool:
        """Whether a whole pre-token that is no white space lies between."""
        for i, j in self.c.scan(text, begin):
            if j > end:
                return False
            if not text[i:j].isspace():
                return True
        return False

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        old = self.text
        start = min(max(0, start), len(old))
        deleted = min(max(0, deleted), len(old) - start)
        new = old[:start] + inserted + old[start + deleted :]
        if not (old and new):
            self.text = new
            self._build(self._leaves(self._pieces(new)))
            self.encoded += len(new)
            return
        width = len(self.chars) // 2
        reach = max([SIGHT, *map(len, self.c.added)])
        first, begin = self._find(start - 1 if start else 0)
        while begin and not (begin + reach <= start and self._stands(old, begin, start)):
            first, begin = self._find(begin - 1)
        last, end = self._find(start + deleted)
        end += int(self.chars[width + last])
        shift, pieces = len(inserted) - deleted, []
        for i, j in self.c.scan(new, begin):
            pieces.append((j - i, self._count(new[i:j])))
            at = j - shift
            while at > end and end < len(old):
                last += 1
                end += int(self.chars[width + last])
            if at == end and j >= start + len(inserted):
                break
        self.text = new
        self.encoded += sum(a for a, _ in pieces)
        leaves, room = self._leaves(pieces), last + 1 - first
        if len(leaves) <= room:
            for k in range(room):
                self._set(first + k, *(leaves[k] if k < len(leaves) else (0, 0)))
        else:
            pairs = list(zip(self.chars[width:].tolist(), self.tokens[width:].tolist(), strict=True))
            self._build([x for x in pairs[:first] + leaves + pairs[last + 1 :] if x[0]])


def _sums(heaps: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, heaps)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heaps) if heaps else np.empty(0, dtype=np.int64)))


_TREE = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("char_sums", "token_sums")]


def build(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with char_sums and token_sums, the segment trees of its texts; element 1 (from 0) of token_sums is the count."""
    df = df.drop("char_sums", "token_sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for batch in slices(whole, text):
                docs = [Document(c, x or "") for x in batch.column(text).to_pylist()]
                yield extended(batch, {"char_sums": _sums([d.chars for d in docs]), "token_sums": _sums([d.tokens for d in docs])})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *_TREE]))


def n_tokens(sums: str = "token_sums"):
    return F.element_at(sums, 2)


def apply_edits(trees: DataFrame, path: str, edits: str = "edits", text: str = "text", encoded: str = "encoded_chars") -> DataFrame:
    """trees (of build(), with a list of edits in each row, applied in order) with new texts and sums, without the
    edits; and a column of how many characters were encoded."""
    kept = [f for f in trees.schema.fields if f.name not in (edits, encoded)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for batch in slices(whole, text):
                docs = []
                for x, chars, tokens, own in zip(*[batch.column(n) for n in (text, "char_sums", "token_sums", edits)], strict=True):
                    d = Document(c, x.as_py() or "", chars.values.to_numpy().copy(), tokens.values.to_numpy().copy())
                    for e in own.as_py() or []:
                        if e:
                            d.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    docs.append(d)
                columns = {n: batch.column(n) for n in names}
                columns |= {text: pa.array([d.text for d in docs], pa.string()), "char_sums": _sums([d.chars for d in docs]), "token_sums": _sums([d.tokens for d in docs])}
                yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), pa.array([d.encoded for d in docs], pa.int64())], names=[*names, encoded])

    return trees.mapInArrow(run, T.StructType([*kept, T.StructField(encoded, T.LongType())]))


def with_edits(trees: DataFrame, edits: DataFrame, id: str = "doc_id", order: str = "seq") -> DataFrame:
    """trees with the edits (id, order, start, deleted, inserted) of each document as a list in order. A document's
    edits go to the task that holds its text, as they act on one another."""
    listed = edits.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(order, "start", "deleted", "inserted"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["deleted"].cast("int").alias("deleted"), e["inserted"].alias("inserted"))))
    return trees.drop("edits").join(listed, id, "left")
