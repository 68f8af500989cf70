"""Tokens of whole Arrow columns at once: the same as text.code_tokens(), for operators that read every text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once.
SLICE = 4_000_000
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of a column of texts, one row at least."""
    if batch.num_rows:
        ends, at = _offsets(batch.column(column)), 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): of each token its text's place and its place in words, which are distinct. A null has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string())
    ends, held = _offsets(texts), texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    ends -= ends[0]
    inside = _ALNUM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = ends[:-1][ends[:-1] < len(data)]
    first[opens] = inside[opens]
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), ends)))
    kept = data[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(row), pa.py_buffer(starts), pa.py_buffer(kept)).dictionary_encode()
    code, words = runs.indices.to_numpy().astype(np.int64), pc.ascii_lower(runs.dictionary)
    mixed = np.flatnonzero(pc.match_substring_regex(runs.dictionary, "[a-z0-9][A-Z]").to_numpy(zero_copy_only=False))
    if len(mixed):
        parts = [re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", runs.dictionary[int(i)].as_py()).lower().split(" ") for i in mixed]
        n = np.zeros(len(words) + 1, np.int64)
        n[mixed + 1] = [len(p) for p in parts]
        begin, more = np.cumsum(n)[:-1], n[1:][code]
        within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        row, code = np.append(row, np.repeat(row, more)), np.append(code, len(words) + np.repeat(begin[code], more) + within)
        words = pa.concat_arrays([words, pa.array([p for own in parts for p in own], pa.string())])
    lower = words.dictionary_encode()
    return row, lower.indices.to_numpy().astype(np.int64)[code], lower.dictionary


def counted(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of each pair that occurs, codes being below n."""
    keys, count = np.unique(row * n + code, return_counts=True)
    return keys // max(n, 1), keys % max(n, 1), count
