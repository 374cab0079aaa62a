"""Word and shingle hashes of whole Arrow batches of texts, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the memory of a task whatever the size of Arrow's batches.
SLICE_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)

# Odd multipliers of the 64-bit mixing steps; any would do.
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S29, S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> S32)) * B
    h = (h ^ (h >> S29)) * C
    return h ^ (h >> S32)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch of about SLICE_BYTES with their bytes, end to end, and the offsets of the texts in them; null is empty."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z as a-z, in order, and the number of words of each text."""
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    per_text = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    number = np.cumsum(first) - 1
    place = (np.arange(len(data)) - starts[np.maximum(number, 0)]).astype(np.uint64)
    value = mix(LOWER[data] * A + place * C + B)
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts) + A), per_text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, ascending, end to end, and their number per text.

    A text of fewer than k words, but one, has its whole sequence as its only shingle.
    """
    words, per_text = word_hashes(data, offsets)
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    windows = max(0, len(words) - k + 1)
    h = np.full(windows, A)
    for j in range(k):
        h = mix(h * B + words[j : j + windows])
    same = text_of[:windows] == text_of[k - 1 : k - 1 + windows]
    h, owner = h[same], text_of[:windows][same]
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(per_text)])
        whole = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            x = np.array([per_text[t]], np.uint64)
            for w in words[at[t] : at[t + 1]]:
                x = mix(x * B + w)
            whole[i] = x[0]
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(per_text))
