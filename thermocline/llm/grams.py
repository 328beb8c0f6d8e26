"""Words and word runs of Arrow text columns as NumPy slices, and a table that interns them.

Words are maximal runs of ASCII letters, digits and non-ASCII characters; A-Z
become lower case, nothing else changes. All words of a batch lie in one buffer, each followed
by a blank, so a run of n consecutive words, joined by one blank, is a slice too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from thermocline.llm.common import LOWER

_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.array([chr(c).isdigit() or "a" <= chr(c) <= "z" or c >= 128 for c in range(256)])
_IN_WORD[128:] = True
PIECE_BYTES = 8 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows holding about ``PIECE_BYTES`` of text, at most ``rows`` of them; a longer text is a piece of its own."""
    held, size, count = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for at, length in enumerate(lengths.tolist()):
            if count and (size + length > PIECE_BYTES or count == rows):
                held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, size, count, start = [], 0, 0, at
            size, count = size + length, count + 1
        held.append(batch.slice(start))
    if count:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Words:
    """Words of several texts; ``count`` has the words of each text."""

    buffer: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(texts: pa.ChunkedArray) -> Words:
        whole = pc.fill_null(texts.cast(pa.large_string()), "").combine_chunks()
        if isinstance(whole, pa.ChunkedArray):
            whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.large_string())
        n = len(whole)
        _, offsets, data = whole.buffers()
        at = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        lower = _LOWER[raw]
        inside = _IN_WORD[lower]
        # a word starts where its text does, or behind a byte outside words
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = at[:-1][at[:-1] < len(raw)]
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        row = np.searchsorted(at, starts, side="right") - 1
        number = np.cumsum(begins)[inside] - 1
        size = np.bincount(number, minlength=len(starts)).astype(np.int64)
        place = np.cumsum(size + 1) - size - 1
        buffer = np.full(int((size + 1).sum()), 32, np.uint8)
        buffer[np.arange(len(number)) + number] = lower[inside]
        return Words(buffer, place, size, row, np.bincount(row, minlength=n).astype(np.int64))

    def runs(self, n: int) -> Words:
        """All runs of ``n`` consecutive words of a text, as slices of the same buffer."""
        if n == 1:
            return self
        last = np.arange(n - 1, len(self.row))
        first = last - (n - 1)
        whole = self.row[first] == self.row[last]
        first, last = first[whole], last[whole]
        size = self.start[last] + self.size[last] - self.start[first]
        row = self.row[first]
        return Words(self.buffer, self.start[first], size, row, np.bincount(row, minlength=len(self.count)).astype(np.int64))

    def part(self, at: slice) -> Words:
        return Words(self.buffer, self.start[at], self.size[at], self.row[at], self.count)

    def __len__(self) -> int:
        return len(self.start)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at these places as an Arrow column."""
        size = self.size[which]
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[which] - (ends - size), size)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.buffer[source]))


def _same_bytes(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = words.size[a] == words.size[b]
    check = np.flatnonzero(same & (a != b))
    if len(check):
        size = words.size[a[check]]
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        differs = (words.buffer[np.repeat(words.start[a[check]], size) + inside]
                   != words.buffer[np.repeat(words.start[b[check]], size) + inside])
        same[check] = ~np.logical_or.reduceat(differs, ends - size)
    return same


def keys_of(words: Words) -> np.ndarray:
    raw, digest = words.buffer.tobytes(), xxhash.xxh64_intdigest
    ends = (words.start + words.size).tolist()
    return np.fromiter((digest(raw[a:b]) for a, b in zip(words.start.tolist(), ends)), np.uint64, len(ends))


@dataclass(frozen=True)
class Interned:
    """An open-addressed table: ``owner`` has the first word of each slot in use, ``slot`` the slot of each word."""

    slot: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(words: Words) -> Interned:
        """Insert all words at once, with linear probing: words that meet in a slot compare keys, then bytes."""
        keys = keys_of(words)
        capacity = 1 << (2 * len(words) + 15).bit_length()
        owner = np.full(capacity, -1, np.int64)
        at = (keys & np.uint64(capacity - 1)).astype(np.int64)
        waiting = np.arange(len(words))
        while len(waiting):
            here = at[waiting]
            free = owner[here] < 0
            owner[here[free][::-1]] = waiting[free][::-1]  # the first that asks keeps the slot
            holder = owner[here]
            same = keys[holder] == keys[waiting]
            same[same] = _same_bytes(words, waiting[same], holder[same])
            waiting = waiting[~same]
            at[waiting] = (at[waiting] + 1) & (capacity - 1)
        return Interned(at, owner)

    def used(self) -> np.ndarray:
        return np.flatnonzero(self.owner >= 0)
