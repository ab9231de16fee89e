"""Words and word hashes of whole Arrow batches, by numpy alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Words over so many bytes are hashed one by one, by blake2b.
LONG_WORD = 256
#: A random number for each byte at each place of a word: simple tabulation hashing, whose sums no arithmetic pattern of bytes can cancel.
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, LONG_WORD * 256, dtype=_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Bytes hashed at a time.
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of some texts: lower-cased bytes, byte places, first word of each text (and one past the last), hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    r"""Maximal runs of bytes outside ``[\x20\x09-\x0D]``, A-Z lower-cased; none goes over the end of a text."""
    low = _LOWER[data]
    n = len(low)
    solid = _SOLID[low]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    hashes = np.empty(len(starts), _U)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    at = 0
    while at < len(starts):  # in blocks, so that working arrays stay small whatever the length of a text
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        if to == at + 1 and ends[at] - starts[at] > LONG_WORD:
            at = to
            continue
        base, size = starts[at], int(min(ends[to - 1], starts[to - 1] + LONG_WORD) - starts[at])
        begin = starts[at:to] - base
        place = np.zeros(size, np.int32)
        place[begin] = begin
        np.maximum.accumulate(place, out=place)
        place = np.minimum(np.arange(size, dtype=np.int32) - place, LONG_WORD - 1)
        total = np.zeros(size + 1, _U)
        np.cumsum(_TABLE[place << 8 | low[base : base + size]], out=total[1:])
        end = np.minimum(ends[at:to] - base, size)
        hashes[at:to] = mix(total[end] - total[begin] + (end - begin).astype(_U))
        at = to
    for i in long:
        hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(low, starts, ends, np.searchsorted(starts, offsets), hashes)


def text_slices(col: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of parts of at most ``max_bytes``, or of one text; nulls are empty."""
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        to = min(to, len(col))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles_of(ws: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and where each text's begin. A text of 1 to k-1 words has one, of all its words."""
    n_words = np.diff(ws.first)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    # position of each shingle's first word
    at = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(ws.first[:-1], counts)
    length = np.repeat(np.minimum(n_words, k), counts)
    h = np.zeros(len(at), _U)
    last = max(len(ws.hashes) - 1, 0)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93)
        h += np.where(length > j, ws.hashes[np.minimum(at + j, last)] if len(at) else _U(0), _U(0))
    return mix(h + length.astype(_U)), first
