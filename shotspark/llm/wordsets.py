"""Word and shingle hashes of whole texts, vectorised over Arrow buffers.

A word is a run of bytes other than ASCII white space, with A-Z lowered.  Its
64-bit hash is a polynomial over random byte codes, taken from prefix sums, so
a batch of texts costs a few numpy passes and no Python string.  Shingles are
five consecutive words, or the whole sequence where there are fewer.

64-bit hashes stand for words and shingles: among the few thousand shingles of
a pair of documents the chance that two differ and share a hash is below 1e-11.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_WINDOW = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RAW = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE = _RAW[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_FACTOR = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _WINDOW:
        n = _WINDOW
    if n not in _powers:
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, _UNBASE, np.uint64)
        down[0] = 1
        pair = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > _WINDOW:
            return pair  # a word longer than a window: used once
        _powers[n] = pair
    return _powers[n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def windows(data: np.ndarray, offsets: np.ndarray, space: np.ndarray):
    """Pieces of at most about _WINDOW bytes that no word runs across.

    Yields (at, start, stop, total, down): the piece begins at byte ``at``; its
    words are [start, stop) within it; the polynomial hash of bytes [i, j) of
    the piece is (total(j) - total(i)) * down[i], where ``total`` maps a table of
    byte codes to prefix sums."""
    n = len(data)
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True  # words end where texts end
    at = 0
    while at < n:
        end = min(at + _WINDOW, n)
        while end < n:  # cut the window where no word runs on
            tail = np.flatnonzero(space[data[at:end]])
            edge = np.flatnonzero(cuts[at + 1:end + 1])
            best = max(at + int(tail[-1]) if len(tail) else at, at + 1 + int(edge[-1]) if len(edge) else at)
            if best > at:
                end = best
                break
            end = min(at + 2 * (end - at), n)
        part = data[at:end]
        blank, brk = space[part], cuts[at:end]
        before = np.empty(end - at, bool)
        before[0] = True
        before[1:] = blank[:-1]
        before |= brk
        after = np.empty(end - at, bool)
        after[-1] = True
        after[:-1] = blank[1:] | brk[1:]
        up, down = _power_tables(end - at)

        def total(code, part=part, up=up):
            out = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(code[part] * up[:len(part)], out=out[1:], dtype=np.uint64)
            return out

        yield at, np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1, total, down
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text."""
    hashes, firsts = [], []
    for at, start, stop, total, down in windows(data, offsets, _SPACE):
        sums = total(_CODE)
        hashes.append(mix64((sums[stop] - sums[start]) * down[start]))
        firsts.append(start + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    f = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return h, np.searchsorted(f, offsets)


#: Bytes that are no letters: ASCII without A-Z and a-z.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = True
NO_LETTER[65:91] = NO_LETTER[97:123] = False


def letter_hashes(data: np.ndarray, offsets: np.ndarray, prefixes=()):
    """Words of letters (A-Z lowered, every byte above 127 a letter), piece by
    piece: (text number, [hash of the whole word, hash of each prefix length
    or 0 where the word is not longer])."""
    for at, start, stop, total, down in windows(data, offsets, NO_LETTER):
        sums, back = total(_CODE), down[start]
        out = [mix64((sums[stop] - sums[start]) * back)]
        for size in prefixes:
            end = np.minimum(start + size, stop)
            h = mix64((sums[end] - sums[start]) * back + np.uint64(size))
            out.append(np.where(stop - start > size, h, np.uint64(0)))
        yield np.searchsorted(offsets, start + at, "right") - 1, out


def shingle_sets(column: pa.Array, budget: int = 1 << 22):
    """For each text of a string column: its sorted distinct shingle hashes."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + budget, "right")) - 1)
        words, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        n = len(words)
        if n >= SHINGLE:
            flat = np.zeros(n - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                flat += words[k:n - SHINGLE + 1 + k] * _FACTOR[k]
            flat = mix64(flat)
        for k in range(b - a):
            i, j = int(first[k]), int(first[k + 1])
            if j - i >= SHINGLE:
                yield np.unique(flat[i:j - SHINGLE + 1])
            elif j > i:  # the whole sequence, told apart by its length
                s = np.uint64(j - i)
                yield mix64(((words[i:j] * _FACTOR[:j - i]).sum(dtype=np.uint64) ^ mix64(np.array([s])))[:1])
            else:
                yield np.zeros(0, np.uint64)
        a = b


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole string (white space included)."""
    data, offsets = text_buffer(strings)
    out = np.zeros(len(offsets) - 1, np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _WINDOW, "right")) - 1)
        part = data[offsets[a]:offsets[b]]
        up, down = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_RAW[part] * up[:len(part)], out=total[1:], dtype=np.uint64)
        o = offsets[a:b + 1] - offsets[a]
        out[a:b] = (total[o[1:]] - total[o[:-1]]) * down[np.minimum(o[:-1], max(len(part) - 1, 0))]
        a = b
    return mix64(out ^ mix64(np.diff(offsets).astype(np.uint64)))
