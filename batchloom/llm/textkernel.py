"""Words of whole texts as 64-bit fingerprints, computed over Arrow buffers by numpy.

A batch of texts is one byte buffer. Word limits come from a byte table. A span's fingerprint reads its bytes eight at a
time: each such word is mixed with its place by a bijection that is not linear, the results are added and mixed with the
span's length. So no Python object exists for a word, and texts of two letters with a regular pattern collide no sooner than
others. Fingerprints only propose that spans are equal: ``distinct_spans`` and ``same_spans`` compare the bytes.

Spans are read ``AT_ONCE`` bytes at a time, so memory follows a text's number of words and nothing stays behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes of spans that are mixed in one step.
AT_ONCE = 1 << 21

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a letter run: ASCII other than letters.
NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)
#: Masks of the first 0 to 8 bytes of a word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _unaligned(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _words_of(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of spans in words of eight, each word's place in its span, and each span's first word (one more at the end)."""
    counts = (ends - starts + 7) >> 3
    firsts = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
    where = np.repeat(starts, counts) + 8 * place
    words = at[where]
    words &= _MASKS[np.minimum(np.repeat(ends, counts) - where, 8)]
    return words, place, firsts


def _chunks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of spans of about ``AT_ONCE`` bytes, or of one span."""
    total, lo = np.cumsum(ends - starts), 0
    while lo < len(starts):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans of ``data`` (ends exclusive, spans not empty)."""
    at, out = _unaligned(data), np.empty(len(starts), np.uint64)
    for lo, hi in _chunks(starts, ends):
        s, e = starts[lo:hi], ends[lo:hi]
        total = mix((at[s] & _MASKS[np.minimum(e - s, 8)]) + mix(np.ones(1, np.uint64)))
        long = np.flatnonzero(e - s > 8)
        if len(long):
            words, place, firsts = _words_of(at, s[long] + 8, e[long])
            total[long] += np.add.reduceat(mix(words + mix((place + 1).astype(np.uint64) * _STEP + np.uint64(1))), firsts[:-1])
        out[lo:hi] = mix(total + (e - s).astype(np.uint64) * _STEP)
    return out


def same_spans(data: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which spans ``a`` have the bytes of their spans ``b`` (not empty)."""
    out = a_ends - a_starts == b_ends - b_starts
    maybe, at = np.flatnonzero(out), _unaligned(data)
    a_starts, a_ends, b_starts, b_ends = a_starts[maybe], a_ends[maybe], b_starts[maybe], b_ends[maybe]
    for lo, hi in _chunks(a_starts, a_ends):
        a, _, firsts = _words_of(at, a_starts[lo:hi], a_ends[lo:hi])
        b, _, _ = _words_of(at, b_starts[lo:hi], b_ends[lo:hi])
        out[maybe[lo:hi]] = np.logical_and.reduceat(a == b, firsts[:-1])
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, and each key's number among the distinct ones."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct span, and each span's number among them. Equal numbers mean equal bytes."""
    one, number = grouped(span_hashes(data, starts, ends) if prints is None else prints)
    like = one[number]
    other = np.flatnonzero(like != np.arange(len(like)))
    odd = other[~same_spans(data, starts[other], ends[other], starts[like[other]], ends[like[other]])]
    if len(odd):  # fingerprints met by chance: these spans are told apart by their bytes
        found: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            key = data[starts[i] : ends[i]].tobytes()
            if key not in found:
                found[key] = len(one) + len(more)
                more.append(i)
            number[i] = found[key]
        one = np.append(one, more)
    return one, number


def word_spans(data: np.ndarray, cuts: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without ``gap`` bytes; ``cuts``: positions that no run crosses."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~gap[data]
    inside[-1] = False
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    end = inside[:-1] & ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` rows and ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(n, lo + most, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, gap: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of some texts in order, and each text's first place among them (one more at the end).

    ``prefixes``: each word is followed by the fingerprints of its first so many bytes.
    """
    data = fold[data]
    s, e = word_spans(data, offsets, gap)
    firsts = np.searchsorted(s, offsets)
    if not prefixes:
        return span_hashes(data, s, e), firsts
    every = [span_hashes(data, s, np.minimum(e, s + k) if k else e) ^ mix(np.full(1, k, np.uint64)) for k in (0, *prefixes)]
    return np.stack(every, axis=1).ravel(), firsts * len(every)


def window_places(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of ``width`` words inside one text: their text's row, and the place of their first word."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts[:-1], counts)


def windows(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows of ``width`` words inside one text, their text's row and the place of their first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, at = window_places(firsts, width)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : n + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)[at], rows, at


def window_numbers(numbers: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window (``at``: first words); equal numbers mean equal words, whatever the fingerprints."""
    if not len(at):
        return np.zeros(0, np.int64)
    prints, _, _ = windows(mix(numbers.astype(np.uint64)), np.array([0, len(numbers)]), width)
    one, group = grouped(prints[at])
    like = at[one][group]
    for k in range(width):
        if (numbers[at + k] != numbers[like + k]).any():  # met by chance: compare the words
            return np.unique(np.stack([numbers[at + k] for k in range(width)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    return group
