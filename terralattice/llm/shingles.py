"""Word shingles as 64-bit hashes, over whole texts in windows of bounded memory."""

from __future__ import annotations

import numpy as np

from terralattice.llm._common import LOWER_BYTES, mix64

#: Base of the polynomial over a word's bytes and of the chain over a shingle's words: fixed odd numbers.
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once; a word may go on from one window to the next.
WINDOW = 1 << 16

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(WINDOW - 1, _BASE, np.uint64))), dtype=np.uint64)


def _windows(text: bytes, size: int):
    """(sums, lengths) of the words that end in each window; sums are polynomials over the words' bytes."""
    held, held_size = 0, 0
    for first in range(0, len(text), size):
        data = np.frombuffer(text[first : first + size].translate(LOWER_BYTES), np.uint8)
        blank = _IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        lengths = ends - starts
        if len(starts):
            at = np.flatnonzero(~blank)
            terms = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[at - np.repeat(starts, lengths)]
            sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        else:
            sums = np.empty(0, np.uint64)
        lengths = lengths.astype(np.uint64)
        if held_size and len(starts) and starts[0] == 0:
            # The word that the last window left open goes on here.
            sums[0] = (int(sums[0]) * pow(_BASE, held_size, 1 << 64) + held) & _MASK
            lengths[0] += np.uint64(held_size)
        elif held_size:
            sums = np.concatenate((np.array([held], np.uint64), sums))
            lengths = np.concatenate((np.array([held_size], np.uint64), lengths))
        held, held_size = 0, 0
        if len(data) and not blank[-1] and first + size < len(text):
            held, held_size = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        yield sums, lengths


def word_hashes(text: bytes, window: int = WINDOW) -> np.ndarray:
    """One hash per word of ``text`` (words lie between blanks; A-Z count as a-z)."""
    parts = [mix64(sums + lengths) for sums, lengths in _windows(text, window)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words; a shorter text is one shingle; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(words, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = mix64(out * _STEP + h[k : len(h) - size + 1 + k])
    if len(h) < words:
        out = mix64(out + np.uint64(len(h)))
    return np.unique(out)
