"""Simple-8b word-aligned coding of unsigned ids, vectorised over blocks.

A 64-bit word holds a selector in its top four bits and as many ids as fit in the other sixty.  Selector
15 is an escape: the next word is one id of more than sixty bits.  Ids are coded in blocks of ``BLOCK``
that share no word, and the word offset of each block is kept, so a reader can decode any block, or all
blocks at once, without walking the words one by one.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the code: ids in a word and bits of each, by selector from 1 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 4096


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    if len(ids) and ids.max() < 1 << 16:
        return _SMALL[ids]
    out = np.ones(len(ids), np.uint8)
    for bits in range(1, 64):
        out += (ids >> np.uint64(bits)) > 0
    return out


_SMALL = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, word offset of each block as uint32) of an array of unsigned ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    width = _widths(ids)
    choice = np.full(n, ESCAPE, np.uint8)
    widest = width  # over the next k ids
    most = max((k for k, b in zip(COUNTS, BITS, strict=True) if b >= int(width.min())), default=0)
    for k in range(1, min(most, n) + 1):
        if k > 1:
            widest = np.maximum(widest[:-1], width[k - 1 :])
        if k in COUNTS:
            selector = COUNTS.index(k) + 1
            fits = widest <= BITS[selector - 1]
            for end in range(BLOCK, n, BLOCK):  # no word reaches over the end of a block
                fits[end - k + 1 : end] = False
            # Larger counts have smaller selectors, and the largest count that fits is taken.
            choice[: len(fits)] = np.minimum(choice[: len(fits)], ESCAPE - fits.view(np.uint8) * np.uint8(ESCAPE - selector))
    step = _STEPS[choice].tobytes()
    starts = []
    note = starts.append
    at = 0
    while at < n:
        note(at)
        at += step[at]
    at = np.array(starts)
    kind = choice[at]
    places = np.cumsum(1 + (kind == ESCAPE)) - (1 + (kind == ESCAPE))
    words = np.zeros(int(places[-1]) + 1 + int(kind[-1] == ESCAPE), np.uint64)
    for selector in np.unique(kind):
        own = kind == selector
        if selector == ESCAPE:
            words[places[own]] = np.uint64(ESCAPE << 60)
            words[places[own] + 1] = ids[at[own]]
            continue
        c, bits = COUNTS[selector - 1], BITS[selector - 1]
        word = np.full(int(own.sum()), np.uint64(int(selector) << 60))
        for j in range(c):
            word |= ids[at[own] + j] << np.uint64(j * bits)
        words[places[own]] = word
    blocks = np.searchsorted(at, np.arange(0, n, BLOCK))
    return words, places[blocks].astype(np.uint32)


_STEPS = np.array([1, *COUNTS, 1], np.uint8)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """All ids of a stretch of blocks; ``n`` ids in all."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.uint8)
    if (kind == ESCAPE).any():  # a word after an escape is no word of its own
        raw = np.zeros(len(words), bool)
        for a, b in zip(offsets.tolist(), [*offsets[1:].tolist(), len(words)], strict=True):
            at = a
            while at < b:
                hits = np.flatnonzero(kind[at:b] == ESCAPE)
                if not len(hits):
                    break
                raw[at + hits[0] + 1] = True
                at += int(hits[0]) + 2
        values = words[np.flatnonzero(raw)]
        heads = np.flatnonzero(~raw)
        words, kind = words[heads], kind[heads]
    else:
        values = None
    counts = np.array([0, *COUNTS, 1])[kind]
    to = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for selector in np.unique(kind):
        own = kind == selector
        if selector == ESCAPE:
            out[to[own]] = values
            continue
        c, bits = COUNTS[selector - 1], BITS[selector - 1]
        mask, part, place = np.uint64((1 << bits) - 1), words[own], to[own]
        for j in range(c):
            out[place + j] = (part >> np.uint64(j * bits)) & mask
    return out[:n]
