"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles.

    Words are what stands between ASCII white space, A-Z in lower case.  A text with fewer words than a
    shingle is one shingle; null, empty and blank texts have none.
    """
    rows = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = rows.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # some ten times faster than to_pylist
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    codes, offsets = coded.indices.to_numpy(), rows.offsets.to_numpy()
    if "" in names:
        keep = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    w = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(w) - words + 1
        if n > 0:
            rolled = w[:n].copy()
            for k in range(1, words):
                rolled = rolled * _MIX + w[k : k + n]
            rolled = _finish(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    h = h * _MIX + w[k]
                out.append(_finish(h))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
