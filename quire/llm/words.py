"""Words of many texts at once, as byte spans of a flat UTF-8 array, and hashes of word runs."""

from __future__ import annotations

import numpy as np

from quire.llm.shared import mix, span_hashes

#: Bytes lower-cased, A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and all beyond ASCII; or all but ASCII white space.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
UNSPACED = np.ones(256, bool)
UNSPACED[[32, *range(9, 14)]] = False


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes in `table`, none across texts, and n + 1 offsets of each text's runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    at = np.flatnonzero(edge)
    if len(cuts):
        at = np.sort(np.concatenate([at, cuts, cuts]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of lower-cased words, never 0 or 1."""
    h = span_hashes(LOWER[data], starts, ends)
    h[h == 1] = 2
    return h


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of the flat array, whatever texts they are of."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = len(words) - n + 1
    h = np.full(total, n, np.uint64)
    for k in range(n):
        h += words[k : k + total] * _ODD[k % 64] if k < 64 else mix(words[k : k + total] + np.uint64(k))
    return mix(h)
