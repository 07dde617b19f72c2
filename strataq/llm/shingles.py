"""Shingle sets of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX2
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """For each text its distinct `size`-word shingles, hashed and sorted.

    Words are runs without the six ASCII spaces, A-Z in lower case. A text of fewer words is one shingle, which no longer
    text shares; without words the set is empty.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    index: dict[bytes, int] = {}
    number = index.setdefault
    flat = np.fromiter((number(w, len(index)) for ws in words for w in ws), np.int64)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
    h = table[flat] if len(flat) else np.zeros(0, np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = n.cumsum()
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        whole = mixed((whole ^ h[j:j + len(whole)]) * MIX)
    out = []
    for m, end in zip(n.tolist(), ends.tolist()):
        if m >= size:
            s = np.sort(whole[end - m:end - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif m:
            one = np.array([m], np.uint64)
            for j in range(end - m, end):
                one = mixed((one ^ h[j:j + 1]) * MIX)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
