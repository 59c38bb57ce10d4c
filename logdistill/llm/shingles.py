"""Word shingles and MinHash of many texts at once, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
# Bytes of words map to themselves, A-Z to a-z, all separators to 0.
_BYTES = np.arange(256, dtype=np.uint8)
_IS_WORD = (
    (_BYTES >= 0x80)
    | ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
)
_FOLD = np.where(_IS_WORD, np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES), 0).astype(
    np.uint8
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[str], size: int):
    """Slices of the list with about ``size`` characters each, so arrays stay small."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the index of its text, in order."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    folded = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
    inside = folded != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = ends - starts
    power = np.full(int(lengths.max()), _ODD, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    at = np.flatnonzero(inside)
    first = np.repeat(starts, lengths)
    values = (folded[at].astype(np.uint64) + np.uint64(1)) * power[at - first]
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hashes = mixed(np.add.reduceat(values, begins) + lengths.astype(np.uint64))
    # Text borders by byte length, one separator each.
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    return hashes, np.searchsorted(np.cumsum(sizes), starts, side="right")


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k consecutive words; shorter texts give one for all words."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(words) - k + 1
    run = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k):
        run = run * _ODD + words[j : j + len(run)]
    run = mixed(run)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            total = np.uint64(b - a)
            for w in words[a:b]:
                total = np.uint64((int(total) * int(_ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mixed(np.array([total], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return (
        rng.integers(0, top, n, dtype=np.uint64) | np.uint64(1),
        rng.integers(0, top, n, dtype=np.uint64),
    )


def minhash(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """Signatures [sets, n]; rows of empty sets are zero."""
    out = np.zeros((len(sets), n), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    begins = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
    a, b = factors(n, seed)
    for j in range(n):
        out[full, j] = np.minimum.reduceat(flat * a[j] + b[j], begins)
    return out
