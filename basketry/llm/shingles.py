"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = 5, letters: bytes = LOWER) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; words are split at ASCII white space, ``letters`` maps bytes (A-Z to lower case).

    A text of fewer words is one shingle, a text without words has none. The texts' words form one buffer; a shingle's hash
    is a difference of two prefix sums of a polynomial, so all are computed at once.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").translate(letters).split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    buffer = np.frombuffer(b" ".join([b" ".join(w) for w in words if w]), dtype=np.uint8)
    up, down = _powers(len(buffer))
    prefix = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=prefix[1:])
    spaces = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(buffer)]))
    each = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))  # shingles by text
    first = np.cumsum(counts) - counts
    begin = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    last = np.minimum(begin + width - 1, np.repeat(first + counts - 1, each))
    s, e = starts[begin], ends[last]
    hashes = mixed((prefix[e] - prefix[s]) * down[s])
    cuts = np.cumsum(each)[:-1]
    return [np.unique(x) for x in np.split(hashes, cuts)]


def batches(texts: list[str | None], most: int = 500_000):
    """Slices of the list with about ``most`` characters each, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """128 bits of a set; None if it is empty."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
