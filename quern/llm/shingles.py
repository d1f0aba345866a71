"""Word shingles of many texts at once, as sorted sets of 64-bit hashes (numpy)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed together; a longer text is cut between words.
BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.RandomState(20).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            with np.errstate(over="ignore"):
                step = np.full(n, base, np.uint64)
                step[0] = 1
                _powers[i] = np.multiply.accumulate(step)
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], ~_SEPARATOR[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_to(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at separators into blocks; a single longer word stays whole."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        while end > at and not _SEPARATOR[data[end - 1]]:
            end -= 1
        if end == at:
            end = at + BLOCK_BYTES
            while end < len(data) and not _SEPARATOR[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if waiting:
            starts, hashes = _hash_words(b" ".join(d for _, d in waiting))
            at = np.cumsum([0, *(len(d) + 1 for _, d in waiting)])
            bounds = np.searchsorted(starts, at)
            for k, (i, _) in enumerate(waiting):
                out[i] = hashes[bounds[k] : bounds[k + 1]]
            waiting.clear()

    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if len(data) > BLOCK_BYTES:
            out[i] = np.concatenate([_hash_words(x)[1] for x in _pieces(data)])
            continue
        if size + len(data) > BLOCK_BYTES:
            flush()
            size = 0
        waiting.append((i, data))
        size += len(data) + 1
    flush()
    return out


def shingle_sets(texts: Sequence[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles.

    A text of fewer words has its whole sequence as its only shingle; one
    without words, or null, has none.
    """
    sets = []
    with np.errstate(over="ignore"):
        for words in word_hashes(texts):
            n = min(k, len(words))
            if n == 0:
                sets.append(np.zeros(0, np.uint64))
                continue
            total = np.full(len(words) - n + 1, n, np.uint64)
            for j in range(n):
                total = mix(total * np.uint64(_P) + words[j : len(words) - n + 1 + j])
            sets.append(np.unique(total))
    return sets
