"""Hashed words and word shingles of whole texts, with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time, up to the end of the word that stands there.
SEGMENT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


def _words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.concatenate([[True], _SPACE[a], [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _power(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up, dtype=np.uint64)])
    return start, end, mix((total[end] - total[start]) * down[start])


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes, exclusive) and 64-bit hash of each word ``[^ \\t\\n\\v\\f\\r]+`` of ``data``."""
    a, at, parts = np.frombuffer(data, np.uint8), 0, []
    while at < len(a):
        stop = min(at + SEGMENT, len(a))
        while stop < len(a) and not _SPACE[a[stop]]:
            more = np.flatnonzero(_SPACE[a[stop : stop + SEGMENT]])
            stop += int(more[0]) if len(more) else min(SEGMENT, len(a) - stop)
        s, e, h = _words(a[at:stop])
        parts.append((s + at, e + at, h))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts: start and end in their text, hash, and where each text's words begin (one more than texts)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    start, end, h = hash_words(b"\n".join(texts))
    first = np.searchsorted(start, offsets)
    shift = np.repeat(offsets[:-1], np.diff(first))
    return start - shift, end - shift, h, first


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours, in order."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out + np.uint64(seed + 0x51ED2701 * (i + 1))) + h[i : i + len(out)] * np.uint64(2 * i + 0x2545F4914F6CDD1D)
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """The different values of ``h``, sorted."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's set of ``n``-word shingles as sorted hashes: A-Z count as a-z; with fewer words the whole sequence is one."""
    _, _, h, first = joined([t.lower() for t in texts])
    every, out = grams(h, n), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(distinct(every[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], int(b - a), seed=int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
