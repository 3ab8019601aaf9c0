"""Vectorised word and window hashes over whole texts (numpy, no per-word Python).

Words are maximal runs of bytes other than space and \\x09-\\x0d of the UTF-8 text. A word's hash is a
polynomial over randomised byte values modulo 2**64, finished by a mixer; a window's hash is a
polynomial over its words' hashes. Two windows hashes with different multipliers make 128 bits.
"""

from __future__ import annotations

import numpy as np

_SEED = 0x5EED_0F_C0FFEE
_PIECE = 1 << 20  # bytes hashed at a time: bounds memory for very long texts

_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15 | 3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _MUL, np.uint64)
        p[0] = 1
        inv = np.full(size, np.uint64(pow(int(_MUL), -1, 2**64)), np.uint64)
        inv[0] = 1
        _powers["p"], _powers["i"] = np.multiply.accumulate(p), np.multiply.accumulate(inv)
    return _powers["p"], _powers["i"]


def hash_values(v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of randomised 64-bit values."""
    p, inv = _power_tables(len(v) + 1)
    acc = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * p[: len(v)], out=acc[1:])
    return _mix((acc[ends] - acc[starts]) * inv[starts])


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of ``b``."""
    return hash_values(_BYTE[b], starts, ends)


def hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with starts and ends (byte offsets) of one piece that no word straddles."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _SPACE[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return hash_spans(b, starts, ends), starts, ends


def pieces(texts: list[bytes], size: int = _PIECE):
    """Runs of texts joined by a space, about ``size`` bytes each: (first text, text after the last, bytes).

    A longer text is cut at white space into several runs of its own.
    """
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if len(t) > size:
            if i > lo:
                yield lo, i, b" ".join(texts[lo:i])
            at = 0
            while at < len(t):
                end = at + size
                while end < len(t) and not _SPACE[t[end]]:
                    end += 1
                yield i, i + 1, t[at:end]
                at = end
            lo, held = i + 1, 0
            continue
        held += len(t) + 1
        if held > size:
            yield lo, i + 1, b" ".join(texts[lo : i + 1])
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), b" ".join(texts[lo:])


def hash_texts(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, text after text, and each text's number of words.

    ``lower`` folds A-Z only. A null text has no words.
    """
    texts = [t or b"" for t in texts]
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for lo, hi, raw in pieces(texts):
        h, starts, _ = hash_piece(raw.translate(LOWER) if lower else raw)
        hashes.append(h)
        if hi == lo + 1:
            counts[lo] += len(h)
        else:
            bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            counts[lo:hi] += np.diff(np.searchsorted(starts, bounds), prepend=0)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of every ``width`` consecutive words (over text borders too: callers mask those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul = np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[which])
    acc = words[:n].copy()
    for j in range(1, width):
        acc *= mul
        acc += words[j : j + n]
    acc *= mul
    acc += np.uint64(width)
    return _mix(acc)
