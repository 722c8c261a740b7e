"""Word hashes of many texts at once, by array operations on their UTF-8 bytes.

A word's hash is a polynomial over random values of its bytes, modulo 2**64, mixed at the end. A text's bytes are
handled in pieces that end at a separator, so memory is bounded by the piece and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once.
PIECE = 1 << 19
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_keep = np.arange(256, dtype=np.uint8)
_low = _keep.copy()
_low[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, PIECE + 8), np.uint64)
        out[:1], k = 1, 1
        while k < len(out):
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
            k += m
        _powers[base] = have = out
    return have[:n]


def _pieces(data: bytes) -> Iterator[bytes]:
    """Runs of whole words of about PIECE bytes; a longer word is one run."""
    at, end = 0, len(data)
    while end - at > PIECE:
        cut = max(data.rfind(s, at, at + PIECE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < at:
            later = [p for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(s, at)) >= 0]
            cut = min(later, default=end - 1)
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


def _hash_piece(data: bytes, lower: bool) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate(([True], _space[b], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    value = _VALUE[_low] if lower else _VALUE
    np.cumsum(value[b] * _power(_BASE, len(b)), out=total[1:])
    return mix64((total[stop] - total[start]) * _power(_INVERSE, len(b))[start] + (stop - start).astype(np.uint64) * _M2)


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (separated by U+0020 and U+0009 to U+000D) of all texts, and the offsets of texts in them: n + 1 numbers."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        data = b" ".join(texts[i] for i in group)
        h = _hash_piece(data, lower)
        if len(group) > 1:
            b = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero(~_space[b] & np.concatenate(([True], _space[b][:-1])))
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            counts[np.asarray(group) + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
        else:
            counts[group[0] + 1] = len(h)
        parts.append(h)
        group, held = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > PIECE:
            flush()
            own = [_hash_piece(p, lower) for p in _pieces(t)]
            counts[i + 1] = sum(map(len, own))
            parts += own
            continue
        if held + len(t) > PIECE:
            flush()
        group.append(i)
        held += len(t) + 1
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(counts)


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k consecutive hashes that begin at each place; len(h) - k + 1 numbers."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(pow(_BASE, 3 + j + 7 * salt, 2**64) | 1)
    return mix64(out + np.uint64(salt))


def crc_mod(keys: list, n: int) -> np.ndarray:
    """crc32 of each key written as text, modulo n; null counts as the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if k is None else str(k).encode()) % n for k in keys), np.int64, len(keys))
