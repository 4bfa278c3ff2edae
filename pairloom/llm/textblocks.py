"""Vectorised word and shingle hashing over blocks of whole texts.

Texts arrive as UTF-8 bytes.  A block holds a few MB of texts (one very long
text makes a block of its own), so a worker's memory is bounded by the block
size or by its longest text, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1_000_000
#: Bytes of a block whose words are hashed at a time: this takes some forty bytes a byte.
PART_BYTES = 250_000
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.arange(256, dtype=np.uint8)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    if len(have := _powers.get(base, np.ones(1, np.uint64))) < n:
        steps = np.full(max(n, 2 * len(have), PART_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * BLOCK_BYTES:  # one huge text: do not keep its table
            del _powers[base]
    return have[:n]


def blocks(texts: Iterable[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``limit`` bytes: (first index, texts)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, start byte and length of every word ``[^\\x20\\x09-\\x0D]+``."""
    buf = (_LOWER if lower else _KEEP)[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    edge = np.diff(np.concatenate([[True], _IS_SPACE[buf]]).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(np.multiply(buf, _power(_P, len(buf)), out=sums[1:]), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_P_INV, len(buf))[start]
    size = end - start
    h = mix64(h ^ (size.astype(np.uint64) << np.uint64(40)))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(firsts, start, "right") - 1, start, size


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingle hashes of each text.

    A text of fewer words gives its whole sequence as one; a text without
    words gives none.
    """
    return [h for _, part in blocks(texts, PART_BYTES) for h in _shingles(part, width)]


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    h, row, _, _ = words(texts)
    n = len(h)
    count = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(count)
    rolled = h.copy()
    for k in range(1, width):
        rolled[: n - k] = mix64(rolled[: n - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:] + np.uint64(k)) if n > k else rolled[: n - k]
    out = []
    for i in range(len(texts)):
        c, e = int(count[i]), int(ends[i])
        if c >= width:
            out.append(np.unique(rolled[e - c : e - width + 1]))
        elif c:
            x = h[e - c : e - c + 1].copy()
            for k in range(1, c):
                x = mix64(x * np.uint64(0xD6E8FEB86659FD93) + h[e - c + k : e - c + k + 1] + np.uint64(k))
            out.append(mix64(x + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
