"""Vectorised 64-bit hashes of words and of word shingles, for use inside Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D. ``bytes.lower`` folds A-Z only, and
UTF-8 never uses those bytes inside a multi-byte character, so byte-wise work equals code-point work.
Texts are hashed in blocks of about 256 KB, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(17)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_STEP = np.random.Generator(np.random.PCG64(18)).integers(1, 2**64 - 1, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(BLOCK.bit_length(), (n + 1).bit_length())
    if size not in _powers:
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, pow(int(_BASE), -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        with np.errstate(over="ignore"):
            found = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        if size > 4 * BLOCK:  # one very long word; not worth keeping
            return found
        _powers[size] = found
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive pieces of the texts, cut at white space where a text is longer than a block."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield first, held
            first, held, size = k, [], 0
        if len(t) <= BLOCK:
            held.append(t)
            size += len(t) + 1
            continue
        at = 0
        while at < len(t):
            end = at + BLOCK
            if end < len(t):
                tail = np.frombuffer(t, np.uint8, offset=end)
                for part in range(0, len(tail), BLOCK):
                    if (hit := _SPACE[tail[part : part + BLOCK]]).any():
                        end += part + int(hit.argmax())
                        break
                else:
                    end = len(t)
            yield k, [t[at:end]]
            at = end
        first, held, size = k + 1, [], 0
    if held:
        yield first, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text)."""
    counts = np.zeros(len(texts), np.int64)
    found = []
    for first, held in _blocks(texts):
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        start = start[: len(end)]
        power, inverse = _power(len(data))
        with np.errstate(over="ignore"):
            total = np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            found.append(mix((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64)))
        ends = np.cumsum([len(t) + 1 for t in held])
        counts[first : first + len(held)] += np.bincount(np.searchsorted(ends, start, "right"), minlength=len(held))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[: len(words) - n + 1] * _STEP[0]
        for j in range(1, n):
            total = total + words[j : len(words) - n + 1 + j] * _STEP[j]
        return mix(total + np.uint64(n))


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words the whole sequence is one."""
    words, counts = word_hashes(texts)
    at = 0
    for c in counts.tolist():
        own = words[at : at + c]
        at += c
        yield np.unique(ngrams(own, min(n, c))) if c else own
