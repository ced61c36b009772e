"""Words and shingles of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes and rows of text that are worked on at once in a Python worker; a longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def batches(ids: Iterable, texts: Iterable, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts with A-Z lowered; a null is the empty text) in batches of about limit bytes and rows texts at most."""
    some, have, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_LOWER)
        if have and (size + len(t) > limit or len(have) >= rows):
            yield some, have
            some, have, size = [], [], 0
        some.append(i)
        have.append(t)
        size += len(t) + 1
    if have:
        yield some, have


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word in order, bounds: text i has the words from bounds[i] to bounds[i + 1])."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[joined]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    bounds = np.searchsorted(starts, before)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    length = ends - starts
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, length)
    value = _BYTE[joined[at]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), bounds


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, bounds). A text with fewer words has its whole sequence as one."""
    words, bounds = word_hashes(texts)
    n = np.diff(bounds)
    if width > len(_PLACE):
        raise ValueError(f"shingles have {len(_PLACE)} words at most")
    out = []
    if len(words) >= width:
        sums = sum(words[k : len(words) - width + 1 + k] * _PLACE[k] for k in range(width))
        hashes = mix(sums)
    for i, count in enumerate(n):
        a = bounds[i]
        if count >= width:
            out.append(np.unique(hashes[a : a + count - width + 1]))
        elif count:
            out.append(mix((words[a : a + count] * _PLACE[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
