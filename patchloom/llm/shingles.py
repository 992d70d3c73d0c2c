"""Hashes of words and of runs of k words, for many texts at once, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes of text worked on at once; longer texts go alone.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverses modulo 2 ** 64, for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK + CHUNK // 4)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]; a part's hash is (H[e] - H[s]) * BASE ** -s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def part_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; those of other lengths differ by their lengths too."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(U) * U(STEP))


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters together."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tidy() -> None:
    """Gives memory that is free back to the system: a worker stays for the next task, and others need the memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def column_parts(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of parts of an Arrow column of about `size` bytes, so that few texts are Python's at a time."""
    n = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(column):
        before = n[start - 1] if start else 0
        end = min(len(column), int(np.searchsorted(n, before + size)) + 1)
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end
    pa.default_memory_pool().release_unused()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, text's index, start and end of each word): lower-cased, split at ASCII white space."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = b" ".join(raw) + b" "
    solid = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, np.searchsorted(np.cumsum(lengths), start, side="right"), start, end


def cells(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each part data[start:end], a part with each number): parts share a number only if all bytes are equal.

    Parts come in order and do not overlap.
    """
    bounds = np.empty(2 * len(start) + 1, np.int64)
    bounds[:-1:2], bounds[1::2] = start, end
    bounds[-1] = end[-1] if len(end) else 0
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    found = every.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    number = found.indices.to_numpy()
    one = np.empty(len(found.dictionary), np.int64)
    one[number[::-1]] = np.arange(len(start) - 1, -1, -1)
    return number, one


def byte_hash(data: bytes, start: np.ndarray, end: np.ndarray, most: int = 64) -> np.ndarray:
    """Hashes of the parts data[start:end]: eight bytes at a time through mix(); parts over `most` bytes by xxHash."""
    size = end - start
    padded = data + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(U) * U(STEP) + U(BASE))
    at = np.arange(len(start))
    for done in range(0, min(most, int(size.max(initial=0))), 8):
        at = at[size[at] > done] if done else at
        left = np.minimum(size[at] - done, 8).astype(U)
        h[at] = mix(h[at] ^ ((eight[start[at] + done] << (U(64) - left * U(8))) * U(BASE)))
    for i in np.flatnonzero(size > most).tolist():
        h[i] = xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of each word, see split_words()."""
    data, doc, start, end = split_words(texts)
    return doc, byte_hash(data, start, end)


def exact_shingles(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(), but with numbers that are equal only for equal runs of words among these texts, instead of hashes."""
    data, doc, start, end = split_words(texts)
    w, kinds = cells(data, start, end)
    w, n, m = w.astype(np.int64), len(texts), len(kinds) + 1
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    at = np.arange(len(w))
    left = first[doc + 1] - at if len(w) else at
    # runs are named word by word: (name of what went before, next word) gets a new name; 0 stands for no word
    own = (left >= k) | ((at == first[doc]) if len(w) else False)
    at = at[own]
    name = np.zeros(len(at), np.int64)
    for j in range(k):
        there = j < np.minimum(left[at], size[doc[at]] if len(w) else 0)
        word = np.where(there, w[np.minimum(at + j, max(len(w) - 1, 0))] + 1 if len(w) else 0, 0)
        name = np.unique(name * m + word, return_inverse=True)[1].astype(np.int64)
    total = int(name.max(initial=-1)) + 1
    both, count = np.unique(doc[at] * max(total, 1) + name, return_counts=True)
    return np.searchsorted(both, np.arange(n + 1) * max(total, 1)), both % max(total, 1), count


def shingles(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle of each text and the end, hashes, counts): distinct runs of k words with how often they occur.

    A text of fewer than k words has one shingle of all its words, one without words has none.
    """
    doc, w = words(texts)
    n = len(texts)
    first = np.searchsorted(doc, np.arange(n + 1))
    out_h, out_c, sizes = [], [], np.zeros(n + 1, np.int64)
    step = [U(pow(STEP, j + 1, 1 << 64)) for j in range(k)]
    if len(w) >= k:
        run = w[: len(w) - k + 1] * step[0]
        for j in range(1, k):
            run = run + w[j : len(w) - k + 1 + j] * step[j]
    else:
        run = np.zeros(0, U)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            h, c = np.unique(mix(run[a : b - k + 1]), return_counts=True)
        elif b > a:
            h, c = mix(np.array([sum(int(w[a + j]) * int(step[j]) for j in range(b - a)) % (1 << 64)], U)), np.ones(1, np.int64)
        else:
            continue
        out_h.append(h)
        out_c.append(c)
        sizes[i + 1] = len(h)
    empty = not out_h
    return np.cumsum(sizes), np.zeros(0, U) if empty else np.concatenate(out_h), np.zeros(0, np.int64) if empty else np.concatenate(out_c)
