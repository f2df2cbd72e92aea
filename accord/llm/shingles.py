"""Hashes of word n-grams by array arithmetic over Arrow's text buffers; used within tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, or one longer text.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about CHUNK bytes."""
    offsets, data = buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each row and the end, 64-bit hashes of the words as given) of a run of rows."""
    n = len(data)
    if not n:
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    word = ~_SEPARATOR[data]
    begin, end = word.copy(), word.copy()
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begin[1:] &= ~word[:-1]
    begin[inner] |= word[inner]
    end[:-1] &= ~word[1:]
    end[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return np.searchsorted(starts, offsets), mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes) of each text's `width`-word shingles, A-Z in lower case.

    Fewer words make one shingle of all of them; no words, none.
    """
    for first, offsets, data in chunks(column):
        n_rows, n = len(offsets) - 1, len(data)
        if not n:
            yield from ((first + k, np.zeros(0, np.uint64)) for k in range(n_rows))
            continue
        power, inverse = _powers(n + 1)
        word = ~_SEPARATOR[data]
        begin, end = word.copy(), word.copy()
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begin[1:] &= ~word[:-1]
        begin[inner] |= word[inner]
        end[:-1] &= ~word[1:]
        end[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * inverse[starts])
        by_row = np.searchsorted(starts, offsets)
        hashes = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            hashes = hashes * np.uint64(_BASE) + words[k : len(words) - width + 1 + k] if len(hashes) else hashes
        hashes = mixed(hashes)
        for k in range(n_rows):
            a, b = by_row[k], by_row[k + 1]
            if b - a >= width:
                own = np.sort(hashes[a : b - width + 1])
                yield first + k, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for w in range(a, b):
                    whole = mixed(whole * np.uint64(_INVERSE) + words[w : w + 1])
                yield first + k, whole
            else:
                yield first + k, np.zeros(0, np.uint64)


def string_hash(data: bytes, salt: int) -> int:
    """The hash that prefix_sets gives a word (salt 0) or a beginning of k characters (salt k)."""
    total = sum((byte + 1) * pow(_BASE, i, 1 << 64) for i, byte in enumerate(data))
    return int(mixed(np.array([(total + salt * _INVERSE) % (1 << 64)], np.uint64))[0])


def prefix_sets(column: pa.Array, separators: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct 64-bit hashes) of each text's words, A-Z in lower case, and of longer words' beginnings."""
    for first, offsets, data in chunks(column):
        n = len(data)
        if not n:
            yield from ((first + k, np.zeros(0, np.uint64)) for k in range(len(offsets) - 1))
            continue
        power, inverse = _powers(n + 1)
        word = ~separators[data]
        begin, end = word.copy(), word.copy()
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begin[1:] &= ~word[:-1]
        begin[inner] |= word[inner]
        end[:-1] &= ~word[1:]
        end[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), [n])
        at = np.searchsorted(chars, starts)
        parts, owners = [mixed((sums[ends] - sums[starts]) * inverse[starts])], [starts]
        for k in prefixes:
            stop = chars[np.minimum(at + k, len(chars) - 1)]
            long = stop < ends
            salt = np.uint64(k * _INVERSE % (1 << 64))
            parts.append(mixed((sums[stop[long]] - sums[starts[long]]) * inverse[starts[long]] + salt))
            owners.append(starts[long])
        hashes, owner = np.concatenate(parts), np.searchsorted(offsets, np.concatenate(owners), "right") - 1
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
            hashes, owner = hashes[new], owner[new]
        cut = np.searchsorted(owner, np.arange(len(offsets)))
        yield from ((first + k, hashes[cut[k] : cut[k + 1]]) for k in range(len(offsets) - 1))


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes; 0 for the empty one."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(hashes) else 0
