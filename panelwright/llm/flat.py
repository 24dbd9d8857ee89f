"""Text as flat byte arrays: documents of an Arrow batch are cut, hashed and grouped with NumPy.

A word is a run of bytes outside space and \\x09-\\x0D, which in UTF-8 is the same as the
pattern [^\\x20\\x09-\\x0D]+ on characters. Memory is some 60 bytes for each byte of a block; a
block holds about two million bytes, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, kept between calls up to a few blocks in size."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        have = np.full(max(count, BLOCK_BYTES + 4096), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:count]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its documents) for runs of whole documents; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < count:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of one non-zero kind inside a document."""
    if not len(kinds):
        none = np.zeros(0, np.int64)
        return none, none, none
    change = np.empty(len(kinds) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    keep = kinds[edges[:-1]] != 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run: a polynomial by prefix sums, then scrambled."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    shift = powers(INVERSE, len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * shift[starts])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, in text order."""
    starts, ends, doc = runs(~SPACE[data], offsets)
    return run_hashes(LOWER[data] if lower else data, starts, ends), doc


def grams(hashes: np.ndarray, doc: np.ndarray, width: int, documents: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of width words; with short, a document of fewer words gives one gram of all."""
    counts = np.bincount(doc, minlength=documents)
    out = np.full(len(hashes), width, np.uint64)
    for j in range(width):
        part = hashes[j:]
        out[: len(part)] = mixed(out[: len(part)] * np.uint64(BASE) + part)
    last = np.cumsum(counts)[doc] if len(doc) else doc
    whole = np.arange(len(hashes)) + width <= last
    gram, owner = out[whole], doc[whole]
    few = np.flatnonzero((counts > 0) & (counts < width)) if short else ()
    if len(few):
        first = np.cumsum(counts)[few] - counts[few]
        held = counts[few].astype(np.uint64)
        for j in range(width - 1):
            live = counts[few] > j
            held[live] = mixed(held[live] * np.uint64(BASE) + hashes[first[live] + j])
        gram, owner = np.concatenate([gram, held]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    return gram, owner


def distinct(values: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, end to end, and their number per document."""
    edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=documents))])
    parts, sizes = [], np.zeros(documents, np.int64)
    for d in np.flatnonzero(np.diff(edges)):
        own = np.sort(values[edges[d] : edges[d + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes[d] = len(own)
    return np.concatenate(parts) if parts else values[:0], sizes
