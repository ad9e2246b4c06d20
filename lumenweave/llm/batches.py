"""Helpers for operators that read texts in Arrow batches: bounded chunks, distinct words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_CHARS = 2_000_000
#: Odd multiplier of the polynomial hashes.
MULT = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches, text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together hold about ``chars`` bytes at most."""
    for b in batches:
        give_back()
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // chars
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)
    give_back()


def column(b: pa.RecordBatch, name: str):
    return b.column(b.schema.get_field_index(name))


def words_of(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's words, the words as numbers, and the distinct words.

    A word is a maximal run of anything but ASCII white space; a null text has none.
    """
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.replace_substring_regex(plain, "[\\x09-\\x0D ]+", " ")
    parts = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    values, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in names:  # what an empty text splits into
        k = names.index("")
        keep = ids != k
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        ids = ids[keep]
    return offsets, ids, names


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def hash_words(names: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w.encode("utf-8", "surrogatepass")) for w in names), dtype=np.uint64, count=len(names))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by position of its first word (length len(h)-k+1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MULT + h[j : j + n]
    return mix64(out)
