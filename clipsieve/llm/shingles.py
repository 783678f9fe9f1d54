"""Word shingles of whole texts as sorted distinct 64-bit hashes, from the bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clipsieve.llm.common import mix64

_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2 ** 64
_STEP = 0x9FB21C651E98DF25


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def words(texts: pa.Array, prefix: int | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, ASCII letters in lower case unless told otherwise, and each text's number of words; null is empty.

    With ``prefix``, the hash of so many first bytes of every word.
    """
    texts = pc.fill_null(texts, "")
    texts = (pc.ascii_lower(texts) if lower else texts).cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = np.zeros(data.size + 1, bool)
    solid[:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    starts = solid[:-1].copy()
    starts[1:] &= ~solid[:-2]
    inner = offsets[(offsets > 0) & (offsets < data.size)]
    starts[inner] = solid[inner]  # a text's first byte never goes on with the text before
    ends = solid[:-1] & ~solid[1:]
    cut = inner[solid[inner] & solid[inner - 1]] - 1
    ends[cut] = True
    first, after = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(1 << max(16, int(data.size + 1).bit_length()))
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: data.size], out=sums[1:])
    if prefix:
        after = np.minimum(after, first + prefix)
    hashes = mix64((sums[after] - sums[first]) * inverse[first])
    counts = np.diff(np.searchsorted(first, offsets))
    return hashes, counts


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, sorted; with fewer words the whole sequence is one; none without words."""
    hashes, counts = words(texts)
    n = hashes.size
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: max(n - k, 0)] += hashes[k:] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    rolled = mix64(rolled, 1)
    out, at = [], 0
    for size in counts.tolist():
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            part = sum(int(h) * pow(_STEP, k + 1, 1 << 64) for k, h in enumerate(hashes[at : at + size]))
            out.append(mix64(np.array([part & 0xFFFFFFFFFFFFFFFF], np.uint64), 100 + size))
        else:
            out.append(rolled[:0])
        at += size
    return out
