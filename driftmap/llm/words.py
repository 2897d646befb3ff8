"""Words of whole texts as integer codes, one Arrow slice at a time.

A word is a run of characters other than space and U+0009 to U+000D; only A to Z
are lower-cased. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are cut into words at a time; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of text each; every row comes once."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """``codes[starts[i]:starts[i + 1]]`` are the words of text i, as places in ``vocabulary``."""

    starts: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for every entry of the vocabulary."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))


def words(texts: pa.Array, lower: bool = True) -> Words:
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    starts -= starts[0]
    codes, vocabulary = encoded.indices.to_numpy(), encoded.dictionary
    empty = pc.index(vocabulary, "").as_py() if len(vocabulary) else -1
    if empty >= 0:
        full = codes != empty
        starts = np.concatenate(([0], np.cumsum(full)))[starts]
        codes = codes[full]
    return Words(starts, codes, vocabulary)


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : j + n]
    return mixed(out + np.uint64(k))


def shingle_sets(w: Words, k: int, costs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sorted distinct k-word shingles of each text, and the summed ``costs`` of their words.

    ``costs`` has a number for every entry of the vocabulary. A shorter text is one
    shingle, an empty one none.
    """
    hashes = w.hashes()[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    spent = None if costs is None else np.concatenate(([0], np.cumsum(costs[w.codes])))
    for start, stop in zip(w.starts[:-1], w.starts[1:], strict=True):
        width = min(k, stop - start)
        if not width:
            yield np.zeros(0, np.uint64), None if spent is None else spent[:0]
        elif spent is None:
            yield np.unique(chained(hashes[start:stop], width)), None
        else:
            found, at = np.unique(chained(hashes[start:stop], width), return_index=True)
            yield found, spent[start + at + width] - spent[start + at]
