"""Word shingles of whole texts as 64-bit hashes, made for a batch at a time over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
    return np.multiply.accumulate(out)


def plain_words(texts: pa.Array) -> pa.Array:
    """Texts without tags, in lower case, their runs of letters and digits parted by single blanks; NULL stays."""
    texts = pc.replace_substring_regex(texts.cast(pa.large_string()), "<[^>]*>", "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def shingle_sets(texts: pa.Array, words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct hashes of each text's runs of that many words, one text after another.

    A NULL text, or one of fewer words, has none. Equal runs have equal hashes in every batch and on every machine.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    rows = len(texts)
    clean = pc.fill_null(plain_words(texts), "")
    offsets = np.frombuffer(clean.buffers()[1], np.int64, rows + 1, clean.offset * 8) if rows else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    none = np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64)
    if high == low:
        return none
    data = np.frombuffer(clean.buffers()[2], np.uint8, high - low, low)
    start = (offsets[:-1] - low)[offsets[:-1] < offsets[1:]]
    inside = data != 32
    opening = inside.copy()
    opening[1:] &= ~inside[:-1]
    opening[start] = inside[start]  # a word never spans two texts
    begin = np.flatnonzero(opening)
    if len(begin) == 0:
        return none
    at = np.cumsum(opening) - 1
    place = np.arange(len(data)) - begin[np.maximum(at, 0)]
    longest = int(place[inside].max()) + 1
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(longest)[np.minimum(np.maximum(place, 0), longest - 1)]
    value[~inside] = 0
    word = mixed(np.add.reduceat(value, begin))
    owner = np.searchsorted(offsets - low, begin, side="right") - 1
    n = len(word) - words + 1
    if n <= 0:
        return none
    run = np.zeros(n, np.uint64)
    for i in range(words):
        run = mixed(run * _BASE + word[i : i + n] + np.uint64(i))
    whole = owner[:n] == owner[words - 1 :]
    run, owner = run[whole], owner[:n][whole]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    run, owner = run[new], owner[new]
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))), run


def one_permutation(offsets: np.ndarray, hashes: np.ndarray, bins: int) -> np.ndarray:
    """Signatures by one-permutation hashing with optimal densification; row i belongs to set i (all 0 if it is empty).

    The hash itself is the permutation: its high part names the bin, and as a set's hashes are sorted, the first of a bin is its
    least. An empty bin takes the value of the first non-empty bin in a sequence that depends on the empty bin's number and
    the attempt alone, so two sets agree in a bin with the probability of their similarity.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, bins), np.uint64)
    if len(hashes) == 0:
        return out
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    key = owner * bins + bin_.astype(np.int64)
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    out.reshape(-1)[key[head]] = hashes[head]
    full = np.zeros((rows, bins), bool)
    full.reshape(-1)[key[head]] = True
    row, col = np.nonzero(~full & full.any(1)[:, None])
    source = out.copy()
    number = np.arange(bins, dtype=np.uint64)
    attempt = 0
    while len(row) and attempt < 64 * bins:
        attempt += 1
        shift = np.uint64((attempt * int(_BASE)) & (2**64 - 1))
        target = (mixed(number * np.uint64(0x10001) + shift) % np.uint64(bins)).astype(np.int64)[col]
        hit = full[row, target]
        out[row[hit], col[hit]] = source[row[hit], target[hit]]
        row, col = row[~hit], col[~hit]
    if len(row):  # practically never: the first non-empty bin
        out[row, col] = source[row, full[row].argmax(1)]
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many successive bins; the band's number is part of it."""
    n, bins = signatures.shape
    count = bins // rows
    key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (n, 1))
    for i in range(rows):
        key = mixed(key * _BASE + signatures[:, i : count * rows : rows])
    return key
