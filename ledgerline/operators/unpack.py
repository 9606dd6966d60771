"""Several values packed in one text field, split over Arrow buffers without a loop over rows.

A batch's text buffer is scanned once as bytes: quote parity and delimiter masks give the separators, their runs
give the items' offsets, and the list array made of them is flattened with its parents' ordinals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Delimiters of the two packed fields.
LIST_MARKS = (",", ";", "|", "/", "+", "&", "\t", "\n", "\r", "،", "؛", "、", "，", "；")
ENTRY_MARKS = ("|", ";", "\t", "\n", "\r", "//")


@dataclass(frozen=True)
class Packing:
    """How a field is packed.

    marks: texts that separate; words: words that separate where blanks (or the ends) surround them, in any case;
    spaced: marks that separate only between blanks; single_quotes: a value may also stand in single quotes.
    Whatever the marks, a text in square brackets whose values are quoted is a JSON list, separated by commas.
    """

    marks: tuple[str, ...] = LIST_MARKS
    words: tuple[str, ...] = ()
    spaced: tuple[str, ...] = ()
    single_quotes: bool = False


LANGUAGES = Packing(LIST_MARKS, words=("and",), spaced=("-", "–", "—"), single_quotes=True)
SPECIALITIES = Packing(ENTRY_MARKS)


def _shifted(mask: np.ndarray, by: int) -> np.ndarray:
    """mask[i + by] at i, False beyond the ends."""
    out = np.zeros_like(mask)
    if by > 0:
        out[:-by or None] = mask[by:] if by < len(mask) else False
    elif by < 0:
        out[-by:] = mask[:by]
    else:
        out[:] = mask
    return out


def _find(data: np.ndarray, word: bytes) -> np.ndarray:
    """True at each byte where the word begins."""
    hit = np.ones(len(data), bool)
    for i, c in enumerate(word):
        hit &= _shifted(data == c, i)
    return hit


def _spread(begin: np.ndarray, length: int) -> np.ndarray:
    out = begin.copy()
    for i in range(1, length):
        out |= _shifted(begin, -i)
    return out


def _unescaped(text: str) -> str:
    """The inside of a JSON string as text; where its escapes are broken only quotes lose theirs."""
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text.replace('\\"', '"')


def split_array(texts: pa.Array, how: Packing) -> pa.ListArray:
    """A list array with the items of each text; a NULL or blank text has an empty list.

    Items have no outer blanks and no enclosing quotes; a doubled quote inside quotes becomes one; empty items
    are dropped and repeats kept. Quoted text is never split. A quote that nothing closes is an ordinary character.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, texts.offset * 8) if rows else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    n = len(data)
    if n == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    start = offsets[:-1] - low
    stop = offsets[1:] - low
    row = np.repeat(np.arange(rows), stop - start)
    first = np.zeros(n, bool)
    first[start[start < stop]] = True
    last = np.zeros(n, bool)
    last[stop[start < stop] - 1] = True

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    blank |= _spread(_find(data, b"\xc2\xa0"), 2)
    solid = np.flatnonzero(~blank)
    if len(solid) == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))

    # JSON lists: the outermost brackets count as blanks, commas separate, a backslash takes a quote's meaning away.
    i0, i1 = np.searchsorted(solid, start), np.searchsorted(solid, stop) - 1
    some = i0 <= i1
    head, tail = solid[np.minimum(i0, len(solid) - 1)], solid[np.maximum(i1, 0)]
    listed = some & (data[head] == ord("[")) & (data[tail] == ord("]")) & (head < tail)
    second = solid[np.minimum(i0 + 1, len(solid) - 1)]
    listed &= np.isin(data[second], (ord('"'), ord("]")))
    blank = blank.copy()
    blank[head[listed]] = blank[tail[listed]] = True
    as_list = listed[row]
    slash = (data == 92) & as_list
    escaped = np.zeros(n, bool)
    if slash.any():
        at = np.arange(n)
        run_begin = np.maximum.accumulate(np.where(slash & ~(_shifted(slash, -1) & ~first), at, -1))
        odd_end = slash & ((at - run_begin) % 2 == 0)
        escaped = _shifted(odd_end, -1) & ~first

    # Double quotes by parity within the row; the last of an odd number is an ordinary character.
    quote = (data == 34) & ~escaped
    seen = np.cumsum(quote)
    before = np.concatenate(([0], seen))[start]
    count = np.concatenate(([0], seen))[stop] - before
    odd = count % 2 == 1
    if odd.any():
        marks = np.flatnonzero(quote)
        quote = quote.copy()
        quote[marks[(before + count - 1)[odd]]] = False
        seen = np.cumsum(quote)
        before = np.concatenate(([0], seen))[start]
    inside = (seen - before[row]) % 2 == 1

    def within(begin: np.ndarray, length: int) -> np.ndarray:
        """Only where all its bytes lie in one row."""
        return begin & (row == row[np.minimum(np.arange(n) + length - 1, n - 1)])

    # Separators, wherever they stand.
    mark = np.zeros(n, bool)
    for m in how.marks:
        b = m.encode()
        mark |= _spread(within(_find(data, b), len(b)), len(b)) if len(b) > 1 else data == b[0]
    edge_before = first | _shifted(blank, -1)
    edge_after = last | _shifted(blank, 1)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    for w in (*how.words, *how.spaced):
        b = w.lower().encode()
        begin = within(_find(lower, b), len(b))
        quoted_next = _shifted(quote, len(b))
        quoted_before = _shifted(quote, -1)
        word = w in how.words
        begin &= (edge_before | (quoted_before if word else False)) & (_shifted(edge_after, len(b) - 1) | (quoted_next if word else False))
        mark |= _spread(begin, len(b))
    mark = np.where(as_list, data == ord(","), mark)

    single = np.zeros(n, bool)
    if how.single_quotes and (data == 39).any():
        # Single quotes count only as a pair that opens where a value begins and closes where one ends.
        ends = np.flatnonzero(~blank & ~mark)
        q = np.flatnonzero((data == 39) & ~inside & ~as_list)
        left = np.searchsorted(solid, q) - 1
        right = np.searchsorted(solid, q, side="right")
        left_at, right_at = solid[np.maximum(left, 0)], solid[np.minimum(right, len(solid) - 1)]
        # A line break or tab is a blank that separates.
        parting = np.concatenate(([0], np.cumsum(mark)))
        opens = (left < 0) | (row[left_at] != row[q]) | (parting[q] > parting[left_at])
        closes = (right >= len(solid)) | (row[right_at] != row[q]) | (parting[right_at + 1] > parting[q + 1])
        opens &= ~((left >= 0) & (left_at == q))
        if len(q) > 1 and len(ends):
            pair = opens[:-1] & closes[1:] & (row[q[:-1]] == row[q[1:]])
            pair &= ~np.concatenate(([False], pair[:-1]))
            a, b_ = q[:-1][pair], q[1:][pair]
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, a, 1)
            np.add.at(step, b_ + 1, -1)
            inside = inside | (np.cumsum(step[:-1]) > 0)
            single[a] = single[b_] = True

    gap = mark & ~inside
    # Items: runs without a separator, cut at rows.
    begins = np.flatnonzero(~gap & (first | _shifted(gap, -1)))
    finals = np.flatnonzero(~gap & (last | _shifted(gap, 1))) + 1
    owner = row[begins]

    def trimmed(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.flatnonzero(~blank)
        lo, hi = np.searchsorted(text, a), np.searchsorted(text, z) - 1
        ok = lo <= hi
        return np.where(ok, text[np.minimum(lo, max(len(text) - 1, 0))], a) if len(text) else a, np.where(ok, text[np.maximum(hi, 0)] + 1, a) if len(text) else a

    begins, finals = trimmed(begins, finals)
    wide = finals - begins >= 2
    loose = np.concatenate(([0], np.cumsum(~inside & ~quote)))
    close = np.maximum(finals - 1, 0)
    b_safe = np.minimum(begins, n - 1)
    enclosed = wide & quote[b_safe] & quote[close] & (loose[finals] - loose[begins] == 0)
    in_single = wide & single[b_safe] & single[close]
    begins2, finals2 = trimmed(np.where(enclosed | in_single, begins + 1, begins), np.where(enclosed | in_single, finals - 1, finals))
    keep = finals2 > begins2
    begins, finals, owner, enclosed = begins2[keep], finals2[keep], owner[keep], enclosed[keep]

    size = finals - begins
    out_offsets = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(out_offsets[-1]) + np.repeat(begins - out_offsets[:-1], size)
    items = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(out_offsets.astype(np.int64)), pa.py_buffer(data[take].tobytes())).cast(pa.string())
    doubled = pa.array(enclosed & ~as_list[begins])
    if pc.any(doubled).as_py():
        items = pc.if_else(doubled, pc.replace_substring(items, '""', '"'), items)
    if slash.any():
        has = np.concatenate(([0], np.cumsum(slash)))
        with_slash = enclosed & as_list[begins] & (has[finals] - has[begins] > 0)
        if with_slash.any():
            items = pc.replace_with_mask(items, pa.array(with_slash), pa.array([_unescaped(x) for x in items.filter(pa.array(with_slash)).to_pylist()], pa.string()))
    per_row = np.bincount(owner, minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)), items)


def unpacked(df: DataFrame, keep: list[str], fields: dict[str, Packing]) -> DataFrame:
    """One row for each value: the kept columns, `field`, `pos` (from 1) and `item`.

    No shuffle: each Arrow batch is split where it lies. A row whose field is NULL or blank gives no row for it.
    Columns of the input other than those named are not read, so their names cannot clash; a kept column must not be
    called field, pos or item. Rows given twice come out twice.
    """
    clash = {"field", "pos", "item"} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    names = list(fields)
    source = df.select(*[df[f"`{c}`"] for c in keep], *[df[f"`{c}`"].cast("string").alias(f"__text{i}") for i, c in enumerate(names)])
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names):
                lists = split_array(batch.column(batch.schema.get_field_index(f"__text{i}")), fields[name])
                parent = pc.list_parent_indices(lists)
                offsets = np.asarray(lists.offsets)
                ordinal = np.arange(len(parent), dtype=np.int64) - offsets[np.asarray(parent)] + 1
                kept = [batch.column(j).take(parent) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([name] * len(parent), pa.string()), pa.array(ordinal.astype(np.int32)), lists.flatten()], names=[*keep, "field", "pos", "item"])

    return source.mapInArrow(split, schema)
