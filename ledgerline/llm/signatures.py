"""Signatures of whole texts, and the exact similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.shingles import bands, mixed, one_permutation, shingle_sets


def signed(df: DataFrame, keep: list[str], text: str, *, words: int, bins: int, band_rows: int, pivots: int = 0) -> DataFrame:
    """The kept columns with node, size, keys and (with pivots) counts, for each row; one pass, no shuffle.

    node: a hash of the text's whole shingle set, so texts of equal sets have equal nodes; NULL for a text without a
    shingle (NULL, empty or too short). size: number of distinct shingles. keys: a key for each band of the text's one-permutation
    signature. counts: number of shingles in each of the equal intervals of the hash space, capped at 255 (one byte each).
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [*[source.schema[c] for c in keep], T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType(), False))]
    if pivots:
        fields.append(T.StructField("counts", T.BinaryType()))
    schema = T.StructType(fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                offsets, hashes = shingle_sets(batch.column(len(keep)), words)
                size = np.diff(offsets)
                some = size > 0
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + np.uint64(0x51ED)), dtype=np.uint64)))
                node = mixed(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)).view(np.int64)
                key = bands(one_permutation(offsets, hashes, bins), band_rows).view(np.int64)
                per = key.shape[1]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * per))).astype(np.int32)), pa.array(key[some].reshape(-1)))
                columns = [*[batch.column(i) for i in range(len(keep))], pa.array(node, mask=~some), pa.array(size.astype(np.int32)), keys]
                if pivots:
                    owner = np.repeat(np.arange(len(size)), size)
                    part = ((hashes >> np.uint64(32)) * np.uint64(pivots)) >> np.uint64(32)
                    count = np.minimum(np.bincount(owner * pivots + part.astype(np.int64), minlength=len(size) * pivots), 255).astype(np.uint8)
                    step = np.arange(0, (len(size) + 1) * pivots, pivots, dtype=np.int32)
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(step), pa.py_buffer(count.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(sign, schema)


def similar(pairs: DataFrame, keep: list[str], text_a: str, text_b: str, *, words: int, least: float) -> DataFrame:
    """The kept columns and `similarity` of those pairs whose texts have at least the similarity, from the texts themselves."""
    source = pairs.select(*keep, F.col(text_a).alias("__a"), F.col(text_b).alias("__b"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("similarity", T.DoubleType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows = batch.num_rows
                oa, ha = shingle_sets(batch.column(len(keep)), words)
                ob, hb = shingle_sets(batch.column(len(keep) + 1), words)
                owner = np.concatenate((np.repeat(np.arange(rows), np.diff(oa)), np.repeat(np.arange(rows), np.diff(ob))))
                value = np.concatenate((ha, hb))
                order = np.lexsort((value, owner))
                owner, value = owner[order], value[order]
                same = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(owner[1:][same], minlength=rows) if len(owner) else np.zeros(rows, np.int64)
                union = np.diff(oa) + np.diff(ob) - common
                score = common / np.maximum(union, 1)
                good = pa.array((score >= least) & (union > 0))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(score)], names=schema.names).filter(good)

    return source.mapInArrow(verify, schema)
