"""Languages of documents and of their stretches (problem 8).

A bidirectional gated recurrent network over bytes labels every position of a text; positions are pooled to sentences
and documents. It is trained on a bounded sample of the labelled rows, labels of which some are wrong: after a first fit, rows of the
sample that contradict it are left out and it is fitted further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm import gru

LANGUAGES = ("ar", "de", "en", "es", "fr", "tl", "ur")


@dataclass(frozen=True)
class Settings:
    """train_rows: labelled rows of each language in the sample, the whole bound of what is fitted on. train_bytes: bytes drawn from one at a time.

    switch: by how much (natural log, summed over positions) a sentence must speak for another language to begin a stretch of its own.
    """

    languages: tuple[str, ...] = LANGUAGES
    hidden: int = 16
    embed: int = 8
    features: int = 32
    stride: int = 4
    train_rows: int = 150
    train_steps: int = 900
    train_batch: int = 112
    train_bytes: int = 160
    window: int = 96
    margin: int = 4
    switch: float = 25.0
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    weights: gru.Weights = field(default_factory=dict)


# Bytes as the network sees them: capitals as small letters, digits as one, white space as one.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[48:58] = 48
_SEEN[[9, 10, 11, 12, 13]] = 32


def label_code(c: Column) -> Column:
    """The leading language code of a label in small letters; NULL if there is none (NULL, blank, und, unknown)."""
    code = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(~code.isin("", "und", "unknown"), code)


def without_tags(texts: pa.Array) -> pa.Array:
    """A tag or address reads as a line break, so that it never joins two sentences and says nothing of the language."""
    return pc.replace_substring_regex(texts.cast(pa.large_string()), "<[^>]*>|https?://\\S+", "\n")


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, texts.offset * 8) if rows else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    return offsets - low, np.frombuffer(texts.buffers()[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)


def _marks(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ends): letters that count (none in brackets), and the bytes at which a sentence ends."""
    n = len(data)
    nxt = np.concatenate((data[1:], [10])).astype(np.uint8)
    prev = np.concatenate(([10], data[:-1])).astype(np.uint8)
    last = np.ones(n, bool)
    last[:-1] = row[1:] != row[:-1]
    after = last | (nxt == 32) | (nxt == 10) | (nxt == 13) | (nxt == 9) | (nxt == 34) | (nxt == 0xC2) | (nxt == 0xE2)
    stop = np.isin(data, (46, 33, 63)) & after
    stop |= (data == 10) | ((data == 0x94) & (prev == 0xDB)) | ((data == 0x9F) & (prev == 0xD8))
    stop |= last
    step = (data == 40).astype(np.int32) - (data == 41).astype(np.int32)
    depth = np.cumsum(step)
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if n else np.zeros(0, np.int64)
    base = np.zeros(n, np.int32)
    if n:
        base = np.repeat(depth[start] - step[start], np.diff(np.append(start, n)))
    inside = (depth - base > 0) | (data == 41)
    # A bracket that is never closed hides nothing.
    if n:
        end_depth = depth[np.append(start[1:], n) - 1] - base[start]
        inside &= np.repeat(end_depth == 0, np.diff(np.append(start, n)))
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0x80)
    return letter & ~inside, stop


def _windows(offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first step, number of steps, row) of every window; windows of a text begin at its first byte."""
    steps = -(-np.diff(offsets) // s.stride)
    count = -(-steps // s.window)
    row = np.repeat(np.arange(len(steps)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * s.window
    return first, np.minimum(s.window, steps[row] - first), row


def positions(model: Model, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities of every step, offsets of each text's steps). What a text gets does not depend on its neighbours."""
    s = model.settings
    steps = -(-np.diff(offsets) // s.stride)
    step_at = np.concatenate(([0], np.cumsum(steps)))
    out = np.zeros((step_at[-1], len(s.languages)), np.float32)
    first, count, row = _windows(offsets, s)
    seen = np.concatenate((_SEEN[data], np.full(1, 32, np.uint8)))
    # Windows of one padded length go through together.
    padded = np.minimum(-(-count // 8) * 8, s.window)
    for length in np.unique(padded):
        chosen = np.flatnonzero(padded == length)
        for part in np.array_split(chosen, -(-len(chosen) // 768)):
            total = int(length) + 2 * s.margin
            at = (first[part, None] - s.margin) * s.stride - 1 + np.arange(total * s.stride + 2)
            lo, hi = offsets[row[part]], offsets[row[part] + 1]
            place = at + lo[:, None]
            place[(at < 0) | (place >= hi[:, None])] = len(seen) - 1
            p = gru.log_probabilities(model.weights, seen[place], s.stride)[s.margin : s.margin + int(length)]
            step = np.arange(int(length))[:, None]
            ok = step < count[part][None, :]
            target = step_at[row[part]][None, :] + first[part][None, :] + step
            out[target[ok]] = p.transpose(0, 2, 1)[ok]
    return out, step_at


def _best_path(score: np.ndarray, switch: float) -> np.ndarray:
    """The most likely languages of a text's sentences when every change costs `switch`."""
    n, k = score.shape
    best, back = score[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch
        stay = best >= jump
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + score[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def stretches(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: (row, seg_no, language number, confidence) of each stretch, and (language, confidence) of each text, -1 where it has no letter."""
    s = model.settings
    k = len(s.languages)
    offsets, data = _buffer(without_tags(texts))
    rows = len(offsets) - 1
    lang, sure = np.full(rows, -1), np.zeros(rows)
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, none, np.zeros(0), lang, sure
    row = np.repeat(np.arange(rows), np.diff(offsets))
    letter, stop = _marks(data, row)
    logp, step_at = positions(model, offsets, data)
    # A step counts by the letters it holds, for the sentence of its middle byte.
    sentence = np.cumsum(np.concatenate(([0], stop[:-1].astype(np.int64))))
    begin = (np.arange(step_at[-1]) - np.repeat(step_at[:-1], np.diff(step_at))) * s.stride + np.repeat(offsets[:-1], np.diff(step_at))
    ends = np.repeat(offsets[1:], np.diff(step_at))
    size = np.concatenate(([0], np.cumsum(letter)))
    weight = (size[np.minimum(begin + s.stride, ends)] - size[begin]) / s.stride
    middle = sentence[np.minimum(begin + s.stride // 2, ends - 1)]
    number = int(sentence[-1]) + 1
    score = np.stack([np.bincount(middle, logp[:, j] * weight, number) for j in range(k)], 1)
    mass = np.stack([np.bincount(middle, np.exp(logp[:, j]) * weight, number) for j in range(k)], 1)
    letters = np.bincount(middle, weight, number)
    owner = row[np.flatnonzero(stop)] if stop[-1] else np.append(row[np.flatnonzero(stop)], row[-1])
    real = letters > 0
    score, mass, letters, owner = score[real], mass[real], letters[real], owner[real]
    if len(owner) == 0:
        return none, none, none, np.zeros(0), lang, sure
    top = score.argmax(1)
    begin_ = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    finish = np.append(begin_[1:], len(owner))
    total = np.add.reduceat(score, begin_)
    texts_of = owner[begin_]
    path = np.repeat(total.argmax(1), finish - begin_)
    # Where each sentence prefers the text's language, so does the best path; the others are few.
    differs = np.add.reduceat((top != path).astype(np.int64), begin_) > 0
    for i in np.flatnonzero(differs):
        path[begin_[i] : finish[i]] = _best_path(score[begin_[i] : finish[i]], s.switch)
    cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])))
    seg = np.flatnonzero(cut)
    seg_row, seg_lang = owner[seg], path[seg]
    seg_mass = np.add.reduceat(mass, seg)
    confidence = seg_mass[np.arange(len(seg)), seg_lang] / np.maximum(np.add.reduceat(letters, seg), 1e-9)
    first = np.concatenate(([True], seg_row[1:] != seg_row[:-1]))
    number_ = np.arange(len(seg)) - np.maximum.accumulate(np.where(first, np.arange(len(seg)), 0)) + 1
    pooled = np.add.reduceat(mass, begin_)
    main = pooled.argmax(1)
    lang[texts_of] = main
    sure[texts_of] = pooled[np.arange(len(main)), main] / np.maximum(np.add.reduceat(letters, begin_), 1e-9)
    return seg_row, number_, seg_lang, confidence, lang, sure


def train(sample: list[tuple[str, str]], s: Settings) -> Model:
    """A model of (text, language code) rows; rows of other codes are ignored. Deterministic for the same rows and settings."""
    sample = sorted((t, c) for t, c in sample if t and c in s.languages)
    model = Model(s, gru.init(len(s.languages), hidden=s.hidden, embed=s.embed, stride=s.stride, features=s.features, seed=s.seed))
    if not sample:
        return model
    offsets, data = _buffer(without_tags(pa.array([t for t, _ in sample])))
    row = np.repeat(np.arange(len(sample)), np.diff(offsets))
    letter = _marks(data, row)[0] if len(data) else np.zeros(0, bool)
    seen = np.concatenate((_SEEN[data], np.full(1, 32, np.uint8)))
    letter = np.concatenate((letter, [False]))
    label = np.array([s.languages.index(c) for _, c in sample])
    rnd = np.random.default_rng(s.seed)
    length = -(-s.train_bytes // s.stride) * s.stride
    good = np.diff(offsets) > 0

    steps = length // s.stride
    stops = np.flatnonzero(_marks(data, row)[1]) + 1 if len(data) else np.zeros(0, np.int64)
    stop_at = np.searchsorted(stops, offsets, side="right")  # stops[stop_at[i] : stop_at[i + 1]] end the sentences of text i

    def pick(size: int) -> np.ndarray:
        lists = [x for x in (np.flatnonzero(good & (label == k)) for k in range(len(s.languages))) if len(x)]
        return np.array([rnd.choice(lists[i]) for i in rnd.integers(0, len(lists), size)])

    def sentence_end(text: np.ndarray) -> np.ndarray:
        count = stop_at[text + 1] - stop_at[text]
        return stops[stop_at[text] + (rnd.random(len(text)) * count).astype(np.int64)]

    def draw(_: int):
        # Each window has two texts: one runs up to the end of a sentence, another begins there with a sentence of its own.
        a, b = pick(s.train_batch), pick(s.train_batch)
        split = rnd.integers(-steps // 2, steps + steps // 2, s.train_batch).clip(0, steps)
        end = sentence_end(a)
        begin = np.where(rnd.random(s.train_batch) < 0.3, offsets[b], sentence_end(b))
        begin = np.where(begin >= offsets[b + 1], offsets[b], begin)
        left = np.arange(-1, length + 1) < (split * s.stride)[:, None]
        owner = np.where(left, a[:, None], b[:, None])
        place = np.arange(-1, length + 1) - (split * s.stride)[:, None] + np.where(left, end[:, None], begin[:, None])
        place[(place >= offsets[owner + 1]) | (place < offsets[owner])] = len(seen) - 1
        weight = letter[place[:, 1:-1]].reshape(s.train_batch, -1, s.stride).mean(2).T
        return seen[place], label[owner[:, 1:-1][:, :: s.stride]].T, weight

    gru.fit(model.weights, draw, steps=s.train_steps // 2, stride=s.stride)
    texts = pa.array([t for t, _ in sample])
    row_, _, lang_, _, _, _ = stretches(model, texts)
    several = np.bincount(row_, minlength=len(sample)) > 1
    only = np.full(len(sample), -1)
    only[row_] = lang_
    agree = (only == label) & ~several & good
    for k in range(len(s.languages)):  # a language that the first fit has not learnt keeps its rows
        if agree[label == k].sum() < 0.5 * (label == k).sum():
            agree |= (label == k) & (np.diff(offsets) > 0)
    good = agree
    gru.fit(model.weights, draw, steps=s.train_steps - s.train_steps // 2, stride=s.stride, rate=0.006)
    return model


def sample_of(df: DataFrame, key: str, text: str, label: str, s: Settings) -> list[tuple[str, str]]:
    """At most train_rows rows of each language, whole, by the least hash of the key; only their keys are ranked, partly before the shuffle."""
    coded = df.select(F.col(key).alias("id"), label_code(F.col(label)).alias("code")).where(F.col("code").isin(*s.languages)).distinct()
    ranked = coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= s.train_rows)
    chosen = F.broadcast(ranked.select("id", "code"))  # train_rows for each language at most
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id").select("text", "code").collect()
    return [(r.text, r.code) for r in rows]


def labelled(df: DataFrame, key: str, text: str, keep: list[str], model: Model) -> DataFrame:
    """One row for each stretch: key, kept columns, lang and confidence of the text, segments, seg_no, seg_lang, seg_confidence.

    A text without a letter (NULL, empty, digits only) has one row with NULL languages, confidence 0, segments 0 and seg_no NULL.
    Whole texts are read. Rows given twice come out twice. No shuffle.
    """
    source = df.select(F.col(key).alias(key), *[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    names = [key, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema += ", lang string, confidence double, segments int, seg_no int, seg_lang string, seg_confidence double"
    codes = np.array([*model.settings.languages, None], object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, number, lang, sure, doc_lang, doc_sure = stretches(model, batch.column(len(names)))
                segments = np.bincount(row, minlength=batch.num_rows)
                empty = np.flatnonzero(segments == 0)
                every = np.concatenate((row, empty))
                order = np.argsort(every, kind="stable")
                take = pa.array(every[order])
                blank = np.concatenate((np.zeros(len(row), bool), np.ones(len(empty), bool)))[order]

                def filled(x, size=len(empty), order=order):
                    return np.concatenate((x, np.zeros(size, x.dtype)))[order]

                seg_lang = codes[np.where(blank, len(codes) - 1, filled(lang.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(take) for i in range(len(names))],
                        pa.array(codes[doc_lang[every[order]]], pa.string()),
                        pa.array(doc_sure[every[order]]),
                        pa.array(segments[every[order]].astype(np.int32)),
                        pa.array(filled(number.astype(np.int64)).astype(np.int32), mask=blank),
                        pa.array(seg_lang, pa.string()),
                        pa.array(filled(sure.astype(float)), mask=blank),
                    ],
                    names=[*names, "lang", "confidence", "segments", "seg_no", "seg_lang", "seg_confidence"],
                )

    return source.mapInArrow(label, schema)


def identify(df: DataFrame, key: str, text: str, label: str, settings: Settings | None = None) -> DataFrame:
    """labelled() by a model trained on a bounded sample of df's own labelled rows, with the label's code as `given`."""
    s = settings or Settings()
    model = train(sample_of(df, key, text, label, s), s)
    return labelled(df.select(key, text, label_code(F.col(label)).alias("given")), key, text, ["given"], model)
