"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled texts are a sample of
all, whatever their labels, so that their share of toxic texts is the prior. The risk of a classifier g with class prior p is estimated as

    p * mean_P loss(g) + max(0, mean_U loss(-g) - p * mean_P loss(-g))

and where the second part falls below zero, the step goes the other way, which
keeps the fit from calling unlabelled positives negative. The model is linear
over hashed words and word beginnings, trained with numpy on a bounded sample;
scoring reads every text once, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import ship, text_of

ship(__name__)

FEATURES = 1 << 18
#: Leading bytes of a word that are a feature of their own.
STEMS = (4, 5, 6)
SAMPLE = {"positive": 3000, "unlabelled": 9000}
#: Bytes as letters: A-Z in lower case, what is neither letter nor digit is a blank.
LETTERS = np.frombuffer(
    bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256)), np.uint8
)
ODD, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK = 4 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text, feature``: numbers of the words and word beginnings of joined texts, repeats included.

    A word's number is that of its bytes weighed by powers of an odd number, a
    beginning's that of its bytes in a row.
    """
    data = np.concatenate((LETTERS[data], np.full(8, 32, np.uint8)))
    letter = data != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    first[inner] = letter[inner]  # a text's first letter begins a word, whatever ends the text before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    power = np.empty(len(data), np.uint64)
    power[0] = 1
    power[1:] = np.uint64(ODD)
    power = np.cumprod(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    back = np.empty(len(data), np.uint64)
    back[0] = 1
    back[1:] = np.uint64(BACK)
    number = (total[ends] - total[starts]) * np.cumprod(back)[starts]
    owner = np.searchsorted(offsets, starts, "right") - 1
    texts, found = [owner], [number]
    stem, size = np.zeros(len(starts), np.uint64), ends - starts
    for k in range(STEMS[-1]):
        stem = stem << np.uint64(8) | data[starts + np.minimum(k, size - 1)].astype(np.uint64)
        if k + 1 in STEMS:
            long_ = size > k + 1
            texts.append(owner[long_])
            found.append(stem[long_] * np.uint64(BACK) + np.uint64(k))
    numbers = np.concatenate(found)
    numbers ^= numbers >> np.uint64(31)
    numbers *= np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(texts), (numbers >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``from, to, bytes, offsets`` of the second, binary column, some megabytes at a time."""
    array = batch.column(1)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in _parts(batch):
            texts, numbers = features(data, offsets)
            keys = np.unique(texts * FEATURES + numbers)
            counts = np.bincount(keys // FEATURES, minlength=to - at)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array((keys % FEATURES).astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], ["positive", "features"])


class Sparse:
    """Rows of feature numbers, all of value one."""

    def __init__(self, rows: list):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
        self.rows = np.repeat(np.arange(len(rows)), self.sizes)

    def keep(self, used: np.ndarray) -> None:
        """Leave only the features of ``used``, numbered by their place in it."""
        place = np.full(FEATURES, -1)
        place[used] = np.arange(len(used))
        mapped = place[self.flat]
        self.flat, self.rows = mapped[mapped >= 0], self.rows[mapped >= 0]

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weight[self.flat], len(self.sizes))

    def back(self, slope: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, slope[self.rows], width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list, unlabelled: list, prior: float, rounds: int = 150, rate: float = 0.05, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, by Adam over whole passes.

    Features are scaled by how much more often the positives have them than the
    prior-corrected rest, so frequent neutral words carry no weight. Without
    positives the weights are zero and the score is the prior everywhere.
    """
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(FEATURES), bias
    p, u = Sparse(positive), Sparse(unlabelled)
    in_p = (np.bincount(p.flat, minlength=FEATURES) + 0.5) / (len(positive) + 1)
    in_u = (np.bincount(u.flat, minlength=FEATURES) + 0.5) / (len(unlabelled) + 1)
    in_n = np.maximum((in_u - prior * in_p) / (1 - prior), 0.5 / (len(unlabelled) + 1))
    scale = np.log(in_p / in_n)
    scale[(np.bincount(p.flat, minlength=FEATURES) < 3) & (scale > 0)] = 0.0  # too rare to tell
    scale[np.abs(scale) < 1.0] = 0.0
    used = np.flatnonzero(scale)
    if not len(used):
        return np.zeros(FEATURES), bias
    p.keep(used)
    u.keep(used)
    scale, width = scale[used], len(used)
    weight, moment, square = np.full(width, 0.1), np.zeros(width), np.zeros(width)
    b, mb, sb = bias, 0.0, 0.0
    for t in range(1, rounds + 1):
        w = weight * scale
        gp, gu = p.dot(w) + b, u.dot(w) + b
        sp, su = sigmoid(gp), sigmoid(gu)
        # logistic loss: slope of loss(g) is s - 1, of loss(-g) is s
        rest = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
        slope_p, slope_u = prior * (sp - 1) / len(sp), np.zeros_like(su)
        if rest >= 0:
            slope_p = slope_p - prior * sp / len(sp)
            slope_u = su / len(su)
        else:
            slope_p, slope_u = prior * sp / len(sp), -su / len(su)
        grad = (p.back(slope_p, width) + u.back(slope_u, width)) * scale + decay * weight / width
        gb = slope_p.sum() + slope_u.sum()
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb ** 2
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        weight -= rate * (moment / c1) / (np.sqrt(square / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    whole = np.zeros(FEATURES)
    whole[used] = weight * scale
    return whole, b


def estimate_prior(labels: DataFrame, label: str, pseudo: float = 1.0) -> float:
    """Share of label 1 among the labels, smoothed to stay inside 0 and 1."""
    n, ones = labels.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    return (ones + pseudo) / (n + 20 * pseudo)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, prior: float | None, sample: dict[str, int], seed: int):
    """Model from confirmed positives and from all rows, taken as unlabelled, in seeded hash order up to the bounds of ``sample``."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_k")).agg(F.max(label).alias("_y"))
    p = estimate_prior(known, "_y") if prior is None else prior
    ids = docs.select(F.col(doc_id).alias("_d")).where("_d is not null").distinct()
    order = F.xxhash64(F.lit(seed), "_d")
    positive = ids.join(known.where("_y = 1"), F.col("_d") == F.col("_k"), "left_semi")
    chosen = [
        of.orderBy(order, "_d").limit(sample[name]).withColumn("positive", F.lit(name == "positive"))
        for of, name in ((positive, "positive"), (ids, "unlabelled"))
    ]
    # at most as many rows as the sample has
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.join(picked, docs[doc_id] == picked["_d"]).select("positive", text_of(text).cast("binary").alias("text"))
    rows = texts.mapInArrow(_feature_rows, "positive boolean, features array<int>").toArrow()
    flags, lists = rows["positive"].to_numpy(zero_copy_only=False), rows["features"].to_numpy(zero_copy_only=False)
    return fit([x for x, y in zip(lists, flags) if y], [x for x, y in zip(lists, flags) if not y], p)


def score_texts(
    docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    prior: float | None = None, threshold: float = 0.3, sample: dict[str, int] | None = None, seed: int = 11,
) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    The model is learned from ``learn_docs`` and the labels of them; ``sample``
    bounds how many positives and unlabelled rows are fitted. ``prior`` is the
    share of toxic texts, by default that among the labels. A null or empty text
    scores the bias alone. Labels with a null id or value are left out; of
    several of a document the highest counts. Without positives every score is
    the prior. An empty table gives no row; further columns are not looked at.
    """
    weight, bias = learn(learn_docs, labels, doc_id, text, label, prior, SAMPLE | (sample or {}), seed)
    model = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias))  # as many numbers as there are features

    def run(batches):
        w, b = model.value
        for batch in batches:
            raw = [np.empty(0)]
            for at, to, data, offsets in _parts(batch):
                texts, numbers = features(data, offsets)
                known = w[numbers] != 0
                keys = np.unique(texts[known] * FEATURES + numbers[known])
                raw.append(np.bincount(keys // FEATURES, w[keys % FEATURES], to - at) + b)
            score = sigmoid(np.concatenate(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["_id", "score", "predicted"]
            )

    key = docs.select(F.col(doc_id).alias("_id"), text_of(text).cast("binary").alias("_text"))
    return key.mapInArrow(run, f"_id {key.schema['_id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("_id", doc_id)
