"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, pairs of words, and up to three word shapes in a row, where a repeated word
has a shape of its own) are scaled by the log ratio of their counts in the two classes, and a linear hinge-loss
model over them is fitted by dual coordinate descent. A logistic curve over margins of rows kept out of the fit,
weighted to the classes' shares among all labelled rows, makes margins into scores.

Fitted on at most SAMPLE labelled rows of each class, those with the smallest hash of their id; a row comes to the driver
as 32 kilobytes at most, however long its text. Scores read the
text alone. Null texts count as empty: they have no n-gram and get the score of the bias. Without labels every
score is 0.5; with labels of one class only, 0.99 or 0.01. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import _CODES, _PLACES, groups, mix, word_hashes

BITS = 18
#: Labelled rows of each class that the fit sees at most.
SAMPLE = 2500
THRESHOLD = 0.3
EPOCHS = 12
COST = 1.0
#: One in this many sampled rows is kept for the curve from margins to scores.
CALIBRATION = 4

_CLASS = np.arange(256)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REPEATED = np.uint64(0x5851F42D4C957F2D)
_STEP = 0xD1342543DE82EF95


def _shapes(texts: list[bytes]) -> np.ndarray:
    """A hash of each word's shape: its kinds of characters, runs of a kind taken once."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~_SPACE[raw]
    kind = _CLASS[raw]
    before = np.roll(kind, 1)
    starts = inside & ~np.roll(inside, 1)
    if len(inside) and inside[0]:
        starts[0] = True
    kept = inside & ((kind != before) | starts)
    codes = _CODES[kind[kept]]
    first = np.flatnonzero(starts[kept])
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    powers = np.cumprod(np.concatenate([[1], np.full(int(place.max()), _STEP, dtype=np.uint64)]).astype(np.uint64), dtype=np.uint64)
    return mix(np.add.reduceat(codes * powers[place], first))


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the places (0 to 2**BITS - 1) of its n-grams, each once."""
    out: list[np.ndarray] = []
    seen = np.zeros(1 << BITS, dtype=np.int64)
    shift = np.uint64(64 - BITS)
    for a, b in groups(texts):
        words, bounds = word_hashes(texts[a:b])
        shapes = _shapes(texts[a:b])
        again = np.zeros(len(words), dtype=bool)
        again[1:] = words[1:] == words[:-1]
        again[bounds[:-1][bounds[:-1] < len(words)]] = False
        shapes[again] = _REPEATED
        grams = [(words, 0)]
        for source, width, salt in ((words, 2, 1), (shapes, 1, 2), (shapes, 2, 3), (shapes, 3, 4)):
            if len(source) >= width:
                total = np.full(len(source) - width + 1, salt, dtype=np.uint64)
                for k in range(width):
                    total = total + source[k : len(source) - width + 1 + k] * _PLACES[k]
                grams.append((mix(total), width - 1))
        placed = [((g >> shift).astype(np.int64), short) for g, short in grams]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.concatenate([g[x : max(x, y - short)] for g, short in placed])
            order = np.arange(len(own))
            seen[own] = order
            out.append(own[seen[own] == order].astype(np.int32))
    return out


class Packed(Sequence):
    """Rows of places as bytes, unpacked when read: 32-bit numbers, or a bit for each place where that is shorter. So no row takes more than 2**BITS / 8 bytes, however long its text."""

    _BITMAP = (1 << BITS) // 8

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    @classmethod
    def pack(cls, places: np.ndarray) -> bytes:
        if 4 * len(places) < cls._BITMAP:
            return places.astype("<i4").tobytes()
        bits = np.zeros(1 << BITS, dtype=bool)
        bits[places] = True
        return np.packbits(bits).tobytes()

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.rows[i]
        if len(row) == self._BITMAP:
            return np.flatnonzero(np.unpackbits(np.frombuffer(row, dtype=np.uint8)))
        return np.frombuffer(row, dtype="<i4")

    def take(self, which: np.ndarray) -> Packed:
        return Packed([self.rows[i] for i in which])


@dataclass
class Model:
    """A weight for each place, a bias, and the curve 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(len(r) or 1) + self.bias for r in rows])

    def scores(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def _dual_descent(rows: Packed, values: np.ndarray, signs: np.ndarray, costs: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine: one dual variable at a time, in random order."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(len(values)), 0.0
    dual = np.zeros(len(rows))
    squares = np.array([(values[r] @ values[r]) / (len(r) or 1) + 1.0 for r in rows])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            own = rows[i]
            scaled = values[own] / np.sqrt(len(own) or 1)
            slope = signs[i] * (weights[own] @ scaled + bias) - 1
            new = min(max(dual[i] - slope / squares[i], 0.0), costs[i])
            if new != dual[i]:
                change = (new - dual[i]) * signs[i]
                weights[own] += change * scaled
                bias += change
                dual[i] = new
    return weights, bias


def fit(rows: Packed, labels: np.ndarray, shares: tuple[float, float]) -> Model:
    """``shares``: how common classes 0 and 1 are among all labelled rows."""
    good = labels == 1
    size = 1 << BITS
    if not len(rows) or good.all() or not good.any():
        level = 0.0 if not len(rows) else 4.6 if good.all() else -4.6
        return Model(np.zeros(size), 0.0, 0.0, level)
    held = np.arange(len(rows)) % CALIBRATION == 0
    if len({*labels[held]}) < 2 or len({*labels[~held]}) < 2:
        held = np.zeros(len(rows), dtype=bool)
    train = np.flatnonzero(~held)
    counts = [np.ones(size), np.ones(size)]
    for i in train:
        counts[int(good[i])][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] == 1) & (counts[1] == 1)] = 0
    signs = np.where(good, 1.0, -1.0)
    n = np.array([(~good[train]).sum(), good[train].sum()])
    costs = COST * len(train) / 2 / n[good[train].astype(int)]
    weights, bias = _dual_descent(rows.take(train), ratio, signs[train], costs)
    model = Model(weights * ratio, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    margin, target = model.margins(rows.take(check)), good[check].astype(float)
    weight = np.array(shares)[good[check].astype(int)] / np.bincount(good[check].astype(int), minlength=2)[good[check].astype(int)]
    weight *= len(check) / weight.sum()
    # Smoothed targets keep the curve finite where the classes part cleanly.
    target = np.where(target > 0, 1 - 1 / (good[check].sum() + 2), 1 / ((~good[check]).sum() + 2))
    a = np.array([1.0, 0.0])
    design = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * a
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a = a - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return Model(model.weights, bias, float(max(a[0], 0.0)), float(a[1]))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def indicator_column(text: str) -> Column:
    @F.pandas_udf("binary")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([Packed.pack(r) for r in indicators([encoded(t) for t in texts])], dtype=object)

    return column(F.col(text))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows outside of the held-out fold. Where an id has two labels, the lower counts; of its texts the smallest, so reruns agree."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    shares = dict(known.groupBy("quality").count().collect())  # two rows
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "quality", indicator_column("text").alias("r")).toPandas().sort_values("doc_id", kind="stable")
    total = sum(shares.values()) or 1
    # Order by a hash, so that the calibration rows are a fair part of either class.
    rows = rows.iloc[np.argsort(mix(rows["doc_id"].to_numpy().astype(np.uint64)), kind="stable")] if len(rows) else rows
    return fit(Packed([bytes(r) for r in rows["r"]]), rows["quality"].to_numpy(), (shares.get(0, 0) / total, shares.get(1, 0) / total))


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column of scores; the model (2**BITS weights, whatever the input's size) is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(Model(*shared.value).scores(indicators([encoded(t) for t in texts])))

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
