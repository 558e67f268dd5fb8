"""Quality scores by Bradley-Terry ranking on preference pairs.

A pair is a document labelled good beside one labelled bad. The logistic loss on the difference of their
features gives a weight vector, whose product with a document's features is its worth. The worth that cuts
off the labelled share of bad documents (a quantile of the sample's worths) becomes score ``threshold``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .langid import held_out
from .process import bounded_batches, keep_nothing


@dataclass(frozen=True)
class QualityConfig:
    """Bounds of the labelled sample and the pairs learnt from, and the score at the cut."""

    sample: int = 20_000
    pairs: int = 40_000
    knots: int = 8
    ridge: float = 1e-3
    steps: int = 10
    threshold: float = 0.3
    seed: int = 4


def _classes() -> np.ndarray:
    """Byte kinds: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 space, 5 newline, 6 . or , 7 other ASCII signs, 8 not ASCII."""
    kind = np.zeros(256, np.int8)
    kind[33:127] = 7
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 3
    kind[[32, 9, 13]], kind[10], kind[[44, 46]], kind[128:] = 4, 5, 6, 8
    return kind


_KIND = _classes()
N_FEATURES = 22


def features(column: pa.Array) -> np.ndarray:
    """One row of measurements for each text: its shape, its signs, and how far it repeats itself."""
    out = np.zeros((len(column), N_FEATURES))
    for row, end, data, at in W.chunks(column):
        n, size = end - row, np.diff(at).astype(float)
        some, least = out[row:end], np.maximum(size, 1)
        kind = _KIND[data]
        doc = np.repeat(np.arange(n), np.diff(at))
        shares = np.bincount(doc * 9 + kind, minlength=9 * n).reshape(n, 9) / least[:, None]
        some[:, 0] = np.log1p(size)
        some[:, 1:10] = shares
        words = W.split(data, at)
        many = np.maximum(np.diff(words.first), 1)
        length = (words.end - words.start).astype(float)
        mean = np.bincount(words.doc, length, n) / many
        some[:, 10] = mean
        some[:, 11] = np.sqrt(np.maximum(np.bincount(words.doc, length**2, n) / many - mean**2, 0))
        some[:, 12] = np.log1p(np.diff(words.first))
        hashes = W.word_hashes(words)
        order = np.lexsort((hashes, words.doc))
        again = np.zeros(len(order), bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])
        some[:, 13] = np.bincount(words.doc[order], again, n) / many
        # Pairs of neighbouring words that the text has had before.
        if len(hashes) > 1:
            pair, whose = W.mix(hashes[:-1] * np.uint64(3) + hashes[1:]), words.doc[:-1]
            order = np.lexsort((pair, whose))
            again = np.zeros(len(order), bool)
            again[1:] = (pair[order][1:] == pair[order][:-1]) & (whose[order][1:] == whose[order][:-1])
            some[:, 14] = np.bincount(whose[order], again, n) / many
        last, first = kind[words.end - 1], kind[words.start]
        some[:, 15] = np.bincount(words.doc, last == 7, n) / many
        some[:, 16] = np.bincount(words.doc, first == 1, n) / many
        some[:, 17] = np.bincount(words.doc, (first == 7) & (words.end - words.start == 1), n) / many
        same = np.zeros(len(data), bool)
        same[1:] = (data[1:] == data[:-1]) & (doc[1:] == doc[:-1])
        some[:, 18] = np.bincount(doc, same, n) / least
        some[:, 19] = np.bincount(doc, same & (kind == 7), n) / least
        lines = W.split(data, at, _LINE)
        some[:, 20] = np.log1p(np.diff(lines.first))
        marks = W.word_hashes(lines)
        order = np.lexsort((marks, lines.doc))
        again = np.zeros(len(order), bool)
        again[1:] = (marks[order][1:] == marks[order][:-1]) & (lines.doc[order][1:] == lines.doc[order][:-1])
        some[:, 21] = np.bincount(lines.doc[order], again, n) / np.maximum(np.diff(lines.first), 1)
    return out


_LINE = np.ones(256, bool)
_LINE[10] = False


@dataclass
class BradleyTerry:
    """Worths from features that are bent at some of their quantiles."""

    centre: np.ndarray
    spread: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float

    def _bent(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.hstack([x, np.maximum(x[:, None, :] - self.knots, 0).reshape(len(x), -1)])

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self._bent(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``threshold`` at the cut."""
        shift = math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.cut + shift, -40, 40)))

    @classmethod
    def learn(cls, x: np.ndarray, good: np.ndarray, config: QualityConfig) -> BradleyTerry:
        """Without both kinds of labels there is no pair: all worths are 0, above the cut if any is good."""
        centre = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        spread = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        spread[spread < 1e-9] = 1
        z = np.clip((x - centre) / spread, -8, 8) if len(x) else np.zeros((1, N_FEATURES))
        knots = np.quantile(z, np.linspace(0.02, 0.98, config.knots), axis=0)
        model = cls(centre, spread, knots, np.zeros(N_FEATURES * (1 + config.knots)), 0.0, config.threshold)
        if good.all() or not good.any():
            model.cut = 0.0 if good.any() or not len(good) else 1.0
            return model
        rng = np.random.default_rng(config.seed)
        bent = model._bent(x)
        win, lose = (rng.choice(np.flatnonzero(k), config.pairs) for k in (good, ~good))
        w, width = model.weights, bent.shape[1]
        for _ in range(config.steps):  # Newton's method on the mean logistic loss
            step, curve = config.ridge * w, config.ridge * np.eye(width)
            for b in range(0, config.pairs, 20_000):
                d = bent[win[b : b + 20_000]] - bent[lose[b : b + 20_000]]
                p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
                step -= d.T @ p / config.pairs
                curve += (d.T * (p * (1 - p))) @ d / config.pairs
            change = np.linalg.solve(curve, step)
            w = w - change
            if np.abs(change).max() < 1e-4:
                break
        model.weights = w
        worth = np.sort(bent @ w)
        # The quantile at the share of bad labels, half way to the next worth.
        bad = int((~good).sum())
        model.cut = float((worth[bad - 1] + worth[bad]) / 2)
        return model


def learn_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> BradleyTerry:
    """Learn from at most about ``sample`` labelled documents, taken by a hash of the id.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); null labels are left out, and a document with
    several labels counts as good if one of them is. Only the sample's ids and features leave the executors.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > config.sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(config.sample / n * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), lists], names=["doc_id", "quality", "x"])

    got = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = got.column("x").combine_chunks().values.to_numpy().reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy()))
    return BradleyTerry.learn(x[order], got.column("quality").to_numpy()[order] == 1, config)


def quality_scores(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """``doc_id, score, predicted`` for every row; a null text is scored as an empty one."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            score = sent.value.score(features(batch.column("text")))
            predicted = (score >= sent.value.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(predicted)], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Learn from the labels that are not held out and score every document."""
    model = learn_quality(docs, labels.where(~held_out(5, 0)), config)
    return quality_scores(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
