"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Features are the hashed n-grams (3 to 5 code points, lower-cased) present in a
text. Spark counts the labelled texts of each class that hold a feature; the
log-count ratio r = log((p + a) / |p| : (q + a) / |q|) scales the feature, and a
logistic regression with an L2 penalty is fitted on r times presence. Only the
``features`` with the largest likelihood-ratio statistic take part.

Training uses a bounded sample: at most ``train_rows`` labelled rows, those with
the smallest hash of their id. Counting and scoring run on Spark, the regression
over the sample on the driver: ``train_rows`` by ``features`` bounds its size.

Null and empty texts have no features and get the score of the intercept. An id
labelled several times counts as toxic if one label says so; null labels and ids
are ignored. Without rows of both classes every score is the class's share (0
without rows). A text repeated under several ids gets one score. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from treeline.llm.words import mixed

SIZES, BITS = (3, 4, 5), 18
FEATURES, TRAIN_ROWS, PENALTY, SMOOTHING = 2048, 20_000, 1.0, 1.0
_PIECE = 1 << 19  # code points hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """``weights`` by feature, zero for features left out."""

    weights: np.ndarray
    intercept: float


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """Stretches of the texts; they overlap, which presence does not see."""
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for start in range(0, len(low), _PIECE):
            yield row, low[start : start + _PIECE + SIZES[-1] - 1]


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    group, size = [], 0
    for row, piece in _pieces(texts):
        group.append((row, piece))
        size += len(piece)
        if size >= _PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _grams(group: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and feature of every n-gram."""
    lengths = np.array([len(piece) for _, piece in group])
    codes = np.frombuffer("".join(piece for _, piece in group).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.array([row for row, _ in group]), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # code points up to the piece's end
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        value = value[: len(codes) - n + 1] * _STEP + codes[n - 1 :]
        if n in SIZES and len(value):
            whole = left[: len(value)] >= n
            yield rows[: len(value)][whole], (mixed(value[whole]) >> np.uint64(64 - BITS)).astype(np.int64)


def _present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and features, of the wanted ones only where given."""
    found = [np.zeros(0, np.int64)]
    for group in _groups(texts):
        own = [np.zeros(0, np.int64)]  # a group may be too short for any n-gram
        for rows, features in _grams(group):
            if wanted is not None:
                keep = wanted[features]
                rows, features = rows[keep], features[keep]
            own.append((rows << BITS) | features)
        found.append(np.unique(np.concatenate(own)))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _sample(documents: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """``text, toxic`` of the training rows: fold 0 of the ids is held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    ).where(fold != 0)
    rows = documents.select("doc_id", "text").join(labelled, "doc_id", "left_semi").select("doc_id")
    chosen = rows.join(labelled, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic")
    )


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for start in range(0, len(batch), 128):
            part = batch[start : start + 128]
            rows, features = _present(part["text"].tolist())
            toxic = part["toxic"].to_numpy()[rows]
            for k in (0, 1):
                counts[k] += np.bincount(features[toxic == k], minlength=1 << BITS)
    used = np.flatnonzero(counts.sum(0))
    yield pd.DataFrame({"feature": used, "toxic": counts[1, used], "clean": counts[0, used]})


def _listed(wanted: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, features = _present(batch["text"].tolist(), wanted)
            cuts = np.searchsorted(rows, np.arange(1, len(batch)))
            yield pd.DataFrame({"toxic": batch["toxic"], "features": np.split(features, cuts)})

    return run


def _evidence(p: np.ndarray, q: np.ndarray, n_p: float, n_q: float) -> np.ndarray:
    """Likelihood-ratio statistic of presence against class."""
    def part(seen: np.ndarray, total: float, both: np.ndarray) -> np.ndarray:
        rate, expected = seen / total, both / (n_p + n_q)
        with np.errstate(divide="ignore", invalid="ignore"):
            yes = np.where(rate > 0, rate * np.log(rate / expected), 0)
            no = np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - expected)), 0)
        return total * (yes + no)

    return part(p, n_p, p + q) + part(q, n_q, p + q)


def _fit(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, toxic: np.ndarray, penalty: float):
    """Weights and intercept by Nesterov's gradient steps on the penalised mean log loss."""
    n, width = len(toxic), len(scale)
    x = scale[columns]
    def times(w):
        return np.bincount(rows, x * w[columns], n)
    # the largest eigenvalue of X'X/n bounds the curvature
    v = np.ones(width) / np.sqrt(width)
    for _ in range(12):
        v = np.bincount(columns, x * times(v)[rows], width)
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * (1.3 * top / n + 1) + penalty / n)
    w, b, ahead, ahead_b = np.zeros(width), 0.0, np.zeros(width), 0.0
    for k in range(400):
        wrong = 1 / (1 + np.exp(-(times(ahead) + ahead_b))) - toxic
        new = ahead - step * (np.bincount(columns, x * wrong[rows], width) + penalty * ahead) / n
        new_b = ahead_b - step * wrong.mean()
        push = k / (k + 3)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return w, b


def train(
    documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES,
    penalty: float = PENALTY,
) -> Model:
    """Fit on the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    sample = _sample(documents, labels, train_rows).persist()
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_q = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n_p or not n_q:
        share = n_p / max(1.0, n_p + n_q)
        sample.unpersist()
        return Model(np.zeros(1 << BITS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counted = sample.mapInPandas(_counts, "feature int, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).toPandas()  # at most 2^BITS rows
    feature = counted["feature"].to_numpy()
    p, q = counted["toxic"].to_numpy(float), counted["clean"].to_numpy(float)
    best = np.lexsort((feature, -_evidence(p, q, n_p, n_q)))[:features]
    feature, p, q = feature[best], p[best], q[best]
    ratio = np.log((p + SMOOTHING) / (n_p + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n_q + 2 * SMOOTHING))
    wanted = np.zeros(1 << BITS, bool)
    wanted[feature] = True
    listed = sample.mapInPandas(_listed(wanted), "toxic int, features array<int>").toPandas()  # the bounded sample
    sample.unpersist()
    place = np.zeros(1 << BITS, np.int64)
    place[feature] = np.arange(len(feature))
    each = [np.asarray(x, np.int64) for x in listed["features"]]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    columns = place[np.concatenate(each)] if len(rows) else np.zeros(0, np.int64)
    fitted, intercept = _fit(rows, columns, ratio, listed["toxic"].to_numpy(float), penalty)
    weights = np.zeros(1 << BITS)
    weights[feature] = fitted * ratio
    return Model(weights, float(intercept))


def _scorer(model: Model):
    wanted = model.weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, features = _present(batch.column("text").to_pylist(), wanted)
            total = model.intercept + np.bincount(rows, model.weights[features], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            others = [c for c in range(batch.num_columns) if batch.schema.names[c] != "text"]
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(score)], names=[*(batch.schema.names[c] for c in others), "score"]
            )

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row of ``documents (doc_id, text)``."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return slim.mapInArrow(_scorer(model), "doc_id long, score double")


def clean(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows with a score below the threshold, all columns as they were."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")
    schema = StructType(packed.schema.fields[:1]).add("score", "double")
    return packed.mapInArrow(_scorer(model), schema).where(F.col("score") < threshold).select("row.*")
