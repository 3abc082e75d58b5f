"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed indicators of word n-grams and of n-grams over word shapes (runs of lower case, capitals, digits and
marks, and whether a word repeats the one before it). Their log-count ratios come from all labelled rows; the hinge-loss
model is fitted by dual coordinate descent on a bounded sample of them, in one task; scores are calibrated on a part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import chunks, join_small, mix64, text_bytes, unit_hash, word_hashes

#: Hashed features; the labelled rows that the model is fitted on, at most (about); the part of these that calibrates.
BITS, SAMPLE, CALIBRATE = 18, 10_000, 0.25
#: Pseudo-count of the ratios, cost of the hinge loss, epochs, and weight of the fitted model against plain naive Bayes.
ALPHA, COST, EPOCHS, BETA = 1.0, 0.1, 8, 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91], _SHAPE[48:58] = ord("A"), ord("0")


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct hashed features of each row, in no order."""
    stamp = np.zeros(1 << bits, np.int32)
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        text = data[int(part[0]) : int(part[-1])]
        local = part - part[0]
        words, at = word_hashes(text, local)
        shape = _SHAPE[text]
        keep = np.ones(len(text), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[local[:-1][local[:-1] < len(text)]] = True
        shapes, at_shapes = word_hashes(shape[keep], np.concatenate([[0], np.cumsum(keep)])[local])
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[at[:-1][at[:-1] < len(words)]] = False  # a row's first word follows none
        shapes = np.where(again, shapes ^ np.uint64(0x5DEECE66D), shapes) if len(shapes) == len(words) else shapes
        shift = np.uint64(64 - bits)
        for i in range(b - a):
            w, s = words[at[i] : at[i + 1]], shapes[at_shapes[i] : at_shapes[i + 1]]
            found = [w, mix64(w[:-1] * np.uint64(3) + w[1:]), mix64(s + np.uint64(7)), mix64(s[:-1] * np.uint64(5) + s[1:]), mix64((s[:-2] * np.uint64(7) + s[1:-1]) * np.uint64(9) + s[2:])]
            ids = (np.concatenate(found) >> shift).astype(np.int32)
            order = np.arange(len(ids), dtype=np.int32)
            stamp[ids] = order
            yield ids[stamp[ids] == order]


def ratios(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """counts: rows with each feature, for label 0 and 1. Log of the smoothed share in label 1 over that in label 0; 0 for unseen features."""
    p, q = counts[1] + alpha, counts[0] + alpha
    return np.where(counts.sum(axis=0) > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, beta: float = BETA) -> tuple[np.ndarray, float]:
    """Weights by feature, for indicators, and bias of the hinge-loss model, by dual coordinate descent. labels: -1 or 1."""
    w, bias, alphas = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in rows])
    norms = np.array([float((r[x] ** 2).sum()) for x in rows]) * scale**2 + 1.0
    upper = cost * np.where(labels > 0, len(labels) / max(1, 2 * (labels > 0).sum()), len(labels) / max(1, 2 * (labels < 0).sum()))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            x = rows[i]
            scaled = r[x] * scale[i]
            slope = labels[i] * (float(w[x] @ scaled) + bias) - 1
            new = min(max(alphas[i] - slope / norms[i], 0.0), upper[i])
            if new != alphas[i]:
                step = (new - alphas[i]) * labels[i]
                w[x] += step * scaled
                bias += step
                alphas[i] = new
    seen = w != 0
    return r * ((1 - beta) * (np.abs(w[seen]).mean() if seen.any() else 1.0) + beta * w), bias


def margins(rows: Iterator[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(weights[x].sum()) / np.sqrt(max(1, len(x))) + bias for x in rows])


def calibrated(m: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of the logistic curve from margins to the chance of label 1, by Newton's method; labels: -1 or 1."""
    good, bad = (labels > 0).sum(), (labels < 0).sum()
    if not good or not bad:
        return 1.0, 0.0
    t = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = m.std() or 1.0
    z, theta = np.stack([m / spread, np.ones(len(m))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2), z @ (p - t) + 1e-3 * theta)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-6) / spread, float(theta[1])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and shift from docs (doc_id, text) and labels (doc_id, quality 0 or 1; other rows are left out).

    Rows that held_out() names are not used. A document with both labels counts as 0. Without labels of both kinds every score is 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    rows = join_small(docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out()), known, "doc_id", "inner").select("text", "_label", unit_hash("doc_id").alias("_u"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labelled = batch.column(1).to_numpy(zero_copy_only=False)
            for ids, label in zip(features(*text_bytes(batch.column(0)), bits), labelled, strict=True):
                n[label][ids] += 1
                total[label] += 1
        seen = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen]), pa.array([int(total[0]), *n[0][seen]]), pa.array([int(total[1]), *n[1][seen]])], ["feature", "n0", "n1"])

    counts = rows.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # 2 ** bits rows at most
    feature, n = counts.column("feature").to_numpy(), np.stack([counts.column("n0").to_numpy(), counts.column("n1").to_numpy()])
    table = np.zeros((2, 1 << bits))
    table[:, feature[feature >= 0]] = n[:, feature >= 0]
    total = n[:, feature < 0].sum(axis=1) if len(feature) else np.zeros(2)
    if not total.all():
        return np.zeros(1 << bits), 0.0, 1.0, 0.0
    r = ratios(table)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: list[np.ndarray] = []
        ys: list[int] = []
        for batch in batches:
            xs += features(*text_bytes(batch.column(0)), bits)
            ys += batch.column(1).to_pylist()
        y = np.array(ys) * 2 - 1
        part = np.random.default_rng(11).random(len(y)) < CALIBRATE
        w, b = fit([x for x, p in zip(xs, part, strict=True) if not p], y[~part], r)
        slope, shift = calibrated(margins((x for x, p in zip(xs, part, strict=True) if p), w, b), y[part])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([b]), pa.array([slope]), pa.array([shift])], ["w", "b", "slope", "shift"])

    chosen = rows.filter(F.col("_u") < sample / max(1.0, float(total.sum()))).select("text", "_label").repartition(1)
    model = chosen.mapInArrow(solve, "w binary, b double, slope double, shift double").first()
    return np.frombuffer(model["w"], np.float32).astype(float), model["b"], model["slope"], model["shift"]


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text; any more columns are kept) with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    The score is a function of the whole text alone; a null or empty text gets that of no features. Columns of docs named like the added ones are replaced.
    """
    weights, bias, slope, shift = train(docs, labels, sample, bits)
    weights = weights.astype(np.float32)
    docs = docs.drop("held_out", "score", "predicted")
    flagged = docs.withColumn("held_out", held_out())
    names, last = [*flagged.columns, "score", "predicted"], len(flagged.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = margins(features(*text_bytes(batch.column(last)), bits), weights, bias)
            score = 1 / (1 + np.exp(-np.clip(slope * m + shift, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)

    schema = flagged.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return flagged.withColumn("_text", F.col("text").cast("string")).mapInArrow(run, schema)
