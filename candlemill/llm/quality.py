"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17  # hashed n-gram indicators
FIT_ROWS = 12_000  # bound on the labelled rows that the classifier is fitted on
EPOCHS = 12
COST = 1.0
BETA = 0.75  # share of the fitted weights, against their mean size
_HASH = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 22  # bytes hashed at once
MODEL = "scale binary, weight binary, slope double, offset double"


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Slots of the byte 2-grams and 3-grams of a whole text; ``seen`` is an all-false scratch array."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for k in range(0, len(data), _PIECE):
        piece = data[k : k + _PIECE + 2].astype(np.uint64)
        two = (piece[:-1] << np.uint64(8)) | piece[1:]
        three = (two[:-1] << np.uint64(8)) | piece[2:]
        for code in (two | np.uint64(1 << 32), three):
            seen[(code * _HASH) >> np.uint64(64 - SLOTS.bit_length() + 1)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, epochs: int, cost: float) -> np.ndarray:
    """Dual coordinate descent for the linear hinge loss on unit-length scaled indicators.

    The last weight belongs to a constant feature of 1.
    """
    w = np.zeros(SLOTS + 1)
    alpha = np.zeros(len(rows))
    values = []
    for x in rows:
        v = scale[x]
        values.append(v / (math.sqrt(float(v @ v)) or 1.0))
    order = np.random.default_rng(7)
    # each class counts alike in the loss
    share = np.array([max((y == s).mean(), 1e-9) for s in (-1, 1)])
    most = {s: cost * 0.5 / share[k] for k, s in enumerate((-1, 1))}
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v, s = rows[i], values[i], y[i]
            gradient = s * (float(w[x] @ v) + w[SLOTS]) - 1.0
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), most[int(s)])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * s * v
                w[SLOTS] += step * s
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through ``margin`` by Newton steps, targets smoothed."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def _margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, x in enumerate(rows):
        v = scale[x]
        out[i] = float(w[x] @ v) / (math.sqrt(float(v @ v)) or 1.0) + w[SLOTS]
    return out


def fit_rows(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, beta: float = BETA):
    """(scale, weight, slope, offset) from slots per row and labels 0 or 1.

    Log-count ratios scale the indicators; one row in five only sets the curve from margins to
    scores. With one class or none the score is the smoothed share of label 1.
    """
    y = np.where(labels > 0, 1, -1)
    scale, w = np.zeros(SLOTS), np.zeros(SLOTS + 1)
    if len(set(y.tolist())) < 2:
        return scale, w, 1.0, math.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1))
    count = {1: np.ones(SLOTS), -1: np.ones(SLOTS)}
    for x, s in zip(texts, y, strict=True):
        count[int(s)][x] += 1
    scale = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    w = _descend([x for x, h in zip(texts, held, strict=True) if not h], y[~held], scale, epochs, cost)
    size = np.abs(w[:SLOTS]).mean()
    w[:SLOTS] = (1 - beta) * size + beta * w[:SLOTS]
    rest = held if held.any() else ~held
    slope, offset = _sigmoid_fit(_margins([x for x, h in zip(texts, rest, strict=True) if h], scale, w), y[rest])
    return scale, w, slope, offset


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", fit: int = FIT_ROWS
) -> DataFrame:
    """At most ``fit`` labelled texts, chosen by a hash of the id: ``text, label`` in that order.

    Null ids and labels are left out, and so are ids whose labels disagree; of repeated ids one
    text is taken.
    """
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(doc_id).agg(F.min(label).alias("_y"), F.max(label).alias("_most"))
        .where(F.col("_y") == F.col("_most"))
        .select(F.col(doc_id).alias("_id"), "_y", F.xxhash64(doc_id, F.lit(4)).alias("_order"))
        .orderBy("_order", "_id").limit(fit)
    )
    return (
        docs.select(doc_id, text).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))  # at most ``fit`` rows
        .groupBy("_order", "_id", "_y").agg(F.min(text).alias("text"))
        .select("_order", "text", F.col("_y").alias("label"))
    )


def _packed(fitted) -> tuple[bytes, bytes, float, float]:
    scale, w, slope, offset = fitted
    return scale.tobytes(), w.tobytes(), slope, offset


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    fit: int = FIT_ROWS,
):
    """Fit on a bounded sample of labelled rows, in one task; returns a row of ``MODEL``."""

    def run(batches):
        seen = np.zeros(SLOTS, bool)
        held = []
        for batch in batches:
            for order, whole, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append((order, indicators(whole, seen).astype(np.int32), y))
        held.sort(key=lambda h: h[0])
        packed = _packed(fit_rows([h[1] for h in held], np.array([h[2] for h in held])))
        kinds = [pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(packed, kinds, strict=True)], ["scale", "weight", "slope", "offset"]
        )

    sample = labelled_sample(docs, labels, label, text, doc_id, fit)
    found = sample.select("_order", "text", "label").coalesce(1).mapInArrow(run, MODEL).first()
    if found is None:  # no labelled row
        return dict(zip(("scale", "weight", "slope", "offset"), _packed(fit_rows([], np.zeros(0))), strict=True))
    return found


def score(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is, from the whole text, 0 to 1.

    Null and empty texts get the score of a text without n-grams. Repeated rows get equal scores. A
    column named like the result is replaced. An empty table gives no rows.
    """
    docs = docs.drop(name)
    names, place = docs.columns, docs.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scale = np.frombuffer(model["scale"]).astype(np.float32)
    weight = np.frombuffer(model["weight"])
    bundle = docs.sparkSession.sparkContext.broadcast(  # two arrays of ``SLOTS`` numbers
        (scale, (weight[:SLOTS] * scale).astype(np.float32), float(weight[SLOTS]), model["slope"], model["offset"])
    )

    def run(batches):
        seen = np.zeros(SLOTS, bool)
        square, gain, bias, slope, offset = bundle.value
        square = square * square
        for batch in batches:
            out = []
            for whole in batch.column(place).to_pylist():
                x = indicators(whole, seen)
                margin = float(gain[x].sum()) / (math.sqrt(float(square[x].sum())) or 1.0) + bias
                out.append(1 / (1 + math.exp(-min(max(slope * margin + offset, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, name])

    return docs.mapInArrow(run, f"{kinds}, `{name}` double")
