"""The classifier: a dense layer, ReLU, a dense layer; NumPy in Arrow batches, and its training on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from . import features, scanner

INPUTS, HIDDEN, CLASSES = 192, 64, 3


def initial(seed: int, inputs: int = INPUTS, hidden: int = HIDDEN, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Xavier-uniform weights and zero biases."""
    rng = np.random.default_rng(seed)

    def layer(a: int, b: int) -> np.ndarray:
        return rng.uniform(-np.sqrt(6 / (a + b)), np.sqrt(6 / (a + b)), (a, b))

    return {"w1": layer(inputs, hidden), "b1": np.zeros(hidden), "w2": layer(hidden, classes), "b2": np.zeros(classes)}


def forward(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy against soft targets y, and its gradient."""
    weight = np.ones(len(x)) if weight is None else weight
    pre = x @ model["w1"] + model["b1"]
    hidden = np.maximum(pre, 0)
    p = probabilities(hidden @ model["w2"] + model["b2"])
    loss = float(np.mean(weight * -(y * np.log(np.maximum(p, 1e-30))).sum(axis=1)))
    d = (p - y) * (weight / len(x))[:, None]
    back = (d @ model["w2"].T) * (pre > 0)
    return loss, {"w1": x.T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ d, "b2": d.sum(axis=0)}


def adamw(model: dict[str, np.ndarray], grads: dict[str, np.ndarray], moments: dict | None, rate: float, decay: float = 0.0) -> tuple[dict[str, np.ndarray], dict]:
    """(weights, moments) after one step; moments of None begin."""
    zeros = {k: np.zeros_like(a) for k, a in model.items()}
    old = moments or {"m": zeros, "v": zeros, "t": 0}
    t = old["t"] + 1
    m = {k: 0.9 * old["m"][k] + 0.1 * grads[k] for k in model}
    v = {k: 0.999 * old["v"][k] + 0.001 * grads[k] ** 2 for k in model}
    step = {k: rate * ((m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + decay * model[k]) for k in model}
    return {k: model[k] - step[k] for k in model}, {"m": m, "v": v, "t": t}


def dropped(x: np.ndarray, channels: slice, share: float, rng: np.random.Generator) -> np.ndarray:
    """The vectors with a share of some channels blanked and what is left of those scaled up."""
    out = x.copy()
    out[:, channels] *= (rng.random(out[:, channels].shape) >= share) / (1 - share)
    return out


def train(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 3e-3, seed: int = 7, drop: tuple[slice, float] | None = None, patience: int = 5, model: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """AdamW without decay on a sample drawn evenly over groups (languages), with early stopping on the loss.

    x is a bounded sample that the caller collected. drop = (channels, share) blanks a share of those channels in each
    batch and scales the rest up. Class weights are min(3, sqrt(n / (3 n_class))).
    """
    rng = np.random.default_rng(seed)
    model = model or initial(seed, x.shape[1])
    onehot = np.eye(CLASSES)[labels]
    counts = np.bincount(labels, minlength=CLASSES)
    weights = np.minimum(3, np.sqrt(len(labels) / (3 * np.maximum(counts, 1))))[labels]
    pools = [np.flatnonzero(groups == g) for g in np.unique(groups)]
    moments = None
    best, best_loss, waited, history = model, np.inf, 0, []
    for _ in range(epochs):
        losses = []
        for _ in range(max(1, len(x) // batch)):
            pick = np.array([rng.choice(pools[g]) for g in rng.integers(len(pools), size=batch)])
            xs = x[pick]
            if drop:
                xs = dropped(xs, *drop, rng)
            loss, g = gradients(model, xs, onehot[pick], weights[pick])
            losses.append(loss)
            model, moments = adamw(model, g, moments, rate)
        history.append(float(np.mean(losses)))
        if history[-1] < best_loss - 1e-4:
            best, best_loss, waited = model, history[-1], 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history


def softmax_batches(logits: Column) -> Column:
    """Probabilities by NumPy over Arrow batches."""

    @pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(probabilities(np.stack(values.to_numpy()))) if len(values) else [], dtype=object)

    return run(logits)


def scorer(model: dict[str, np.ndarray]):
    """A vectorised function of a feature column: logits of the classifier. The weights travel with the function."""
    fixed = {k: np.asarray(v, dtype=np.float64) for k, v in model.items()}

    @pandas_udf("array<double>")
    def score(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        return pd.Series(list(forward(fixed, np.stack(features.to_numpy()).astype(np.float64))))

    return score


def padded_scorer(model: dict[str, np.ndarray], batch: int):
    """scorer() in batches of a fixed size, the last filled up with zeros."""
    fixed = {k: np.asarray(v, dtype=np.float64) for k, v in model.items()}

    @pandas_udf("array<double>")
    def score(features: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for at in range(0, len(features), batch):
            part = np.stack(features.iloc[at : at + batch].to_numpy()).astype(np.float64)
            full = np.zeros((batch, part.shape[1]))
            full[: len(part)] = part
            out += list(forward(fixed, full)[: len(part)])
        return pd.Series(out, dtype=object)

    return score


def choice(models: dict[int, dict[str, np.ndarray]], documents: DataFrame, number: str) -> DataFrame:
    """number, gap_label, prediction, n: how many boundaries of documents of a number have each label of at most two
    blank lines and get each label from the classifier of that number; null where there is none. The weights travel with
    the function, the vectors stay in the task that reads the text."""
    names = [number, "gap_label", "prediction", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: dict[int, np.ndarray] = {}
            for k, text in zip(batch.column(number).to_pylist(), batch.column("text")):
                gaps, x = features.gaps_and_vectors(scanner.as_bytes(text.as_py()), features.ALL if k in models else ())
                near = gaps <= 2
                if not near.any():
                    continue
                guess = forward(models[k], x[near].astype(np.float64)).argmax(axis=1) if k in models else np.full(near.sum(), CLASSES)
                cells[k] = cells.get(k, 0) + np.bincount(gaps[near] * (CLASSES + 1) + guess, minlength=CLASSES * (CLASSES + 1))
            rows = [(k, *divmod(at, CLASSES + 1), int(c[at])) for k, c in cells.items() for at in np.flatnonzero(c).tolist()]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] if r[2] < CLASSES else None for r in rows], [r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names)

    return documents.select(number, "text").where("text IS NOT NULL").mapInArrow(run, f"{number} int, gap_label int, prediction int, n long")
