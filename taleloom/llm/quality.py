"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded; gated attention weighs the passages; the
document's score comes from their weighted mean. Only documents have labels: which passages tell is learnt from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import documents
from taleloom.llm.learning import adam, held_out, labelled, sample, sampled_texts, sigmoid

#: Bound of the sample of labelled documents that the model is fitted on.
LABELLED = 8000
#: Words of a passage.
PASSAGE_WORDS = 64
#: Passages worked on at once.
GROUP = 256
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8

#: Byte classes, by the first that a byte belongs to.
_CLASSES = [b" ", b"\n", b"\t\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,", b";:", b"!?", b"|", b"#$%&*@", b"\"'`", b"()[]{}<>", b"/\\_-=+~^"]
_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES):
    _OF[list(_members)] = _i
_OF[:32] = np.where(_OF[:32] == len(_CLASSES), len(_CLASSES) + 1, _OF[:32])
_OF[127] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
_UPPER, _LOWER = 4, 3
_SPACE = _OF < 3
N_FEATURES = N_CLASSES + 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def passages(text: str) -> np.ndarray:
    """A row of features for each passage of PASSAGE_WORDS words; a text without words has one row of zeros. Passages are
    worked on GROUP at a time, so that a long text takes little more memory than itself."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    count = max(1, round(n / PASSAGE_WORDS))
    out, before = [], None
    for at in range(0, count, GROUP):
        here = min(GROUP, count - at)
        a, b = at * PASSAGE_WORDS, (at + here) * PASSAGE_WORDS if at + here < count else n
        left, right = int(start[a]) if at else 0, int(start[b]) if b < n else len(data)
        rows, before = _rows(data[left:right], start[a:b] - left, end[a:b] - left, here, before)
        out.append(rows)
    return np.concatenate(out)


def _rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: int, before: np.uint64 | None) -> tuple[np.ndarray, np.uint64]:
    """The features of so many passages from their bytes and words, and the last word's value; before: the value of the word
    ahead of them."""
    kind, solid, n = _OF[data], ~_SPACE[data], len(start)
    of_word = np.minimum(np.arange(n) // PASSAGE_WORDS, count - 1)
    first = np.searchsorted(of_word, np.arange(count))
    of_byte = np.searchsorted(start[first], np.arange(len(data)), side="right") - 1
    classes = np.bincount(np.maximum(of_byte, 0) * N_CLASSES + kind, minlength=count * N_CLASSES).reshape(count, N_CLASSES).astype(np.float64)
    size, long = np.diff(np.r_[first, n]).astype(np.float64), (end - start).astype(np.float64)

    # A word's value: its bytes as a polynomial; sums over its bytes, in wrapping arithmetic.
    place = np.arange(len(data)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)]))
    power = np.multiply.accumulate(np.full(int(place.max()) + 1, _BASE | np.uint64(1)))
    value = np.add.reduceat(np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0)), start)
    again = np.r_[before is not None and value[0] == before, value[1:] == value[:-1]]
    order = np.lexsort((value, of_word))
    fresh = np.r_[True, (value[order][1:] != value[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    upper = np.add.reduceat(np.where(solid & (kind == _UPPER), 1, 0), start)
    lower = np.add.reduceat(np.where(solid & (kind == _LOWER), 1, 0), start)

    def share(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float64), first) / size

    mean = share(long)
    more = np.stack([
        np.log1p(size),
        np.log1p(mean),
        np.sqrt(np.maximum(share(long**2) - mean**2, 0)) / (1 + mean),
        share(long > 20),
        share(again),
        np.add.reduceat(fresh.astype(np.float64), first) / size,
        share((upper > 1) & (lower == 0)),
        share((upper == 0) & (lower == 0)),
    ], axis=1)
    return np.concatenate([np.sqrt(classes / classes.sum(axis=1, keepdims=True)), more], axis=1).astype(np.float32), value[-1]


class QualityModel:
    """Parameters, and the mean and spread of the features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "a": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE),
            "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of bags one after another; first: where each bag begins."""
        p, size = self.p, np.diff(np.r_[first, len(x)])
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["W"] + p["a"])
        tv, su = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (tv * su) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
        weight = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"x": x, "h": h, "tv": tv, "su": su, "weight": weight, "z": z, "score": sigmoid(z @ p["c"] + p["b"]), "size": size}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], f["size"], axis=0)
        dweight = (dz * f["h"]).sum(axis=1)
        inner = np.add.reduceat(f["weight"] * dweight, first)
        ds = f["weight"] * (dweight - np.repeat(inner, f["size"]))
        dgate = ds[:, None] * p["w"]
        dv, du = dgate * f["su"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["su"] * (1 - f["su"])
        dh = (f["weight"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        out = {"W": f["x"].T @ dh, "a": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["tv"] * f["su"]).T @ ds, "c": f["z"].T @ d, "b": np.array([d.sum()])}
        return {k: v + (decay * p[k] if k in "WVUc" else 0) for k, v in out.items()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> None:
        rng, step = np.random.default_rng(seed), adam(self.p, rate)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), batch):
                chosen = order[at : at + batch]
                some = [bags[i] for i in chosen]
                first = np.cumsum([0, *(len(b) for b in some[:-1])])
                step(self.gradients(np.concatenate(some), first, y[chosen], decay))

    def scores(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = []
        for at in range(0, len(texts), block):
            bags = [passages(t) for t in texts[at : at + block]]
            first = np.cumsum([0, *(len(b) for b in bags[:-1])])
            out.append(self.forward(np.concatenate(bags), first)["score"])
        return np.concatenate(out) if out else np.zeros(0)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [passages(t.as_py() or "").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "passages"])


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on at most LABELLED documents whose labels may be learnt from. Without any, the model is
    one that takes every document for good: no evidence, no rejection."""
    rows = sampled_texts(docs, sample(labelled(labels, "quality"), LABELLED)).mapInArrow(_encoded, "y int, passages binary").collect()
    if not rows:
        model = QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES))
        model.p["c"][:], model.p["b"][:] = 0, 3
        return model
    rows.sort(key=lambda r: (r["y"], bytes(r["passages"])))  # the order in which tasks end must not matter
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, N_FEATURES) for _, x in rows]
    every = np.concatenate(bags).astype(np.float64)
    model = QualityModel(every.mean(axis=0), every.std(axis=0) + 0.01)
    model.fit(bags, np.array([float(y > 0) for y, _ in rows]))
    return model


def quality(text: Column, model: QualityModel) -> Column:
    """The score of a text column: 0 to 1, higher for likelier good. Whole texts; a null one is empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t or "" for t in texts]), dtype="float64")

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Labels of held-out rows are not read. A null text is empty; a null doc_id counts as held out; repeated rows repeat;
    other columns are ignored.
    """
    model = train(docs, labels)
    out = documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(F.coalesce("text", F.lit("")), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
