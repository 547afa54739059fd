"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic documents and from documents without regard to any label. With
the class prior p, the risk of calling an unlabelled document toxic is corrected for the toxic ones among
them: R = p R(positive as positive) + max(0, R(unlabelled as negative) - p R(positive as negative)). Where
the second part falls below zero the model overfits, and its step goes the other way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import documents
from taleloom.llm.learning import adam, held_out, labelled, sample, sampled_texts, sigmoid

#: Bounds of the sample that the classifier is fitted on.
POSITIVES, UNLABELLED = 3000, 9000
#: Hash range of the features, and how many of them the classifier uses at most.
BUCKETS, FEATURES = 1 << 20, 512
#: A feature must be commoner among the positives by so many standard errors.
MARKED = 4.0
THRESHOLD = 0.5
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> set[int]:
    """A word's features: itself, and its first letters, which inflected forms share."""
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (f"={word}", *(word[:n] for n in (4, 5, 6) if len(word) > n))}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class ToxicityModel:
    """weights: of the buckets in use. A text's score is sigmoid(bias + the weights of its features)."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            hits: set[int] = set()
            for word in words(text):
                got = known.get(word)
                if got is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = got = tuple(b for b in buckets(word) if b in self.weights)
                if got:
                    hits.update(got)
            return float(sigmoid(np.float64(self.bias + sum(self.weights[b] for b in sorted(hits)))))

        return score


def nnpu_slope(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, b: np.ndarray, prior: float, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The derivatives of the risk by weights and bias, under logistic loss; where the second part of the risk is below -beta,
    those of that part alone, turned round."""
    zp, zu = positive @ w + b, unlabelled @ w + b
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # derivatives of the mean losses by z
    p_pos, p_neg, u_neg = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    gp, gu = (prior * (p_pos - p_neg), u_neg) if as_negative >= -beta else (prior * p_neg, -u_neg)
    return gp.astype(positive.dtype) @ positive + gu.astype(unlabelled.dtype) @ unlabelled, np.array([gp.sum() + gu.sum()])  # one type: no copies of the rows


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under logistic loss. Rows are documents."""
    model = {"w": np.zeros(positive.shape[1], dtype=np.float32), "b": np.zeros(1)}
    step = adam(model, rate)
    for _ in range(steps):
        slope, bias = nnpu_slope(positive, unlabelled, model["w"], model["b"], prior, beta)
        step({"w": slope + np.float32(decay) * model["w"], "b": bias})
    return model["w"], float(model["b"][0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.array(sorted(set().union(*map(buckets, words(t.as_py() or "")))), dtype=np.uint32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "features"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on at most POSITIVES confirmed toxic and UNLABELLED other-than-held-out documents. The class
    prior is the share of toxic rows among the labels to learn from. Without a toxic label every
    score is 0.5 or less: there is nothing to learn."""
    toxic = sample(labelled(labels, "toxic", 1), POSITIVES)
    unlabelled = sample(documents(docs).select("doc_id").filter("doc_id is not null").filter(~held_out(F.col("doc_id"))), UNLABELLED).withColumn("y", F.lit(0))
    n, share = labelled(labels, "toxic").agg(F.count("*"), F.avg("y")).first()
    rows = [(y, np.frombuffer(x, dtype=np.uint32)) for part in (toxic, unlabelled) for y, x in sampled_texts(docs, part).mapInArrow(_features, "y int, features binary").collect()]
    of = {y: [x for k, x in rows if k == y] for y in (0, 1)}
    if not n or not share or not of[1] or not of[0]:
        return ToxicityModel({}, -1.0)
    seen = {y: np.bincount(np.concatenate(of[y]), minlength=BUCKETS) / len(of[y]) for y in (0, 1)}
    both = (seen[0] * len(of[0]) + seen[1] * len(of[1])) / len(rows)
    mark = (seen[1] - seen[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / len(of[0]) + 1 / len(of[1])))
    chosen = np.argsort(-mark, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[mark[chosen] >= MARKED])
    if not len(chosen):
        return ToxicityModel({}, -1.0)

    def dense(docs_: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs_), len(chosen)), dtype=np.float32)
        for i, x in enumerate(docs_):
            out[i, np.searchsorted(chosen, x[np.isin(x, chosen)])] = 1
        return out

    w, b = fit_nnpu(dense(of[1]), dense(of[0]), min(0.9, max(1e-3, share)))
    return ToxicityModel({int(k): float(v) for k, v in zip(chosen, w, strict=True)}, b)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """The score of a text column: 0 to 1, higher for likelier toxic. Whole texts; a null one is empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield pd.Series([of(t or "") for t in texts], dtype="float64")

    return score(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Labels of held-out rows are not read. A null text is empty; a null doc_id counts as held out; repeated rows repeat;
    other columns are ignored.
    """
    model = train(docs, labels)
    out = documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.coalesce("text", F.lit("")), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
