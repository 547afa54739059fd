"""What the trained classifiers share: the held-out fold, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import documents

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text divides by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def labelled(labels: DataFrame, column: str, value: int | None = None) -> DataFrame:
    """(doc_id, y) of the rows to learn from: labelled, not held out, one for each id (its greatest label)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("y is not null")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.filter(F.col("y") == value) if value is not None else rows


def sample(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` different rows, the same ones each time, spread evenly: those with the least hashes of doc_id. Of many more, a
    bound on the hash leaves about twice as many to be sorted."""
    mark = F.xxhash64("doc_id")
    few, n = ids, ids.count()
    if n > 4 * rows:
        low = ids.filter(mark < F.lit(int(-(2**63) + 2**64 * (2 * rows / n))).cast("long")).distinct()
        few = low if low.count() >= rows else ids
    return few.distinct().orderBy(mark, "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(y, text) of a sample's documents, one row for each id (its least text); the sample's size is bounded, so it is broadcast."""
    found = documents(docs).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def adam(parameters: dict[str, np.ndarray], rate: float = 0.01):
    """step(gradients): updates the parameters in place."""
    first = {k: np.zeros_like(v) for k, v in parameters.items()}
    second = {k: np.zeros_like(v) for k, v in parameters.items()}
    t = 0

    def step(gradients: dict[str, np.ndarray]) -> None:
        nonlocal t
        t += 1
        for k, g in gradients.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            parameters[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    return step


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
