"""Exact deduplication: counting quotient filters route repeated fingerprints to byte comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import bounded_broadcast, documents, materialise, squeeze
from taleloom.llm.cqf import CountingQuotientFilter

#: Fingerprints that one merging task holds, about.
SHARD_ROWS = 250_000


def _filters(shards: int):
    """Builds one partition's filter and cuts it into ranges of the fingerprint."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        fps, counts = CountingQuotientFilter.of(np.concatenate([x for x, _ in got]).view(np.uint64), np.concatenate([x for _, x in got])).items()
        home = (fps >> np.uint64(32)).astype(np.int64) * shards >> 32
        for shard in np.unique(home):
            at = slice(*np.searchsorted(home, [shard, shard + 1]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([CountingQuotientFilter.of(fps[at], counts[at]).dumps()], pa.binary())], ["shard", "filter"])

    return build


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    fps, counts = CountingQuotientFilter.merged([CountingQuotientFilter.loads(x) for x in group["filter"]]).items()
    return pd.DataFrame({"fp": fps[counts > 1].view(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Of (fp long, copies long): the fingerprints that stand for more than one row. Each
    partition builds a filter; the filters' ranges merge, a range to a task."""
    shards = max(1, -(-rows // SHARD_ROWS))
    built = fingerprints.select("fp", "copies").mapInArrow(_filters(shards), "shard int, filter binary")
    return built.groupBy("shard").applyInPandas(_merge, "fp long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, fp.

    Texts are equal when their bytes are after white space is squeezed. keep_id is the smallest
    doc_id of the equal texts. A null text is an empty one. A null doc_id is never the smallest,
    unless its group has no other (keep_id is then null). Of repeated rows with the same
    doc_id and text one is kept. No rows give no rows; other columns are ignored.
    """
    texts = documents(docs).withColumn("norm", squeeze(F.col("text"))).select("doc_id", "norm", F.xxhash64("norm").alias("fp"))
    thin = materialise(texts.groupBy("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")).agg(F.count("*").alias("copies")), "dedup-rows")
    rows = thin.count()
    repeated = materialise(repeated_fingerprints(thin, rows), "dedup-repeated")

    # Byte verification: the text itself is the key, and equal ones fold before they are shuffled.
    routed = texts.join(bounded_broadcast(repeated), "fp", "left_semi")
    groups = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("fp", F.sha2("norm", 256).alias("text_sha256"), "norm", "keep_id", "group_size")
    groups = materialise(groups.select("fp", "text_sha256", "keep_id", "group_size"), "dedup-groups")
    if not groups.groupBy("fp", "text_sha256").count().filter("count > 1").isEmpty():
        raise ArithmeticError("two different texts share a 64-bit fingerprint and a SHA-256 digest")

    out = thin.join(groups, ["fp", "text_sha256"], "left")
    out = out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").alias("group_size"),
        "text_sha256",
        "fp",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"),
    )
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", "fp")
