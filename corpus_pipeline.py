"""The corpus pipeline: each stage works on the documents that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.llm import quality
from taleloom.llm.common import bounded_broadcast, materialise, squeeze, table
from taleloom.llm.exact_dedup import exact_duplicates
from taleloom.llm.packing import packed
from taleloom.llm.queries import vocabulary
from taleloom.llm.secrets import masked_text
from taleloom.llm.simhash import near_duplicates, one_of_each, text_mark


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores at its threshold or above."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality(F.coalesce("text", F.lit("")), model) >= quality.THRESHOLD)


def _kept(docs: DataFrame, found: DataFrame, mark: Column) -> DataFrame:
    """The rows of docs that `found` (doc_id, mark, kept: a row for each of docs) keeps; `mark` is made from the text.
    Documents themselves move only if the dropped pairs are too many to broadcast. Rows with the
    same id and mark can't be told apart; of those that are kept at all, one is."""
    id_, mark_ = (next(n for n in (f"__{x}{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("id", "mark"))
    pairs = materialise(found.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("kept")).filter("n > 1 or kept = 0"), "pairs")
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (mark == F.col(mark_))
    out = docs.join(bounded_broadcast(pairs.select(id_, mark_)), same, "left_anti")
    twins = pairs.filter("kept = 1").select(id_, mark_)
    if twins.isEmpty():
        return out
    again = docs.join(bounded_broadcast(twins), same, "left_semi").withColumn(mark_, mark)
    return out.unionByName(again.dropDuplicates(["doc_id", mark_]).drop(mark_))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that with the smallest doc_id."""
    found = exact_duplicates(docs).select("doc_id", F.col("fp").alias("mark"), "kept")
    return _kept(docs, found, F.xxhash64(squeeze(F.col("text"))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: that with the smallest doc_id."""
    return _kept(docs, one_of_each(near_duplicates(docs)).select("doc_id", "mark", "kept"), text_mark("text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret, those in nested encodings too; documents stay, with n_chars brought up to date."""
    text = masked_text(F.col("text"))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens: a row for each piece."""
    return packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The first stage is a trained classifier and the last one packs token ids: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs
