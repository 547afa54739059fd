"""The corpus operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taleloom.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.permutation_index import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sentencepiece(rows: DataFrame, *keys: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    from taleloom.llm.sentencepiece_lattice import SPACE, decoded, encode, joined, piece_octets

    path = vocabulary("piece_bpe_32k.model")
    octets = piece_octets(path)
    decimals = pa.array([b"%d," % i for i in range(len(octets))], pa.large_binary())

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The digests of a batch's ids, and whether they are read back as its texts."""
        text, ids = batch.column(len(keys)), batch.column(len(keys) + 1)
        spaces = pc.replace_substring(text, SPACE, " ")  # the mark for a space is read as one
        digests = pa.array([hashlib.sha256(x.as_buffer()[:-1] if len(x.as_buffer()) else b"").hexdigest() for x in joined(ids, decimals)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pc.list_value_length(ids).cast(pa.int64()), digests, pc.equal(decoded(ids, octets), spaces)], names=returns.names)

    rows = rows.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = {"n_ids": T.LongType(), "ids_sha256": T.StringType(), "same_text": T.BooleanType()}
    returns = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]] + [T.StructField(name, type_) for name, type_ in made.items()])
    return encode(rows, "text", path, read, returns)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. The README has its cost."""
    return _sentencepiece(table(spark, sf_dir, "documents"), "doc_id")


def sentencepiece_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over the turns of conversations."""
    return _sentencepiece(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.chat import formatted, read_back

    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(formatted(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce("first_bad", F.lit(0)).alias("first_bad"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark", "component")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleloom.llm.secrets import scanned

    found = scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_chat": op5_chat,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "sentencepiece_conversations": sentencepiece_conversations,
}

ORACLES: dict[str, str] = {
    "op5_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
             t AS (SELECT *, length(text) + length(regexp_replace(text, '[^~\[<>]', '', 'g'))
                             + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 14
                                         ELSE 16 + length(role) + length(regexp_replace(role, '[^~\[<>]', '', 'g')) END AS written FROM c),
             o AS (SELECT *, row_number() OVER w AS nth, lag(role, 1, 'start') OVER w || ' ' || role AS step FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             g AS (SELECT conv_id, count(*) AS n_turns,
                          min(nth) FILTER (step NOT IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user')) AS first_bad,
                          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                          coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                          sum(written) AS written FROM o GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(written AS BIGINT) AS formatted_chars, first_bad IS NULL AS valid, coalesce(first_bad, 0) AS first_bad FROM g""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             k AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN k ON d.norm = k.norm""",
}
