"""Approximate nearest neighbours by a permutation index.

Vectors are first made equally long by one more component, so that the largest inner product is the nearest direction.
A vector is represented by its nearest pivots, in order. It is posted in the inverted files of those pivots, one
file for each level of rank that it reaches. A query reads the files of its own nearest pivots and levels and adds up, for
each vector met, how many both are in: that ranks vectors by footrule distance of the ranks in levels (a pivot beyond the
prefix counts as next after it). Files are the columns of a matrix, so that reading them is a product. The nearest by footrule are reranked by the true inner product.

Vectors are dealt out in blocks of about BLOCK rows; a block holds its own inverted files, and each chunk of the query
set visits every block. A block returns each query's best; those fold in rounds of FAN blocks, so no task holds more
than that. Nothing is indexed on the driver but the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import materialise

#: Rows that the pivots are chosen from, the number of pivots, how many of them represent a vector, and in how many levels
#: their ranks are posted.
SAMPLE, PIVOTS, PREFIX, LEVELS = 4096, 512, 256, 4
#: Share of a block that is reranked, and the least number: in small blocks the order by footrule is coarser.
RERANKED, RERANKED_ROWS = 0.125, 256
#: Vectors so many times as long as 99 of 100 are reranked for every query: beside their length others' differences are lost.
LONG = 1000.0
BLOCK, CHUNK, FAN = 2048, 4096, 32
K = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part: an id, only finite components, not all of
    them zero, and as many as most vectors have."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (sizes["n"] if sizes else 0))


def levelled(vectors: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over the length `top`, with one more component that makes them as long as 1, and which ones are longer as it
    is. A query gets 0 for it: the inner products stay in order, and the largest is then that of the nearest direction."""
    vectors = vectors / top
    with np.errstate(over="ignore"):
        rest = 1 - (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(0, rest))]), np.flatnonzero(rest < -1e-6)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors far from each other: each next one is the row whose nearest pivot so far is farthest."""
    rows = np.unique(sample / np.linalg.norm(sample, axis=1, keepdims=True), axis=0)
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def weights(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX, levels: int = LEVELS) -> np.ndarray:
    """A row for each vector, a column for each level and pivot: 1 where the pivot's rank among the vector's nearest reaches
    the level (the lowest holds all of the prefix, the next ones ever nearer pivots)."""
    near = vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    step = -(-prefix // levels)
    sizes = [max(0, prefix - step * level) for level in range(levels)]
    places = [near.shape[1] - size for size in sizes if size]
    parted = np.partition(near, places, axis=1)
    out = np.zeros((len(near), levels, near.shape[1]), dtype=np.float32)
    for level, place in enumerate(places):
        out[:, level] = near >= parted[:, place, None]
        for row in np.flatnonzero(out[:, level].sum(axis=1) != sizes[level]):  # equally near pivots at the border: those in front
            out[row, level] = 0
            out[row, level, np.argsort(-near[row], kind="stable")[: sizes[level]]] = 1
    return out.reshape(len(near), -1)


def agreement(queries: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """For each query and vector the number of files that both are in: the sum, over pivots, of the lesser level. Prefixes
    are equally long, so the footrule distance is a constant less twice that: more is nearer."""
    return queries @ posted.T  # whole numbers, below what a float holds


def shortlist(near: np.ndarray, count: int) -> np.ndarray:
    """For each query, which `count` vectors are nearest; of equally near ones those in front. With its place, a whole number is
    unlike all others of its row, so that one border cuts the row, and no row is sorted."""
    rows = near.shape[1]
    if count >= rows:
        return np.ones(near.shape, dtype=bool)
    unlike = near.astype(np.int64) * rows - np.arange(rows)
    return unlike >= np.partition(unlike, rows - count, axis=1)[:, rows - count, None]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            large = np.abs(x).max(axis=1)
            with np.errstate(over="ignore"):
                length = large * np.sqrt(((x / large[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(length)], names=["length"])


def _cell(pivots: np.ndarray, top_length: float, k: int, share: float):
    def find(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            ids, x, q = block["vec_id"].to_numpy(), np.stack(block["embedding"]), np.stack(queries["asked"])
            # Copies of a vector have one score, so their least ids go first: they are searched as one vector.
            x, place = np.unique(x, axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([place.ravel(), ids]), axis=0)  # repeated rows count once
            vector, ids = pairs[:, 0], pairs[:, 1]
            query_ids, first = queries["query_id"].to_numpy(), np.searchsorted(vector, np.arange(len(x) + 1))
            copies = [np.arange(a, min(b, a + k + 1)) for a, b in zip(first[:-1], first[1:], strict=True)]  # one may be the query's own
            count = min(len(x), max(RERANKED_ROWS, k, int(np.ceil(share * len(ids)))))
            room = np.empty_like(x)  # used again for each query
            single = len(np.unique(ids)) == len(ids)
            level, longer = levelled(x, top_length)
            posted, asked = weights(level, pivots), weights(np.column_stack([q, np.zeros(len(q))]), pivots)
            for at in range(0, len(q), 256):
                for i, row in enumerate(shortlist(agreement(asked[at : at + 256], posted), count), at):
                    row[longer] = True
                    best = np.flatnonzero(row)
                    taken = np.take(x, best, axis=0, out=room[: len(best)], mode="clip")
                    value = np.multiply(taken, q[i], out=taken).sum(axis=1)
                    if single and len(best) > k + 1:  # vectors behind k + 1 others, of which one may be the query's own, can't be returned
                        known = np.where(np.isnan(value), -np.inf, value)
                        ahead = known >= np.partition(known, -k - 1)[-k - 1]
                        best, value = best[ahead], value[ahead]
                    score = dict(zip(best.tolist(), value.tolist(), strict=True))
                    best = np.concatenate([copies[v] for v in best])
                    best = best[ids[best] != query_ids[i]]
                    best = best[np.argsort(ids[best], kind="stable")]
                    score = np.array([score[v] for v in vector[best].tolist()])
                    top = np.lexsort((ids[best], -score))
                    if (ids[best][1:] == ids[best][:-1]).any():  # an id with several vectors: its best one
                        top = top[np.sort(np.unique(ids[best][top], return_index=True)[1])]
                    out.append((key[0], int(query_ids[i]), ids[best][top[:k]].tolist(), score[top[:k]].tolist()))
        return pd.DataFrame(out, columns=["block", "query_id", "vec_ids", "scores"])

    return find


def search(vectors: DataFrame, is_query: Column, k: int = K, share: float = RERANKED) -> DataFrame:
    """For each query row of (vec_id, embedding), its nearest found among all rows with another vec_id: query_id,
    rank, vec_id, score.

    Nearest is largest inner product, ties to the smaller vec_id; a vec_id that is repeated counts once, with its best
    score, as a query with its least vector. Rows that usable() leaves out take no part; a query without any candidate
    has no row. No rows give no rows; other columns are ignored.
    """
    rows = materialise(usable(vectors), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.select("embedding").mapInArrow(_lengths, "length double")
    longest, usual = lengths.agg(F.max("length"), F.percentile_approx("length", 0.99)).first()
    top = min(longest, LONG * usual)
    pivots = choose_pivots(levelled(np.array([r[0] for r in sample]), top)[0])
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("asked"))
    blocks = -(-rows.count() // BLOCK)
    chunks = max(1, -(-queries.count() // CHUNK))

    def part(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("vec_id", "embedding", part("vec_id", blocks).alias("block"), every(chunks).alias("chunk"))
    right = queries.select("query_id", "asked", every(blocks).alias("to_block"), part("query_id", chunks).alias("of_chunk"))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("to_block", "of_chunk")).applyInPandas(_cell(pivots, top, k, share), "block int, query_id long, vec_ids array<long>, scores array<double>")
    found = found.select("block", "query_id", F.zip_with("vec_ids", "scores", lambda i, s: F.struct((-s).alias("far"), i.alias("vec_id"))).alias("best"))
    while True:
        found = found.withColumn("block", F.floor(F.col("block") / FAN))
        blocks = -(-blocks // FAN)
        best = F.sort_array(F.flatten(F.collect_list("best")))
        found = found.groupBy("query_id", "block").agg(best.alias("best"))
        found = found.select("query_id", "block", F.slice("best", 1, k).alias("best"))
        if blocks <= 1:
            break
    out = found.select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))

