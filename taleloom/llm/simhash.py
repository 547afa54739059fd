"""SimHash near-duplicates: tables of distances to reference fingerprints, then verification.

A fingerprint's row in the table holds its Hamming distances to reference fingerprints; the table is made once, for each
different fingerprint, and stored. Distances obey the triangle inequality, so two fingerprints within 3 bits differ by at most
3 in every coordinate; a pair that differs by more anywhere goes without being compared.

So that not all pairs of rows meet, fingerprints meet in blocks: a coordinate alone parts only half of all pairs, and cells
along it would have to overlap by as much. The 64 bits fall into 4 bands; of
3 differing bits at least one band has none, so a linked pair agrees in some band whole. A block whose members
are too many is dealt anew by 4 bands of its 48 other bits, and what is still too large goes over a grid of
cells. All of it is exact: no link is lost and no block is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import bounded_broadcast, documents, materialise
from taleloom.llm.components import connected_components

#: Differing bits that still link.
DISTANCE = 3
WORDS = 3
SEED = 42
#: Members of a block beyond which it is dealt anew.
BLOCK_ROWS = 1024


def _references(count: int = 24, of: int = 512) -> np.ndarray:
    """Fixed reference fingerprints, far apart: of random ones, each next is the one whose nearest so far is farthest."""
    drawn = np.random.default_rng(20_240_601).integers(0, 2**64, size=of, dtype=np.uint64)
    chosen, nearest = [0], np.bitwise_count(drawn ^ drawn[0])
    while len(chosen) < count:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, np.bitwise_count(drawn ^ drawn[chosen[-1]]))
    return drawn[chosen]


REFERENCES = _references()

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; without words, zero."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - np.array([len(t) + 1 for t in tokens])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(tokens) - words + 1)
    ends = ends[words - 1 :] or ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], dtype=">u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py() or "") for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): mark is a hash of the whole text; fp holds the unsigned fingerprint's bits as a long."""
    return documents(docs).select("doc_id", "text", text_mark("text")).mapInArrow(_fingerprints, "doc_id long, mark long, fp long")


def text_mark(text: str) -> Column:
    """Tells rows with the same doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def distance_table(fps: np.ndarray, references: np.ndarray = REFERENCES) -> np.ndarray:
    """Hamming distances, a row for each fingerprint and a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def _with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = distance_table(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in table], pa.binary())], ["fp", "least", "distances"])


def tabled(nodes: DataFrame) -> DataFrame:
    """(fp, least, distances): different fingerprints with their rows of the distance table."""
    return nodes.select("fp", "least").mapInArrow(_with_table, "fp long, least long, distances binary")


def linked_pairs(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs with the same key within DISTANCE bits. Rows must be sorted by key, then by
    the distance to the first reference: a sweep stops for a row where that coordinate alone parts it.
    table: the fingerprints' rows of the distance table."""
    left, step = np.arange(len(fps)), 0
    while len(left):
        step += 1
        left = left[left + step < len(fps)]
        right = left + step
        near = (keys[left] == keys[right]) & (table[right, 0] - table[left, 0] <= DISTANCE)
        left, right = left[near], right[near]
        a, b = left, right
        for at in range(1, table.shape[1], 6):  # the coordinates a few at a time, on what is left
            keep = (np.abs(table[a, at : at + 6] - table[b, at : at + 6]) <= DISTANCE).all(axis=1)
            a, b = a[keep], b[keep]
        same = np.bitwise_count(fps[a] ^ fps[b]) <= DISTANCE
        if same.any():
            yield a[same], b[same]


def _roots(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _stars(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links inside blocks as one edge to a centre for each member: as many rows as members at most."""
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    parent = np.arange(len(fps))
    for a, b in linked_pairs(keys, fps, table):
        while True:
            ra, rb = parent[a], parent[b]
            if not (apart := ra != rb).any():
                break
            np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            parent = _roots(parent)
    member = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[member], fps[parent[member]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by key: whole blocks gather until there are enough rows to compare."""
    keys, fps, table = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros((0, len(REFERENCES)), dtype=np.int8)

    def out(k: np.ndarray, f: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        u, v = _stars(k, f, t)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int8).reshape(-1, len(REFERENCES))
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        table = np.concatenate([table, rows])
        if len(keys) >= 1 << 15:
            whole = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:whole], fps[:whole], table[:whole])
            keys, fps, table = keys[whole:], fps[whole:], table[whole:]
    yield out(keys, fps, table)


def _banded(df: DataFrame, bits: int, offset: int, key: list) -> DataFrame:
    """A row for each of 4 bands of that many bits, from `offset` bits up, with the band's bits in the key."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("rest", offset + bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias("bits")) for i in range(4)])
    return df.select("*", F.explode(bands).alias("b")).withColumn("key", F.xxhash64(*key, "b.band", "b.bits"))


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, fp, distances) of (fp, distances): any two fingerprints within DISTANCE bits share a key. Keys are hashes; where two
    meet in one value, their block is only larger."""
    row = ["fp", "distances"]
    first = _banded(nodes.select(*row, F.col("fp").alias("rest")), 16, 0, [F.lit(1)]).select("key", *row, "b")
    parts, level = [], first
    for depth in (1, 2):
        hot = level.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS)
        hot = materialise(hot, "hot-blocks")
        if hot.isEmpty():
            return _union([*parts, level.select("key", *row)])
        hot = bounded_broadcast(hot)
        parts.append(level.join(hot, "key", "left_anti").select("key", *row))
        again = level.join(hot, "key")
        if depth == 1:  # the other 48 bits, side by side
            low = F.expr("fp & (shiftleft(1L, b.band * 16) - 1)")
            high = F.when(F.col("b.band") == 3, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(shiftrightunsigned(fp, (b.band * 16 + 16) % 64), b.band * 16)"))
            again = again.select(*row, F.col("key").alias("outer"), low.bitwiseOR(high).alias("rest"))
            level = _banded(again, 12, 0, [F.col("outer"), F.lit(2)]).select("key", *row, "b")
        else:
            cells = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
            own = F.pmod(F.xxhash64("fp", F.lit(7)), cells).cast("int")
            grid = again.select("key", *row, cells.alias("n"), own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
            parts.append(grid.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit(3)).alias("key"), *row))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links of at most 3 differing bits), mark (text_mark) and component (one fingerprint of it).

    A null text is empty; texts without words have fingerprint zero, linked like any other. A null
    doc_id is never the smallest; a component of nulls has a null id. Repeated rows give repeated rows.
    Copies share a fingerprint and meet once, as one node.
    """
    thin = materialise(fingerprints(docs), "fingerprints")
    nodes = thin.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialise(tabled(nodes), "distance-table")
    members = blocks(nodes).repartition("key").sortWithinPartitions("key")
    components = connected_components(members.mapInArrow(_links, "u long, v long"))
    nodes = nodes.drop("distances").join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component", "component_id")
    return thin.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "mark", "component")


def one_of_each(found: DataFrame) -> DataFrame:
    """near_duplicates()'s rows with kept: of each component the row with the smallest doc_id, then mark."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    first = found.groupBy("component").agg(F.min(key).alias("first"))
    return found.join(first, "component").withColumn("kept", key.eqNullSafe(F.col("first"))).drop("first")
