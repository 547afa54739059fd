import re

import numpy as np
import pytest
import xxhash

from taleloom.llm import simhash
from taleloom.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", ["", " \t", "a", "A b", "a b c", "Äb  C\n d e\x1cf g\x85h", "x " * 70_000, "one two three four five ÉA"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [1024, 32, 3])
def test_links_survive_every_way_of_blocking(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    found = list(rng.integers(0, 2**64, 60, dtype=np.uint64))
    for _ in range(300):
        x = int(found[rng.integers(len(found))])
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        found.append(np.uint64(x))
    fps = np.unique(np.array(found, dtype=np.uint64))
    nodes = simhash.tabled(spark.createDataFrame([(int(x), 0) for x in fps.view(np.int64)], "fp long, least long"))
    links = simhash.blocks(nodes).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._links, "u long, v long")
    label = {r.node: r.component for r in connected_components(links).collect()}
    got = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert got == brute_components(fps.view(np.int64), fps)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (4, "quite another text here"), (7, None), (6, ""), (None, base), (5, base), (8, "x " * 200_000)]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, fp int, key string")
    got = simhash.near_duplicates(docs).collect()
    fps = np.array([brute_fingerprint(t or "") for _, t in rows], dtype=np.uint64)
    want = brute_components([10**9 if i is None else i for i, _ in rows], fps)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i, f"{int(f):016x}", w) for (i, _), f, w in zip(rows, fps, want, strict=True)), key=str)


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 400, 400: 400}


def test_references_are_far_apart():
    near = np.bitwise_count(simhash.REFERENCES[:, None] ^ simhash.REFERENCES[None, :])
    assert near[np.triu_indices(len(near), 1)].min() >= 28
