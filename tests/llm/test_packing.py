import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taleloom.llm.packing import Plan, best_fit, packed
from taleloom.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "  ", "a  b", "a \n b", "a\n b", "a\n\n b", "a   b", " a", "a  ", "\n a b", "a\x1c b", "a  b", "it's he'll ' s", "<|endoftext|> x", "a\x85 b", "　 b", "​  c", "é \U0001f600 z", "1 23 45a  6", "a\t b\t\t c"]


def test_ids_are_the_tokenizers(reference):
    encoder = TextEncoder(PATH)
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("ab  \n\t'1.,é ") for _ in range(60)) for _ in range(400)]
    for text in texts * 2:
        assert encoder.ids(text) == array("I", reference(text)).tobytes(), repr(text)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_plan_opens_as_many_sequences_as_one_by_one_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, rng.choice([5, 40, 100])) for _ in range(rng.randint(1, 150))]
        plan = Plan({x: lengths.count(x) for x in set(lengths)}, 100)
        assert plan.sequences == best_fit_decreasing(lengths, 100)


def check(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_documents(spark, reference):
    rng = random.Random(5)
    texts = [None, "", "x " * 5000] + [" ".join(rng.choice(["alpha", "be", "c,"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    rows = [(i, t, 1, "q") for i, t in enumerate(texts)] + [(7, texts[7], 1, "q"), (None, "null id", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, length string").repartition(5)
    got = packed(docs, PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*reference(t or ""), 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert check(got, 1024) == best_fit_decreasing([w[3] for w in want], 1024)


def test_ranks_across_partitions(spark):
    rows = [(i, 0, 0, 30 if i % 4 else i % 50 + 1, i) for i in range(4000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7)
    got = best_fit(parts, 100).collect()
    assert len(got) == 4000
    assert check(got, 100) == best_fit_decreasing([r[3] for r in rows], 100)


def test_no_documents(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
