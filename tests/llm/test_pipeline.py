import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from taleloom.llm.secrets import masked, secrets

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, extra string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ta", "lo", "mi", "re", "su") for b in ("ne", "ka", "vo", "di", "pes")]
    docs = []
    for i in range(400):
        text = " ".join(rng.choice(words, int(rng.integers(40, 400))))
        if i % 4 == 1:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        docs.append((i, text))
    docs += [(500, docs[0][1]), (501, docs[0][1].replace(" ", "  \n")), (502, docs[2][1] + " tail"), (503, docs[3][1] + " secret: abcdef123 end"), (504, ""), (505, None), (7, docs[7][1])]
    labels = [(i, int(i % 4 != 1), 0) for i in range(400)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = STAGE["quality classifier"](spark, docs, folder).cache()
    kept = {r.doc_id for r in good.collect()}
    assert {i for i in range(400) if i % 4 != 1} <= kept and not kept & {i for i in range(400) if i % 4 == 1}
    assert good.columns == docs.columns

    exact = STAGE["exact dedup"](spark, good, folder).cache()
    least = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), tuple(r))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(r[0] for r in least.values())

    near = STAGE["SimHash near-dedup"](spark, exact, folder).cache()
    rows = exact.collect()
    label = brute_components([r.doc_id for r in rows], np.array([brute_fingerprint(r.text or "") for r in rows], dtype=np.uint64))
    assert rows_of(near) == sorted((tuple(r) for r, c in zip(rows, label, strict=True) if r.doc_id == c), key=str)

    clean = STAGE["secret scans"](spark, near, folder).cache()
    want = [(r.doc_id, t := r.text if r.text is None else masked(r.text, secrets(r.text)[1]), r.lang, r.source, r.n_chars if t is None else len(t), r.extra) for r in near.collect()]
    assert rows_of(clean) == sorted(want, key=str)
    assert clean.schema == docs.schema

    packed = STAGE["best-fit packing"](spark, clean, folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for r in packed:
        whole.setdefault(r.doc_id, []).append(r)
    assert set(whole) == {r.doc_id for r in clean.collect()}
    for r in clean.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        for p in whole[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(array("I", ids[p.start : p.start + p.length]).tobytes())
        assert sum(p.length for p in whole[r.doc_id]) == len(ids)
    assert len(packed) == corpus_pipeline.run(spark, folder).count()


@pytest.mark.parametrize("stage", ["exact dedup", "SimHash near-dedup"])
def test_rows_that_cannot_be_told_apart(spark, folder, stage):
    rows = [(2, "one two three four", "a"), (2, "one two three four", "b"), (2, "quite other words there", "c"), (None, "alone among the nulls", "d"), (None, "one two three four", "e"), (None, None, "f"), (9, "", "g")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, x) for i, t, x in rows], SCHEMA)
    got = [r.extra for r in STAGE[stage](spark, docs, folder).collect()]
    assert sorted("a" if x == "b" else x for x in got) == ["a", "c", "d", "g"]


@pytest.mark.parametrize("stage", STAGE)
def test_empty_table(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert STAGE[stage](spark, docs, folder).count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.simhash_near_dedup])
def test_stages_keep_columns_with_clashing_names(spark, stage):
    rows = [(2, "a text of some words", "x", 1, 5), (1, "a text of some words", "y", 2, 6), (1, "a text of some words", "z", 3, 7), (3, "another text, not like it at all", "w", 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __mark int, mark int")
    got = stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and set(map(tuple, got)) <= set(rows)
