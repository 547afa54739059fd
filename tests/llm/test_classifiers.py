import math
import re
import zlib

import numpy as np
import pytest

from taleloom.llm import quality, toxicity
from pyspark.sql import functions as F

from taleloom.llm.learning import held_out, labelled, sample, sampled_texts

WORDS = ["river", "stone", "morning", "window", "garden", "letter", "silver", "evening", "market", "bridge", "answer", "winter"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "", "ly", "s"])) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(700):
        text, toxic, good = prose(rng, int(rng.integers(30, 300))), int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            parts = text.split()
            for w in ("vilething", "vilescum", "grotty"):
                parts.insert(int(rng.integers(len(parts))), w)
            text = " ".join(parts)
        if not good:
            text = prose(rng, 100) + " " + " ".join(w.upper() + "!!" for w in prose(rng, 80).split()) + " " + prose(rng, 50)
        docs.append((i, text, 9, "en", 0.5))
        labels.append((i, good, int(toxic and good)))
    docs += [(None, "null id", 1, "en", 0.1), (5000, None, 1, "en", 0.1), (5001, "", 1, "en", 0.1), (5002, "word " * 100_000, 1, "x", 0.2), (3, docs[3][1], 9, "en", 0.5)]
    labels += [(None, 1, 1), (5002, None, None), (9999, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, y int, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(docs)


def crc_held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("scores", "column", "threshold"), [(quality.quality_scores, "quality", 0.3), (toxicity.toxicity_scores, "toxic", 0.5)])
def test_held_out_accuracy(corpus, scores, column, threshold):
    docs, labels, n = corpus
    got = scores(docs, labels).collect()
    assert len(got) == n
    assert all(r.held_out == crc_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    true = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id < 700}
    held = [(true[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in true]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95


def test_learning_reads_no_held_out_label(corpus):
    docs, labels, _ = corpus
    ids = [r.doc_id for r in labelled(labels, "quality").collect()]
    assert ids and not any(map(crc_held_out, ids))
    assert sample(labelled(labels, "toxic", 1), 10).count() == 10


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_empty_tables(spark, corpus, scores):
    docs, labels, n = corpus
    assert scores(docs.limit(0), labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == n


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k, quality.N_FEATURES)) for k in (1, 4, 2)]
    x, first, y = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = quality.QualityModel(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    assert np.allclose(np.add.reduceat(model.forward(x, first)["weight"], first), 1)

    def loss():
        s = model.forward(x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in model.gradients(x, first, y, 0).items():
        at = tuple(rng.integers(n) for n in g.shape)
        was = model.p[k][at]
        model.p[k][at] = was + 1e-5
        up = loss()
        model.p[k][at] = was - 1e-5
        down = loss()
        model.p[k][at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_passages_cover_the_whole_text():
    text = "Word, " * 1000
    x = quality.passages(text)
    assert x.shape == (round(1000 / 64), quality.N_FEATURES)
    assert quality.passages("").shape == (1, quality.N_FEATURES) and not quality.passages(" \n").any()
    repeated, varied = quality.passages("ab ab ab ab cd cd"), quality.passages("ab cd ef gh ij kl")
    assert repeated[0, quality.N_CLASSES + 4] == np.float32(4 / 6) and varied[0, quality.N_CLASSES + 4] == 0
    assert repeated[0, quality.N_CLASSES + 5] == np.float32(2 / 6) and varied[0, quality.N_CLASSES + 5] == 1


def test_unlabelled_positives_do_not_pull_the_risk_down():
    rng = np.random.default_rng(2)
    toxic = (rng.random((1000, 6)) < [0.7, 0.7, 0.7, 0.5, 0.5, 0.5]).astype(np.float32)
    clean = (rng.random((4000, 6)) < [0.01, 0.01, 0.01, 0.5, 0.5, 0.5]).astype(np.float32)
    w, b = toxicity.fit_nnpu(toxic[:500], np.concatenate([toxic[500:], clean]), 500 / 4500)
    # One mark alone is likelier clean (posterior 0.43), so no rule finds more than 0.78 of the toxic but by luck.
    assert (toxic[500:] @ w + b > 0).mean() > 0.75 and (clean @ w + b > 0).mean() < 0.06


def test_risk_slopes():
    rng = np.random.default_rng(3)
    p, u, w, prior = rng.normal(size=(5, 3)), rng.normal(size=(9, 3)), rng.normal(size=3), 0.4
    for b in (np.array([0.3]), np.array([-6.0]), np.array([6.0])):

        def parts(w, b):
            loss = lambda x, y: np.mean([math.log1p(math.exp(-y * (r @ w + b[0]))) for r in x])
            return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

        whole = (lambda w, b: sum(parts(w, b))) if parts(w, b)[1] >= 0 else (lambda w, b: -parts(w, b)[1])
        slope, bias = toxicity.nnpu_slope(p, u, w, b, prior)
        for i in range(3):
            d = np.eye(3)[i] * 1e-6
            assert abs((whole(w + d, b) - whole(w - d, b)) / 2e-6 - slope[i]) < 1e-6
        assert abs((whole(w, b + 1e-6) - whole(w, b - 1e-6)) / 2e-6 - bias[0]) < 1e-6


def plain_passages(text):
    """A passage's features, one character after another."""
    classes = [" ", "\n", "\t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", ";:", "!?", "|", "#$%&*@", "\"'`", "()[]{}<>", "/\\_-=+~^"]
    data = text.encode("utf-8", "surrogatepass").decode("latin-1")
    words = [(m.start(), m[0]) for m in re.finditer(r"[^ \n\t\r\x0b\x0c]+", data)]
    if not words:
        return [[0.0] * quality.N_FEATURES]
    count = max(1, round(len(words) / 64))
    out = []
    for k in range(count):
        a, b = 64 * k, 64 * (k + 1) if k + 1 < count else len(words)
        span = data[words[a][0] if k else 0 : words[b][0] if b < len(words) else len(data)]
        of = [next((i for i, c in enumerate(classes) if x in c), 15 if ord(x) < 32 or ord(x) == 127 else 14) for x in span]
        mine = [w for _, w in words[a:b]]
        n, long = len(mine), [len(w) for w in mine]
        mean = sum(long) / n
        upper, lower = [sum("A" <= x <= "Z" for x in w) for w in mine], [sum("a" <= x <= "z" for x in w) for w in mine]
        out.append([math.sqrt(of.count(i) / len(of)) for i in range(16)] + [
            math.log1p(n), math.log1p(mean), math.sqrt(max(sum(x * x for x in long) / n - mean**2, 0)) / (1 + mean), sum(x > 20 for x in long) / n,
            sum(i > 0 and words[i - 1][1] == words[i][1] for i in range(a, b)) / n, len(set(mine)) / n,
            sum(u > 1 and not v for u, v in zip(upper, lower)) / n, sum(not u and not v for u, v in zip(upper, lower)) / n,
        ])
    return out


def plain_quality(text, model):
    sig, p = lambda z: 1 / (1 + math.exp(-z)), model.p
    h = [np.tanh(np.clip((np.array(x) - model.mean) / model.spread, -8, 8) @ p["W"] + p["a"]) for x in plain_passages(text)]
    e = [math.exp(sum(math.tanh(x @ p["V"][:, j]) * sig(x @ p["U"][:, j]) * p["w"][j] for j in range(quality.GATE))) for x in h]
    return sig(sum(w / sum(e) * x for w, x in zip(e, h)) @ p["c"] + p["b"][0])


def plain_toxicity(text, model):
    found = set()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        found |= {f"={word}"} | {word[:n] for n in (4, 5, 6) if len(word) > n}
    z = model.bias + sum(model.weights.get(b, 0.0) for b in {zlib.crc32(x.encode()) % toxicity.BUCKETS for x in found})
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize(("module", "scores", "plain"), [(quality, quality.quality_scores, plain_quality), (toxicity, toxicity.toxicity_scores, plain_toxicity)])
def test_scores_against_a_plain_version(spark, corpus, module, scores, plain, monkeypatch):
    monkeypatch.setattr(quality, "GROUP", 2)
    docs, labels, n = corpus
    more = spark.createDataFrame([(6000, "ÉA b\x01 ~ | é é\nQQ 12 a,b;! \x7f" * 40), (6001, "vileThing VILESCUM, grotty_ness"), (6002, " \n")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").filter("doc_id < 60 or doc_id = 5001 or doc_id is null").unionByName(more)
    model = module.train(docs, labels)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    of = {i: t for i, t in texts}
    for r in scores(docs, labels).collect():
        assert abs(r.score - plain(of[r.doc_id] or "", model)) < 1e-6, r


def test_samples_are_bounded_and_the_same_whichever_way(spark):
    ids = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    got = [r.doc_id for r in sample(ids, 50).collect()]
    assert got == [r.doc_id for r in ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()]
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert dict(labelled(labels, "quality").collect()) == {i: y for i, y in ((1, 1), (2, 0)) if not crc_held_out(i)}
    docs = spark.createDataFrame([(1, "b")] * 5 + [(1, "a")] * 5, "doc_id long, text string")
    assert sampled_texts(docs, spark.createDataFrame([(1, 1)], "doc_id long, y int")).collect() == [(1, "a")]
