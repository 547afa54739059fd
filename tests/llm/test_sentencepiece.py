import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import functions as F

from taleloom.llm.queries import QUERIES
from taleloom.llm.sentencepiece_lattice import SPACE, PieceTable, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", " a", "a ", "é", "ﬁ x", "a\nb", "\t", "日本\U0001d518", "a" + SPACE + "b", "<s> </s> <unk>", "<0x41>", "[INST] x", "１２", "\x00a", "a　b", "x" * 47, "y" * 48, "the " * 3000, "thentionable" * 400, " " * 100, "é" * 100]


def test_ids_and_texts_are_the_librarys(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["th", "en", "tion", " ", "  ", "ü", "\n", "ing", "1", ".", "zq", "日"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts + texts[:5])], "id long, text string, key string, at int")
    got = encode(rows, "text", PATH).withColumn("back", decode(F.col("ids"), PATH)).collect()
    assert len(got) == len(texts) + 5
    for r in got:
        assert r.ids == model.encode(r.text), repr(r.text)
        assert r.back == r.text.replace(SPACE, " "), repr(r.text)


def test_nulls_and_no_rows(spark):
    schema = "id long, text string"
    assert [r.ids for r in encode(spark.createDataFrame([(1, None)], schema), "text", PATH).collect()] == [[]]
    assert encode(spark.createDataFrame([], schema), "text", PATH).count() == 0


def test_queries_encode_documents_and_conversations(spark, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "the nation  of é"), (2, None), (2, "y" * 60), (3, "a" + SPACE + "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in rows], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ids = [(i, model.encode(t or "")) for i, t in rows]
    want = sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), True) for i, x in ids)
    assert sorted(map(tuple, QUERIES["op8_sentencepiece"](spark, str(tmp_path)).collect())) == want
    turns = QUERIES["sentencepiece_conversations"](spark, str(tmp_path)).drop("turn", "role")
    assert sorted(map(tuple, turns.collect())) == want


def _model(path, kind, pieces, byte_pieces=True, **rules):
    """A model file of given pieces and scores; nothing is trained."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = proto.trainer_spec.ModelType.Value(kind)
    proto.trainer_spec.byte_fallback = byte_pieces
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for k, v in rules.items():
        setattr(proto.normalizer_spec, k, v)
    kinds = proto.SentencePiece.Type
    rows = [("<unk>", 0, kinds.Value("UNKNOWN")), ("<s>", 0, kinds.Value("CONTROL")), ("</s>", 0, kinds.Value("CONTROL"))]
    rows += [(f"<0x{b:02X}>", 0, kinds.Value("BYTE")) for b in range(256)] if byte_pieces else []
    for piece, score, type_ in rows + [(x, v, kinds.Value("NORMAL")) for x, v in pieces]:
        proto.pieces.add(piece=piece, score=score, type=type_)
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return str(path)


def test_unigram_pieces_by_viterbi(spark, tmp_path):
    rng = random.Random(8)
    pieces = {SPACE: -2.0, "a": -3.0, "b": -3.0, "ab": -5.5, SPACE + "a": -4.0, "aa": -6.0, "ba": -6.0, "aba": -9.0}  # with ties
    while len(pieces) < 80:
        pieces.setdefault(rng.choice(["", "", SPACE]) + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))), -rng.randint(4, 40) / 4)
    path = _model(tmp_path / "unigram.model", "UNIGRAM", pieces.items())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "aba", "abaaba ab", "é日x", "  a  b "] + ["".join(rng.choice("aabbcde é") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for r in encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text", path).collect():
        assert r.ids == model.encode(r.text), r.text


def test_bpe_pieces_that_rank_before_their_parts(spark, tmp_path):
    rng = random.Random(9)
    found = {SPACE, *"abcd"}
    while len(found) < 90:
        found.add(rng.choice(["", "", SPACE]) + "".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))))
    pieces = sorted(found)
    rng.shuffle(pieces)  # the order of ranks is any: parts before and after what they are parts of
    path = _model(tmp_path / "bpe.model", "BPE", [(x, -float(i)) for i, x in enumerate(pieces)])
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "aaaa", "abab" * 12, "eaé日b"] + ["".join(rng.choice("aabbcde ") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for r in encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text", path).collect():
        assert r.ids == model.encode(r.text), r.text


def test_a_column_named_ids_is_replaced(spark):
    got = encode(spark.createDataFrame([("the", 5, "k", "x")], "ids string, text int, __key string, __ids string"), "ids", PATH).collect()
    assert [tuple(r) for r in got] == [(5, "k", "x", sentencepiece.SentencePieceProcessor(model_file=PATH).encode("the"))]


def test_other_models_are_refused(tmp_path):
    for kind, match, kwargs in (("WORD", "kind", {}), ("CHAR", "kind", {}), ("UNIGRAM", "byte pieces", {"byte_pieces": False}), ("BPE", "rewrites", {"remove_extra_whitespaces": True})):
        path = _model(tmp_path / f"{kind}.model", kind, [("a", -1.0), ("b", -2.0)], **kwargs)
        with pytest.raises(ValueError, match=match):
            PieceTable(path)


def test_nothing_is_shuffled_and_numbers_begin_anew(spark, monkeypatch):
    from taleloom.llm import sentencepiece_lattice as lattice

    texts = [f"the nation{i} {'x' * 47}.{'z' * 60} of,é" for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(lattice, "PARTS", 7)
    monkeypatch.setattr(lattice, "ROWS", 5)
    out = encode(rows, "text", PATH)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [(r.text, r.ids) for r in out.collect()] == [(t, model.encode(t)) for t in texts]


def test_bpe_pieces_of_equal_scores(spark, tmp_path):
    rng = random.Random(10)
    found = {SPACE, *"abcd"}
    while len(found) < 60:
        found.add(rng.choice(["", "", SPACE]) + "".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))))
    path = _model(tmp_path / "bpe.model", "BPE", [(x, -float(rng.randint(0, 70))) for x in sorted(found)])
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["aaaa", "abab" * 12] + ["".join(rng.choice("aabbcde ") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for r in encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text", path).collect():
        assert r.ids == model.encode(r.text), r.text


def test_an_edge_takes_one_step_of_the_fold(tmp_path):
    # The fold of a lattice goes over its edges once; before, it went over all borders again for each merge.
    from taleloom.llm.sentencepiece_lattice import _along, _Merges

    rng = random.Random(11)
    for _ in range(30):
        found = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
        pieces = rng.sample(sorted(found), len(found))  # any order of ranks
        path = _model(tmp_path / "bpe.model", "BPE", [(SPACE, -1000.0), *((c, -900.0 - ord(c)) for c in "abc"), *((x, -float(i)) for i, x in enumerate(pieces))])
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        codes = {x: (i << 20) + model.piece_to_id(x) for i, x in enumerate([*pieces, SPACE, *"abc"])}
        texts = [SPACE + "".join(rng.choice("abc") for _ in range(rng.randint(1, 47))) for _ in range(100)]
        for text, edges in zip(texts, _Merges(codes).lattices(texts).to_pylist(), strict=True):
            at = (1 << len(text) + 1) - 1
            for e in edges:
                at = at ^ e["split"] if at & e["span"] == e["want"] else at
            assert _along(text, at, codes, 3) == model.encode(text[1:]), text


def test_nothing_is_left_to_do_for_each_id_after_the_tasks_that_have_them(spark, tmp_path):
    # Joining ids and reading them back in expressions took most of the time.
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["op8_sentencepiece"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "array_join" not in plan


def test_bytes_that_are_no_text_are_replaced(spark):
    table = PieceTable(PATH)
    cases = [[table.first_byte + b for b in octets] for octets in (b"\xff", b"A\xe2\x96B", "é".encode(), b" ", b"  ")]
    got = [r.back for r in spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "n int, ids array<int>").withColumn("back", decode(F.col("ids"), PATH)).orderBy("n").collect()]
    assert got == ["�", "A�B", "é", "", " "]
    nulls = spark.createDataFrame([(None,), ([None, cases[0][0]],), ([],)], "ids array<int>").select(decode(F.col("ids"), PATH)).collect()
    assert [r[0] for r in nulls] == [None, "�", ""]


def test_numbers_looked_up_together_and_paths_read_together():
    import numpy as np
    import pyarrow as pa

    from taleloom.llm.sentencepiece_lattice import _all_along, _along, _Places

    rng = random.Random(12)
    keys = [*rng.sample(range(1 << 41), 5000), *range(3000)]
    places, asked = dict(zip(keys, range(len(keys)))), [*keys, *range(2000, 9000)]
    assert _Places(np.array(keys), np.arange(len(keys))).of(np.array(asked)).tolist() == [places.get(k, -1) for k in asked]
    assert _Places(np.zeros(0, np.int64), np.zeros(0, np.int64)).of(np.array([0, 5])).tolist() == [-1, -1]
    codes = {SPACE: 300, "a": 301, "é": 302, "aé": 303, "日": 304}
    parts = ["".join(rng.choice([SPACE, "a", "é", "日", "\U0001d518"]) for _ in range(rng.randint(1, 47))) for _ in range(500)]
    paths = [sum(1 << i for i in range(1, len(x)) if x[i - 1 : i + 1] != "aé") | 1 | 1 << len(x) for x in parts]
    ids, sizes = _all_along(pa.array(["cut off", *parts]).slice(1), np.array(paths), pa.array(codes), codes, 3)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [_along(x, at, codes, 3) for x, at in zip(parts, paths)]


def test_no_list_is_sent_as_null(spark, monkeypatch):
    # Asked for a batch's size at each row, Arrow walks over all null lists since the last other one: rows in runs took the square of the run.
    rows = spark.createDataFrame([("the nation of é",), (None,), ("z" * 60,), ("  ",)], "text string")
    frames, real = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: frames.append(self) or real(self, *a, **k))
    encode(rows, "text", PATH)
    got = frames[1].collect()
    assert len(got) > 8 and all(r["__numbers"] is not None and r["__known"] is not None for r in got)
