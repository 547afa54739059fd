import random

from taleloom.llm.chat import formatted, read_back

PARTS = ["[INST] ", " [/INST]", "</s>", " </s>", "<ANSWER> ", "<<SYS>> ", "~", "~0", "~1", "[", "<", ">", "a b", "é\U0001f600", "\n", "\\", " ", "<ROLE:x> ", " </ROLE>"]


def test_every_text_comes_back(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "assistant", "tool", "a>b [x]", ""])
            rows.append((conv, turn, role, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))))
    got = {r.conv_id: r for r in read_back(formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).collect()}
    for conv in range(120):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == mine
        assert got[conv].loss_text == "".join(t for r, t in mine if r == "assistant")


def test_turn_order_and_flags(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "q"), (4, 0, "user", "q"), (4, 1, "user", "q"), (5, 0, "tool", "x"), (6, 0, "system", "s"), (6, 1, "assistant", "a")]
    got = {r.conv_id: r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert {k: r.first_bad for k, r in got.items()} == {1: None, 2: 1, 3: None, 4: 2, 5: 1, 6: 2}
    assert got[1].formatted == "[INST] q [/INST]<ANSWER> a </s>"
    assert [(s.text, s.loss) for s in got[1].segments] == [("[INST] ", False), ("q", False), (" [/INST]", False), ("<ANSWER> ", False), ("a", True), (" </s>", False)]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, segments int"
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "user", ""), (2, 5, "assistant", "long [" * 60_000)]
    got = {r.conv_id: r for r in read_back(formatted(spark.createDataFrame([(*r, "z", 1) for r in rows], schema))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("unknown", "x"), ("unknown", "x")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "")]
    assert got[2].loss_text == "long [" * 60_000
    assert formatted(spark.createDataFrame([], schema)).count() == 0


def test_long_conversations_and_the_query(spark):
    import duckdb

    from taleloom.llm.queries import ORACLES, op5_chat

    n = 20_000  # over many chunks of turns
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}[") for i in range(n)] + [(2, i, ("user", "assistant")[i % 2 if i < 900 else 0], "x") for i in range(1000)]
    got = {r.conv_id: r for r in read_back(formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].valid and len(got[1].turns) == n and got[1].loss_text == "".join(f"t{i}[" for i in range(1, n, 2))
    assert not got[2].valid and got[2].first_bad == 902
    plan = op5_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "invalid" in plan and "start" in plan  # the state machine is part of the query's result
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(ORACLES["op5_chat"]).fetchdf()
    mine = op5_chat(spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(mine) == key(want)
