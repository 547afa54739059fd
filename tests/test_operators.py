"""Small cases with results worked out by hand, and references written apart from the Spark code."""

import json

import pytest
from pyspark.sql import functions as F

from taleloom.functions import timeparse as tp
from taleloom.functions import titles as tt
from taleloom.operators import documents, entities, graph, hierarchy, links, markup, notes, registry, textstats, timeline
from taleloom.sources import vault


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("title", "want"), [
    ("[CHARACTER:ALLY|Jon Snow]", ("CHARACTER", "ALLY", "Jon Snow")),
    ("  [ITEM|  Ice ]\n", ("ITEM", None, "Ice")),
    ("[CHARACTER:CITY|x]", (None, None, None)),
    ("[FOO|x]", (None, None, None)),
    ("[CHARACTER:ALLY]", ("CHARACTER", "ALLY", None)),
    ("[NPC|a|b]", ("NPC", None, "a|b")),
    ("plain", (None, None, None)),
    ("", (None, None, None)),
])
def test_titles(spark, title, want):
    assert tuple(one(spark, tt.parsed(F.lit(title)))) == want


def test_title_helpers(spark):
    assert one(spark, tt.display_name(F.lit("[CHARACTER:ALLY]"))) == "ALLY"
    assert one(spark, tt.is_subtype_root(tt.parsed(F.lit("[CHARACTER:ALLY]")))) is True
    assert one(spark, tt.edited_title(F.lit("[CHARACTER:ALLY|Jon"), F.lit(""))) == "[CHARACTER:ALLY|Jon]"
    assert one(spark, tt.edited_title(F.lit("[CHARACTER|"), F.lit(""))) is None
    assert one(spark, tt.entity_id(F.lit("ITEM"), F.lit(" a \t b "))) == "ITEM:A_B"
    assert one(spark, tt.key_label(F.lit("ITEM|a|b"))) == "a|b"


def markup_rows(spark, text):
    return spark.createDataFrame([("n", text, 0)], "id string, content string, ord int")


def test_markup_quirks(spark):
    df = markup_rows(spark, "x [[CHARACTER|Jon]] é\U0001f600 [FOO|y] [ITEM|Ice|{'age':3}] [ITEM|Bad|{'a}] #a #a @b.c <<Back | z>> [A|x] (REL) [B|y]")
    assert [r.value for r in markup.wikilinks(df).collect()] == ["CHARACTER"]
    found = {(r.kind, r.label): r for r in markup.entities(df).collect()}
    assert {("CHARACTER", "Jon"), ("FOO", "y"), ("ITEM", "Ice"), ("A", "x"), ("B", "y")} <= set(found)
    assert found["CHARACTER", "Jon"].position == 3
    assert found["FOO", "y"].position == 24  # UTF-16: the emoji counts twice
    assert found["ITEM", "Ice"].attributes == {"age": "3"}
    assert [r.value for r in markup.tags(df).collect()] == ["a"] and [r.value for r in markup.mentions(df).collect()] == ["b"]
    assert [r.value for r in markup.backlinks(df).collect()] == ["Back"]
    assert markup.triples(df).count() == 0
    assert [tuple(r)[2:] for r in markup.triples(markup_rows(spark, "[A| x ]  ->R->[B|y]")).collect()] == [("A", "x", "R", "B", "y")]
    link = [r for r in links.outgoing(df).collect() if r.entity_kind == "ITEM"][0]
    assert link.target_title == "Ice|{'age':3}"


def test_tokens_do_not_overlap(spark):
    got = markup.tokens(markup_rows(spark, "[ITEM|#a] [FOO|@b] [[x #y]] #z three days later")).collect()
    assert [(r.type, r.text) for r in sorted(got, key=lambda r: r.start)] == [("entity", "[ITEM|#a]"), ("wikilink", "[[x #y]]"), ("tag", "#z"), ("time", "three days later")]


def test_link_context(spark):
    got = links.outgoing(markup_rows(spark, "a" * 50 + " [[T]] " + "b" * 50)).first()
    assert got.context == "..." + "a" * 39 + " [[T]] " + "b" * 39 + "..."


def test_text_statistics(spark):
    row = textstats.analyze(spark.createDataFrame([(1, "word " * 225)], "id int, text string"), "id").first()
    assert (row.reading_minutes, row.reading_seconds, row.speaking_minutes, row.speaking_seconds) == (1, 0, 1, 30)
    assert one(spark, textstats.syllables(F.lit("created"))) == 1
    odd = textstats.analyze(spark.createDataFrame([(1, "3.14 is. a\U0001f600"), (2, " \n"), (3, "...")], "id int, text string"), "id").collect()
    assert [(r.id, r.sentence_count, r.char_count) for r in odd] == [(1, 3, 12), (3, 0, 3)]
    assert odd[1].reading_level == "N/A"


def relation(spark, rows):
    return spark.createDataFrame(rows, "source_kind string, source string, target_kind string, target string, type string, weight int, confidence double, ord int")


def test_explicit_relation_confidence(spark):
    ids = spark.createDataFrame([("A", "x", "A:X"), ("B", "y", "B:Y")], "kind string, label string, entity_id string")
    r = ("A", "x", "B", "y", "R", 1, 1.0)
    assert entities.explicit_relations(relation(spark, [(*r, 0)]), ids).first().confidence == 0.5
    two = entities.explicit_relations(relation(spark, [(*r, 0), ("B", "y", "A", "x", "R", 1, 1.0, 1), ("A", "X", "B", "y", "R", 1, 1.0, 2)]), ids).collect()
    assert [(t.source_id, t.weight, t.confidence) for t in two] == [("A:X", 2, 0.75)]


def test_pmi_of_the_only_note(spark):
    e = spark.createDataFrame([("a", 1), ("b", 1)], "entity_id string, notes long")
    assert entities.with_pmi(spark.createDataFrame([("a", "b", 1)], "a string, b string, weight long"), e, 1).first().pmi == 0


@pytest.fixture(scope="module")
def pieces(spark):
    """A path of four, a triangle and a lone node."""
    names = ["a", "b", "c", "d", "t1", "t2", "t3", "z"]
    nodes = spark.createDataFrame([(n, i, 1) for i, n in enumerate(names)], "id string, ord long, frequency long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("t1", "t2"), ("t2", "t3"), ("t1", "t3")], "a string, b string").withColumns({"weight": F.lit(1), "ord": F.monotonically_increasing_id()})
    return nodes, edges


def test_graph_of_pieces(spark, pieces):
    nodes, edges = pieces
    got = {r.id: r for r in graph.analytics(nodes, edges).collect()}
    assert {n: r.community for n, r in got.items()} == dict.fromkeys("abcd", "community_0") | dict.fromkeys(["t1", "t2", "t3"], "community_1") | {"z": "community_2"}
    assert got["z"].closeness == 0 and abs(got["b"].closeness - 3 / 7 * 3 / 4) < 1e-12
    assert abs(got["b"].betweenness - 4 / 21) < 1e-12 and got["t1"].betweenness == 0
    near, between = graph.ego(nodes, edges, "b", 1)
    assert {r.id for r in near.collect()} == set("abc") and between.count() == 2
    assert graph.ego(nodes, edges, "nobody")[0].count() == 0
    assert graph.statistics(nodes.limit(0), edges.limit(0)).first()[0:4] == (0, 0, 0.0, 0.0)


def test_betweenness_of_a_path():
    assert graph.path_betweenness(["a", "b", "c"], [("a", "b"), ("b", "c")]) == {"a": 0.0, "b": 2.0, "c": 0.0}


def test_components_of_a_long_path(spark):
    n = 150
    nodes = spark.createDataFrame([(str(i), (i * 37) % n, 1) for i in range(n)], "id string, ord long, frequency long")
    edges = spark.createDataFrame([(str(i), str(i + 1), 1, i) for i in range(n - 1)], "a string, b string, weight int, ord long")
    assert {r.community for r in graph.components(nodes, edges).collect()} == {"community_0"}


def test_components_of_an_ordered_path_and_many_lone_nodes(spark):
    n = 1000
    nodes = spark.range(n + 500).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.lit(1).cast("long").alias("frequency"))
    edges = spark.range(n - 1).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"), F.lit(1).alias("weight"), F.col("id").alias("ord"))
    got = {int(r.id): r.community for r in graph.components(nodes, edges).collect()}
    assert got == {i: "community_0" if i < n else f"community_{i - n + 1}" for i in range(n + 500)}


def test_deep_folders(spark):
    n = 1000
    rows = [(f"f{i}", "[LOCATION:CITY|x]" if i == 3 else f"n{i}", f"f{i - 1}" if i else None, "#111111" if i == 5 else None) for i in range(n)]
    rows += [("lost", "[FACTION]", "nowhere", None), ("below", "b", "lost", None), ("r1", "ring", "r2", None), ("r2", "ring", "r1", None), ("r3", "under a ring", "r1", None)]
    tree = {r.id: r for r in hierarchy.walk(hierarchy.typed(spark.createDataFrame(rows, "id string, name string, parent_id string, color string"))).collect()}
    assert set(tree) == {r[0] for r in rows} - {"r1", "r2", "r3"}
    assert [tree[f"f{i}"].depth for i in range(n)] == list(range(n)) and tree["f999"].path == "/".join(f"f{i}" for i in range(n))
    assert tree["f3"].inherited_kind is None and tree["f999"].inherited_kind == "LOCATION" and tree["f999"].inherited_subtype == "CITY"
    assert tree["f6"].parent_color == "#111111" and tree["f7"].parent_color is None
    assert (tree["lost"].depth, tree["below"].depth, tree["below"].inherited_kind) == (0, 1, "FACTION")


def test_event_tree_of_many_roots_and_levels(spark):
    many = spark.range(2_000_000).select(F.concat(F.lit("e"), "id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("minor").alias("importance"))
    deep = spark.range(300).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") == 0, F.lit("e7")).otherwise(F.concat(F.lit("d"), (F.col("id") - 1).cast("string"))).alias("parent_id"), F.when(F.col("id") == 200, F.lit("major")).otherwise(F.lit("minor")).alias("importance"))
    tree = timeline.event_tree(many.unionByName(deep), ["minor"])
    assert tree.filter("depth = 0").count() == 2_000_000
    assert sorted((r.depth, r.id, r.root) for r in tree.filter("depth > 0").collect()) == [(i + 1, f"d{i}", "e7") for i in range(200)]


@pytest.mark.parametrize(("text", "want"), [
    ("Act 2", ("sequential", 200, 1.0)),
    ("Chapter 1", ("sequential", 10000, 1.0)),
    ("ch. 3 scene 9", ("sequential", 30000, 1.0)),
    ("3 days later", ("relative", None, 0.8)),
    ("the same day", ("abstract", None, 0.4)),
    ("soon after", ("abstract", None, 0.5)),
    ("2024-02-30", ("abstract", None, 0.4)),
    ("12 March 2024", ("precise", None, 0.95)),
])
def test_time(spark, text, want):
    p = one(spark, tp.parse(F.lit(text)))
    assert (p.granularity, p.sequence, p.confidence) == want


def test_comparable_time(spark):
    assert one(spark, tp.comparable(tp.parse(F.lit("Act 2")), F.lit(None).cast("long"))) == 2200
    assert one(spark, tp.comparable(tp.parse(F.lit("Chapter 1")), F.lit(None).cast("long"))) == 1_010_000
    assert one(spark, tp.comparable(tp.parse(F.lit("in a dream")), F.lit(0).cast("long"))) == tp.NEVER
    assert one(spark, tp.display(tp.parse(F.lit("#7")))) == "#7" and one(spark, tp.display(tp.parse(F.lit("Chapter 2, act 3")))) == "Ch. 2, Act 3"


def test_timeline_positions(spark):
    rows = spark.createDataFrame([(i, i, 5 - i % 3, "major") for i in range(20)], "id int, ord int, time long, importance string").repartition(4)
    got = [r.id for r in timeline.ordered(rows).orderBy("position").collect()]
    assert got == sorted(range(20), key=lambda i: (5 - i % 3, i))


def test_folder_tree(spark):
    f = spark.createDataFrame([("r", "[LOCATION:CITY]", None, None), ("k", "plain", "r", None), ("g", "[ITEM]", "k", None), ("h", "x", "g", None), ("lost", "y", "gone", None), ("o", "o", "p", None), ("p", "p", "o", None)], "id string, name string, parent_id string, color string")
    tree = {r.id: r for r in hierarchy.walk(hierarchy.typed(f)).collect()}
    assert {k: r.depth for k, r in tree.items()} == {"r": 0, "k": 1, "g": 2, "h": 3, "lost": 0}
    assert (tree["h"].inherited_kind, tree["h"].inherited_subtype) == ("ITEM", "CITY") and tree["h"].path == "r/k/g/h"


def test_sync_and_history(spark):
    schema = "id string, title string, updated_at long"
    local = spark.createDataFrame([("a", "mine", 5), ("b", "mine", 5), ("only", "mine", 9)], schema)
    other = spark.createDataFrame([("a", "theirs", 5), ("b", "theirs", 6), ("new", "theirs", 1)], schema)
    assert {(r.id, r.title) for r in notes.synced(local, other).collect()} == {("a", "mine"), ("b", "theirs"), ("new", "theirs")}
    assert ("only", "mine") in {(r.id, r.title) for r in notes.synced(local, other, keep_local_only=True).collect()}
    assert notes.replay("pur") == [0, 0, 0]
    assert len(set(notes.replay("p" * 80))) == 80


def test_documents():
    d = {"type": "doc", "content": [{"type": "heading", "content": [{"type": "text", "text": "H", "marks": [{"type": "entity", "attrs": {"kind": "ITEM", "label": "Ice", "attributes": {"age": 3}}}, {"type": "tag", "attrs": {"tag": "t"}}, {"type": "mentionMark", "attrs": {"id": "no"}}]}]}, {"type": "listItem", "content": [{"type": "text", "text": "i"}, {"type": "hardBreak"}]}, {"type": "wikilink", "attrs": {"title": "W"}}]}
    text, context, link, texts, found, tags, mentions, _, wikilinks, _ = documents.read(json.dumps(d))
    assert text == "H\n\ni" and context == "H i  " and link == "H i  " and texts == ["H", "i"]
    assert found == [{"kind": "ITEM", "label": "Ice", "attributes": [("age", "3")]}] and tags == ["t"] and mentions == [] and wikilinks == ["W"]
    assert documents.read(" not json ")[0] == " not json " and documents.read("123")[0] == "" and documents.read(None)[0] == ""
    deep = '{"type":"doc","content":[' * 400 + "]}" * 400
    assert documents.read(deep)[0] == ""


def test_registry(spark):
    types = registry.entity_types(spark)
    with pytest.raises(registry.Duplicate):
        registry.registered(types, types.limit(1), "kind")
    with pytest.raises(registry.Protected):
        registry.without(types, "kind", "EVENT", registry.KINDS)
    assert one(spark, registry.progress_percent(F.lit(5), F.lit(0))) == 0
    assert one(spark, registry.edited_progress(F.lit("x"), F.lit(9).cast("long"))) is None


def test_vault(spark, tmp_path):
    good = spark.createDataFrame([('{"notes":[{"id":"a","createdAt":"2024-01-01T00:00:00Z"}],"folders":[]}',)], "value string")
    assert [r.id for r in vault.notes_of(vault.import_blob(good)).collect()] == ["a"]
    with pytest.raises(Exception, match="notes and folders"):
        vault.import_blob(spark.createDataFrame([('{"notes":[]}',)], "value string")).select("vault.notes").collect()
    store = vault.SnapshotStore(spark, f"file://{tmp_path}")
    df = spark.range(3)
    assert store.load("t", df.schema).count() == 0
    store.save({"t": df})
    store.save({"t": spark.range(5)})
    assert (store.load("t", df.schema).count(), store.load_backup("t", df.schema).count()) == (5, 3)
    import shutil

    shutil.rmtree(tmp_path / "v2")
    assert store.load("t", df.schema).count() == 3
    store.restore()
    assert store.pointer()["current"] == 1


def test_stream_keeps_the_last_write_in_any_order(spark, tmp_path):
    from taleloom.streaming.notes import changes, upsert

    rows = [(i % 7, i, (i * 13) % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "key int, value int, version int")
    for part in range(5):
        df.filter(F.col("value") % 5 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = vault.SnapshotStore(spark, f"file://{tmp_path}/store")
    upsert(changes(spark, f"{tmp_path}/in", df.schema, 1), store, "t", "key", "version", f"{tmp_path}/ck", {"availableNow": True}).awaitTermination()
    want = {k: max((v, x) for kk, x, v in rows if kk == k) for k in range(7)}
    assert {r.key: (r.version, r.value) for r in store.load("t", df.schema).collect()} == want


def test_extractor_registry(spark):
    known = entities.Extractors()
    known.register("regex", entities.by_regex)
    assert known.has("regex") and not known.has("llm")
    assert known.extract(markup_rows(spark, "[ITEM|a]"), ["llm"]) is None
    assert known.extract(markup_rows(spark, "[ITEM|a] [ITEM|a]"), ["llm", "regex"]).first().positions == [0, 9]
    known.register("broken", lambda notes: notes.select("no such column"))
    with pytest.warns(UserWarning, match="broken"):
        got = known.extract(markup_rows(spark, "[ITEM|a|{'x': '1'}]"), ["broken", "regex"])
    assert got.first().attributes == {"x": "1"} and entities.merged(got).first().methods == ["regex"]
