"""Registry, fact sheets, vault, documents and the change stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions.constants import COLORS, KINDS, RELATIONSHIP_TYPES
from taleloom.operators import documents as doc
from taleloom.operators import markup as mu
from taleloom.operators import notes as no
from taleloom.operators import registry as rg
from taleloom.plans import sql
from taleloom.plans.markup import _ENTITIES
from taleloom.plans.registry import query, table
from taleloom.sources import corpus, vault
from taleloom.sources.shared import new_path, spread, written

c = F.col
_TYPES = "types AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'title', 'rectangle', '{COLORS[k]}')" for k in KINDS) + ") t(kind, label_prop, shape, color))"
_RELS = "rels AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{t}', {str(d).lower()})" for a, b, t, d in RELATIONSHIP_TYPES) + ") t(label, source, targets, directed))"


@query("k01_entity_types", sql.with_(_TYPES, "SELECT * FROM types"))
def k01(spark, d):
    return rg.entity_types(spark)


@query("k01_relationship_types", sql.with_(_RELS, "SELECT * FROM rels"))
def k01r(spark, d):
    return rg.relationship_types(spark).select("label", c("from").alias("source"), F.array_join("to", ",").alias("targets"), "directed")


@query("k02_register", sql.with_(_TYPES, "SELECT kind, color FROM types UNION ALL SELECT DISTINCT upper(replace(p_type, ' ', '_')), '#abcdef' FROM part"))
def k02(spark, d):
    new = table(spark, d, "part").select(F.upper(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("kind")).distinct()
    new = new.select("kind", F.lit("name").alias("label_prop"), F.lit("ellipse").alias("shape"), F.lit("#abcdef").alias("color"))
    return rg.registered(rg.entity_types(spark), new, "kind").select("kind", "color")


@query("k03_update", sql.with_(_TYPES, "SELECT kind, label_prop, CASE kind WHEN 'EVENT' THEN '#ffffff' ELSE color END AS color FROM types"))
def k03(spark, d):
    patch = spark.createDataFrame([("EVENT", None, "#ffffff")], "kind string, label_prop string, color string")
    return rg.updated(rg.entity_types(spark), patch, "kind", ["label_prop", "color"]).select("kind", "label_prop", "color")


@query("k04_delete", sql.with_(_RELS, "SELECT label FROM rels WHERE label <> 'MENTIONS'"))
def k04(spark, d):
    return rg.without(rg.relationship_types(spark), "label", "MENTIONS").select("label")


@query("k05_blueprints", "SELECT DISTINCT p_type AS entity_kind, 'bp ' || p_type AS name FROM part WHERE p_type <> 'ECONOMY'")
def k05(spark, d):
    rows = table(spark, d, "part").select(c("p_type").alias("entity_kind"), F.concat(F.lit("bp "), "p_type").alias("name")).distinct()
    return rg.without(rows, "entity_kind", "ECONOMY")


@query("k06_valid_blueprint", "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS valid FROM part")
def k06(spark, d):
    k = c("p_partkey")
    return table(spark, d, "part").select(k, rg.valid_blueprint(F.when(k % 3 == 0, "  ").otherwise(c("p_name")), F.when(k % 5 != 0, c("p_type"))).alias("valid"))


_SHEETS = "sheets AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in rg.FACT_SHEETS.items()) + ") t(kind, cards, fields))"


@query("k07_fact_sheet", sql.with_(sql.DERIVED + "," + _SHEETS, "SELECT id, cards, fields FROM derived JOIN sheets ON entity_kind = kind"))
def k07(spark, d):
    return no.derived(corpus.notes(spark, d)).join(F.broadcast(rg.fact_sheets(spark)), c("entity_kind") == c("kind")).select("id", "cards", "fields")


@query("k08_note_entities", sql.with_(sql.DERIVED + _ENTITIES, "SELECT id, kind, label, ord >= 0 AS inline FROM (SELECT id, kind, label, min(ord) AS ord FROM (SELECT id, entity_kind AS kind, entity_label AS label, -1 AS ord FROM derived WHERE is_entity UNION ALL SELECT id, kind, label, ord FROM ents) GROUP BY id, kind, label)"))
def k08(spark, d):
    notes = corpus.notes(spark, d)
    return rg.note_entities(no.derived(notes), mu.entities(notes))


@query("k09_attributes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS value, p_name AS other FROM part")
def k09(spark, d):
    key, other = F.lit("ITEM|a"), F.lit("ITEM|b")
    first = rg.with_attributes(F.lit(None).cast("map<string,map<string,string>>"), key, F.create_map(F.lit("v"), "p_type"))
    both = rg.with_attributes(first, other, F.create_map(F.lit("v"), "p_name"))
    last = F.when(c("p_partkey") % 2 == 0, rg.with_attributes(both, key, F.create_map(F.lit("v"), "p_brand"))).otherwise(both)
    rows = table(spark, d, "part").select("p_partkey", last.alias("m"))
    return rows.select("p_partkey", rg.attributes_of(c("m"), key)["v"].alias("value"), rg.attributes_of(c("m"), other)["v"].alias("other"))


@query("k10_defaults", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS t, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 7 ELSE 0 END AS n, 0 AS current, 100 AS most, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 10 END AS stat FROM part")
def k10(spark, d):
    k, size = c("p_partkey"), c("p_size")
    null = F.lit(None).cast("int")
    p = rg.progress_field(null, null)
    return table(spark, d, "part").select(k, rg.text_field(F.when(k % 2 == 0, c("p_name"))).alias("t"), rg.number_field(F.when(k % 3 == 0, size), F.when(k % 3 == 1, 7)).alias("n"), p["current"].alias("current"), p["max"].alias("most"), rg.stat_field(F.when(k % 2 == 0, size)).alias("stat"))


@query("k11_progress_percent", "SELECT p_partkey, CASE WHEN p_size - 10 > 0 THEN greatest(0.0, least(100.0, (p_partkey % 60 - 5) / (p_size - 10) * 100)) ELSE 0.0 END AS percent FROM part")
def k11(spark, d):
    return table(spark, d, "part").select("p_partkey", rg.progress_percent(c("p_partkey") % 60 - 5, c("p_size") - 10).alias("percent"))


@query("k12_edit_progress", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN least(p_size, 20) ELSE 20 END::BIGINT AS value FROM part")
def k12(spark, d):
    k, s = c("p_partkey"), c("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("x"), s)).when(k % 4 == 1, F.concat(F.lit("-"), s)).when(k % 4 == 2, F.concat(F.lit(" "), s, F.lit(".9"))).otherwise("999")
    return table(spark, d, "part").select(k, rg.edited_progress(text, F.lit(20).cast("long")).alias("value"))


@query("k13_clamp", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN least(greatest(p_size, 10), 30) WHEN 1 THEN greatest(p_size, 10) ELSE p_size END AS value FROM part")
def k13(spark, d):
    k = c("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", rg.clamped(c("p_size"), F.when(k != 2, 10), F.when(k == 0, 30)).alias("value"))


@query("k14_stat_total", "SELECT p_partkey, p_size + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS total, greatest(p_size - 25, 0) AS edited FROM part")
def k14(spark, d):
    return table(spark, d, "part").select("p_partkey", rg.stat_total(c("p_size"), F.when(c("p_partkey") % 2 == 0, 3)).alias("total"), rg.edited_stat(c("p_size") - 25).alias("edited"))


@query("k15_standing", "SELECT p_partkey, v AS value, (v + 100) / 200 * 100 AS percent, CASE WHEN v >= 50 THEN 'hsl(142, 76%, 36%)' WHEN v >= 20 THEN 'hsl(142, 76%, 50%)' WHEN v >= -20 THEN 'hsl(45, 93%, 47%)' WHEN v >= -50 THEN 'hsl(25, 95%, 53%)' ELSE 'hsl(0, 84%, 60%)' END AS color FROM (SELECT p_partkey, greatest(-100, least(100, p_partkey % 260 - 130)) AS v FROM part)")
def k15(spark, d):
    return table(spark, d, "part").select("p_partkey", rg.standing(c("p_partkey") % 260 - 130).alias("s")).select("p_partkey", "s.*")


@query("k16_list_edits", "SELECT p_partkey, p_name || ',' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ',new' ELSE '' END AS appended, CASE WHEN p_partkey % 2 = 0 THEN p_name || ',new' ELSE p_name || ',' || p_brand END AS replaced, p_brand AS removed FROM part")
def k16(spark, d):
    items, value = F.array("p_name", "p_brand"), F.when(c("p_partkey") % 2 == 0, " new ").otherwise("  ")
    show = lambda x, n: F.array_join(x, ",").alias(n)
    return table(spark, d, "part").select("p_partkey", show(rg.appended(items, value), "appended"), show(rg.replaced(items, F.lit(1), value), "replaced"), show(rg.removed(items, F.lit(0)), "removed"))


#: Order keys to a blob: what one value holds does not grow with the table.
BLOB_NOTES = 1000


# The vault: blobs of notes, exported and read again.
def blobs(spark, d):
    notes = corpus.notes(spark, d).select("id", "title", "content", F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("createdAt"), "ord", c("folder_id").alias("folderId"))
    empty = spark.createDataFrame([], "id string, ord long")
    return vault.export_blob(notes, empty, F.lit("2024-01-01T00:00:00Z"), F.floor(c("ord") / BLOB_NOTES))


@query("s03_parse_blob", sql.with_(sql.NOTES, "SELECT id, title, content, folder_id, epoch_ms(created_at) AS created_ms FROM notes"))
def s03(spark, d):
    return vault.notes_of(vault.parse(blobs(spark, d))).select("id", "title", "content", c("folderId").alias("folder_id"), F.unix_millis("createdAt").alias("created_ms"))


@query("s05_export", sql.with_(sql.NOTES, """SELECT CAST(ord // 1000 AS BIGINT) AS part, sha256('{"notes":[' || string_agg('{"id":"' || id || '","title":"' || title || '","content":"' || content || '","createdAt":"'
    || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '"' || coalesce(',"folderId":"' || folder_id || '"', '') || '}', ',' ORDER BY ord) || '],"folders":[],"exportedAt":"2024-01-01T00:00:00Z","version":"1.0"}') AS value_sha256 FROM notes GROUP BY 1"""))
def s05(spark, d):
    return blobs(spark, d).select("part", F.sha2("value", 256).alias("value_sha256"))


@query("s06_import", sql.with_(sql.NOTES, "SELECT CAST(ord // 1000 AS BIGINT) AS part, string_agg(id, ',' ORDER BY ord) AS ids FROM notes GROUP BY 1"))
def s06(spark, d):
    return vault.import_blob(blobs(spark, d)).select("part", F.array_join(F.transform("vault.notes", lambda n: n["id"]), ",").alias("ids"))


_STORE_SQL = "SELECT 'current' AS slot, o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'backup', o_orderkey FROM orders UNION ALL SELECT 'restored', o_orderkey FROM orders"


@query("s01_s02_s04_s08_snapshots", _STORE_SQL)
def s04(spark, d):
    store = vault.SnapshotStore(spark, new_path(spark, "store"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.save({"orders": orders})
    store.save({"orders": orders.filter("o_orderstatus <> 'P'")})
    first = store.load("orders", orders.schema).select(F.lit("current").alias("slot"), "o_orderkey")
    second = store.load_backup("orders", orders.schema).select(F.lit("backup").alias("slot"), "o_orderkey")
    store.restore()
    return first.unionByName(second).unionByName(store.load("orders", orders.schema).select(F.lit("restored").alias("slot"), "o_orderkey"))


@query("s07_registry", sql.with_(_TYPES + "," + _RELS, "SELECT kind AS name FROM types UNION ALL SELECT 'OWN' UNION ALL SELECT label FROM rels"))
def s07(spark, d):
    """Saved entity types come back; relationship types, which were not saved, are the defaults."""
    store = vault.SnapshotStore(spark, new_path(spark, "registry"))
    own = spark.createDataFrame([("OWN", "title", "rectangle", "#000000")], "kind string, label_prop string, shape string, color string")
    rg.save_registry(store, {"entity_types": rg.registered(rg.entity_types(spark), own, "kind")})
    found = rg.load_registry(store, spark)
    return written(found["entity_types"].select(c("kind").alias("name")).unionByName(found["relationship_types"].select(c("label").alias("name"))))


@query("s09_as_document", "SELECT doc_id, text AS back FROM documents WHERE text <> ''")
def s09(spark, d):
    rows = table(spark, d, "documents").filter("text <> ''").select(c("doc_id").alias("id"), vault.as_document(c("text")).alias("content"))
    return doc.walked(rows).select(c("id").cast("long").alias("doc_id"), c("link_text").alias("back"))


def rich(spark, d):
    """A document per order: a heading, a marked paragraph, a list item and nodes, as JSON."""
    def text(x, marks=None):
        return F.struct(F.lit("text").alias("type"), x.alias("text"), *([marks.alias("marks")] if marks is not None else []))

    mark = F.to_json(F.array(F.struct(F.lit("entity").alias("type"), F.struct(F.lit("ITEM").alias("kind"), c("o_orderpriority").alias("label")).alias("attrs"))))
    status = F.to_json(F.array(F.struct(F.lit("tag").alias("type"), F.struct(c("o_orderstatus").alias("tag")).alias("attrs"))))
    plain = F.to_json(text(F.concat(F.lit("Order "), c("o_orderkey").cast("string"))))
    marked = F.concat(F.lit('{"type":"text","text":'), F.to_json(F.array("o_orderpriority")).substr(F.lit(2), F.length(F.to_json(F.array("o_orderpriority"))) - 2), F.lit(',"marks":'), mark, F.lit("}"))
    tagged = F.concat(F.lit('{"type":"text","text":"item","marks":'), status, F.lit("}"))
    link = F.concat(F.lit('{"type":"wikilink","attrs":{"title":"Order '), (c("o_orderkey") - 1).cast("string"), F.lit('"}}'))
    content = F.concat(
        F.lit('{"type":"doc","content":[{"type":"heading","content":['), plain, F.lit(']},{"type":"paragraph","content":['), marked, F.lit(","), link,
        F.lit(']},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":['), tagged, F.lit("]}]}]}]}"),
    )
    return spread(table(spark, d, "orders")).select(c("o_orderkey").cast("string").alias("id"), content.alias("content"))


_BR = "chr(10)"


@query("t01_analytics_text", f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey || {_BR} || {_BR} || o_orderpriority || {_BR} || {_BR} || 'item' AS text FROM orders")
def t01(spark, d):
    return doc.walked(rich(spark, d)).select("id", "text")


@query("t02_context_text", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority || '  item' AS context_text FROM orders")
def t02(spark, d):
    return doc.walked(rich(spark, d)).select("id", "context_text")


@query("t03_link_text", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority || '  item' AS link_text FROM orders")
def t03(spark, d):
    return doc.walked(rich(spark, d)).select("id", "link_text")


@query("m01_walk", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey || '|' || o_orderpriority || '|item' AS texts FROM orders")
def m01(spark, d):
    return doc.walked(rich(spark, d)).select("id", F.array_join("texts", "|").alias("texts"))


@query("m02_entity_marks", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'ITEM' AS kind, o_orderpriority AS label FROM orders")
def m02(spark, d):
    return doc.walked(rich(spark, d)).select("id", F.explode("entities").alias("e")).select("id", "e.kind", "e.label")


@query("m03_tag_marks", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS tag FROM orders")
def m03(spark, d):
    return doc.walked(rich(spark, d)).select("id", F.explode("tags").alias("tag"))


@query("m04_wikilink_nodes", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || (o_orderkey - 1) AS title FROM orders")
def m04(spark, d):
    return doc.walked(rich(spark, d)).select("id", F.explode("wikilinks").alias("title"))


@query("w01_change_stream", "SELECT user_id, arg_max(event_id, epoch_us(ts)) AS event_id, max(epoch_us(ts)) AS version FROM events GROUP BY user_id")
def w01(spark, d):
    """All changes as a stream of small files, until it is empty; the result is the table that it leaves."""
    from taleloom.streaming.notes import changes, upsert

    work = new_path(spark, "stream")
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("version"))
    rows.repartition(6, "event_id").write.parquet(f"{work}/in")
    store = vault.SnapshotStore(spark, f"{work}/store")
    upsert(changes(spark, f"{work}/in", rows.schema, 2), store, "last", "user_id", "version", f"{work}/checkpoint", {"availableNow": True}).awaitTermination()
    return written(store.load("last", rows.schema))

