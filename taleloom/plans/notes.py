"""Titles, folders and the note store."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions import marks
from taleloom.functions import titles as tt
from taleloom.functions.constants import SUBTYPES
from taleloom.operators import hierarchy as hi
from taleloom.operators import notes as op
from taleloom.plans import sql
from taleloom.plans.registry import query, table
from taleloom.sources import corpus

c = F.col


def derived(spark, d):
    return op.derived(corpus.notes(spark, d))


def folders(spark, d):
    return hi.inherited(hi.typed(corpus.folders(spark, d)))


def placed(spark, d):
    return op.with_folder(derived(spark, d), folders(spark, d))


@query("n01_parse_title", sql.with_(sql.NOTES + "," + sql.parsed("notes", "title", "p"), "SELECT id, kind, subtype, label FROM p"))
def n01(spark, d):
    return corpus.notes(spark, d).select("id", tt.parsed(c("title")).alias("p")).select("id", "p.kind", "p.subtype", "p.label")


@query("n02_parse_folder", sql.with_(sql.TYPED, "SELECT id, kind, subtype, label, kind IS NOT NULL AND coalesce(label, '') = '' AND subtype IS NULL AS is_typed_root, kind IS NOT NULL AND coalesce(label, '') = '' AND subtype IS NOT NULL AS is_subtype_root FROM typed"))
def n02(spark, d):
    p = c("p")
    return corpus.folders(spark, d).withColumn("p", tt.parsed(c("name"))).select("id", "p.kind", "p.subtype", "p.label", tt.is_typed_root(p).alias("is_typed_root"), tt.is_subtype_root(p).alias("is_subtype_root"))


@query("n03_format_titles", sql.with_(sql.NOTES + "," + sql.parsed("notes", "title", "p"), "SELECT id, '[' || kind || coalesce(':' || subtype, '') || '|' || label || ']' AS title, '[' || kind || ']' AS folder, '[' || kind || ':' || subtype || ']' AS subfolder FROM p WHERE kind IS NOT NULL"))
def n03(spark, d):
    rows = corpus.notes(spark, d).select("id", tt.parsed(c("title")).alias("p")).filter("p.kind is not null")
    return rows.select("id", tt.entity_title(c("p.kind"), c("p.subtype"), c("p.label")).alias("title"), tt.typed_folder_name(c("p.kind")).alias("folder"), tt.subtype_folder_name(c("p.kind"), c("p.subtype")).alias("subfolder"))


@query("n04_display_name", sql.with_(sql.NOTES + "," + sql.parsed("notes", "title", "p"), "SELECT id, coalesce(nullif(label, ''), subtype, kind, title) AS name FROM p"))
def n04(spark, d):
    return corpus.notes(spark, d).select("id", tt.display_name(c("title")).alias("name"))


@query("n05_is_entity_title", sql.with_(sql.NOTES + "," + sql.parsed("notes", "title", "p"), "SELECT id, kind IS NOT NULL AS is_entity_title FROM p"))
def n05(spark, d):
    return corpus.notes(spark, d).select("id", tt.parsed(c("title"))["kind"].isNotNull().alias("is_entity_title"))


@query("n06_folder_predicates", sql.with_(sql.TYPED, "SELECT id, kind IS NOT NULL AND coalesce(label, '') = '' AND subtype IS NULL AS typed_root, kind IS NOT NULL AND coalesce(label, '') = '' AND subtype IS NOT NULL AS subtype_root, kind IS NOT NULL AND coalesce(label, '') <> '' AS typed_subfolder FROM typed"))
def n06(spark, d):
    p = c("p")
    return corpus.folders(spark, d).withColumn("p", tt.parsed(c("name"))).select("id", tt.is_typed_root(p).alias("typed_root"), tt.is_subtype_root(p).alias("subtype_root"), tt.is_typed_subfolder(p).alias("typed_subfolder"))


_SUBTYPES_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{','.join(s)}'" for k, s in SUBTYPES.items()) + " END"


@query("n07_kind_checks", rf"""WITH k AS (SELECT p_partkey, upper(p_name) AS raw, CASE p_partkey % 3 WHEN 0 THEN 'CHARACTER' WHEN 1 THEN 'EVENT' ELSE p_type END AS kind, CASE p_partkey % 2 WHEN 0 THEN 'ALLY' ELSE 'MEETING' END AS subtype FROM part)
SELECT p_partkey, kind IN ({sql.KINDS_SQL}) AS valid_kind, kind || ':' || subtype IN ({sql.PAIRS_SQL}) AS valid_subtype, {_SUBTYPES_CASE} AS subtypes FROM k""")
def n07(spark, d):
    k = c("p_partkey")
    rows = table(spark, d, "part").select(k, F.when(k % 3 == 0, "CHARACTER").when(k % 3 == 1, "EVENT").otherwise(c("p_type")).alias("kind"), F.when(k % 2 == 0, "ALLY").otherwise("MEETING").alias("subtype"))
    return rows.select("p_partkey", tt.is_kind(c("kind")).alias("valid_kind"), tt.is_subtype(c("kind"), c("subtype")).alias("valid_subtype"), tt.subtypes_of(c("kind")).alias("subtypes"))


@query("n08_entity_id", f"SELECT p_partkey, {sql.entity_id(chr(39) + 'ITEM' + chr(39), 'p_name')} AS id FROM part")
def n08(spark, d):
    return table(spark, d, "part").select("p_partkey", tt.entity_id(F.lit("ITEM"), c("p_name")).alias("id"))


@query("n09_registry_name", f"SELECT p_partkey, regexp_replace(upper(' ' || p_name), '{tt.WS}+', '_', 'g') AS name FROM part")
def n09(spark, d):
    return table(spark, d, "part").select("p_partkey", tt.registry_name(F.concat(F.lit(" "), "p_name")).alias("name"))


@query("n10_unfinished_title", sql.with_(sql.NOTES, f"SELECT id, regexp_matches(title, '{tt.UNFINISHED}') AS unfinished FROM notes"))
def n10(spark, d):
    return corpus.notes(spark, d).select("id", c("title").rlike(tt.UNFINISHED).alias("unfinished"))


@query("n11_edit_title", sql.with_(sql.NOTES, rf"""SELECT id, CASE WHEN t = '' OR regexp_matches(t, '{tt.BARE_PREFIX}') OR ends_with(t, '|') OR f = before THEN NULL ELSE f END AS saved FROM
    (SELECT *, CASE WHEN regexp_matches(t, '{tt.OPEN_ENTITY}') THEN t || ']' ELSE t END AS f FROM (SELECT id, {sql.trim('title')} AS t, CASE WHEN ord % 3 = 0 THEN title ELSE '' END AS before FROM notes))"""))
def n11(spark, d):
    return corpus.notes(spark, d).select("id", tt.edited_title(c("title"), F.when(c("ord") % 3 == 0, c("title")).otherwise("")).alias("saved"))


@query("n12_split_key", "SELECT p_partkey, split_part(k, '|', 1) AS kind, substr(k, length(split_part(k, '|', 1)) + 2) AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type || '|' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_brand ELSE '' END END AS k FROM part)")
def n12(spark, d):
    p = c("p_partkey")
    k = F.when(p % 5 == 0, c("p_name")).otherwise(F.concat("p_type", F.lit("|"), "p_name", F.when(p % 2 == 0, F.concat(F.lit("|"), "p_brand")).otherwise("")))
    return table(spark, d, "part").select("p_partkey", k.alias("k")).select("p_partkey", tt.key_kind(c("k")).alias("kind"), tt.key_label(c("k")).alias("label"))


@query("r01_search", sql.with_(sql.NOTES, "SELECT id FROM notes WHERE contains(lower(title), 'order 12') OR contains(lower(content), 'order 12') OR contains(tag, 'order 12')"))
def r01(spark, d):
    return op.search(corpus.notes(spark, d), "Order 12").select("id")


@query("r01_search_tag", sql.with_(sql.NOTES, "SELECT id FROM notes WHERE contains(lower(title), 'building') OR contains(lower(content), 'building') OR contains(tag, 'building')"))
def r01t(spark, d):
    return op.search(corpus.notes(spark, d), "BUILDING").select("id")


@query("r02_without_folder", sql.with_(sql.NOTES, "SELECT id FROM notes WHERE coalesce(folder_id, '') = ''"))
def r02(spark, d):
    return op.without_folder(corpus.notes(spark, d)).select("id")


@query("r03_favorites", sql.with_(sql.NOTES, "SELECT id FROM notes WHERE favorite"))
def r03(spark, d):
    return op.favorites(corpus.notes(spark, d)).select("id")


@query("r04_folder_tree", sql.with_(sql.NOTES + "," + sql.TREE, "SELECT t.id, CAST(depth AS BIGINT) AS depth, path, count(n.id) AS notes FROM tree t LEFT JOIN notes n ON n.folder_id = t.id GROUP BY t.id, depth, path"))
def r04(spark, d):
    tree = hi.walk(hi.typed(corpus.folders(spark, d)))
    counts = corpus.notes(spark, d).groupBy("folder_id").agg(F.count("*").alias("n"))
    return tree.join(counts, tree["id"] == counts["folder_id"], "left").select("id", c("depth").cast("long").alias("depth"), "path", F.coalesce("n", F.lit(0)).cast("long").alias("notes"))


@query("r05_entity_note", sql.with_(sql.DERIVED, "SELECT arg_min(id, ord) AS id FROM derived WHERE entity_kind = 'EVENT' AND entity_label = 'Order 22'"))
def r05(spark, d):
    return op.entity_note(derived(spark, d), F.lit("EVENT"), F.lit("Order 22"))


@query("r06_nearest_kind", sql.with_(sql.TREE, "SELECT id, coalesce(kind, inherited_kind) AS kind, coalesce(subtype, inherited_subtype) AS subtype FROM tree"))
def r06(spark, d):
    return hi.walk(hi.typed(corpus.folders(spark, d))).select("id", F.coalesce("own_kind", "inherited_kind").alias("kind"), F.coalesce("own_subtype", "inherited_subtype").alias("subtype"))


_ENTITY = ("is_entity", "entity_kind", "entity_subtype", "entity_label")


@query("r07_derive_notes", sql.with_(sql.DERIVED, f"SELECT id, {', '.join(_ENTITY)} FROM derived"))
def r07(spark, d):
    return derived(spark, d).select("id", *_ENTITY)


@query("r08_derive_folders", sql.with_(sql.TREE, "SELECT id, kind AS entity_kind, subtype AS entity_subtype, label AS entity_label, inherited_kind, inherited_subtype FROM full_folders"))
def r08(spark, d):
    return folders(spark, d).select("id", "entity_kind", "entity_subtype", "entity_label", "inherited_kind", "inherited_subtype")


@query("r09_effective_kind", sql.with_(sql.NOTE_FOLDER, "SELECT id, coalesce(entity_kind, folder_kind) AS kind FROM placed"))
def r09(spark, d):
    return placed(spark, d).select("id", op.effective_kind().alias("kind"))


@query("r10_kind_warning", sql.with_(sql.NOTE_FOLDER, """SELECT id, 'Entity kind "' || entity_kind || '" does not match folder kind "' || folder_kind || '"' AS warning FROM placed WHERE is_entity AND folder_kind IS NOT NULL AND entity_kind <> folder_kind"""))
def r10(spark, d):
    return placed(spark, d).select("id", op.kind_warning().alias("warning")).filter("warning is not null")


@query("r11_needs_migration", sql.with_(sql.DERIVED, "SELECT coalesce(bool_or(is_entity), false) AS needed FROM derived"))
def r11(spark, d):
    now = derived(spark, d)
    stored = now.select("id", F.lit(None).cast("string").alias("entity_kind"), F.lit(None).cast("string").alias("entity_label"))
    return op.needs_migration(stored, now)


@query("r12_add", sql.with_(sql.NOTES + "," + sql.FOLDERS, "SELECT id, ord FROM notes UNION ALL SELECT 'new' || i, (SELECT min(ord) FROM notes) - 1 - i FROM range(3) t(i) UNION ALL SELECT id, ord FROM folders UNION ALL SELECT 'new-f' || i, (SELECT max(ord) FROM folders) + 1 + i FROM range(3) t(i)"))
def r12(spark, d):
    new = spark.range(3).select(F.concat(F.lit("new"), c("id").cast("string")).alias("id"), c("id").alias("ord"))
    newer = spark.range(3).select(F.concat(F.lit("new-f"), c("id").cast("string")).alias("id"), c("id").alias("ord"))
    return op.added_first(corpus.notes(spark, d).select("id", "ord"), new).unionByName(op.added_last(corpus.folders(spark, d).select("id", "ord"), newer))


@query("r13_patch", sql.with_(sql.NOTES, "SELECT id, CASE WHEN ord % 7 = 0 THEN 'patched ' || ord ELSE title END AS title, content, CASE WHEN ord % 7 = 0 THEN TIMESTAMP '2030-01-01' ELSE created_at END AS updated_at FROM notes"))
def r13(spark, d):
    rows = corpus.notes(spark, d).select("id", "ord", "title", "content", c("created_at").alias("updated_at"))
    patch = rows.filter("ord % 7 = 0").select("id", F.concat(F.lit("patched "), c("ord").cast("string")).alias("title"), F.lit(None).cast("string").alias("content"), F.lit("2030-01-01").cast("timestamp_ntz").alias("at"))
    return op.patched(rows, patch, ["title", "content"], "at").drop("ord")


@query("r14_delete_note", sql.with_(sql.NOTES, "SELECT id FROM notes WHERE ord % 3 <> 0"))
def r14(spark, d):
    rows = corpus.notes(spark, d)
    return op.deleted(rows, rows.filter("ord % 3 = 0")).select("id")


@query("r15_delete_folder", sql.with_(sql.NOTES + "," + sql.FOLDERS, "SELECT 'note' AS what, id FROM notes WHERE folder_id IS NULL OR folder_id NOT LIKE 's3-%' UNION ALL SELECT 'folder', id FROM folders WHERE id NOT LIKE 's3-%' AND id <> 'r1'"))
def r15(spark, d):
    f = corpus.folders(spark, d)
    notes, left = op.folder_deleted(corpus.notes(spark, d), f, f.filter("id like 's3-%' or id = 'r1'"))
    return notes.select(F.lit("note").alias("what"), "id").unionByName(left.select(F.lit("folder").alias("what"), "id"))


@query("r16_import_replaces", "SELECT 'n' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def r16(spark, d):
    from taleloom.sources.vault import import_blob, notes_of

    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), c("o_orderkey").cast("string")).alias("id"))).alias("notes"), F.array().cast("array<struct<id:string>>").alias("folders"))).alias("value"))
    return notes_of(import_blob(rows)).select("id")


@query("r17_write_derives", sql.with_(sql.NOTES + ", changed AS (SELECT id, ord, CASE WHEN ord % 2 = 0 THEN '[ITEM:KEY|' || customer || ']' ELSE title END AS title FROM notes)," + sql.parsed("changed", "title", "p"), "SELECT id, title, CASE WHEN coalesce(label, '') <> '' THEN kind END AS entity_kind, CASE WHEN coalesce(label, '') <> '' THEN label END AS entity_label FROM p"))
def r17(spark, d):
    rows = corpus.notes(spark, d)
    patch = rows.filter("ord % 2 = 0").select("id", F.concat(F.lit("[ITEM:KEY|"), "customer", F.lit("]")).alias("title"))
    return op.derived(op.patched(rows, patch, ["title"])).select("id", "title", "entity_kind", "entity_label")


@query("r18_folder_color", sql.with_(sql.TREE, f"SELECT id, coalesce(color, parent_color, {sql.PALETTE_SQL}[depth % 8 + 1]) AS color FROM tree"))
def r18(spark, d):
    return hi.folder_color(hi.walk(hi.typed(corpus.folders(spark, d))), corpus.PALETTE)


@query("r19_prefilled_title", sql.with_(sql.TREE, "SELECT id, CASE WHEN k IS NULL THEN '' WHEN s IS NULL THEN '[' || k || '|' ELSE '[' || k || ':' || s || '|' END AS title FROM (SELECT id, coalesce(kind, inherited_kind) AS k, coalesce(subtype, inherited_subtype) AS s FROM full_folders)"))
def r19(spark, d):
    f = folders(spark, d).select("id", F.coalesce("entity_kind", "inherited_kind").alias("folder_kind"), F.coalesce("entity_subtype", "inherited_subtype").alias("folder_subtype"))
    return f.select("id", op.prefilled_title().alias("title"))


@query("r20_history", "SELECT o_custkey % 60 AS version, o_orderkey FROM orders WHERE o_custkey % 60 IN (SELECT DISTINCT o_custkey % 60 FROM orders ORDER BY 1 DESC LIMIT 50)")
def r20(spark, d):
    return op.history(table(spark, d, "orders").select((c("o_custkey") % 60).alias("version"), "o_orderkey"))


@query("w02_sync", sql.with_(sql.NOTES + ", l AS (SELECT id, title, created_at AS updated_at FROM notes WHERE ord % 3 <> 0), e AS (SELECT id, 'theirs ' || id AS title, created_at + to_days(CAST(ord % 3 - 1 AS INTEGER)) AS updated_at FROM notes WHERE ord % 5 <> 0)", "SELECT e.id, CASE WHEN l.updated_at >= e.updated_at THEN l.title ELSE e.title END AS title, CASE WHEN l.updated_at >= e.updated_at THEN l.updated_at ELSE e.updated_at END AS updated_at FROM e LEFT JOIN l ON e.id = l.id"))
def w02(spark, d):
    rows = corpus.notes(spark, d)
    local = rows.filter("ord % 3 <> 0").select("id", "title", c("created_at").alias("updated_at"))
    shifted = F.expr("created_at + make_dt_interval(cast(ord % 3 - 1 as int))")
    external = rows.filter("ord % 5 <> 0").select("id", F.concat(F.lit("theirs "), "id").alias("title"), shifted.alias("updated_at"))
    return op.synced(local, external)


@query("z02_kind_color", sql.with_(sql.DERIVED, f"SELECT id, {sql.COLOR_CASE.format('entity_kind')} AS color FROM derived"))
def z02(spark, d):
    return derived(spark, d).select("id", tt.color_of(c("entity_kind")).alias("color"))


@query("z03_permalink", sql.with_(sql.NOTES, "SELECT id, 'https://example.org/note/' || id AS link FROM notes"))
def z03(spark, d):
    return corpus.notes(spark, d).select("id", op.permalink("https://example.org", c("id")).alias("link"))


@query("z04_rename_color", sql.with_(sql.TYPED, f"SELECT id, CASE WHEN k IS NOT NULL AND kind IS NULL THEN {sql.COLOR_CASE.format('k')} ELSE color END AS color FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 'EVENT' END AS k FROM typed)"))
def z04(spark, d):
    new = F.when(c("ord") % 2 == 0, "EVENT")
    return hi.typed(corpus.folders(spark, d)).select("id", op.renamed_color(new, c("entity_kind"), c("color"), tt.color_of(new)).alias("color"))


@query("z05_note_count", "SELECT count(*) AS notes FROM orders")
def z05(spark, d):
    return corpus.notes(spark, d).agg(F.count("*").alias("notes"))


@query("z06_data_url", "SELECT p_partkey, 'text/plain' AS mime, p_name AS content FROM part")
def z06(spark, d):
    from taleloom.sources.vault import data_url

    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("p_name", "UTF-8"))).alias("url"))
    return rows.select("p_partkey", data_url(c("url")).alias("x")).select("p_partkey", "x.mime", F.decode("x.data", "UTF-8").alias("content"))


@query("z01_ids", "SELECT count(*) AS notes, count(*) AS different, count(*) AS well_formed FROM orders")
def z01(spark, d):
    ids = corpus.notes(spark, d).select(tt.new_id().alias("id"))
    return ids.agg(F.count("*").alias("notes"), F.count_distinct("id").alias("different"), F.count_if(c("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"))


MARKED = """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EVENT' WHEN 1 THEN 'NPC' WHEN 2 THEN 'OTHER' END AS kind,
                          p_name || ' "a" <b> & &lt;' AS label, CASE WHEN p_partkey % 3 = 0 THEN '{"size":' || p_size || '}' END AS json FROM part),
                 e AS (SELECT *, CASE kind WHEN 'EVENT' THEN '#14b8a6' WHEN 'NPC' THEN '#f59e0b' ELSE '#6b7280' END AS color,
                          replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM p)"""


@query("z07_entity_marks", MARKED + """
    SELECT p_partkey, '<span' || coalesce(' data-kind="' || kind || '"', '') || ' data-label="' || safe || '"' || coalesce(' data-attributes="' || replace(json, '"', '&quot;') || '"', '')
           || ' data-entity="true" class="entity-mark" style="background-color: ' || color || '20; color: ' || color
           || '; padding: 2px 6px; border-radius: 4px; font-weight: 500; font-size: 0.875em;">' || safe || '</span>' AS html, kind, label, json AS attributes FROM e""")
def z07_entity(spark, d):
    kind = F.when(c("p_partkey") % 4 == 0, "EVENT").when(c("p_partkey") % 4 == 1, "NPC").when(c("p_partkey") % 4 == 2, "OTHER")
    label = F.concat("p_name", F.lit(' "a" <b> & &lt;'))
    attributes = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit('{"size":'), c("p_size").cast("string"), F.lit("}")))
    rows = table(spark, d, "part").select("p_partkey", marks.mark_html("entity", label, kind, label, attributes).alias("html"))
    return rows.select("p_partkey", "html", marks.mark_values("entity", c("html")).alias("x")).select("p_partkey", "html", "x.*")


@query("z07_other_marks", """
    WITH m AS (SELECT * FROM (VALUES ('tag', 'data-tag', '#3b82f6', ''), ('mention', 'data-mention-id', '#10b981', ''),
                                     ('wikilink', 'data-wikilink-title', '#6366f1', ' text-decoration: underline; text-decoration-style: dotted; cursor: pointer;')) AS t(mark, name, color, more))
    SELECT p_partkey, mark, '<span ' || name || '="' || p_name || '" class="' || mark || '-mark" style="background-color: ' || color || '20; color: ' || color
           || '; padding: 2px 6px; border-radius: 4px; font-weight: 500; font-size: 0.875em;' || more || '">' || p_brand || '</span>' AS html, p_name AS value FROM part, m""")
def z07_others(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), marks.mark_html(m, c("p_brand"), c("p_name")).alias("html")) for m in marks.TINTS])).alias("x"))
    value = F.coalesce(*[F.when(c("x.mark") == m, marks.mark_values(m, c("x.html"))[marks.MARKS[m][0][0].removeprefix("data-").replace("-", "_")]) for m in marks.TINTS])
    return rows.select("p_partkey", "x.mark", "x.html", value.alias("value"))
