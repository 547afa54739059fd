"""Markup and links over the derived notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.operators import links as li
from taleloom.operators import markup as mu
from taleloom.operators import notes as no
from taleloom.plans import sql
from taleloom.plans.registry import query, table
from taleloom.sources import corpus

_W = r"\[\[\s*([^\]\s|][^\]|]*?)\s*(?:\|[^\]]*)?\]\]"


def _values_sql(pattern: str, source: str = "notes", text: str = "content") -> str:
    """First-seen order, once a note."""
    return f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS INTEGER) AS ord, value FROM
    (SELECT id, value, min(i) AS first FROM (SELECT id, unnest(regexp_extract_all({text}, '{pattern}', 1)) AS raw, generate_subscripts(regexp_extract_all({text}, '{pattern}', 1), 1) AS i FROM {source}) x,
     LATERAL (SELECT {sql.trim('raw')} AS value) GROUP BY id, value)"""


@query("m05_tags", sql.with_(sql.NOTES, _values_sql(mu.TAG)))
def m05(spark, d):
    return mu.tags(corpus.notes(spark, d))


@query("m06_mentions", "WITH " + "docs AS (SELECT 'd' || doc_id AS id, text FROM documents) " + _values_sql(mu.MENTION, "docs", "text"))
def m06(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return mu.mentions(docs, "text")


@query("m07_wikilinks", sql.with_(sql.NOTES, _values_sql(_W)))
def m07(spark, d):
    return mu.wikilinks(corpus.notes(spark, d))


_ENT = r"\[([A-Z_]+)(?::([A-Z_]+))?\|([^\]]+?)(?:\|(\{.*?\}))?\]"
_ENTITIES = f""", raw AS (SELECT id, content, regexp_extract_all(content, '{_ENT}', 0) AS w, regexp_extract_all(content, '{_ENT}', 1) AS k, regexp_extract_all(content, '{_ENT}', 2) AS s, regexp_extract_all(content, '{_ENT}', 3) AS l,
     string_split_regex(content, '{_ENT}') AS gaps FROM notes),
ents AS (SELECT id, i - 1 AS ord, k[i] AS kind, nullif(s[i], '') AS subtype, l[i] AS label,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS position FROM raw, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) t)"""


@query("m08_entities", sql.with_(sql.NOTES + _ENTITIES, "SELECT id, CAST(ord AS INTEGER) AS ord, kind, subtype, label, CAST(position AS INTEGER) AS position FROM ents"))
def m08(spark, d):
    return mu.entities(corpus.notes(spark, d)).drop("attributes")


@query("m08_attributes", "SELECT p_partkey, p_name AS label, CAST(p_size AS VARCHAR) AS size FROM part")
def m08a(spark, d):
    text = F.concat(F.lit("see [ITEM|"), "p_name", F.lit("|{'size':"), F.col("p_size").cast("string"), F.lit("}] there"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("content"))
    return mu.entities(rows).select(F.col("id").alias("p_partkey"), "label", F.col("attributes")["size"].alias("size"))


@query("m09_backlinks", "SELECT p_partkey AS id, 0 AS ord, p_name AS value FROM part")
def m09(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("a << "), "p_name", F.lit(" |x>> b <<"), "p_name", F.lit(">> <<  >>")).alias("content"))
    return mu.backlinks(rows)


_TRIPLES_SRC = r"""
lives AS (SELECT 'c' || c_custkey AS id, '[CHARACTER|' || c_name || '] ->LIVES_IN-> [LOCATION| ' || n_name || ' ]' AS content FROM customer JOIN nation ON c_nationkey = n_nationkey),
part_of AS (SELECT 'p' || n_nationkey AS id, '[LOCATION|' || n_name || '] ->PART_OF-> [LOCATION|' || r_name || '] and [A|x] (REL) [B|y] [LOCATION|' || n_name || ']->PART_OF->[LOCATION|' || r_name || ']' AS content FROM nation JOIN region ON n_regionkey = r_regionkey),
texts AS (SELECT * FROM lives UNION ALL SELECT * FROM part_of),
found AS (SELECT id, regexp_extract_all(content, '\[([A-Z_]+)\|([^\]]+)\]\s*->([A-Z_]+)->\s*\[([A-Z_]+)\|([^\]]+)\]', 0) AS w FROM texts),
matches AS (SELECT id, i - 1 AS ord, w[i] AS m FROM found, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) t),
triples AS (SELECT id, CAST(ord AS INTEGER) AS ord, regexp_extract(m, '^\[([A-Z_]+)', 1) AS subject_kind, trim(regexp_extract(m, '^\[[A-Z_]+\|([^\]]+)', 1)) AS subject, regexp_extract(m, '->([A-Z_]+)->', 1) AS predicate,
                   regexp_extract(m, '->\s*\[([A-Z_]+)', 1) AS object_kind, trim(regexp_extract(m, '->\s*\[[A-Z_]+\|([^\]]+)', 1)) AS object FROM matches)
"""


@query("m10_triples", sql.with_(_TRIPLES_SRC, "SELECT * FROM triples"))
def m10(spark, d):
    return mu.triples(corpus.triples_text(spark, d))


@query("m11_distinct_values", sql.with_(sql.NOTES, f"SELECT id, count(DISTINCT value) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '{mu.TAG}', 1)) AS value FROM notes) GROUP BY id"))
def m11(spark, d):
    return mu.tags(corpus.notes(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("m12_merged_entities", sql.with_(sql.NOTES + _ENTITIES, "SELECT id, kind, subtype, label, CAST(min(ord) AS INTEGER) AS ord, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM ents GROUP BY id, kind, subtype, label"))
def m12(spark, d):
    out = mu.merged_entities(mu.entities(corpus.notes(spark, d)))
    return out.select("id", "kind", "subtype", "label", "ord", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("m13_has_syntax", rf"SELECT doc_id, regexp_matches(text, '#(\w+)') OR regexp_matches(text, '@(\w+)') OR regexp_matches(text, '{_W}') OR regexp_matches(text, '{_ENT}') OR regexp_matches(text, '{mu.BACKLINK}') AS has_syntax FROM documents")
def m13(spark, d):
    return table(spark, d, "documents").select("doc_id", mu.has_syntax(F.col("text")).alias("has_syntax"))


def _spans(kind: str, pattern: str) -> str:
    """SQL for the places of a pattern's matches in the notes, from the text between them."""
    return f"""(SELECT id, '{kind}' AS type, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS s, w[i] AS text FROM
        (SELECT id, regexp_extract_all(content, '{pattern}', 0) AS w, string_split_regex(content, '{pattern}') AS g FROM notes), LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) t)"""


_TOKENS = ", brackets AS (SELECT * FROM " + _spans("entity", r"\[(?:[A-Z_]+)(?::(?:[A-Z_]+))?\|(?:[^\]]+)\]") + "), loose AS (SELECT * FROM " + _spans("wikilink", r"\[\[(?:[^\]]+)\]\]") + " UNION ALL SELECT * FROM " + _spans("tag", r"#\w+") + " UNION ALL SELECT * FROM " + _spans("mention", r"@\w+") + ")"


@query("p01_tokens", sql.with_(sql.NOTES + _TOKENS, r"""SELECT id, CAST(s AS INTEGER) AS "start", CAST(s + length(text) AS INTEGER) AS "end", type, text FROM (
    SELECT * FROM brackets WHERE regexp_matches(text, '^\[(CHARACTER|LOCATION|ITEM|FACTION)[:|]')
    UNION ALL SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM brackets b WHERE b.id = l.id AND b.s < l.s + length(l.text) AND l.s < b.s + length(b.text)))"""))
def p01(spark, d):
    return mu.tokens(corpus.notes(spark, d))


_PHRASE = "CASE event_id % 4 WHEN 0 THEN 'Three days later, at dawn, ' || event_type || ' came the next morning' WHEN 1 THEN 'meanwhile 5 hours ago ' || event_type WHEN 2 THEN 'that evening, moments later' ELSE event_type END"


@query("p02_temporal_phrases", f"WITH e AS (SELECT event_id, {_PHRASE} AS t FROM events), p AS (" + " UNION ALL ".join(f"SELECT event_id, {i} AS pattern, unnest(regexp_extract_all(t, '{p}')) AS phrase FROM e" for i, p in enumerate(mu.TEMPORAL)) + ") SELECT * FROM p")
def p02(spark, d):
    e = F.col("event_id") % 4
    text = F.when(e == 0, F.concat(F.lit("Three days later, at dawn, "), "event_type", F.lit(" came the next morning"))).when(e == 1, F.concat(F.lit("meanwhile 5 hours ago "), "event_type")).when(e == 2, F.lit("that evening, moments later")).otherwise(F.col("event_type"))
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("phrases")) for i, p in enumerate(mu.TEMPORAL)])
    rows = table(spark, d, "events").select("event_id", F.explode(found).alias("x"))
    return rows.select("event_id", "x.pattern", F.explode("x.phrases").alias("phrase"))


# Links. The oracle's contexts come from string positions, which differ from the gaps that the operator adds up.
_LINKS = r""", lw AS (SELECT id AS source, 'wikilink' AS link_type, NULL::VARCHAR AS entity_kind, unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS raw, 0 AS part, generate_subscripts(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), 1) AS i FROM notes),
le AS (SELECT id, 'entity', unnest(regexp_extract_all(content, '\[([A-Z][A-Z_]*)(?::[A-Z_]+)?\|([^\]]+)\]', 1)), unnest(regexp_extract_all(content, '\[([A-Z][A-Z_]*)(?::[A-Z_]+)?\|([^\]]+)\]', 2)), 1, generate_subscripts(regexp_extract_all(content, '\[([A-Z][A-Z_]*)(?::[A-Z_]+)?\|([^\]]+)\]', 1), 1) FROM notes),
lm AS (SELECT id, 'mention', NULL, unnest(regexp_extract_all(content, '@(\w+)', 1)), 2, generate_subscripts(regexp_extract_all(content, '@(\w+)', 1), 1) FROM notes),
la AS (SELECT * FROM lw UNION ALL SELECT * FROM le UNION ALL SELECT * FROM lm),
links AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY part, i) - 1 AS INTEGER) AS ord, trim(raw) AS target_title, link_type, entity_kind,
                 CASE WHEN entity_kind IS NULL THEN 'note:' ELSE 'entity:' || entity_kind || ':' END || lower(trim(raw)) AS key FROM la),
ix AS (SELECT source, key, count(*) AS "count", arg_min(link_type, ord) AS link_type FROM links GROUP BY source, key),
names AS (SELECT lower(trim(title)) AS name, id, ord FROM derived UNION ALL SELECT lower(trim(entity_label)), id, ord FROM derived WHERE is_entity),
firsts AS (SELECT name, arg_min(id, ord) AS target FROM names GROUP BY name),
hits AS (SELECT d.id, i.source, i."count", i.link_type, 0 AS way FROM derived d JOIN ix i ON i.key = 'note:' || lower(trim(d.title)) WHERE d.id <> i.source
         UNION ALL SELECT d.id, i.source, i."count", i.link_type, 1 FROM derived d JOIN ix i ON d.is_entity AND i.key = 'entity:' || d.entity_kind || ':' || lower(trim(d.entity_label)) WHERE d.id <> i.source)
"""
_L = sql.DERIVED + _LINKS


def links(spark, d):
    return li.outgoing(corpus.notes(spark, d))


@query("l01_outgoing", sql.with_(_L, "SELECT source, ord, target_title, link_type, entity_kind FROM links"))
def l01(spark, d):
    return links(spark, d).drop("context")


for _i, _kind in (("a", "wikilink"), ("b", "entity"), ("c", "mention")):
    @query(f"l01{_i}_{_kind}s", sql.with_(_L, f"SELECT source, target_title, entity_kind FROM links WHERE link_type = '{_kind}'"))
    def l01x(spark, d, kind=_kind):
        return links(spark, d).filter(F.col("link_type") == kind).select("source", "target_title", "entity_kind")


@query("l02_context", sql.with_(sql.NOTES, r"""SELECT id AS source, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(content, a + 1, b - a)) || CASE WHEN b < length(content) THEN '...' ELSE '' END AS context FROM
    (SELECT id, content, greatest(p - 1 - 40, 0) AS a, least(length(content), p - 1 + n + 40) AS b FROM (SELECT id, content, strpos(content, m) AS p, length(m) AS n FROM (SELECT id, content, regexp_extract(content, '\[\[([^\]|]+)\]\]') AS m FROM notes)))"""))
def l02(spark, d):
    return links(spark, d).filter("link_type = 'wikilink'").select("source", "context")


@query("l03_link_keys", sql.with_(_L, "SELECT source, ord, key FROM links"))
def l03(spark, d):
    return links(spark, d).select("source", "ord", li.link_key(F.col("target_title"), F.col("entity_kind")).alias("key"))


@query("l04_links_per_note", sql.with_(_L, "SELECT source, count(*) AS links FROM links GROUP BY source"))
def l04(spark, d):
    return links(spark, d).groupBy("source").agg(F.count("*").alias("links"))


@query("l05_link_index", sql.with_(_L, 'SELECT source, key, "count", link_type FROM ix'))
def l05(spark, d):
    return li.index(links(spark, d)).drop("context")


@query("l06_backlinks", sql.with_(_L, 'SELECT id, source, "count", link_type FROM hits QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY way) = 1'))
def l06(spark, d):
    return li.backlinks(no.derived(corpus.notes(spark, d)), li.index(links(spark, d)))


@query("l07_links_of_note", sql.with_(_L, "SELECT ord, target_title, link_type FROM links WHERE source = 'n42'"))
def l07(spark, d):
    return links(spark, d).filter("source = 'n42'").select("ord", "target_title", "link_type")


@query("l08_find_note", sql.with_(_L, "SELECT source, ord, target FROM links LEFT JOIN firsts ON name = lower(target_title)"))
def l08(spark, d):
    return li.resolved(links(spark, d), no.derived(corpus.notes(spark, d))).select("source", "ord", "target")


@query("l09_dangling", sql.with_(_L, "SELECT source, ord, target_title FROM links WHERE lower(target_title) NOT IN (SELECT name FROM firsts)"))
def l09(spark, d):
    return li.dangling(links(spark, d), no.derived(corpus.notes(spark, d))).select("source", "ord", "target_title")


@query("l10_outgoing_counts", sql.with_(_L, "SELECT source, count(*) FILTER (link_type = 'wikilink') AS wikilinks, count(*) FILTER (link_type = 'mention') AS mentions, count(*) FILTER (link_type = 'entity') AS entities, count(*) AS total FROM (SELECT DISTINCT source, link_type, entity_kind, lower(target_title) AS t FROM links) GROUP BY source"))
def l10(spark, d):
    return li.outgoing_counts(links(spark, d))


@query("l11_create_missing", sql.with_(_L, "SELECT min(target_title) AS title FROM links WHERE link_type = 'wikilink' AND lower(target_title) NOT IN (SELECT name FROM firsts) GROUP BY lower(target_title)"))
def l11(spark, d):
    return li.created_for_missing(links(spark, d), no.derived(corpus.notes(spark, d)))


@query("p03_link_exists", sql.with_(_L, "SELECT source, ord, target IS NOT NULL AS found FROM links LEFT JOIN firsts ON name = lower(target_title) WHERE link_type = 'wikilink'"))
def p03(spark, d):
    return li.resolved(links(spark, d).filter("link_type = 'wikilink'"), no.derived(corpus.notes(spark, d))).select("source", "ord", F.col("target").isNotNull().alias("found"))
