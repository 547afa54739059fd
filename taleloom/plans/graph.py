"""Entities, co-occurrence and graph analytics over the derived notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions.titles import color_of
from taleloom.operators import entities as en
from taleloom.operators import graph as gr
from taleloom.operators import markup as mu
from taleloom.plans import sql
from taleloom.plans.markup import _ENTITIES, _TRIPLES_SRC
from taleloom.plans.registry import query, table
from taleloom.sources import corpus
from taleloom.sources.shared import written

_X = sql.NOTES + _ENTITIES + f""",
extracted AS (SELECT e.id AS note_id, n.ord AS note_ord, kind, subtype, label, count(*) AS n, min(e.ord) AS ord, {sql.entity_id('kind', 'label')} AS entity_id FROM ents e JOIN notes n USING (id) GROUP BY e.id, n.ord, kind, subtype, label),
entities AS (SELECT entity_id, arg_min(label, note_ord * 1000 + ord) AS label, arg_min(kind, note_ord * 1000 + ord) AS kind, arg_min(subtype, note_ord * 1000 + ord) FILTER (subtype IS NOT NULL) AS subtype,
                    CAST(sum(n) AS BIGINT) AS frequency, count(DISTINCT note_id) AS notes, 1.0 AS confidence, min(note_ord * 1000 + ord) AS ord FROM extracted GROUP BY entity_id),
member AS (SELECT DISTINCT entity_id, note_id FROM extracted),
cooc AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS weight FROM member x JOIN member y ON x.note_id = y.note_id AND x.entity_id < y.entity_id GROUP BY 1, 2)
"""


def extractors() -> en.Extractors:
    known = en.Extractors()
    known.register("regex", en.by_regex)
    return known


def extracted(spark, d):
    return extractors().extract(corpus.notes(spark, d), ["llm", "regex"])


def entities(spark, d):
    return en.merged(extracted(spark, d))


def cooc(spark, d):
    return en.cooccurrence(en.memberships(extracted(spark, d)))


@query("e01_extractors", sql.with_(_X, "SELECT 'regex' AS method, count(*) AS entities FROM extracted"))
def e01(spark, d):
    return extracted(spark, d).groupBy("method").agg(F.count("*").alias("entities"))


@query("e04_extract", sql.with_(_X, "SELECT note_id, kind, subtype, label, 1.0::DOUBLE AS confidence, n AS mentions FROM extracted"))
def e04(spark, d):
    return extracted(spark, d).select("note_id", "kind", "subtype", "label", "confidence", en.mention_count().cast("long").alias("mentions"))


@query("e05_mention_context", sql.with_(sql.NOTES, r"""SELECT id, trim(CASE WHEN a > 0 THEN '...' ELSE '' END || substr(content, a + 1, b - a) || CASE WHEN b < length(content) THEN '...' ELSE '' END) AS context FROM
    (SELECT id, content, greatest(p - 50, 0) AS a, least(p + length(l) + 50, length(content)) AS b FROM (SELECT id, content, strpos(content, '[LOCATION') - 1 AS p, regexp_extract(content, '\[LOCATION:COUNTRY\|([^\]]+)\]', 1) AS l FROM notes))"""))
def e05(spark, d):
    notes = corpus.notes(spark, d)
    found = mu.entities(notes).filter("kind = 'LOCATION'")
    return found.join(notes.select("id", "content"), "id").select("id", en.mention_context(F.col("content"), F.col("position"), F.col("label")).alias("context"))


@query("e06_merge", sql.with_(_X, "SELECT entity_id, label, kind, subtype, frequency, notes, confidence::DOUBLE AS confidence, 'regex' AS methods FROM entities"))
def e06(spark, d):
    return entities(spark, d).drop("ord").withColumn("methods", F.array_join("methods", ","))


@query("e06_note_ids", sql.with_(_X, "SELECT entity_id, note_id FROM member"))
def e06n(spark, d):
    return en.memberships(extracted(spark, d)).select("entity_id", F.col("unit").alias("note_id"))


@query("e06_mentions", sql.with_(_X, """SELECT entity_id, id AS note_id, CAST(p AS INTEGER) AS position,
    trim(CASE WHEN a > 0 THEN '...' ELSE '' END || substr(content, a + 1, b - a) || CASE WHEN b < length(content) THEN '...' ELSE '' END) AS context FROM
    (SELECT id, content, p, greatest(p - 50, 0) AS a, least(p + length(label) + 50, length(content)) AS b, entity_id FROM
        (SELECT e.id, content, CAST(position AS BIGINT) AS p, label, """ + sql.entity_id("kind", "label") + """ AS entity_id FROM ents e JOIN notes n USING (id)))"""))
def e06m(spark, d):
    notes = corpus.notes(spark, d)
    return en.mentions(extracted(spark, d), notes)


_SIZED = """rows AS (SELECT p_partkey AS k, 'ITEM:' || upper(replace(p_brand, ' ', '_')) AS entity_id, p_size::VARCHAR AS size, p_type AS kind FROM part)"""


@query("e04_attributes", "WITH " + _SIZED + " SELECT entity_id, 'size' AS key, arg_max(size, k) AS value FROM rows GROUP BY 1 UNION ALL SELECT entity_id, 'kind', arg_max(kind, k) FROM rows WHERE k % 3 = 0 GROUP BY 1")
def e04a(spark, d):
    k = F.col("p_partkey")
    more = F.when(k % 3 == 0, F.concat(F.lit(", 'kind': '"), "p_type", F.lit("'"))).otherwise("")
    text = F.concat(F.lit("see [ITEM|"), "p_brand", F.lit("|{'size': '"), F.col("p_size").cast("string"), F.lit("'"), more, F.lit("}] there"))
    notes = table(spark, d, "part").select(k.cast("string").alias("id"), k.alias("ord"), text.alias("content"))
    return en.entity_attributes(extractors().extract(notes, ["regex"]))


@query("e04_relationships", sql.with_(_TRIPLES_SRC, "SELECT id AS note_id, subject_kind AS source_kind, subject AS source, object_kind AS target_kind, object AS target, predicate AS type, 1 AS weight, 1.0::DOUBLE AS confidence, 'regex' AS method FROM triples"))
def e04r(spark, d):
    return en.relationships(corpus.triples_text(spark, d)).drop("ord")


def _fails(notes):
    raise ValueError("this extractor does not work")


@query("e02_e03_failing_extractor", sql.with_(_X, "SELECT note_id, count(*) AS entities FROM extracted GROUP BY note_id"))
def e02(spark, d):
    """One extractor of three fails and one is unknown: the notes' entities come from the one that works."""
    import warnings

    known = extractors()
    known.register("llm", _fails)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = known.extract(corpus.notes(spark, d), ["llm", "nobody", "regex"])
    return found.groupBy("note_id").agg(F.count("*").alias("entities"))


@query("e06_attributes", "SELECT 'ITEM:' || upper(replace(p_name, ' ', '_')) AS entity_id, 'size' AS key, arg_max(p_size::VARCHAR, p_partkey) AS value FROM part GROUP BY 1 UNION ALL SELECT 'ITEM:' || upper(replace(p_name, ' ', '_')), 'even', arg_max(p_type, p_partkey) FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def e06a(spark, d):
    k = F.col("p_partkey")
    size = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    attributes = F.when(k % 2 == 0, F.map_concat(size, F.create_map(F.lit("even"), "p_type"))).otherwise(size)
    rows = table(spark, d, "part").select(en.entity_id(F.lit("ITEM"), F.col("p_name")).alias("entity_id"), k.alias("ord"), attributes.alias("attributes"))
    return en.merged_attributes(rows)


@query("e07_id_map", sql.with_(_X, "SELECT kind || ':' || label AS key, entity_id FROM entities"))
def e07(spark, d):
    return en.id_map(entities(spark, d)).select(F.concat("kind", F.lit(":"), "label").alias("key"), "entity_id")


@query("c02_entities_of_notes", sql.with_(_X, "SELECT note_id, count(*) AS entities FROM member GROUP BY note_id"))
def c02(spark, d):
    return en.memberships(extracted(spark, d)).groupBy(F.col("unit").alias("note_id")).agg(F.count("*").alias("entities"))


for _w in ("note", "paragraph"):
    @query(f"c01_window_{_w}" if _w == "paragraph" else "c03_cooccurrence", sql.with_(_X, "SELECT a, b, weight FROM cooc"))
    def c03(spark, d, window=_w):
        return en.cooccurrence(en.memberships(extracted(spark, d), window))


_SENTENCES = sql.NOTES + r""", s AS (SELECT id, unnest(string_split(content, '. ')) AS t, generate_subscripts(string_split(content, '. '), 1) - 1 AS i FROM notes),
e AS (SELECT DISTINCT id, i, 'X:' || upper(regexp_replace(unnest(regexp_extract_all(t, '\|([^\]]+)\]', 1)), '\s+', '_', 'g')) AS entity_id FROM s)
"""


@query("c04_sentence_window", sql.with_(_SENTENCES, "SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS weight FROM e x JOIN e y ON x.id = y.id AND x.i = y.i AND x.entity_id < y.entity_id GROUP BY 1, 2"))
def c04(spark, d):
    rows = corpus.notes(spark, d).select("id", F.posexplode(F.split("content", r"\. ")).alias("sentence_index", "t"))
    rows = rows.select(F.col("id").alias("note_id"), "sentence_index", F.explode(F.regexp_extract_all("t", F.lit(r"\|([^\]]+)\]"), F.lit(1))).alias("label"), F.lit("X").alias("kind"))
    return en.cooccurrence(en.memberships(rows, "sentence"))


@query("c05_edge_ids", sql.with_(_X, "SELECT a || '--' || b || '::CO_OCCURS' AS id FROM cooc"))
def c05(spark, d):
    return cooc(spark, d).select(en.edge_id(F.col("b"), F.col("a"), F.lit("CO_OCCURS")).alias("id"))


_REL = _TRIPLES_SRC + f""", r AS (SELECT subject_kind, subject, predicate, object_kind, object, row_number() OVER (ORDER BY id, ord) AS o FROM triples),
idm AS (SELECT DISTINCT kind, label, {sql.entity_id('kind', 'label')} AS entity_id FROM (SELECT 'CHARACTER' AS kind, c_name AS label FROM customer UNION SELECT 'LOCATION', n_name FROM nation UNION SELECT 'LOCATION', r_name FROM region)),
j AS (SELECT s.entity_id AS sid, t.entity_id AS tid, predicate, o, least(s.entity_id, t.entity_id) || '--' || greatest(s.entity_id, t.entity_id) || '::' || predicate AS edge_id FROM r JOIN idm s ON s.kind = subject_kind AND s.label = subject JOIN idm t ON t.kind = object_kind AND t.label = object),
k AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY o DESC) AS back FROM j),
rel AS (SELECT edge_id, arg_min(sid, o) AS source_id, arg_min(tid, o) AS target_id, min(predicate) AS type, count(*) AS weight, sum(pow(0.5, back)) AS confidence FROM k GROUP BY edge_id)
"""


def relations(spark, d):
    rel = en.relationships(corpus.triples_text(spark, d))
    names = table(spark, d, "customer").select(F.lit("CHARACTER").alias("kind"), F.col("c_name").alias("label")).union(table(spark, d, "nation").select(F.lit("LOCATION"), "n_name")).union(table(spark, d, "region").select(F.lit("LOCATION"), "r_name")).distinct()
    return en.explicit_relations(rel, names.withColumn("entity_id", en.entity_id(F.col("kind"), F.col("label"))))


@query("c06_explicit_relations", sql.with_(_REL, "SELECT edge_id, source_id, target_id, type, weight, confidence FROM rel"))
def c06(spark, d):
    return relations(spark, d)


_PMI = _X + ", pmi AS (SELECT a, b, weight, round(log2((weight / (SELECT count(*) FROM notes)) / ((x.notes / (SELECT count(*) FROM notes)) * (y.notes / (SELECT count(*) FROM notes)))), 6) AS pmi FROM cooc JOIN entities x ON a = x.entity_id JOIN entities y ON b = y.entity_id)"


def pmi(spark, d):
    member = written(en.memberships(extracted(spark, d)))  # read twice below
    notes = table(spark, d, "orders").count()  # a note per order
    out = en.with_pmi(en.cooccurrence(member), member.groupBy("entity_id").agg(F.count("*").alias("notes")), notes)
    return out.select("a", "b", "weight", F.round("pmi", 6).alias("pmi"))


@query("c07_pmi", sql.with_(_PMI, "SELECT * FROM pmi"))
def c07(spark, d):
    return pmi(spark, d)


@query("c08_by_weight", sql.with_(_X, "SELECT a, b, weight FROM cooc WHERE weight >= 3"))
def c08(spark, d):
    return en.by_weight(cooc(spark, d), 3)


@query("c09_by_confidence", sql.with_(_REL, "SELECT edge_id, confidence FROM rel WHERE confidence >= 0.75"))
def c09(spark, d):
    return en.by_confidence(relations(spark, d), 0.75).select("edge_id", "confidence")


@query("c10_by_pmi", sql.with_(_PMI, "SELECT a, b, pmi FROM pmi WHERE pmi >= 2"))
def c10(spark, d):
    return en.by_pmi(pmi(spark, d), 2.0).select("a", "b", "pmi")


# A large graph: customers, brands and their nations. A small one: brands in one order, thinned by weight.
_BIG = r"""
nodes AS (SELECT 'c' || c_custkey AS id, c_custkey AS ord, coalesce(f, 0) AS frequency FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS f FROM orders GROUP BY 1) ON c_custkey = o_custkey
          UNION ALL SELECT 'n' || n_nationkey, 10000000 + n_nationkey, 100 FROM nation),
edges AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 1 + c_custkey % 7 AS weight, c_custkey AS ord FROM customer WHERE c_custkey % 10 <> 0)
"""
_SMALL = r"""
ob AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS weight FROM ob x JOIN ob y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2),
cut AS (SELECT quantile_disc(weight, 0.9) AS q FROM pairs),
nodes AS (SELECT DISTINCT p_brand AS id, CAST(substr(p_brand, 7) AS BIGINT) AS ord, 1::BIGINT AS frequency FROM part),
edges AS (SELECT a, b, weight, weight AS ord FROM pairs WHERE weight >= (SELECT q FROM cut))
"""


def big(spark, d):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    customers = table(spark, d, "customer")
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("f"))
    nodes = customers.join(f, k == F.col("o_custkey"), "left").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), k.alias("ord"), F.coalesce("f", F.lit(0)).alias("frequency"))
    nodes = nodes.union(table(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")), (n + 10_000_000).cast("long"), F.lit(100).cast("long")))
    edges = customers.filter(k % 10 != 0).select(F.concat(F.lit("c"), k.cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"), (1 + k % 7).alias("weight"), k.alias("ord"))
    return nodes, edges


def small(spark, d):
    part = table(spark, d, "part")
    ob = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("entity_id"), F.col("l_orderkey").alias("unit")).distinct()
    pairs = written(en.cooccurrence(ob))
    cut = pairs.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY weight)").alias("q"))
    edges = pairs.crossJoin(F.broadcast(cut)).filter("weight >= q").select("a", "b", "weight", F.col("weight").alias("ord"))  # one row
    nodes = part.select(F.col("p_brand").alias("id")).distinct().select("id", F.substring("id", 7, 10).cast("long").alias("ord"), F.lit(1).cast("long").alias("frequency"))
    return nodes, edges


@query("g01_build", sql.with_(_BIG, "SELECT a, b, round(least(1 + ln(weight + 1), 5.0), 6) AS width FROM edges"))
def g01(spark, d):
    nodes, edges = big(spark, d)
    twice = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("weight") * 9).alias("weight"), (F.col("ord") + 10**9).alias("ord")))
    lost = edges.limit(5).select("a", F.lit("nobody").alias("b"), "weight", "ord")
    return gr.build(nodes, twice.unionByName(lost)).select("a", "b", F.round("width", 6).alias("width"))


@query("g01_node_size", sql.with_(_BIG, "SELECT id, round(least(10 + 5 * ln(frequency + 1), 30.0), 6) AS size FROM nodes"))
def g01s(spark, d):
    return big(spark, d)[0].select("id", F.round(gr.node_size(F.col("frequency")), 6).alias("size"))


_DEG = ", ends AS (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges), deg AS (SELECT n.id, n.ord, count(e.id) AS degree, round(count(e.id) / greatest(1, (SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id, n.ord)"


@query("g02_degree", sql.with_(_BIG + _DEG, "SELECT id, degree, centrality FROM deg"))
def g02(spark, d):
    return gr.degrees(*big(spark, d)).select("id", "degree", F.round("centrality", 9).alias("centrality"))


@query("g03_betweenness_large", sql.with_(_BIG + _DEG, "SELECT id, centrality AS betweenness FROM deg"))
def g03l(spark, d):
    return gr.betweenness(*big(spark, d)).select("id", F.round("betweenness", 9).alias("betweenness"))


_DIST = _SMALL + """, sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT id AS source, id, 0 AS distance FROM nodes UNION SELECT w.source, s.v, w.distance + 1 FROM walk w JOIN sym s ON w.id = s.u WHERE w.distance < 25),
dist AS (SELECT source, id, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY source, id)
"""


# A search that takes neighbours by id finds, of the shortest paths to a node, the one that is least as a list of ids.
_BETWEEN = _DIST + """, paths AS (SELECT id AS source, id, 0 AS k, [id] AS path FROM nodes
          UNION ALL SELECT p.source, s.v, p.k + 1, list_append(p.path, s.v) FROM paths p JOIN sym s ON p.id = s.u JOIN dist d ON d.source = p.source AND d.id = s.v AND d.distance = p.k + 1),
least_paths AS (SELECT source, id, min(path) AS path FROM paths WHERE k > 0 GROUP BY source, id),
visits AS (SELECT x AS id, count(*) AS v FROM (SELECT unnest(path[2:len(path) - 1]) AS x FROM least_paths) GROUP BY x),
size AS (SELECT count(*) AS n FROM nodes),
between AS (SELECT n.id, round(coalesce(v, 0) / (CASE WHEN n > 2 THEN (n - 1) * (n - 2) / 2.0 ELSE 1 END), 9) AS betweenness FROM nodes n CROSS JOIN size LEFT JOIN visits USING (id))
"""


@query("g03_betweenness", sql.with_(_BETWEEN, "SELECT id, betweenness FROM between"))
def g03(spark, d):
    return gr.betweenness(*small(spark, d)).select("id", F.round("betweenness", 9).alias("betweenness"))


_CLOSE = "SELECT n.id, round(coalesce(r / ((SELECT count(*) FROM nodes) - 1) * (r / t), 0.0), 9) AS closeness FROM nodes n LEFT JOIN (SELECT source, count(*) AS r, sum(distance) AS t FROM dist WHERE distance > 0 GROUP BY source) ON n.id = source"


@query("g04_closeness", sql.with_(_DIST, _CLOSE))
def g04(spark, d):
    return gr.closeness(*small(spark, d)).select("id", F.round("closeness", 9).alias("closeness"))


@query("g05_bfs", sql.with_(_DIST, "SELECT source, id, distance FROM dist"))
def g05(spark, d):
    return gr.distances(*small(spark, d))


_REACH = """
reach AS (SELECT id AS source, id FROM nodes UNION SELECT r.source, s.v FROM reach r JOIN sym s ON r.id = s.u),
lab AS (SELECT r.source AS id, min(n.ord) AS label FROM reach r JOIN nodes n ON r.id = n.id GROUP BY r.source)"""
_COMMUNITY = "SELECT id, 'community_' || (dense_rank() OVER (ORDER BY label) - 1) AS community FROM lab"


@query("g06_components", sql.with_(_SMALL + ", sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges)," + _REACH, _COMMUNITY))
def g06(spark, d):
    return gr.components(*small(spark, d))


@query("g06_components_large", sql.with_(_BIG + ", lab AS (SELECT n.id, coalesce(min(e.ord) OVER (PARTITION BY coalesce(e.b, CASE WHEN n.id LIKE 'n%' THEN n.id END)), n.ord) AS label FROM nodes n LEFT JOIN edges e ON n.id = e.a WHERE n.id LIKE 'c%'), low AS (SELECT b AS id, min(ord) AS label FROM edges GROUP BY b), alln AS (SELECT n.id, CASE WHEN n.id LIKE 'n%' THEN coalesce(l.label, n.ord) ELSE coalesce(m.label, n.ord) END AS label FROM nodes n LEFT JOIN low l ON n.id = l.id LEFT JOIN edges e ON n.id = e.a LEFT JOIN low m ON e.b = m.id)", "SELECT id, 'community_' || (dense_rank() OVER (ORDER BY label) - 1) AS community FROM alln"))
def g06l(spark, d):
    return gr.components(*big(spark, d))


@query("g07_statistics", sql.with_(_BIG, "SELECT n, m, round(2 * m / (n * (n - 1)), 12) AS density, round(2 * m / n, 9) AS average_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)"))
def g07(spark, d):
    return gr.statistics(*big(spark, d)).select("n", "m", F.round("density", 12).alias("density"), F.round("average_degree", 9).alias("average_degree"))


@query("g08_analytics", sql.with_(_BETWEEN + _DEG + "," + _REACH, f"SELECT id, centrality AS degree, betweenness, closeness, community FROM deg JOIN between USING (id) JOIN ({_CLOSE}) USING (id) JOIN ({_COMMUNITY}) USING (id)"))
def g08(spark, d):
    found = gr.analytics(*small(spark, d))
    return found.select("id", *[F.round(x, 9).alias(x) for x in ("degree", "betweenness", "closeness")], "community")


@query("g09_enrich", sql.with_(_BIG + _DEG, "SELECT n.id, frequency, centrality AS degree FROM nodes n JOIN deg USING (id)"))
def g09(spark, d):
    nodes, edges = big(spark, d)
    return nodes.join(gr.degrees(nodes, edges), "id", "left").select("id", "frequency", F.round("centrality", 9).alias("degree"))


@query("g10_by_frequency", sql.with_(_BIG, "SELECT a, b FROM edges WHERE a IN (SELECT id FROM nodes WHERE frequency >= 12) AND b IN (SELECT id FROM nodes WHERE frequency >= 12)"))
def g10(spark, d):
    return gr.frequent(*big(spark, d), 12)[1].select("a", "b")


_EGO = _SMALL + ", sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges), one AS (SELECT 'Brand#19' AS id UNION SELECT v FROM sym WHERE u = 'Brand#19'), two AS (SELECT id FROM one UNION SELECT v FROM sym JOIN one ON u = id)"


@query("g11_ego_nodes", sql.with_(_EGO, "SELECT id FROM two"))
def g11(spark, d):
    return gr.ego(*small(spark, d), "Brand#19", 2)[0].select("id")


@query("g11_ego_edges", sql.with_(_EGO, "SELECT a, b FROM edges WHERE a IN (SELECT id FROM one) AND b IN (SELECT id FROM one)"))
def g11e(spark, d):
    return gr.ego(*small(spark, d), "Brand#19", 1)[1].select("a", "b")


@query("g12_cytoscape", sql.with_(_BIG, """SELECT 'nodes' AS "group", '{"id":"' || id || '","color":"' || """ + sql.COLOR_CASE.format("'CHARACTER'") + """ || '","size":' || CAST(round(least(10 + 5 * ln(frequency + 1), 30.0), 3) AS VARCHAR) || '}' AS data FROM nodes
    UNION ALL SELECT 'edges', '{"source":"' || a || '","target":"' || b || '","width":' || CAST(round(least(1 + ln(weight + 1), 5.0), 3) AS VARCHAR) || '}' FROM edges"""))
def g12(spark, d):
    nodes, edges = big(spark, d)
    return gr.cytoscape(nodes, gr.build(nodes, edges), color_of(F.lit("CHARACTER")))


@query("g13_top_entities", sql.with_(_BIG + _DEG, "SELECT id, centrality FROM deg ORDER BY centrality DESC, ord LIMIT 10"))
def g13(spark, d):
    nodes, edges = big(spark, d)
    return gr.top(gr.degrees(nodes, edges), nodes, "centrality").select("id", F.round("centrality", 9).alias("centrality"))
