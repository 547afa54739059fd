"""Time parsing and timelines over events and derived phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions import timeparse as tp
from taleloom.operators import timeline as tl
from taleloom.plans import sql
from taleloom.plans.registry import query, table

c = F.col

# Phrases by event number, and what they mean, written out case by case: the oracle does not run the patterns.
_CASES = [
    ("'2024-03-' || lpad(CAST(1 + e // 12 % 28 AS VARCHAR), 2, '0')", "precise", "NULL", "NULL", "NULL", "NULL", "NULL", "0.95", "explicit"),
    ("'March ' || (1 + e // 12 % 28) || ', 2024'", "precise", "NULL", "NULL", "NULL", "NULL", "NULL", "0.95", "explicit"),
    ("'May ' || (1990 + e // 12 % 30)", "datetime", "NULL", "NULL", "NULL", "NULL", "NULL", "0.7", "explicit"),
    ("(e // 12 % 9) || ' days later'", "relative", "CAST(e // 12 % 9 AS DOUBLE)", "NULL", "NULL", "NULL", "NULL", "0.8", "contextual"),
    ("(e // 12 % 9) || ' Months before the war'", "relative", "CAST(e // 12 % 9 * -30 AS DOUBLE)", "NULL", "NULL", "NULL", "NULL", "0.8", "contextual"),
    ("'the evening before'", "relative", "-1.0", "NULL", "NULL", "NULL", "NULL", "0.75", "contextual"),
    ("'Later that night'", "relative", "0.0", "4.0", "NULL", "NULL", "NULL", "0.7", "contextual"),
    ("'Chapter ' || (e // 12 % 40) || ', Act ' || (e // 12 % 5)", "sequential", "NULL", "NULL", "e // 12 % 40", "e // 12 % 5", "e // 12 % 40 * 10000 + e // 12 % 5 * 100", "1.0", "explicit"),
    ("'#' || (e // 12 % 300)", "sequential", "NULL", "NULL", "NULL", "NULL", "e // 12 % 300", "1.0", "explicit"),
    ("'next morning'", "abstract", "NULL", "NULL", "NULL", "NULL", "NULL", "0.4", "explicit"),
    ("'Once upon a time'", "abstract", "NULL", "NULL", "NULL", "NULL", "NULL", "0.3", "explicit"),
    ("'Meanwhile, ' || event_type", "abstract", "NULL", "NULL", "NULL", "NULL", "NULL", "0.6", "explicit"),
]


def _case(i: int, text: bool = False) -> str:
    return "CASE e % 12 " + " ".join(f"WHEN {k} THEN " + (f"'{x[i]}'" if text else x[i]) for k, x in enumerate(_CASES)) + " END"


_POINTS = f"""
src AS (SELECT event_id AS e, event_type, ts FROM events),
points AS (SELECT e, event_type, ts, {_case(0)} AS phrase, {_case(1, True)} AS granularity, {_case(2)} AS offset_days, {_case(3)} AS offset_hours, {_case(4)} AS chapter, {_case(5)} AS act, {_case(6)} AS sequence,
           {_case(7)} AS confidence, {_case(8, True)} AS source,
           CASE e % 12 WHEN 0 THEN make_timestamp(2024, 3, 1 + e // 12 % 28, 0, 0, 0) WHEN 1 THEN make_timestamp(2024, 3, 1 + e // 12 % 28, 0, 0, 0) WHEN 2 THEN make_timestamp(1990 + e // 12 % 30, 5, 1, 0, 0, 0) END AS moment FROM src)
"""
_TIME = _POINTS + """, timed AS (SELECT *, CASE WHEN moment IS NOT NULL THEN epoch_ms(moment) WHEN granularity = 'sequential' THEN coalesce(chapter, 0) * 1000000 + coalesce(act, 0) * 1000 + sequence
    WHEN granularity = 'relative' THEN CAST(CASE WHEN e >= 24 THEN epoch_ms(make_timestamp(2024, 3, 1, 0, 0, 0)) ELSE 0 END + offset_days * 86400000 + coalesce(offset_hours, 0) * 3600000 AS BIGINT) ELSE 9007199254740991 END AS time FROM points)
"""


def phrases(spark, d):
    e = c("event_id")
    i = F.floor(e / 12).cast("long")
    s = lambda x: x.cast("string")
    texts = [
        F.concat(F.lit("2024-03-"), F.lpad(s(1 + i % 28), 2, "0")),
        F.concat(F.lit("March "), s(1 + i % 28), F.lit(", 2024")),
        F.concat(F.lit("May "), s(1990 + i % 30)),
        F.concat(s(i % 9), F.lit(" days later")),
        F.concat(s(i % 9), F.lit(" Months before the war")),
        F.lit("the evening before"),
        F.lit("Later that night"),
        F.concat(F.lit("Chapter "), s(i % 40), F.lit(", Act "), s(i % 5)),
        F.concat(F.lit("#"), s(i % 300)),
        F.lit("next morning"),
        F.lit("Once upon a time"),
        F.concat(F.lit("Meanwhile, "), "event_type"),
    ]
    text = None
    for k, t in enumerate(texts):
        text = (F.when if text is None else text.when)(e % 12 == k, t)
    return table(spark, d, "events").select(e.alias("e"), "event_type", text.alias("phrase"))


def points(spark, d):
    """Relative ones refer to event 0 (a date) from number 24 on, to nothing known before."""
    ref = F.when(c("e") >= 24, "0").otherwise("none")
    return phrases(spark, d).withColumn("start", tp.parse(c("phrase"), ref))


def timed(spark, d):
    rows = points(spark, d).withColumns({"ord": c("e"), "id": c("e").cast("string")})
    return tl.with_time(rows, rows.select("id", "start"))


@query("d01_parse", sql.with_(_POINTS, "SELECT e, granularity, confidence::DOUBLE AS confidence, source FROM points"))
def d01(spark, d):
    return points(spark, d).select("e", "start.granularity", "start.confidence", "start.source")


@query("d02_dates", sql.with_(_POINTS, "SELECT e, epoch_ms(moment) AS ms FROM points WHERE moment IS NOT NULL"))
def d02(spark, d):
    return points(spark, d).filter("start.timestamp is not null").select("e", tp.millis(c("start.timestamp")).alias("ms"))


@query("d03_is_relative", sql.with_(_POINTS, "SELECT e, granularity = 'relative' OR phrase = 'next morning' AS relative FROM points"))
def d03(spark, d):
    return phrases(spark, d).select("e", tp.is_relative(c("phrase")).alias("relative"))


@query("d04_offsets", sql.with_(_POINTS, "SELECT e, offset_days::DOUBLE AS offset_days, offset_hours::DOUBLE AS offset_hours FROM points WHERE granularity = 'relative'"))
def d04(spark, d):
    return points(spark, d).filter("start.granularity = 'relative'").select("e", "start.offset_days", "start.offset_hours")


@query("d05_sequences", sql.with_(_POINTS, "SELECT e, chapter, act, sequence FROM points WHERE granularity = 'sequential'"))
def d05(spark, d):
    return points(spark, d).filter("start.granularity = 'sequential'").select("e", "start.chapter", "start.act", "start.sequence")


@query("d06_abstract", sql.with_(_POINTS, "SELECT e, confidence::DOUBLE AS confidence FROM points WHERE granularity = 'abstract'"))
def d06(spark, d):
    return phrases(spark, d).join(points(spark, d).filter("start.granularity = 'abstract'").select("e"), "e", "left_semi").select("e", tp.abstract_confidence(c("phrase")).alias("confidence"))


@query("d07_offset_days", "SELECT p_partkey, round(p_size * CASE p_partkey % 7 WHEN 0 THEN 1/86400 WHEN 1 THEN 1/1440 WHEN 2 THEN 1/24 WHEN 3 THEN 1 WHEN 4 THEN 7 WHEN 5 THEN 30 ELSE 365 END * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 9) AS days FROM part")
def d07(spark, d):
    k = c("p_partkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in tp.UNIT_DAYS]), (k % 7 + 1).cast("int"))
    way = F.when(k % 4 == 0, "before").when(k % 4 == 2, "earlier").when(k % 4 == 1, "after").otherwise("later")
    return table(spark, d, "part").select("p_partkey", F.round(tp.offset_days(c("p_size").cast("double"), unit, way), 9).alias("days"))


@query("d08_reference_points", sql.with_(_TIME, "SELECT e, time FROM timed WHERE granularity = 'relative'"))
def d08(spark, d):
    return timed(spark, d).filter("start.granularity = 'relative'").select("e", "time")


_FULL = "CASE WHEN granularity = 'precise' THEN strftime(moment, '%Y-%m-%d %H:%M:%S') WHEN granularity = 'sequential' AND (coalesce(chapter, 0) <> 0 OR coalesce(act, 0) <> 0 OR sequence BETWEEN 1 AND 99) THEN concat_ws(', ', CASE WHEN chapter <> 0 THEN 'Ch. ' || chapter END, CASE WHEN act <> 0 THEN 'Act ' || act END, CASE WHEN sequence BETWEEN 1 AND 99 THEN '#' || sequence END) ELSE phrase END"


@query("d09_display", sql.with_(_POINTS, f"SELECT e, {_FULL} AS text FROM points"))
def d09(spark, d):
    return points(spark, d).select("e", tp.display(c("start")).alias("text"))


@query("h01_comparable_time", sql.with_(_TIME, "SELECT e, time FROM timed"))
def h01(spark, d):
    return timed(spark, d).select("e", "time")


_EV = r"""
ev AS (SELECT event_id AS id, event_id AS ord, user_id, event_type, epoch_ms(ts) AS time, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor' ELSE 'background' END AS importance,
       CASE WHEN event_id % 5 = 0 OR event_id < 5 THEN NULL ELSE event_id - event_id % 5 END AS parent_id, 's' || user_id || '-' || strftime(ts, '%j') AS scene_id, value FROM events),
rk AS (SELECT *, CASE importance WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END AS rank FROM ev),
sc AS (SELECT scene_id AS id, min(ord) AS ord, min(time) AS time, min(user_id) AS user_id FROM ev GROUP BY scene_id)
"""


def events(spark, d):
    k, t = c("event_id"), c("event_type")
    importance = F.when(t == "error", "critical").when(t == "purchase", "major").when(t == "signup", "minor").otherwise("background")
    parent = F.when((k % 5 != 0) & (k >= 5), k - k % 5)
    none = {n: F.lit(None).cast(k2) for n, k2 in (("relative_to", "string"), ("offset_days", "double"), ("offset_hours", "double"), ("chapter", "long"), ("act", "long"), ("sequence", "long"))}
    start = F.struct(F.lit("precise").alias("granularity"), c("ts").cast("timestamp").alias("timestamp"), *[v.alias(n) for n, v in none.items()], t.alias("display_text"))
    rows = table(spark, d, "events").select(k.alias("id"), k.alias("ord"), "user_id", "event_type", "value", importance.alias("importance"), parent.alias("parent_id"), F.concat(F.lit("s"), c("user_id").cast("string"), F.lit("-"), F.date_format("ts", "DDD")).alias("scene_id"), start.alias("start"))
    return tl.with_time(rows, rows.select("id", "start").limit(0).select(c("id").cast("string"), "start"))


def scenes(spark, d):
    return events(spark, d).groupBy(c("scene_id").alias("id")).agg(F.min("ord").alias("ord"), F.min("time").alias("time"), F.min("user_id").alias("user_id"), F.min_by("start", "time").alias("start"))


@query("h02_reference_lookup", sql.with_(_TIME, "SELECT e, CASE WHEN e >= 24 THEN 1709251200000 ELSE 0 END AS reference_ms FROM timed WHERE granularity = 'relative'"))
def h02(spark, d):
    rows = timed(spark, d).filter("start.granularity = 'relative'")
    offset = c("start.offset_days") * 86_400_000 + F.coalesce("start.offset_hours", F.lit(0.0)) * 3_600_000
    return rows.select("e", (c("time") - offset.cast("long")).alias("reference_ms"))


for _mode, _order in (("chronological", "time, ord"), ("reverse", "time DESC, ord"), ("importance", "rank, time, ord")):
    @query(f"h03_order_{_mode}", sql.with_(_EV, f"SELECT id, row_number() OVER (ORDER BY {_order}) AS position FROM rk"))
    def h03(spark, d, mode=_mode):
        return tl.ordered(events(spark, d), mode).select("id", "position")


@query("h04_build", sql.with_(_EV, "SELECT id, row_number() OVER (ORDER BY time, ord) AS position FROM sc"))
def h04(spark, d):
    return tl.ordered(scenes(spark, d)).select("id", "position")


@query("h05_events_only", sql.with_(_EV, "SELECT id, importance FROM ev WHERE parent_id IS NULL AND importance IN ('critical', 'major')"))
def h05(spark, d):
    return tl.top_level(events(spark, d), ["critical", "major"]).select("id", "importance")


_PEOPLE = _EV + ", people AS (SELECT DISTINCT scene_id AS owner_id, 'u' || (ord % 7) AS entity_id FROM ev UNION ALL SELECT CAST(id AS VARCHAR), 'u' || (ord % 7) FROM ev)"


def people(spark, d):
    e = events(spark, d)
    who = F.concat(F.lit("u"), (c("ord") % 7).cast("string")).alias("entity_id")
    return e.select(c("scene_id").alias("owner_id"), who).distinct().unionByName(e.select(c("id").cast("string").alias("owner_id"), who))


@query("h06_of_character", sql.with_(_PEOPLE, "SELECT 'SCENE' AS kind, id FROM sc WHERE id IN (SELECT owner_id FROM people WHERE entity_id = 'u3') OR user_id = 3 UNION ALL SELECT 'EVENT', CAST(id AS VARCHAR) FROM ev WHERE ord % 7 = 3"))
def h06(spark, d):
    s = scenes(spark, d).withColumn("pov", F.when(c("user_id") == 3, "u3"))
    e = events(spark, d).withColumn("id", c("id").cast("string"))
    return tl.of_character(s, e, people(spark, d), "u3").select("kind", "id")


@query("h07_of_location", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'r#00000001')")
def h07(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", c("s_name").alias("location"))
    return tl.of_location(rows, "R#00000001").select("s_suppkey")


@query("h08_nested_events", sql.with_(_EV, "SELECT scene_id, CAST(id AS VARCHAR) AS event_id FROM ev WHERE CAST(substr(split_part(scene_id, '-', 1), 2) AS BIGINT) % 3 <> 0 UNION ALL SELECT id, 'own-' || id FROM sc WHERE user_id % 3 = 0 AND user_id % 2 = 0"))
def h08(spark, d):
    own = F.when(c("user_id") % 3 == 0, F.when(c("user_id") % 2 == 0, F.array(F.concat(F.lit("own-"), "id"))).otherwise(F.array().cast("array<string>")))
    return tl.nested(scenes(spark, d).withColumn("event_ids", own), events(spark, d).withColumn("id", c("id").cast("string")))


@query("h09_event_tree", sql.with_(_EV, "SELECT id, 0 AS depth, id AS root FROM ev WHERE parent_id IS NULL UNION ALL SELECT c.id, 1, c.parent_id FROM ev c JOIN ev p ON c.parent_id = p.id AND p.parent_id IS NULL WHERE c.importance IN ('critical', 'minor')"))
def h09(spark, d):
    return tl.event_tree(events(spark, d), ["critical", "minor"])


_CARDS = r"""
ppl AS (SELECT o_orderkey AS owner, string_agg(x, ', ' ORDER BY pos) FILTER (pos <= 3) AS first3, string_agg(x, ' & ' ORDER BY pos) FILTER (pos <= 2) AS first2, string_agg('**' || x || '** (ITEM)', ', ' ORDER BY pos) AS present, count(*) AS n
        FROM (SELECT l_orderkey AS o_orderkey, p_name AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1),
cards AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, first2, present, coalesce(n, 0) AS n, concat_ws(' • ', c_name, first3 || CASE WHEN n > 3 THEN ' +' || (n - 3) ELSE '' END, '⬤ ' || o_orderpriority) AS subtitle, c_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ppl ON owner = o_orderkey)
"""


def cards(spark, d):
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("owner_id"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("entity_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("pos"), F.lit(None).cast("string").alias("label"), F.lit("").alias("role"))
    entities = table(spark, d, "part").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("id"), c("p_name").alias("label"), F.lit("ITEM").alias("kind"), F.lit(0).alias("ord"))
    lists = tl.lists(tl.labelled(li, entities))
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    out = orders.join(lists, c("o_orderkey") == c("owner_id"), "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"names": F.coalesce("names", empty), "details": F.coalesce("details", empty)})


@query("h10_scene_subtitle", sql.with_(_CARDS, "SELECT o_orderkey, subtitle FROM cards"))
def h10(spark, d):
    return cards(spark, d).select("o_orderkey", tl.scene_subtitle(c("c_name"), c("names"), c("o_orderpriority")).alias("subtitle"))


@query("h11_scene_text", sql.with_(_CARDS, r"SELECT o_orderkey, o_orderstatus || CASE WHEN n > 0 THEN chr(10) || chr(10) || '*Present:* ' || present ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '*POV:* ' || c_name ELSE '' END AS text FROM cards"))
def h11(spark, d):
    pov = F.when(c("o_orderkey") % 2 == 0, c("c_name"))
    return cards(spark, d).select("o_orderkey", tl.scene_text(c("o_orderstatus"), c("details"), pov).alias("text"))


@query("h12_event_text", sql.with_(_CARDS, r"SELECT o_orderkey, CASE WHEN n > 0 THEN chr(10) || chr(10) || '*Affected:* ' || replace(replace(present, '**', ''), ' (ITEM)', '') || chr(10) || chr(10) || '*Leads to:* ' || n || ' event(s)' ELSE '' END || chr(10) || chr(10) || '*Tags:* ' || o_orderstatus || ', ' || o_orderpriority AS text FROM cards"))
def h12(spark, d):
    return cards(spark, d).select("o_orderkey", tl.event_text(F.lit(None).cast("string"), c("names"), c("details"), F.array("o_orderstatus", "o_orderpriority")).alias("text"))


@query("h13_actors_summary", sql.with_(_CARDS, "SELECT o_orderkey, coalesce(first2, '') AS actors FROM cards"))
def h13(spark, d):
    return cards(spark, d).select("o_orderkey", tl.actors_summary(c("names")).alias("actors"))


@query("h14_entity_labels", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'again ' || p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'Unknown' END AS shown FROM part")
def h14(spark, d):
    k = c("p_partkey")
    refs = table(spark, d, "part").select(k, k.alias("entity_id"), F.when(k % 3 == 1, c("p_brand")).when(k % 3 == 2, "").alias("label"))
    one = table(spark, d, "part").filter(k % 3 == 0).select(k.alias("id"), c("p_name").alias("label"), F.lit("ITEM").alias("kind"), F.lit(0).alias("ord"))
    again = one.withColumns({"label": F.concat(F.lit("again "), "label"), "ord": F.lit(1)})
    return tl.labelled(refs, one.unionByName(again)).select("p_partkey", "shown")


@query("h15_from_references", "SELECT o_custkey AS note_id, kind, label, CAST(row_number() OVER (PARTITION BY o_custkey, kind ORDER BY ord) AS INTEGER) AS sequence, CASE kind WHEN 'SCENE' THEN 'Scene ' ELSE 'Event ' END || row_number() OVER (PARTITION BY o_custkey, kind ORDER BY ord) AS display_text, CASE WHEN kind = 'EVENT' THEN 'major' END AS importance FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'SCENE' WHEN 1 THEN 'EVENT' ELSE 'ITEM' END AS kind, o_orderpriority AS label, o_orderkey AS ord FROM orders) WHERE kind <> 'ITEM'")
def h15(spark, d):
    k = c("o_orderkey")
    refs = table(spark, d, "orders").select(c("o_custkey").alias("note_id"), F.when(k % 3 == 0, "SCENE").when(k % 3 == 1, "EVENT").otherwise("ITEM").alias("kind"), c("o_orderpriority").alias("label"), k.alias("ord"))
    return tl.from_references(refs)


@query("h16_importance_choice", sql.with_(_EV, "SELECT 'some' AS choice, count(*) AS n FROM ev WHERE importance IN ('minor', 'critical') UNION ALL SELECT 'none', count(*) FROM ev"))
def h16(spark, d):
    e = events(spark, d)
    n = F.count("*").alias("n")
    return tl.of_importance(e, ["minor", "critical"]).agg(n).select(F.lit("some").alias("choice"), "n").unionByName(tl.of_importance(e, []).agg(n).select(F.lit("none").alias("choice"), "n"))


@query("h17_select_item", sql.with_(_CARDS, "SELECT min(o_orderkey) AS o_orderkey FROM cards WHERE o_orderstatus = 'F' AND first2 = (SELECT first2 FROM cards WHERE o_orderkey = 12)"))
def h17(spark, d):
    items = cards(spark, d).select("o_orderkey", c("o_orderkey").alias("position"), c("o_orderstatus").alias("card_title"), tl.actors_summary(c("names")).alias("card_subtitle"))
    wanted = items.filter("o_orderkey = 12").first()["card_subtitle"]
    return tl.selected(items, "F", wanted).select("o_orderkey")
