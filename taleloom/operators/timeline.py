"""Timelines of scenes and events: order, filters, nesting and card texts.

Rows: scenes(id, label, start, location, mood, pov, ...), events(id, label, start, scene_id, parent_id, importance, ...);
`start` is a struct as timeparse.parse() gives it; participants are (owner_id, entity_id, label, role, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.functions.timeparse import comparable, millis
from taleloom.operators.ordering import numbered
from taleloom.operators.trees import ascended

# Importance, highest first.
IMPORTANCE = ("critical", "major", "minor", "background")
SHOWN = 3


def rank(importance: Column) -> Column:
    out = None
    for i, name in enumerate(IMPORTANCE):
        out = (F.when if out is None else out.when)(importance == name, F.lit(i))
    return out.otherwise(99)


def with_time(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows with `time`. references: (id, start) of scenes and events; only their own timestamps count, not
    what those refer to; an unknown reference is 0."""
    known = references.filter("start.timestamp is not null").groupBy(F.col("id").alias("ref")).agg(F.min(millis(F.col("start.timestamp"))).alias("ref_ms"))
    out = rows.join(known, rows["start"]["relative_to"] == known["ref"], "left")
    return out.withColumn("time", comparable(F.col("start"), F.col("ref_ms"))).drop("ref", "ref_ms")


def ordered(rows: DataFrame, mode: str = "chronological") -> DataFrame:
    """rows with `position` from 1. Sorts are stable: ties keep ord; by importance, time decides within a rank."""
    keys = {
        "chronological": ["time", "ord"],
        "reverse": [F.desc("time"), F.asc("ord")],
        "importance": [rank(F.col("importance")), "time", "ord"],
    }[mode]
    return numbered(rows, keys)


def of_importance(events: DataFrame, chosen: list[str] | None) -> DataFrame:
    """No choice is no filter."""
    return events.filter(F.col("importance").isin(*chosen)) if chosen else events


def top_level(events: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    return of_importance(events.filter("parent_id is null"), chosen)


def of_character(scenes: DataFrame, events: DataFrame, people: DataFrame, who: str) -> DataFrame:
    """(kind, id, start, ord) of scenes where someone takes part or is the point of view, and of events where
    they act or are affected."""
    mine = people.filter(F.col("entity_id") == who).select(F.col("owner_id").alias("id")).distinct()
    s = scenes.join(mine, "id", "left_semi").select("id").unionByName(scenes.filter(F.col("pov") == who).select("id")).distinct()
    keep = ["id", "start", "ord"]
    scene_rows = scenes.join(s, "id", "left_semi").select(F.lit("SCENE").alias("kind"), *keep)
    return scene_rows.unionByName(events.join(mine, "id", "left_semi").select(F.lit("EVENT").alias("kind"), *keep))


def of_location(scenes: DataFrame, part: str) -> DataFrame:
    return scenes.filter(F.contains(F.lower("location"), F.lit(part.lower())))


def nested(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """(scene_id, event_id): the events of each scene; a scene with an own list (even an empty one) shows that only."""
    own = scenes.filter("event_ids is not null").select(F.col("id").alias("scene_id"), F.explode("event_ids").alias("event_id"))
    by_parent = events.select(F.col("scene_id"), F.col("id").alias("event_id")).filter("scene_id is not null")
    free = scenes.filter("event_ids is null").select(F.col("id").alias("scene_id"))
    return own.unionByName(by_parent.join(free, "scene_id", "left_semi").select("scene_id", "event_id"))


def event_tree(events: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """(id, depth, root): events under their parents, to any depth, the importance filter at each nested level: what is left out
    hides what is below. Children of a missing parent, and rings, don't show."""
    rows = events.select("id", "parent_id", "importance")
    shown = rows.filter("parent_id is null").unionByName(of_importance(rows.filter("parent_id is not null"), chosen))
    links = shown.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("id").alias("root"))
    return ascended(links, {"depth": lambda mine, theirs: mine + theirs, "root": lambda mine, theirs: theirs})


def labelled(people: DataFrame, entities: DataFrame) -> DataFrame:
    """people with `shown`: the entity's label, else their own, else Unknown; of entities with the same id the last one counts."""
    last = entities.groupBy(F.col("id").alias("entity_id")).agg(F.max_by("label", "ord").alias("entity_label"), F.max_by("kind", "ord").alias("entity_kind"))
    out = people.join(last, "entity_id", "left")
    full = [F.when(F.col(c) != "", F.col(c)) for c in ("entity_label", "label")]
    return out.withColumn("shown", F.coalesce(*full, F.lit("Unknown")))


def lists(people: DataFrame) -> DataFrame:
    """(owner_id, names, roles): of one owner, in order; an owner has few people."""
    role = F.coalesce(F.when(F.col("role") != "", F.col("role")), "entity_kind", F.lit(""))
    detail = F.concat(F.lit("**"), "shown", F.lit("**"), F.when(role != "", F.concat(F.lit(" ("), role, F.lit(")"))).otherwise(""))
    rows = people.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("pos", "shown", detail.alias("detail")))).alias("x"))
    return rows.select("owner_id", F.transform("x", lambda p: p["shown"]).alias("names"), F.transform("x", lambda p: p["detail"]).alias("details"))


def scene_subtitle(location: Column, names: Column, mood: Column, shown: int = SHOWN) -> Column:
    more = F.size(names) - shown
    people = F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")))
    return F.array_join(F.array(F.when(location != "", location), people, F.when(mood != "", F.concat(F.lit("⬤ "), mood))), " • ")


def scene_text(description: Column, details: Column, pov_label: Column) -> Column:
    present = F.when(F.size(details) > 0, F.concat(F.lit("\n\n*Present:* "), F.array_join(details, ", "))).otherwise("")
    return F.concat(F.coalesce(description, F.lit("")), present, F.when(pov_label.isNotNull(), F.concat(F.lit("\n\n*POV:* "), pov_label)).otherwise(""))


def event_text(description: Column, affected: Column, triggers: Column, tags: Column) -> Column:
    return F.concat(
        F.coalesce(description, F.lit("")),
        F.when(F.size(affected) > 0, F.concat(F.lit("\n\n*Affected:* "), F.array_join(affected, ", "))).otherwise(""),
        F.when(F.size(triggers) > 0, F.concat(F.lit("\n\n*Leads to:* "), F.size(triggers).cast("string"), F.lit(" event(s)"))).otherwise(""),
        F.when(F.size(tags) > 0, F.concat(F.lit("\n\n*Tags:* "), F.array_join(tags, ", "))).otherwise(""),
    )


def actors_summary(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 2), " & ")


def from_references(references: DataFrame) -> DataFrame:
    """Scenes and events out of a note's entity references (note_id, kind, label, ord): a place in sequence by kind, importance major."""
    rows = references.filter("kind in ('SCENE', 'EVENT')")
    n = F.row_number().over(W.partitionBy("note_id", "kind").orderBy("ord"))
    rows = rows.withColumn("sequence", n)
    return rows.select("note_id", "kind", "label", "sequence", F.concat(F.initcap(F.lower("kind")), F.lit(" "), F.col("sequence").cast("string")).alias("display_text"), F.when(F.col("kind") == "EVENT", "major").alias("importance"))


def selected(items: DataFrame, title: str, subtitle: str) -> DataFrame:
    return items.filter((F.col("card_title") == title) & (F.col("card_subtitle") == subtitle)).orderBy("position").limit(1)
