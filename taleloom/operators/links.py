"""Link index: outgoing links, backlinks and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.functions.titles import jstrim
from taleloom.operators.markup import MENTION, places

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
ENTITY = r"\[([A-Z][A-Z_]*)(?::[A-Z_]+)?\|([^\]]+)\]"
RADIUS = 40


def normalized(title: Column) -> Column:
    return jstrim(F.lower(title))


def link_key(title: Column, kind: Column) -> Column:
    return F.when(kind.isNotNull(), F.concat(F.lit("entity:"), kind, F.lit(":"), normalized(title))).otherwise(F.concat(F.lit("note:"), normalized(title)))


def context(text: Column, start: Column, size: Column, radius: int = RADIUS) -> Column:
    """What stands around a match, trimmed, then marked where it was cut. start counts from 0, in code points."""
    left = F.greatest(start - radius, F.lit(0))
    right = F.least(F.length(text), start + size + radius)
    inner = jstrim(F.substr(text, left + 1, right - left))
    return F.concat(F.when(left > 0, F.lit("...")).otherwise(""), inner, F.when(right < F.length(text), F.lit("...")).otherwise(""))


def _found(text: Column, pattern: str, kind: str, kind_group: int | None, title_group: int) -> Column:
    titles = F.regexp_extract_all(text, F.lit(pattern), F.lit(title_group))
    kinds = F.regexp_extract_all(text, F.lit(pattern), F.lit(kind_group)) if kind_group else F.transform(titles, lambda x: F.lit(None).cast("string"))
    zipped = F.arrays_zip(titles.alias("title"), kinds.alias("kind"), places(text, pattern).alias("at"))
    return F.transform(zipped, lambda x: F.struct(jstrim(x["title"]).alias("target_title"), F.lit(kind).alias("link_type"), x["kind"].alias("entity_kind"), context(text, x["at"]["start"], x["at"]["size"]).alias("context")))


def outgoing(notes: DataFrame, text: str = "content") -> DataFrame:
    """(source, ord, target_title, link_type, entity_kind, context): wikilinks, then entities, then mentions."""
    t = F.col(text)
    found = F.concat(_found(t, WIKILINK, "wikilink", None, 1), _found(t, ENTITY, "entity", 1, 2), _found(t, MENTION, "mention", None, 1))
    return notes.select(F.col("id").alias("source"), F.posexplode(found).alias("ord", "x")).select("source", "ord", "x.*")


def index(links: DataFrame) -> DataFrame:
    """(source, key, count, link_type, context): links of a note to one target, with the first one's type and context."""
    keyed = links.withColumn("key", link_key(F.col("target_title"), F.col("entity_kind")))
    return keyed.groupBy("source", "key").agg(F.count("*").alias("count"), F.min_by("link_type", "ord").alias("link_type"), F.min_by("context", "ord").alias("context"))


def backlinks(notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, source, count, link_type): for each derived note, who links to its title or, where that note doesn't yet, to its
    entity; not itself. Two equi-joins in place of one on either key."""
    by_title = notes.select("id", F.concat(F.lit("note:"), normalized(F.col("title"))).alias("key"), F.lit(0).alias("way"))
    by_entity = notes.filter("is_entity").select("id", link_key(F.col("entity_label"), F.col("entity_kind")).alias("key"), F.lit(1).alias("way"))
    hits = by_title.unionByName(by_entity).join(indexed, "key").filter("id <> source")
    first = F.row_number().over(W.partitionBy("id", "source").orderBy("way"))
    return hits.withColumn("n", first).filter("n = 1").select("id", "source", "count", "link_type")


def resolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with `target`: the first derived note whose title, or whose entity label, is the link's title; null if none."""
    names = notes.select(normalized(F.col("title")).alias("name"), "id", F.col("ord").alias("note_ord"))
    names = names.unionByName(notes.filter("is_entity").select(normalized(F.col("entity_label")), "id", "ord").toDF("name", "id", "note_ord"))
    first = names.groupBy("name").agg(F.min_by("id", "note_ord").alias("target"))
    return links.withColumn("name", normalized(F.col("target_title"))).join(first, "name", "left").drop("name")


def dangling(links: DataFrame, notes: DataFrame) -> DataFrame:
    return resolved(links, notes).filter("target is null").drop("target")


def distinct_outgoing(links: DataFrame) -> DataFrame:
    """links without later ones of the same type, kind and lower-case title."""
    same = W.partitionBy("source", "link_type", "entity_kind", F.lower("target_title")).orderBy("ord")
    return links.withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n")


def outgoing_counts(links: DataFrame) -> DataFrame:
    kinds = [F.sum((F.col("link_type") == k).cast("long")).alias(f"{k}s") for k in ("wikilink", "mention")]
    return distinct_outgoing(links).groupBy("source").agg(*kinds, F.sum((F.col("link_type") == "entity").cast("long")).alias("entities"), F.count("*").alias("total"))


def created_for_missing(links: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes that clicks on dangling wikilinks make: one for each normalized title, by its first spelling."""
    missing = dangling(links.filter("link_type = 'wikilink'"), notes).filter("target_title <> ''")
    return missing.groupBy(normalized(F.col("target_title")).alias("name")).agg(F.min("target_title").alias("title")).select("title")
