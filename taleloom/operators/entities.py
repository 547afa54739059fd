"""Entity extraction and merging, co-occurrence, PMI and explicit relations."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.functions.titles import entity_id
from taleloom.operators import markup as mu

CONTEXT_RADIUS = 50

Extractor = Callable[[DataFrame], DataFrame]


class Extractors:
    """Named functions from notes to (note_id, kind, label, subtype, confidence, positions, attributes, note_ord, ord). Unknown names
    are skipped, and so is an extractor that fails, with a warning: the others go on."""

    def __init__(self):
        self._known: dict[str, Extractor] = {}

    def register(self, name: str, extractor: Extractor) -> None:
        self._known[name] = extractor

    def has(self, name: str) -> bool:
        return name in self._known

    def extract(self, notes: DataFrame, methods: list[str]) -> DataFrame | None:
        out = None
        for name in methods:
            if not self.has(name):
                continue
            try:
                got = self._known[name](notes).withColumn("method", F.lit(name))
            except Exception as error:  # whatever an extractor of someone else's raises
                warnings.warn(f"extraction failed for {name}: {error}", stacklevel=2)
                continue
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        return out


def by_regex(notes: DataFrame, text: str = "content") -> DataFrame:
    """Merged entities of each note, confidence 1."""
    found = mu.merged_entities(mu.entities(notes.withColumn("note_ord", F.col("ord")), text, ("note_ord",)), ("note_ord",))
    return found.select(F.col("id").alias("note_id"), "kind", "label", "subtype", F.lit(1.0).alias("confidence"), "positions", "attributes", "note_ord", "ord")


def relationships(notes: DataFrame, text: str = "content") -> DataFrame:
    """The triples of each note as relations: (note_id, source_kind, source, target_kind, target, type, weight, confidence, method, ord)."""
    found = mu.triples(notes, text)
    ends = [F.col("subject_kind").alias("source_kind"), F.col("subject").alias("source"), F.col("object_kind").alias("target_kind"), F.col("object").alias("target")]
    return found.select(F.col("id").alias("note_id"), *ends, F.col("predicate").alias("type"), F.lit(1).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("regex").alias("method"), F.struct("id", "ord").alias("ord"))


def mentions(extracted: DataFrame, notes: DataFrame, text: str = "content") -> DataFrame:
    """(entity_id, note_id, position, context): every mention of every entity, with what stands around it. An entity without a
    place is mentioned once, at 0, with its label for a context."""
    rows = extracted.select(entity_id(F.col("kind"), F.col("label")).alias("entity_id"), "note_id", "label", F.explode_outer("positions").alias("position"))
    rows = rows.join(notes.select(F.col("id").alias("note_id"), F.col(text).alias("text")), "note_id", "left")
    context = F.when(F.col("position").isNull(), F.col("label")).otherwise(mention_context(F.col("text"), F.col("position"), F.col("label")))
    return rows.select("entity_id", "note_id", F.coalesce("position", F.lit(0)).alias("position"), context.alias("context"))


def mention_context(text: Column, start: Column, label: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """What stands around a mention: marked where cut, then trimmed. The place is one in the whole text."""
    left, right = F.greatest(start - radius, F.lit(0)), F.least(start + F.length(label) + radius, F.length(text))
    inner = F.substr(text, left + 1, right - left)
    marked = F.concat(F.when(left > 0, F.lit("...")).otherwise(""), inner, F.when(right < F.length(text), F.lit("...")).otherwise(""))
    return F.regexp_replace(marked, r"^\s+|\s+$", "")


def mention_count() -> Column:
    return F.greatest(F.size("positions"), F.lit(1))


def merged(extracted: DataFrame) -> DataFrame:
    """One row per canonical entity: first label, kind and non-empty subtype, frequency (mentions, at least one a note), number
    of notes, extraction methods, and the mention-weighted mean confidence. What an entity may have without bound is a relation of
    its own: memberships() (its notes), mentions(), merged_attributes()."""
    at = F.struct("note_ord", "ord")
    rows = extracted.withColumn("entity_id", entity_id(F.col("kind"), F.col("label"))).withColumn("n", mention_count())
    return rows.groupBy("entity_id").agg(
        F.min_by("label", at).alias("label"),
        F.min_by("kind", at).alias("kind"),
        F.min_by("subtype", F.when(F.coalesce("subtype", F.lit("")) != "", at)).alias("subtype"),
        F.sum("n").cast("long").alias("frequency"),
        F.count_distinct("note_id").alias("notes"),
        (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"),
        F.min(at).alias("ord"),
        F.sort_array(F.collect_set("method")).alias("methods"),  # as many as there are extractors
    )


def entity_attributes(extracted: DataFrame) -> DataFrame:
    """(entity_id, key, value) of extracted entities: of the values that notes give a key, in order, the last one."""
    rows = extracted.select(entity_id(F.col("kind"), F.col("label")).alias("entity_id"), F.struct("note_ord", "ord").alias("ord"), "attributes")
    return merged_attributes(rows)


def merged_attributes(rows: DataFrame) -> DataFrame:
    """(entity_id, key, value): a shallow merge of (entity_id, ord, attributes) maps in which the last one wins."""
    flat = rows.select("entity_id", "ord", F.explode("attributes").alias("key", "value"))
    return flat.groupBy("entity_id", "key").agg(F.max_by("value", "ord").alias("value"))


def id_map(entities: DataFrame) -> DataFrame:
    """(kind, label, entity_id): the exact first spelling only."""
    return entities.select("kind", "label", "entity_id")


def memberships(extracted: DataFrame, window: str = "note") -> DataFrame:
    """(entity_id, unit): which entities stand in which notes (a paragraph counts as its note) or sentences."""
    rows = extracted.withColumn("entity_id", entity_id(F.col("kind"), F.col("label")))
    if window in ("note", "paragraph"):
        return rows.select("entity_id", F.col("note_id").alias("unit")).distinct()
    if window == "sentence":  # rows without a sentence stand in none
        return rows.filter("sentence_index is not null").select("entity_id", F.struct("note_id", "sentence_index").alias("unit")).distinct()
    raise ValueError(f"no window named {window}")


def cooccurrence(member: DataFrame) -> DataFrame:
    """(a, b, weight): pairs of entities by the units they share. One shuffle on the unit, then pairs fold
    before the second. Pairs are made inside a unit, whose size is that of one note."""
    other = member.select(F.col("entity_id").alias("b"), F.col("unit").alias("u"))
    pairs = member.join(other, (F.col("unit") == F.col("u")) & (F.col("entity_id") < F.col("b")))
    return pairs.groupBy(F.col("entity_id").alias("a"), "b").agg(F.count("*").alias("weight"))


def edge_id(a: Column, b: Column, kind: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("--"), F.greatest(a, b), F.lit("::"), kind)


def explicit_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations (source_kind, source, target_kind, target, type, weight, confidence, ord) merged by unordered pair
    and type: first direction, summed weight, and a confidence that starts at 0 and moves half way to each next one.
    Ends that are spelled otherwise than in `ids` drop out."""
    s = ids.select(F.col("kind").alias("source_kind"), F.col("label").alias("source"), F.col("entity_id").alias("source_id"))
    t = ids.select(F.col("kind").alias("target_kind"), F.col("label").alias("target"), F.col("entity_id").alias("target_id"))
    rows = relations.join(s, ["source_kind", "source"]).join(t, ["target_kind", "target"])
    rows = rows.withColumn("edge_id", edge_id(F.col("source_id"), F.col("target_id"), F.col("type")))
    each = W.partitionBy("edge_id")
    back = F.row_number().over(each.orderBy(F.desc("ord")))
    rows = rows.withColumn("part", F.col("confidence") * F.pow(F.lit(0.5), back))
    return rows.groupBy("edge_id").agg(F.min_by("source_id", "ord").alias("source_id"), F.min_by("target_id", "ord").alias("target_id"), F.first("type").alias("type"), F.sum("weight").alias("weight"), F.sum("part").alias("confidence"))


def with_pmi(edges: DataFrame, entities: DataFrame, total: int | Column) -> DataFrame:
    """edges (a, b, weight) with pmi; an entity that is not known counts as in one note; null if there is no note."""
    n = F.lit(total).cast("double") if isinstance(total, int) else total.cast("double")
    f = entities.select(F.col("entity_id"), F.col("notes"))
    rows = edges.join(f.toDF("a", "fa"), "a", "left").join(f.toDF("b", "fb"), "b", "left")
    p = F.col("weight") / n / (F.coalesce("fa", F.lit(1)) / n * (F.coalesce("fb", F.lit(1)) / n))
    return rows.withColumn("pmi", F.when((n > 0) & (p > 0), F.log2(p))).drop("fa", "fb")


def by_weight(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


def by_confidence(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("confidence") >= least)


def by_pmi(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.coalesce("pmi", F.lit(0.0)) >= least)
