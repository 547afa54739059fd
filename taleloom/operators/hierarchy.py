"""Folder trees: from each folder up to its root, with what it inherits on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.functions.titles import parsed
from taleloom.operators.trees import ascended
from taleloom.sources.shared import written


def typed(folders: DataFrame) -> DataFrame:
    """folders with entity_kind, entity_subtype, entity_label from their names."""
    p = parsed(F.col("name"))
    return folders.withColumns({"entity_kind": p["kind"], "entity_subtype": p["subtype"], "entity_label": p["label"]})


def walk(folders: DataFrame) -> DataFrame:
    """Of typed folders: id, depth, path, parent color and the nearest kind and subtype above. Roots have no
    parent or one that is missing; members of a parent cycle have no root and vanish."""
    rows = folders.select("id", "parent_id", "color", F.col("entity_kind").alias("own_kind"), F.col("entity_subtype").alias("own_subtype"))
    parents = rows.select(F.col("id").alias("up"), F.col("color").alias("parent_color"), F.col("own_kind").alias("inherited_kind"), F.col("own_subtype").alias("inherited_subtype"))
    links = written(rows.join(parents, F.col("parent_id") == F.col("up"), "left").withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)))
    nearest = lambda mine, theirs: F.coalesce(mine, theirs)
    up = ascended(
        links.withColumn("path", F.col("id")),
        {"depth": lambda mine, theirs: mine + theirs, "path": lambda mine, theirs: F.concat(theirs, F.lit("/"), mine), "inherited_kind": nearest, "inherited_subtype": nearest},
    )
    own = links.select("id", "color", "own_kind", "own_subtype", "parent_color")
    return own.join(up, "id").select("id", "depth", "path", "color", "own_kind", "own_subtype", "inherited_kind", "inherited_subtype", "parent_color")


def inherited(folders: DataFrame) -> DataFrame:
    """Typed folders with inherited_kind and inherited_subtype: the nearest above; none for roots and cycles."""
    up = walk(folders).select("id", "inherited_kind", "inherited_subtype")
    return folders.join(up, "id", "left")


def folder_color(tree: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """(id, color): a folder's own, else its parent's, else one of the palette by depth."""
    of_depth = F.element_at(F.array(*[F.lit(c) for c in palette]), F.col("depth") % len(palette) + 1)
    return tree.select("id", F.coalesce("color", "parent_color", of_depth).alias("color"))
