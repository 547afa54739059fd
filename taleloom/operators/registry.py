"""Schema registry, blueprints and fact-sheet fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.functions.constants import COLORS, KINDS, RELATIONSHIP_TYPES
from taleloom.functions.titles import jstrim

# The fact sheets' numbers of cards and fields.
FACT_SHEETS = {"CHARACTER": (7, 29), "LOCATION": (6, 29), "NPC": (5, 30), "ITEM": (5, 29), "FACTION": (6, 30), "SCENE": (5, 29), "EVENT": (5, 26), "CONCEPT": (5, 26)}
# The least standings of the four upper bands, and the bands' colours.
STANDING = ((50, "hsl(142, 76%, 36%)"), (20, "hsl(142, 76%, 50%)"), (-20, "hsl(45, 93%, 47%)"), (-50, "hsl(25, 95%, 53%)"))
STANDING_LOW = "hsl(0, 84%, 60%)"


class Duplicate(ValueError):
    """A key that is registered already."""


class Protected(ValueError):
    """A core type that can't be deleted."""


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, "title", "rectangle", COLORS[k]) for k in KINDS], "kind string, label_prop string, shape string, color string")


def relationship_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c.split(","), d) for a, b, c, d in RELATIONSHIP_TYPES], "label string, from string, to array<string>, directed boolean")


def fact_sheets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *n) for k, n in FACT_SHEETS.items()], "kind string, cards int, fields int")


def load_registry(store, spark: SparkSession) -> dict[str, DataFrame]:
    """Entity and relationship types of a snapshot store, each with its defaults where none can be read."""
    out = {}
    for name, default in (("entity_types", entity_types(spark)), ("relationship_types", relationship_types(spark))):
        found = store.load(name, default.schema)
        out[name] = default if found.isEmpty() else found
    return out


def save_registry(store, tables: dict[str, DataFrame]) -> int:
    return store.save(tables)


def registered(types: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """types and the new ones; an error where a key is there already."""
    if not types.join(new.select(key), key, "left_semi").isEmpty():
        raise Duplicate(f"{key} is registered already")
    return types.unionByName(new)


def updated(types: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """types with the patch's non-null values."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns])
    out = types.join(p, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns})
    return out.select(types.columns)


def without(types: DataFrame, key: str, value: str, protected: tuple[str, ...] = ()) -> DataFrame:
    if value in protected:
        raise Protected(f"{value} is a core type")
    return types.filter(~F.col(key).eqNullSafe(F.lit(value)))


def valid_blueprint(name: Column, kind: Column) -> Column:
    return (jstrim(F.coalesce(name, F.lit(""))) != "") & (F.coalesce(kind, F.lit("")) != "")


def note_entities(notes: DataFrame, inline: DataFrame) -> DataFrame:
    """(id, kind, label, inline): a note as an entity first, then those in its text, once by kind and label."""
    own = notes.filter("is_entity").select("id", F.col("entity_kind").alias("kind"), F.col("entity_label").alias("label"), F.lit(-1).alias("ord"))
    rows = own.unionByName(inline.select("id", "kind", "label", "ord"))
    first = W.partitionBy("id", "kind", "label").orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("id", "kind", "label", (F.col("ord") >= 0).alias("inline"))


def with_attributes(content: Column, key: Column, attributes: Column) -> Column:
    """A note's attributes (a map of maps) with one entity's replaced."""
    old = F.coalesce(content, F.create_map().cast("map<string,map<string,string>>"))
    rest = F.map_filter(old, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, attributes))


def attributes_of(content: Column, key: Column) -> Column:
    """What with_attributes() wrote; an empty map if nothing."""
    return F.coalesce(F.try_element_at(content, key), F.create_map().cast("map<string,string>"))


def text_field(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def number_field(x: Column, default: Column) -> Column:
    return F.coalesce(x, default, F.lit(0))


def progress_field(current: Column, most: Column) -> Column:
    return F.struct(F.coalesce(current, F.lit(0)).alias("current"), F.coalesce(most, F.lit(100)).alias("max"))


def stat_field(x: Column) -> Column:
    return F.coalesce(x, F.lit(10))


def list_field(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def clamped(x: Column, least: Column, most: Column) -> Column:
    """x within bounds, either of which may be null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, most), least))


def progress_percent(current: Column, most: Column) -> Column:
    return F.when(most > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(current, most) * 100))).otherwise(F.lit(0.0))


def edited_progress(value: Column, most: Column) -> Column:
    """Typed text as a whole number from 0 to the most; null if it is none."""
    n = F.regexp_extract(jstrim(value), r"^([+-]?\d+)", 1).try_cast("long")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0)), most))


def stat_total(base: Column, modifier: Column) -> Column:
    return base + F.coalesce(modifier, F.lit(0))


def edited_stat(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def standing(x: Column) -> Column:
    """struct(value, percent, color): a standing from -100 to 100."""
    v = F.greatest(F.lit(-100), F.least(F.lit(100), x))
    color = None
    for least, c in STANDING:
        color = (F.when if color is None else color.when)(v >= least, F.lit(c))
    return F.struct(v.alias("value"), ((v + 100) / 200 * 100).alias("percent"), color.otherwise(STANDING_LOW).alias("color"))


def appended(items: Column, value: Column) -> Column:
    t = jstrim(value)
    return F.when(t != "", F.concat(items, F.array(t))).otherwise(items)


def replaced(items: Column, at: Column, value: Column) -> Column:
    t = jstrim(value)
    return F.when(t != "", F.transform(items, lambda x, i: F.when(i == at, t).otherwise(x))).otherwise(items)


def removed(items: Column, at: Column) -> Column:
    return F.filter(items, lambda x, i: i != at)
