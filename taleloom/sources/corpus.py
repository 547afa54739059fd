"""Notes, folders and relations derived from the star-schema tables, so that every operator runs at any scale.

A note per order holds markup; folders are regions, nations and market segments. All of it is built from
expressions; only the items of one order are gathered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PALETTE = ("#ef4444", "#f97316", "#eab308", "#22c55e", "#14b8a6", "#3b82f6", "#8b5cf6", "#ec4899")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title(k) -> F.Column:
    n = k.cast("string")
    special = {
        3: F.concat(F.lit("[FOO|Order "), n, F.lit("]")),
        7: F.concat(F.lit("[CHARACTER:CITY|Order "), n, F.lit("]")),
        9: F.lit(" [LOCATION] "),
        11: F.lit("[ITEM:KEY]"),
        13: F.concat(F.lit("[SCENE| padded "), n, F.lit(" ]")),
        15: F.concat(F.lit("[EVENT|Order "), n),
        17: F.lit("[EVENT|"),
        19: F.concat(F.lit("[NPC|Order "), n, F.lit("|x]")),
    }
    out = None
    for rest, value in special.items():
        out = (F.when if out is None else out.when)(k % 50 == rest, value)
    out = out.when(k % 2 == 0, F.concat(F.lit("[EVENT:MEETING|Order "), n, F.lit("]")))
    return out.otherwise(F.concat(F.lit("Order "), n))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, title, content, folder_id, tags, favorite, created_at, customer."""
    orders, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("[ITEM:KEY|"), "p_name", F.lit("] by [FACTION:GUILD|"), "p_brand", F.lit("]")).alias("item"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(part, "l_partkey")
    items = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "item"))), lambda x: x["item"]), ". ").alias("items"))
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")  # both sides grow alike: neither is broadcast
    rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    content = F.concat(
        F.lit("[CHARACTER|"), "c_name", F.lit("] of [LOCATION:COUNTRY|"), "n_name", F.lit("] #"), "c_mktsegment",
        F.lit(" [[Order "), (k - 1).cast("string"), F.lit("]] @"), F.lower("c_mktsegment"), F.coalesce(F.concat(F.lit(". "), "items"), F.lit("")),
    )
    folder = F.when(k % 10 == 0, F.lit(None)).when(k % 97 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment"))
    return rows.select(
        F.concat(F.lit("n"), k.cast("string")).alias("id"), k.alias("ord"), _title(k).alias("title"), content.alias("content"), folder.cast("string").alias("folder_id"),
        F.array(F.lower("c_mktsegment")).alias("tags"), (k % 10 == 1).alias("favorite"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("c_name").alias("customer"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, parent_id, color, ord: three levels, one dangling parent and a cycle of two."""
    regions, nations, customers = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    top = regions.select(F.concat(F.lit("r"), r.cast("string")).alias("id"), F.when(r % 2 == 0, F.lit("[LOCATION:CONTINENT]")).otherwise(F.lit("[LOCATION]")).alias("name"), F.lit(None).cast("string").alias("parent_id"), F.when(r == 0, F.lit("#000000")).alias("color"), r.cast("long").alias("ord"))
    name = F.when(n % 3 == 0, F.concat(F.lit("[LOCATION:COUNTRY|"), "n_name", F.lit("]"))).when(n % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("[FACTION|"), "n_name", F.lit("]")))
    parent = F.when(n == 24, F.lit("gone")).otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    mid = nations.select(F.concat(F.lit("f"), n.cast("string")), name, parent, F.when(n % 7 == 0, F.lit("#123456")), (n + 100).cast("long"))
    seg = customers.select("c_nationkey", "c_mktsegment").distinct()
    c = F.col("c_nationkey").cast("string")
    low = seg.select(F.concat(F.lit("s"), c, F.lit("-"), "c_mktsegment"), F.col("c_mktsegment"), F.concat(F.lit("f"), c), F.lit(None).cast("string"), (F.col("c_nationkey") + 1000).cast("long"))
    ring = spark.range(2).select(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit("ring"), F.concat(F.lit("x"), (1 - F.col("id")).cast("string")), F.lit(None).cast("string"), F.col("id") + 5000)
    return top.union(mid).union(low).union(ring)


def triples_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, content): relation syntax, a line for each customer and for each nation."""
    customers, nations, regions = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    lives = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("ord"),
        F.concat(F.lit("[CHARACTER|"), "c_name", F.lit("] ->LIVES_IN-> [LOCATION| "), "n_name", F.lit(" ]")).alias("content"),
    )
    part = n.select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")), F.col("n_nationkey").cast("long") + 10_000_000,
        F.concat(F.lit("[LOCATION|"), "n_name", F.lit("] ->PART_OF-> [LOCATION|"), "r_name", F.lit("] and [A|x] (REL) [B|y] [LOCATION|"), "n_name", F.lit("]->PART_OF->[LOCATION|"), "r_name", F.lit("]")),
    )
    return lives.union(part)
