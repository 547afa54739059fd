"""The vault: notes and folders as JSON blobs and as snapshot tables, read with an explicit schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTE = "struct<id:string,title:string,content:string,createdAt:string,updatedAt:string,folderId:string,tags:array<string>,isPinned:boolean,favorite:boolean,entityKind:string,entitySubtype:string,entityLabel:string,isEntity:boolean>"
FOLDER = "struct<id:string,name:string,parentId:string,color:string,createdAt:string,entityKind:string,entitySubtype:string,entityLabel:string,isTypedRoot:boolean,isSubtypeRoot:boolean,inheritedKind:string,inheritedSubtype:string>"
BLOB = f"struct<notes:array<{NOTE}>,folders:array<{FOLDER}>,exportedAt:string,version:string>"
VERSION = "1.0"


class BadVault(ValueError):
    """A blob without notes or folders."""


def parse(blobs: DataFrame, value: str = "value") -> DataFrame:
    """blobs with `vault`, a struct by the declared schema."""
    return blobs.withColumn("vault", F.from_json(value, BLOB))


def import_blob(blobs: DataFrame, value: str = "value") -> DataFrame:
    """parse(), refusing blobs where notes or folders are missing."""
    rows = parse(blobs, value)
    broken = F.col("vault").isNull() | F.col("vault.notes").isNull() | F.col("vault.folders").isNull()
    return rows.withColumn("vault", F.when(broken, F.raise_error(F.lit("notes and folders must be there")).cast(BLOB)).otherwise(F.col("vault")))


def notes_of(vault: DataFrame) -> DataFrame:
    """A row per note: `ord` is its place; ISO times become timestamps (null where they are none)."""
    rows = vault.select(F.posexplode("vault.notes").alias("ord", "n")).select("ord", "n.*")
    return rows.withColumns({"createdAt": F.try_to_timestamp("createdAt"), "updatedAt": F.try_to_timestamp("updatedAt")})


def folders_of(vault: DataFrame) -> DataFrame:
    rows = vault.select(F.posexplode("vault.folders").alias("ord", "f")).select("ord", "f.*")
    return rows.withColumn("createdAt", F.try_to_timestamp("createdAt"))


def export_blob(notes: DataFrame, folders: DataFrame, exported_at: Column, parts: Column | None = None) -> DataFrame:
    """One JSON value per part (by default one for all): notes and folders in order, exportedAt and version. A vault that
    does not fit one value is exported in parts, so that no task holds all of it."""
    key = parts if parts is not None else F.lit(0)

    def listed(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != "ord"]
        return df.withColumn("part", key).groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*columns).alias("row")))), lambda x: x["row"]).alias(name))

    both = listed(notes, "notes").join(listed(folders, "folders"), "part", "full")
    return both.select("part", F.to_json(F.struct(F.coalesce("notes", F.array()).alias("notes"), F.coalesce("folders", F.array()).alias("folders"), exported_at.alias("exportedAt"), F.lit(VERSION).alias("version"))).alias("value"))


def data_url(url: Column) -> Column:
    """struct(mime, data) of a base64 data URL."""
    pattern = r"^data:([^;,]*);base64,(.*)$"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("mime"), F.unbase64(F.regexp_extract(url, pattern, 2)).alias("data"))


def as_document(content: Column) -> Column:
    """Content as a JSON document: what is no JSON becomes one paragraph; an empty one, an empty document."""
    wrapped = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))).alias("content"))).alias("content")))
    empty = F.lit('{"type":"doc","content":[{"type":"paragraph"}]}')
    return F.when(F.coalesce(content, F.lit("")) == "", empty).when(F.is_variant_null(F.try_parse_json(content)) | F.try_parse_json(content).isNotNull(), content).otherwise(wrapped)


class SnapshotStore:
    """A folder of snapshots with two slots, current and backup, kept in a pointer file. Data is written first and
    the pointer last, so a failed write leaves the old state; paths go through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def pointer(self) -> dict:
        fs, p = self._fs(f"{self.root}/pointer.json")
        if not fs.exists(p):
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/pointer.json").collect()))

    def _point(self, slots: dict) -> None:
        fs, p = self._fs(f"{self.root}/pointer.json")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(slots).encode()))
        finally:
            out.close()

    def save(self, tables: dict[str, DataFrame]) -> int:
        slots = self.pointer()
        version = slots.get("last", 0) + 1
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/v{version}/{name}")
        self._point({"current": version, "backup": slots.get("current"), "last": version})
        return version

    def _read(self, version: int | None, name: str, schema: T.StructType) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/v{version}/{name}")

    def load(self, name: str, schema: T.StructType) -> DataFrame:
        """The current snapshot; where it can't be read, the backup; without any, no rows."""
        slots = self.pointer()
        try:
            df = self._read(slots.get("current"), name, schema)
            df.isEmpty()
            return df
        except Exception:  # a missing or damaged snapshot, whatever the file system says about it
            return self.load_backup(name, schema)

    def load_backup(self, name: str, schema: T.StructType) -> DataFrame:
        return self._read(self.pointer().get("backup"), name, schema)

    def restore(self) -> None:
        """The backup becomes the current snapshot."""
        slots = self.pointer()
        if slots.get("backup"):
            self._point(slots | {"current": slots["backup"]})
