"""The note and folder store as relations: derivation, search, writes, history and sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.functions.titles import parsed, some

HISTORY = 50


def derived(notes: DataFrame) -> DataFrame:
    """notes with the entity columns that their titles say; a title that says none clears them."""
    p = parsed(F.col("title"))
    is_entity = some(p["label"]).isNotNull()
    return notes.withColumns({
        "entity_kind": F.when(is_entity, p["kind"]),
        "entity_subtype": F.when(is_entity, p["subtype"]),
        "entity_label": F.when(is_entity, p["label"]),
        "is_entity": is_entity,
    })


def search(notes: DataFrame, text: str) -> DataFrame:
    """Notes whose title, raw content or any tag contains the text, whatever the case; all for an empty text."""
    if not text:
        return notes
    q = F.lit(text.lower())
    return notes.filter(F.contains(F.lower("title"), q) | F.contains(F.lower("content"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), q)))


def without_folder(notes: DataFrame) -> DataFrame:
    return notes.filter(F.coalesce("folder_id", F.lit("")) == "")


def favorites(notes: DataFrame) -> DataFrame:
    return notes.filter(F.coalesce("favorite", F.lit(False)))


def entity_note(notes: DataFrame, kind: Column, label: Column) -> DataFrame:
    """The first derived note of an entity."""
    return notes.filter((F.col("entity_kind") == kind) & (F.col("entity_label") == label)).groupBy().agg(F.min_by("id", "ord").alias("id"))


def with_folder(notes: DataFrame, folders: DataFrame, how: str = "left") -> DataFrame:
    """Derived notes with their folder's kinds, as folder_kind, folder_subtype: its own or inherited ones."""
    f = folders.select(
        F.col("id").alias("folder_id"),
        F.coalesce("entity_kind", "inherited_kind").alias("folder_kind"),
        F.coalesce("entity_subtype", "inherited_subtype").alias("folder_subtype"),
    )
    return notes.join(f, "folder_id", how)


def effective_kind() -> Column:
    return F.coalesce("entity_kind", "folder_kind")


def kind_warning() -> Column:
    differs = F.col("is_entity") & F.col("folder_kind").isNotNull() & (F.col("entity_kind") != F.col("folder_kind"))
    text = F.concat(F.lit('Entity kind "'), "entity_kind", F.lit('" does not match folder kind "'), "folder_kind", F.lit('"'))
    return F.when(differs, text)


def prefilled_title() -> Column:
    """The title that a new note in a folder starts with; empty for an untyped folder."""
    k, s = F.col("folder_kind"), F.col("folder_subtype")
    return F.when(k.isNull(), F.lit("")).when(s.isNull(), F.concat(F.lit("["), k, F.lit("|"))).otherwise(F.concat(F.lit("["), k, F.lit(":"), s, F.lit("|")))


def needs_migration(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether any stored note (id, entity_kind, entity_label) differs from what its title says."""
    both = now.select("id", F.struct("entity_kind", "entity_label").alias("now")).join(stored.select("id", F.struct("entity_kind", "entity_label").alias("was")), "id")
    return both.agg(F.coalesce(F.bool_or(~F.col("now").eqNullSafe(F.col("was"))), F.lit(False)).alias("needed"))


def added_first(notes: DataFrame, new: DataFrame) -> DataFrame:
    """New notes come before all others: their ord falls below the least."""
    least = notes.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("least"))
    n = new.crossJoin(F.broadcast(least)).withColumn("ord", F.col("least") - 1 - F.col("ord")).drop("least")  # one row
    return notes.unionByName(n)


def added_last(folders: DataFrame, new: DataFrame) -> DataFrame:
    most = folders.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("most"))
    n = new.crossJoin(F.broadcast(most)).withColumn("ord", F.col("most") + 1 + F.col("ord")).drop("most")  # one row
    return folders.unionByName(n)


def patched(rows: DataFrame, patch: DataFrame, columns: list[str], stamp: str | None = None) -> DataFrame:
    """rows with the patch's non-null values by id; `stamp` names a patch column that replaces updated_at."""
    p = patch.select(F.col("id"), *[F.col(c).alias(f"new_{c}") for c in columns], *([F.col(stamp).alias("new_stamp")] if stamp else []), F.lit(True).alias("hit"))
    out = rows.join(p, "id", "left")
    values = {c: F.coalesce(f"new_{c}", c) for c in columns}
    if stamp:
        values["updated_at"] = F.when(F.col("hit"), F.col("new_stamp")).otherwise(F.col("updated_at"))
    return out.withColumns(values).select(rows.columns)


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def folder_deleted(notes: DataFrame, folders: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and folders after folders go with their direct notes; their subfolders stay and become roots."""
    gone = ids.select(F.col("id").alias("folder_id"))
    return notes.join(gone, "folder_id", "left_anti"), deleted(folders, ids)


def history(snapshots: DataFrame) -> DataFrame:
    """The newest HISTORY versions of (version, ...)."""
    newest = snapshots.select("version").distinct().orderBy(F.desc("version")).limit(HISTORY)
    return snapshots.join(F.broadcast(newest), "version", "left_semi")  # at most HISTORY rows


def replay(actions: str, pushes_first: int = 0) -> list[int]:
    """Which snapshot shows after each action of a string of p (push), u (undo) and r (redo). A redo reads two
    steps ahead of its index, so right after one push and one undo it finds none and does nothing."""
    past, index, shown, out = list(range(pushes_first)), pushes_first - 1, pushes_first - 1, []
    count = pushes_first
    for a in actions:
        if a == "p":
            past = [*past[: index + 1], count][-HISTORY:]
            index, shown, count = len(past) - 1, count, count + 1
        elif a == "u" and index >= 0:
            shown, index = past[index], index - 1
        elif a == "r" and index + 2 < len(past):
            shown, index = past[index + 2], index + 1
        out.append(shown)
    return out


def renamed_color(kind: Column, old_kind: Column, color: Column, new_color: Column) -> Column:
    """A folder's colour after a rename: a kind's own only if the folder had no kind before."""
    return F.when(kind.isNotNull() & old_kind.isNull(), new_color).otherwise(color)


def synced(local: DataFrame, external: DataFrame, keep_local_only: bool = False) -> DataFrame:
    """Notes after another writer's set arrives: for each external note the newer of both, the local one on a tie. Notes that only
    the local side has are dropped unless keep_local_only says otherwise."""
    columns = local.columns
    mine = local.select("id", F.struct(*columns).alias("mine"))
    theirs = external.select("id", F.struct(*columns).alias("theirs"))
    both = mine.join(theirs, "id", "full" if keep_local_only else "right")
    newer = F.when(F.col("theirs").isNull() | (F.col("mine.updated_at") >= F.col("theirs.updated_at")), F.col("mine")).otherwise(F.col("theirs"))
    return both.select(newer.alias("n")).select("n.*")


def permalink(origin: str, note_id: Column) -> Column:
    return F.concat(F.lit(f"{origin}/note/"), note_id)


def newest_version(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last write of each key, ties by the whole row."""
    latest = W.partitionBy(key).orderBy(F.desc(version), F.desc(F.to_json(F.struct(*changes.columns))))
    return changes.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


