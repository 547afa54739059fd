"""Scalar functions over note titles and folder names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions.constants import COLORS, GREY, KINDS, SUBTYPES

#: What String.prototype.trim removes, as a class both Java and RE2 read.
WS = r"[\s\x{0B}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = f"^{WS}+|{WS}+$"
TITLE = r"^\[([A-Z_]+)(?::([A-Z_]+))?(?:\|(.+))?\]$"
UNFINISHED = r"^\[[A-Z_]+(?::[A-Z_]+)?\|$"
BARE_PREFIX = r"^\[[A-Z_]+(?::[A-Z_]+)?\|?\]?$"
OPEN_ENTITY = r"^\[[A-Z_]+(?::[A-Z_]+)?\|[^\]]+$"
VALID_PAIRS = tuple(f"{k}:{s}" for k, subtypes in SUBTYPES.items() for s in subtypes)


def jstrim(x: Column) -> Column:
    return F.regexp_replace(x, TRIM, "")


def some(x: Column) -> Column:
    """Null for an empty string."""
    return F.when(x != "", x)


def is_kind(x: Column) -> Column:
    return F.coalesce(x.isin(*KINDS), F.lit(False))


def is_subtype(kind: Column, subtype: Column) -> Column:
    return F.coalesce(F.concat(kind, F.lit(":"), subtype).isin(*VALID_PAIRS), F.lit(False))


def subtypes_of(kind: Column) -> Column:
    """The subtypes of a kind, joined by commas; null for an unknown kind."""
    out = F.when(kind == KINDS[0], F.lit(",".join(SUBTYPES[KINDS[0]])))
    for k in KINDS[1:]:
        out = out.when(kind == k, F.lit(",".join(SUBTYPES[k])))
    return out


def let(value: Column, build) -> Column:
    """build(value), with the value computed once and the generated code kept small."""
    return F.element_at(F.transform(F.array(value), build), 1)


def parsed(title: Column) -> Column:
    """struct(kind, subtype, label): all null unless the title is entity syntax with a known kind and a subtype of it."""

    def groups(t: Column) -> Column:
        return F.struct(t.rlike(TITLE).alias("m"), *[F.regexp_extract(t, TITLE, i).alias(n) for i, n in ((1, "k"), (2, "s"), (3, "l"))])

    def checked(g: Column) -> Column:
        ok = g["m"] & is_kind(g["k"]) & ((g["s"] == "") | is_subtype(g["k"], g["s"]))
        return F.struct(F.when(ok, g["k"]).alias("kind"), F.when(ok, some(g["s"])).alias("subtype"), F.when(ok & (g["l"] != ""), jstrim(g["l"])).alias("label"))

    return let(let(jstrim(title), groups), checked)


def is_typed_root(p: Column) -> Column:
    return p["kind"].isNotNull() & some(p["label"]).isNull() & p["subtype"].isNull()


def is_subtype_root(p: Column) -> Column:
    return p["kind"].isNotNull() & some(p["label"]).isNull() & p["subtype"].isNotNull()


def is_typed_subfolder(p: Column) -> Column:
    return p["kind"].isNotNull() & some(p["label"]).isNotNull()


def display_name(title: Column) -> Column:
    p = parsed(title)
    return F.coalesce(some(p["label"]), p["subtype"], p["kind"], title)


def entity_title(kind: Column, subtype: Column, label: Column) -> Column:
    return F.concat(F.lit("["), kind, F.coalesce(F.concat(F.lit(":"), some(subtype)), F.lit("")), F.lit("|"), label, F.lit("]"))


def typed_folder_name(kind: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("]"))


def subtype_folder_name(kind: Column, subtype: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(":"), subtype, F.lit("]"))


def entity_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.upper(F.regexp_replace(jstrim(label), f"{WS}+", "_")))


def registry_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), f"{WS}+", "_")


def edited_title(value: Column, before: Column) -> Column:
    """The title to save after an edit; null where the edit is cancelled."""
    t = jstrim(value)
    refused = (t == "") | t.rlike(BARE_PREFIX) | t.endswith("|")
    final = F.when(t.rlike(OPEN_ENTITY), F.concat(t, F.lit("]"))).otherwise(t)
    return F.when(~refused & (final != before), final)


def key_kind(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def key_label(key: Column) -> Column:
    return F.when(F.instr(key, "|") > 0, F.substr(key, F.instr(key, "|") + 1)).otherwise(F.lit(""))


def color_of(kind: Column) -> Column:
    out = F.when(kind == KINDS[0], F.lit(COLORS[KINDS[0]]))
    for k in KINDS[1:]:
        out = out.when(kind == k, F.lit(COLORS[k]))
    return out.otherwise(F.lit(GREY))


def new_id() -> Column:
    """A fresh identifier; not deterministic, so no result that is compared holds one."""
    return F.uuid()
