"""Markup in text: tags, mentions, wikilinks, entities, backlinks and triples as rows.

Values come from regexp_extract_all on the JVM. Where offsets are needed they come from the gaps: a text split at a pattern
gives what stands between the matches, and running lengths of gaps and matches give each match's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions.constants import KINDS
from taleloom.functions.titles import jstrim

# The patterns of the markup.
TAG = r"#(\w+)"
MENTION = r"@(\w+)"
WIKILINK = r"\[\[\s*([^\]\s|][^\]|]*?)\s*(?:\|[^\]]*)?\]\]"
ENTITY = r"\[([A-Z_]+)(?::([A-Z_]+))?\|([^\]]+?)(?:\|(\{.*?\}))?\]"
BACKLINK = r"<<\s*([^>\s|][^>|]*?)\s*(?:\|[^>]*)?>>"
TRIPLE = r"\[([A-Z_]+)\|([^\]]+)\]\s*->([A-Z_]+)->\s*\[([A-Z_]+)\|([^\]]+)\]"
# Inline tokens. An entity needs a bar; a wikilink may be any text in double brackets.
TOKEN_ENTITY = r"\[([A-Z_]+)(?::([A-Z_]+))?\|([^\]]+)\]"
TOKEN_LINK = r"\[\[([^\]]+)\]\]"
# Phrases that tell a time.
TEMPORAL = (
    r"(?i)\b(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(second|minute|hour|day|week|month|year)s?\s+(later|before|after|earlier|ago)\b",
    r"(?i)\b(next|last|the following|the previous)\s+(morning|afternoon|evening|night|day|week|month|year|dawn|dusk|midnight|noon)\b",
    r"(?i)\b(yesterday|tomorrow|today|tonight|nowadays)\b",
    r"(?i)\b(at|by|before|after|around)\s+(dawn|dusk|midnight|noon|sunrise|sunset)\b",
    r"(?i)\b(moments?|seconds?|minutes?|hours?)\s+(later|before|after|earlier)\b",
    r"(?i)\b(meanwhile|eventually|suddenly|immediately|soon|later|afterwards|beforehand)\b",
    r"(?i)\b(in the|that)\s+(morning|afternoon|evening|night)\b",
    r"(?i)\b(the next day|the day after|the night before|the morning of|the evening of)\b",
)


def groups(text: Column, pattern: str, *which: int) -> Column:
    """For each match a struct g1, g2, ... of its groups; a group that took no part is empty."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in which]
    return F.arrays_zip(*[f.alias(f"g{g}") for f, g in zip(found, which, strict=True)])


def utf16(x: Column) -> Column:
    return (F.length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def places(text: Column, pattern: str, length=F.length) -> Column:
    """For each match struct(start, size), counted by `length` (code points, or utf16). Split keeps all gaps, so gap i ends
    where match i begins; both arrays are made once and added up in one pass."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(length(gap).alias("gap"), length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        # the last gap has no match after it
        return F.when(x["size"].isNull(), s).otherwise(
            F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), x["size"].alias("size")))).alias("out"))
        )

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def offsets(text: Column, pattern: str) -> Column:
    """The UTF-16 place of each match."""
    return F.transform(places(text, pattern, utf16), lambda x: x["start"])


def values(notes: DataFrame, text: str, pattern: str, distinct: bool = True) -> DataFrame:
    """(id, ord, value): group 1 of each match, trimmed; once a note, at its first place."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), jstrim)
    return notes.select("id", F.posexplode(F.array_distinct(found) if distinct else found).alias("ord", "value"))


def tags(notes: DataFrame, text: str = "content") -> DataFrame:
    return values(notes, text, TAG)


def mentions(notes: DataFrame, text: str = "content") -> DataFrame:
    return values(notes, text, MENTION)


def wikilinks(notes: DataFrame, text: str = "content") -> DataFrame:
    return values(notes, text, WIKILINK)


def backlinks(notes: DataFrame, text: str = "content") -> DataFrame:
    return values(notes, text, BACKLINK)


def entities(notes: DataFrame, text: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ord, kind, subtype, label, attributes, position, and the columns of notes to keep): every match, kinds not checked.
    attributes: JSON after its single quotes became double ones; null where that is no JSON."""
    rows = notes.select("id", *keep, F.arrays_zip(groups(F.col(text), ENTITY, 1, 2, 3, 4).alias("g"), offsets(F.col(text), ENTITY).alias("position")).alias("m"))
    rows = rows.select("id", *keep, F.posexplode("m").alias("ord", "x"))
    json = F.replace("x.g.g4", F.lit("'"), F.lit('"'))
    return rows.select(
        "id", "ord", F.col("x.g.g1").alias("kind"), F.when(F.col("x.g.g2") != "", F.col("x.g.g2")).alias("subtype"), F.col("x.g.g3").alias("label"),
        F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, "map<string,string>")).alias("attributes"), F.col("x.position").alias("position"), *keep,
    )


def merged_entities(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (note, kind, subtype, label): positions in order, the first one's attributes. keep: columns of the note."""
    keys = ["id", "kind", "subtype", "label", *keep]
    out = found.groupBy(*keys).agg(F.sort_array(F.collect_list("position")).alias("positions"), F.min("ord").alias("ord"), F.min_by("attributes", "ord").alias("attributes"))
    return out.select("id", "ord", "kind", "subtype", "label", "positions", "attributes", *keep)


def triples(notes: DataFrame, text: str = "content") -> DataFrame:
    rows = notes.select("id", F.posexplode(groups(F.col(text), TRIPLE, 1, 2, 3, 4, 5)).alias("ord", "x"))
    return rows.select("id", "ord", F.col("x.g1").alias("subject_kind"), jstrim(F.col("x.g2")).alias("subject"), F.col("x.g3").alias("predicate"), F.col("x.g4").alias("object_kind"), jstrim(F.col("x.g5")).alias("object"))


def has_syntax(text: Column) -> Column:
    out = text.rlike(TAG)
    for p in (MENTION, WIKILINK, ENTITY, BACKLINK):
        out = out | text.rlike(p)
    return out


def tokens(notes: DataFrame, text: str = "content") -> DataFrame:
    """(id, start, end, type, text): inline tokens in code points, by priority: entity, wikilink, tag, mention, time. A token that
    touches a range taken before is left out. Brackets of an unknown kind take their range but are no token."""
    t = F.col(text)
    kinds = [("entity", TOKEN_ENTITY), ("wikilink", TOKEN_LINK), ("tag", TAG), ("mention", MENTION), *[("time", p) for p in TEMPORAL]]

    def typed(kind: str, pattern: str) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.zip_with(places(t, pattern), whole, lambda at, m: F.struct(at["start"].alias("start"), (at["start"] + at["size"]).alias("end"), F.lit(kind).alias("type"), m.alias("text")))

    found = F.concat(*[typed(k, p) for k, p in kinds])
    free = F.aggregate(
        found,
        F.array().cast("array<struct<start:int,end:int,type:string,text:string>>"),
        lambda taken, x: F.when(F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), taken).otherwise(F.concat(taken, F.array(x))),
    )
    rows = notes.select("id", F.explode(free).alias("x")).select("id", "x.start", "x.end", "x.type", "x.text")
    known = F.regexp_extract("text", TOKEN_ENTITY, 1).isin(*KINDS)
    return rows.filter((F.col("type") != "entity") | known)
