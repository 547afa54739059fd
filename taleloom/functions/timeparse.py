"""Narrative time: text to a point in time, and points to text and to comparable numbers.

A cascade, first match wins: a date in one of the known forms (day, month and year: exact; month and year or a year
alone: less so), a relative offset, a place in a sequence, else an abstract phrase. No form depends on the current
time. Natural-language dates beyond these forms are read as abstract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions.titles import jstrim, let

# The patterns of relative, sequential and abstract time, and their confidences.
RELATIVE = (
    r"(?i)\d+\s+(day|hour|week|month|year)s?\s+(after|before|later|earlier)",
    r"(?i)(next|previous|following|prior)\s+(morning|evening|day|week)",
    r"(?i)(the\s+)?(morning|evening|night)\s+(after|before|of|following)",
    r"(?i)later\s+that\s+(day|night|evening|morning)",
    r"(?i)the\s+same\s+(day|night|evening|morning)",
)
OFFSET = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+(after|before|later|earlier)"
PERIOD = r"(?i)(the\s+)?(morning|evening|night|afternoon)\s+(after|before|of|following)"
LATER = r"(?i)later\s+that\s+(day|night|evening|morning)"
SEQUENTIAL = (r"(?i)\b(chapter|act|scene|part|book|episode|sequence)\s+\d+", r"^#\d+$", r"(?i)\bch\.?\s*\d+")
CHAPTER, ACT, SCENE, NUMBER = r"(?i)(?:chapter|ch\.?)\s*(\d+)", r"(?i)act\s*(\d+)", r"(?i)scene\s*(\d+)", r"#(\d+)"
ABSTRACT = (
    (r"(?i)^(meanwhile|in the meantime|at the same time)", 0.6),
    (r"(?i)^(long ago|once upon a time|in ancient times)", 0.3),
    (r"(?i)^(in another life|in a dream|somewhere in time)", 0.2),
    (r"(?i)^(eventually|soon|later|afterwards)", 0.5),
)
UNIT_DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
#: Date forms: a pattern of the whole text, Spark's format, and whether day, month and year are all there.
DATES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", True),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", True),
    (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy", True),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy", True),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", True),
    (r"^[A-Z][a-z]+ \d{4}$", "MMMM yyyy", False),
)
#: What has no time sorts last: 2**53 - 1.
NEVER = 9007199254740991


def _any(text: Column, patterns) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return out


def is_relative(text: Column) -> Column:
    return _any(text, RELATIVE)


def is_sequential(text: Column) -> Column:
    return _any(text, SEQUENTIAL)


def number(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, pattern, 1)
    return F.when(got != "", got).cast("long")


def offset_days(amount: Column, unit: Column, direction: Column) -> Column:
    days = None
    for u, d in UNIT_DAYS.items():
        days = (F.when if days is None else days.when)(unit == u, F.lit(d))
    sign = F.when(direction.isin("before", "earlier"), F.lit(-1)).otherwise(F.lit(1))
    return amount * days.otherwise(F.lit(1.0)) * sign + F.lit(0.0)  # no negative zero


def timestamp_of(text: Column) -> Column:
    out = None
    for pattern, form, _ in DATES:
        value = F.try_to_timestamp(F.regexp_replace(text, "T", " ") if " HH" in form else text, F.lit(form))
        out = (F.when if out is None else out.when)(text.rlike(pattern), value)
    return out


def is_exact(text: Column) -> Column:
    return _any(text, [p for p, _, whole in DATES if whole])


def abstract_confidence(text: Column) -> Column:
    out = None
    for pattern, confidence in ABSTRACT:
        out = (F.when if out is None else out.when)(text.rlike(pattern), F.lit(confidence))
    return out.otherwise(0.4)


def parse(text: Column, reference: Column | None = None) -> Column:
    """struct(granularity, timestamp, relative_to, offset_days, offset_hours, chapter, act, scene, sequence, display_text, confidence,
    source). reference: the id of the event that relative times refer to."""
    ref = reference if reference is not None else F.lit(None).cast("string")
    return let(F.struct(jstrim(text).alias("t"), ref.alias("ref")), lambda x: _point(x["t"], x["ref"]))


def _point(t: Column, ref: Column) -> Column:
    at = timestamp_of(t)
    dated, seq = at.isNotNull(), is_sequential(t)
    by_offset, by_period, by_later = t.rlike(OFFSET), t.rlike(PERIOD), t.rlike(LATER)
    relative = ~dated & is_relative(t) & (by_offset | by_period | by_later)
    sequential = ~dated & ~is_relative(t) & seq
    way = F.lower(F.regexp_extract(t, PERIOD, 3))
    days = (
        F.when(by_offset, offset_days(F.regexp_extract(t, OFFSET, 1).try_cast("double"), F.lower(F.regexp_extract(t, OFFSET, 2)), F.lower(F.regexp_extract(t, OFFSET, 3))))
        .when(by_period, F.when(way == "before", F.lit(-1.0)).when(way.isin("after", "following"), F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )
    parts = {n: number(t, p) for n, p in (("chapter", CHAPTER), ("act", ACT), ("scene", SCENE), ("n", NUMBER))}
    sequence = F.coalesce(parts["chapter"], F.lit(0)) * 10000 + F.coalesce(parts["act"], F.lit(0)) * 100 + F.coalesce(parts["n"], F.lit(0))
    return F.struct(
        F.when(dated & is_exact(t), "precise").when(dated, "datetime").when(relative, "relative").when(sequential, "sequential").otherwise("abstract").alias("granularity"),
        at.alias("timestamp"),
        F.when(relative, ref).alias("relative_to"),
        F.when(relative, days).alias("offset_days"),
        F.when(relative & ~by_offset & ~by_period, F.lit(4.0)).alias("offset_hours"),
        *[F.when(sequential, parts[n]).alias(n) for n in ("chapter", "act", "scene")],
        F.when(sequential, sequence).alias("sequence"),
        t.alias("display_text"),
        F.when(dated, F.when(is_exact(t), 0.95).otherwise(0.7)).when(relative, F.when(by_offset, 0.8).when(by_period, 0.75).otherwise(0.7)).when(sequential, 1.0).otherwise(abstract_confidence(t)).alias("confidence"),
        F.when(relative & by_offset, F.when(ref.isNotNull(), "contextual").otherwise("inferred")).when(relative, "contextual").otherwise("explicit").alias("source"),
    )


def display(p: Column, full: bool = True) -> Column:
    """A point as text. Exact times have a fixed form in place of the host's locale."""
    seq = F.array_join(
        F.array(
            F.when(F.coalesce(p["chapter"], F.lit(0)) != 0, F.concat(F.lit("Ch. "), p["chapter"].cast("string"))),
            F.when(F.coalesce(p["act"], F.lit(0)) != 0, F.concat(F.lit("Act "), p["act"].cast("string"))),
            F.when(F.lit(full) & (F.coalesce(p["sequence"], F.lit(0)) != 0) & (p["sequence"] < 100), F.concat(F.lit("#"), p["sequence"].cast("string"))),
        ),
        ", ",
    )
    exact = F.date_format(p["timestamp"], "yyyy-MM-dd HH:mm:ss" if full else "yyyy-MM-dd")
    return F.when(p["granularity"] == "precise", F.coalesce(exact, p["display_text"])).when((p["granularity"] == "sequential") & (seq != ""), seq).otherwise(p["display_text"])


def millis(timestamp: Column) -> Column:
    """Milliseconds, rounded, halves away from zero: as epoch_ms() of the SQL counts finer times."""
    rest = F.pmod(F.unix_micros(timestamp), F.lit(1000))
    return F.unix_millis(timestamp) + F.when((rest > 500) | (rest == 500) & (F.unix_micros(timestamp) > 0), 1).otherwise(0)


def comparable(p: Column, reference_ms: Column) -> Column:
    """A long to sort by: milliseconds, a weighted sequence, or a reference's time and an offset; else the largest."""
    zero = F.lit(0)
    return (
        F.when(p["timestamp"].isNotNull(), millis(p["timestamp"]))
        .when(p["granularity"] == "sequential", F.coalesce(p["chapter"], zero) * 1_000_000 + F.coalesce(p["act"], zero) * 1000 + F.coalesce(p["sequence"], zero))
        .when(p["granularity"] == "relative", (F.coalesce(reference_ms, zero) + F.coalesce(p["offset_days"], F.lit(0.0)) * 86_400_000 + F.coalesce(p["offset_hours"], F.lit(0.0)) * 3_600_000).cast("long"))
        .otherwise(F.lit(NEVER))
    )
