"""Editor marks as HTML spans, and the spans' attributes read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions.titles import color_of

# Each mark's attributes in HTML, class and further style.
MARKS = {
    "entity": (("data-kind", "data-label", "data-attributes"), "entity-mark", ""),
    "tag": (("data-tag",), "tag-mark", ""),
    "mention": (("data-mention-id",), "mention-mark", ""),
    "wikilink": (("data-wikilink-title",), "wikilink-mark", " text-decoration: underline; text-decoration-style: dotted; cursor: pointer;"),
}
TINTS = {"tag": "#3b82f6", "mention": "#10b981", "wikilink": "#6366f1"}
STYLE = "background-color: {0}20; color: {0}; padding: 2px 6px; border-radius: 4px; font-weight: 500; font-size: 0.875em;"
#: What a span of HTML can't hold as it is, and its character reference.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(text: Column) -> Column:
    for plain, written in REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _plain(text: Column) -> Column:
    for plain, written in reversed(REFERENCES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def mark_html(mark: str, content: Column, *values: Column) -> Column:
    """The span of a mark around its content; values in the order of MARKS. A null or empty value has no attribute."""
    names, css, more = MARKS[mark]
    attributes = [F.when(v != "", F.concat(F.lit(f' {name}="'), _escaped(v), F.lit('"'))) for name, v in zip(names, values, strict=True)]
    before, after = (F.lit(part) for part in STYLE.split("{0}20; color: {0}"))
    tint = color_of(values[0]) if mark == "entity" else F.lit(TINTS[mark])
    flag = ' data-entity="true"' if mark == "entity" else ""
    style = F.concat(before, tint, F.lit("20; color: "), tint, after, F.lit(more))
    return F.concat(F.lit("<span"), F.concat_ws("", *attributes), F.lit(f'{flag} class="{css}" style="'), style, F.lit('">'), _escaped(F.coalesce(content, F.lit(""))), F.lit("</span>"))


def mark_values(mark: str, html: Column) -> Column:
    """struct of the first span's attributes of a mark, null where there is none; the attributes' names without `data-`."""
    names, _, _ = MARKS[mark]
    span = F.regexp_extract(html, f'<span(?=[^>]* {"data-entity" if mark == "entity" else names[0]}=")[^>]*>', 0)

    def value(name: str) -> Column:
        written = F.regexp_extract(span, f' {name}="([^"]*)"', 1)
        return F.when(written != "", _plain(written)).alias(name.removeprefix("data-").replace("-", "_"))

    return F.struct(*[value(name) for name in names])
