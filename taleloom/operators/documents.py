"""Rich JSON documents: one walk of the tree gives the three flat texts and what marks and nodes say.

A tree of any depth has no fixed schema, so this is the one reader that runs in Python: in Arrow batches, whole
documents, no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = pa.struct([("kind", pa.string()), ("label", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
LISTS = ("tags", "mentions", "links", "wikilinks", "backlinks")
SCHEMA = "id string, text string, context_text string, link_text string, texts array<string>, entities array<struct<kind:string,label:string,attributes:map<string,string>>>, " + ", ".join(f"{n} array<string>" for n in LISTS)


def _children(node: dict) -> list:
    c = node.get("content")
    return c if isinstance(c, list) else []


def _walk(root, join) -> str:
    """Post-order without recursion: join(node, its children's texts) gives a node's text."""
    done: list[list[str]] = [[]]
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            parts = done.pop()
            done[-1].append(join(node, parts))
            continue
        if not isinstance(node, dict):
            done[-1].append("")
            continue
        stack.append((node, True))
        done.append([])
        stack.extend((x, False) for x in reversed(_children(node)))
    return done[0][0]


def _analytics_text(node: dict, parts: list[str]) -> str:
    if isinstance(node.get("text"), str) and node["text"]:
        return node["text"]
    end = {"paragraph": "\n\n", "heading": "\n\n", "listItem": "\n"}.get(node.get("type"), "")
    return "".join(parts) + (end if isinstance(node.get("content"), list) else "")


def _spaced_text(node: dict, parts: list[str]) -> str:
    return node["text"] if isinstance(node.get("text"), str) and node["text"] else " ".join(parts)


def _typed_text(node: dict, parts: list[str]) -> str:
    return node["text"] if node.get("type") == "text" and isinstance(node.get("text"), str) and node["text"] else " ".join(parts)


def read(content: str | None) -> tuple:
    """(text, context_text, link_text, texts, entities, tags, mentions, links, wikilinks, backlinks) of one document."""
    lists: dict[str, list] = {n: [] for n in LISTS}
    if not content:
        return ("", "", "", [], [], *lists.values())
    try:
        root = json.loads(content)
    except (ValueError, RecursionError):
        return (content, "", content, [], [], *lists.values())
    texts, entities, stack = [], [], list(reversed(_children(root))) if isinstance(root, dict) else []
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        for mark in node.get("marks") or []:
            attrs = (mark or {}).get("attrs") or {}
            kind = (mark or {}).get("type")
            if kind == "entity" and attrs.get("kind") and attrs.get("label"):
                given = attrs.get("attributes")
                entities.append({"kind": attrs["kind"], "label": attrs["label"], "attributes": [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in given.items()] if isinstance(given, dict) else None})
            for what, name, key in (("tag", "tags", "tag"), ("mention", "mentions", "id"), ("link", "links", "href")):
                if kind == what and attrs.get(key):
                    lists[name].append(str(attrs[key]))
        for what, name in (("wikilink", "wikilinks"), ("backlink", "backlinks")):
            if node.get("type") == what and (node.get("attrs") or {}).get("title"):
                lists[name].append(str(node["attrs"]["title"]))
        if isinstance(node.get("text"), str) and node["text"]:
            texts.append(node["text"])
        stack.extend(reversed(_children(node)))
    lists = {n: list(dict.fromkeys(v)) for n, v in lists.items()}
    return (_walk(root, _analytics_text).strip(), _walk(root, _spaced_text), _walk(root, _typed_text), texts, entities, *lists.values())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "text", "context_text", "link_text", "texts", "entities", *LISTS]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(ENTITY), *[pa.list_(pa.string())] * len(LISTS)]
    for batch in batches:
        rows = [read(x.as_py()) for x in batch.column(1)]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def walked(notes: DataFrame, content: str = "content") -> DataFrame:
    """One row per note: text (for statistics: blocks end in line breaks), context_text and link_text (children joined by spaces at every
    level; the latter from text nodes only), texts (the text nodes in order), and what marks and nodes hold. Content that is no JSON is its own
    text; JSON that is no object has none; a null or empty one neither."""
    return notes.select(F.col("id").cast("string").alias("id"), F.col(content).cast("string").alias("content")).mapInArrow(_read, SCHEMA)
