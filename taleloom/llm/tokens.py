"""Byte-level BPE ids of whole texts, with a cache of words.

The vocabulary's pre-tokenizer never joins a non-space to the space that follows it, so a text may be cut before
every space that follows a non-space, and each part encoded on its own. Words repeat, so parts are looked up; new ones
go through the tokenizer.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

#: Words kept at once; the older half goes when they are more.
CACHE_WORDS = 300_000
#: Parts above this are encoded without being kept.
CACHE_CHARS = 40

#: Fixed value: the pre-tokenizer's pattern of a byte-level vocabulary of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_JOINT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s ")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary of a tokenizers file, run by tiktoken, which is quicker on single words. In a byte-level
    vocabulary whose ids count the merges the ids are the ranks. With it a pattern of the file's special strings (or None) and
    the file's own tokenizer, which takes the texts that hold one."""
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    octet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(octet[c] for c in word): rank for word, rank in model["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, re.compile("|".join(map(re.escape, sorted(special)))) if special else None, tokenizers.Tokenizer.from_file(path)


class TextEncoder:
    """ids(text): little-endian 32-bit ids, as bytes."""

    def __init__(self, path: str):
        fast, self.special, self.own = _encoding(path)
        self.encode = fast.encode_ordinary
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()
        if _RUN.search(text):
            parts = _JOINT.split(text)
        else:
            head, *rest = text.split(" ")
            parts = [f" {x}" for x in rest]
            if head:
                parts.insert(0, head)
        get = self.new.get
        found = [get(x) for x in parts]
        if None in found:
            old = self.old
            for i, x in enumerate(found):
                if x is None:
                    word = parts[i]
                    x = self.new.get(word) or old.get(word) or array("I", self.encode(word)).tobytes()
                    if len(word) <= CACHE_CHARS:
                        self.new[word] = x
                    found[i] = x
            if len(self.new) > CACHE_WORDS:
                self.old, self.new = self.new, {}
        return b"".join(found)
