"""SentencePiece encoding and decoding by relations: a lattice of substrings, joined to the piece table.

A text becomes words: runs of spaces (written as U+2581) and what follows up to the next. No piece of the table reaches
over such a border (checked when the table is read), so words are encoded on their own; those of BPE models are cut further. Each
different part's substrings, looked up in the piece table by the task that met it, are the edges of its lattice; Spark folds
them with a higher-order aggregate in the same task.

The fold follows the model's kind, and kinds other than these two are refused when the table is read. For unigram models, whose
pieces have log probabilities, it is Viterbi's: position by position, the best way to it. BPE scores give the order of merges
instead, and the best sum of scores is another segmentation than the library's; so there the fold keeps the borders of one
path and removes the one whose two neighbours join into the edge with the best score (the leftmost of equals) until no edge
joins two neighbours. Where no edge has a score that another piece has too, the order in which a lattice's edges can come to be
is known beforehand (`_Merges`), and the fold goes through the edges once, with borders as bits; else it goes step by step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words of more characters go through the library: the fold's work grows with the square of a word.
LATTICE_CHARS = 48
#: Different parts that a task keeps at most, and the rows of a batch, so that what is in memory has a bound.
PARTS, ROWS, PIECE_ROWS = 500_000, 1_000, 5_000
_RANKS = 1 << 20  # ranks and ids are below


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _proto(model):
    from sentencepiece import sentencepiece_model_pb2

    return sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())


class _Places:
    """Values of whole numbers from 0 up, looked up many at a time: open addressing, a probe of all that are not settled at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            some = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[some]], self.values[slot[some]] = keys[left[some]], values[left[some]]
            more = self.keys[slot] != keys[left]
            left, slot = left[more], slot[more] + 1 & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._slots(keys)
        there = self.keys[slot]
        hit = there == keys
        found = np.where(hit, self.values[slot], -1)
        left = np.flatnonzero(~hit & (there >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.last
            there = self.keys[slot]
            hit = there == keys[left]
            found[left[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            left, slot = left[more], slot[more]
        return found


class _Merges:
    """The order of merges, known from the table alone for texts that hold no piece of several characters whose rank another has too.

    What happens inside a span until it is one piece doesn't depend on what is around it: it is what happens to the piece's own
    text. So a piece that its own text doesn't end in never comes to be, and one that does is joined at one place, its `split`.
    A merge of rank r is taken when nothing better is there; what it makes possible with a rank before r contains it and follows at
    once, before the next merge of rank r to the right. So an edge's turn is told by the greatest rank in its history, where the
    last merge of that rank begins, how many merges followed that, and its own rank."""

    def __init__(self, codes: dict[str, int]):
        ranks = Counter(code // _RANKS for piece, code in codes.items() if len(piece) > 1)
        self.trie: list = [{}, _NONE]
        turns, spans, wants, splits = [], [], [], []
        for piece, code in codes.items():
            n = len(piece)
            if not 1 < n <= LATTICE_CHARS:
                continue
            if ranks[code // _RANKS] > 1:
                self._node(piece)[1] = _TIED
                continue
            done = self._history(piece, codes)
            if len(done) < n - 1:
                continue
            greatest = max(rank for rank, _, _ in done)
            last = max(i for i, x in enumerate(done) if x[0] == greatest)
            rank, _, split = done[-1]
            self._node(piece)[1] = len(turns)
            turns.append((greatest << 32) + (done[last][1] << 26) + (n - 2 - last << 20) + rank)
            spans.append((1 << n + 1) - 1)
            wants.append(1 | 1 << split | 1 << n)
            splits.append(1 << split)
        self._flatten()
        self.turns, self.spans, self.wants, self.splits = (np.array(x, np.int64) for x in (turns, spans, wants, splits))

    def _flatten(self) -> None:
        """The trie as tables: (node, character), the node each leads to, and each node's merge."""
        nodes, steps = [self.trie], []
        for n, (below, _) in enumerate(nodes):  # nodes grows meanwhile
            for c, node in below.items():
                steps.append((n << 21 | ord(c), len(nodes)))
                nodes.append(node)
        self.below = _Places(*np.array(steps, np.int64).reshape(-1, 2).T.copy())
        self.ends, self.trie = np.array([x for _, x in nodes], np.int64), None

    def _node(self, piece: str) -> list:
        node = self.trie
        for c in piece:
            node = node[0].setdefault(c, [{}, _NONE])
        return node

    @staticmethod
    def _history(piece: str, codes: dict[str, int]) -> list[tuple[int, int, int]]:
        """The merges (rank, start, border that goes) of a text of its own."""
        at, done = list(range(len(piece) + 1)), []
        while len(at) > 2:
            joins = [(code // _RANKS, i) for i in range(len(at) - 2) if (code := codes.get(piece[at[i] : at[i + 2]])) is not None]
            if not joins:
                break
            rank, i = min(joins)
            done.append((rank, at[i], at.pop(i + 1)))
        return done

    def lattices(self, parts: list[str]) -> pa.ListArray:
        """Each part's edges in the order of their turns: all borders of the span, those there before the merge, and the one that goes.
        Null: the part is too long, or holds a piece whose rank another has too."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text, of = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.arange(len(parts)), sizes)
        first, null = np.cumsum(sizes) - sizes, sizes > LATTICE_CHARS
        start = np.flatnonzero(~null[of])
        at, node, last = start, np.zeros(len(start), np.int64), (first + sizes)[of]
        which, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(start):
            below = self.below.of(node << 21 | text[at])
            on = below >= 0
            start, at, node = start[on], at[on] + 1, below[on]
            merge = self.ends[node]
            which.append(merge[merge >= 0])
            where.append(start[merge >= 0])
            null[of[start[merge == _TIED]]] = True
            on = at < last[start]
            start, at, node = start[on], at[on], node[on]
        which, where = np.concatenate(which), np.concatenate(where)
        known = ~null[of[where]]
        which, part = which[known], of[where[known]]
        start = where[known] - first[part]
        order = np.lexsort((self.turns[which] + (start << 26), part))
        which, start = which[order], start[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(parts)))])
        values = pa.StructArray.from_arrays([pa.array(x[which] << start) for x in (self.spans, self.wants, self.splits)], names=_EDGE.fieldNames())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(null))


_NONE, _TIED = -1, -2  # no piece, or none that comes to be; a piece whose rank another has too
_EDGE = T.StructType([T.StructField(c, T.LongType()) for c in ("span", "want", "split")])


class PieceTable:
    """What the relations need of a model: (piece, code) rows, byte pieces' first id, and each id's bytes. A code is a rank
    (BPE: of the score; unigram: 0) and an id."""

    def __init__(self, path: str):
        model = _model(path)
        proto = _proto(model)
        self.kind = proto.trainer_spec.ModelType.Name(proto.trainer_spec.model_type)
        if self.kind not in ("BPE", "UNIGRAM"):
            raise ValueError("the model is neither of the BPE nor of the unigram kind")
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the model rewrites texts before it cuts them")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(proto.pieces[i].type == proto.pieces[i].USER_DEFINED for i in plain):
            raise ValueError("the model has pieces that come before all others")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        rank = {i: order[model.get_score(i)] if self.kind == "BPE" else 0 for i in plain}
        self.path, self.rows = path, [(model.id_to_piece(i), rank[i] * _RANKS + i) for i in plain]
        self.scores = [model.get_score(i) for i in range(n)]
        #: Fixed value: an unknown character costs 10 more than the worst piece.
        self.unknown = min(model.get_score(i) for i in plain) - 10
        self.longest = max(len(p) for p, _ in self.rows)
        if any(SPACE in p.lstrip(SPACE) for p, _ in self.rows):
            raise ValueError("a piece reaches over a word border")
        octets = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if not octets or octets != {b: octets[0] + b for b in range(256)}:
            raise ValueError("there are no byte pieces, or their ids are not in a row")
        self.first_byte = octets[0]
        self.merges = _Merges(dict(self.rows)) if self.kind == "BPE" else None
        spelt = [b"" for _ in range(n)]
        for i in plain:
            spelt[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in octets.items():
            spelt[i] = bytes([b])
        self.octets = pa.array(spelt, pa.large_binary())


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(path)


def _spelt(word: Column, start: Column, size: Column, first_byte: int) -> Column:
    """The byte pieces of a part of a word."""
    octets = F.hex(F.encode(F.substr(word, start + 1, size), "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(octets), F.lit(2)), lambda k: F.conv(F.substr(octets, k, F.lit(2)), 16, 10).cast("int") + first_byte)


def _viterbi(word: Column, edges: Column, table: PieceTable) -> Column:
    """The ids of a word from its edges (a map from start * 64 + length to code) by the greatest sum of scores; of equal ones, the
    one whose last piece starts first. Sums are single floats, as the library's are. A character that is no piece is an edge
    of its own, spelt in bytes."""
    scores = F.split(F.lit(",".join(map(repr, table.scores))), ",")  # a constant: Spark folds it into one array
    first = F.struct(F.array(F.lit(0.0).cast("float")).alias("best"), F.array().cast("array<struct<start:int,id:int>>").alias("last"))

    def step(state: Column, end: Column) -> Column:
        def way(start: Column) -> Column:
            code = F.try_element_at(edges, (start * 64 + (end - start)).cast("int"))
            score = F.when(code.isNotNull(), F.element_at(scores, (code + 1).cast("int")).cast("float")).when(start == end - 1, F.lit(table.unknown).cast("float"))
            return F.struct((-(F.get(state["best"], start) + score)).alias("cost"), start.cast("int").alias("start"), F.coalesce(code, F.lit(-1)).cast("int").alias("id"))

        ways = F.filter(F.transform(F.sequence(F.greatest(F.lit(0), end - table.longest), end - 1), way), lambda w: w["cost"].isNotNull())

        def best(w: Column) -> Column:
            return F.struct(F.concat(state["best"], F.array(-w["cost"])).alias("best"), F.concat(state["last"], F.array(F.struct(w["start"].alias("start"), w["id"].alias("id")))).alias("last"))

        # transform over one element names the best way, so that it is found once
        return F.element_at(F.transform(F.array(F.array_min(ways)), best), 1)

    def back(last: Column) -> Column:
        def take(state: Column, end: Column) -> Column:
            x = F.element_at(last, end.cast("int"))
            ids = F.when(x["id"] >= 0, F.array(x["id"])).otherwise(_spelt(word, x["start"], end - x["start"], table.first_byte))
            return F.when(end == state["at"], F.struct(x["start"].alias("at"), F.concat(ids, state["ids"]).alias("ids"))).otherwise(state)

        return F.aggregate(F.sequence(F.size(last), F.lit(1)), F.struct(F.size(last).alias("at"), F.array().cast("array<int>").alias("ids")), take)["ids"]

    ways = F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step)["last"]
    return F.element_at(F.transform(F.array(ways), back), 1)


def _merged(word: Column, edges: Column, first_byte: int) -> Column:
    """The ids of a word from its edges (a map from start * 64 + length to code) by merges in the order of their ranks."""
    none = F.lit(1 << 62)

    def code(a: Column, b: Column) -> Column:
        return F.try_element_at(edges, (a * 64 + (b - a)).cast("int"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        joins = F.transform(F.slice(at, 3, F.size(at) - 2), lambda end, i: F.struct(F.floor(F.coalesce(code(at[i], end), none) / _RANKS).alias("rank"), (i + 1).alias("border")))
        best = F.array_min(joins)

        def merged(found: Column) -> Column:
            return F.when(found["rank"] < (1 << 40), F.struct(F.filter(at, lambda x, i: i != found["border"]).alias("at"), F.lit(True).alias("more"))).otherwise(F.struct(at.alias("at"), F.lit(False).alias("more")))

        # transform over one element names the best join, so that it is found once
        return F.when(~state["more"] | (F.size(at) < 3), F.struct(at.alias("at"), F.lit(False).alias("more"))).otherwise(F.element_at(F.transform(F.array(best), merged), 1))

    size = F.length(word)
    start = F.struct(F.sequence(F.lit(0), size).alias("at"), F.lit(True).alias("more"))
    borders = F.aggregate(F.sequence(F.lit(1), size), start, step)["at"]

    def ids(end: Column, i: Column, at: Column) -> Column:
        found = code(at[i], end)
        spelt = _spelt(word, at[i], end - at[i], first_byte)
        return F.when(found.isNotNull(), F.array((found % _RANKS).cast("int"))).otherwise(spelt)

    return F.flatten(F.element_at(F.transform(F.array(borders), lambda at: F.transform(F.slice(at, 2, F.size(at) - 1), lambda end, i: ids(end, i, at))), 1))


def _path(word: Column, edges: Column) -> Column:
    """The borders (bits) that are left of a word's when its edges have had their turns."""
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(word) + 1) - 1
    return F.aggregate(edges, every, lambda at, e: F.when(at.bitwiseAND(e["span"]) == e["want"], at.bitwiseXOR(e["split"])).otherwise(at))


def _along(part: str, path: int, codes: dict[str, int], first_byte: int) -> list[int]:
    """The ids of the pieces between the borders of a path."""
    ids, start = [], 0
    for end in range(1, len(part) + 1):
        if path >> end & 1:
            code = codes.get(part[start:end])
            if code is None:
                ids += [first_byte + b for b in part[start:end].encode()]
            else:
                ids.append(code % _RANKS)
            start = end
    return ids


def _all_along(parts: pa.StringArray, paths: np.ndarray, pieces: pa.StringArray, codes: dict[str, int], first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces between the borders of each part's path, one part after another, and how many each part has."""
    ends, octets = _octets(parts)
    begins = np.append(np.flatnonzero(octets & 0xC0 != 0x80), len(octets))  # of characters
    first = np.searchsorted(begins, ends)
    of = np.repeat(np.arange(len(parts)), np.diff(first))
    last = np.flatnonzero(paths[of] >> np.arange(1, len(of) + 1) - first[of] & 1)  # characters that end a piece
    found = pc.index_in(_strings(np.concatenate([[0], begins[last[:-1] + 1]])[: len(last)], octets), pieces)
    ids = np.array([code % _RANKS for code in codes.values()], np.int32)[found.fill_null(0).to_numpy()]
    sizes = np.bincount(of[last], minlength=len(parts))
    if not found.null_count:
        return ids, sizes
    # Parts with characters that are no piece, which are spelt in bytes.
    odd = np.unique(of[last[found.is_null().to_numpy(zero_copy_only=False)]])
    spelt = [_along(parts[i].as_py(), int(paths[i]), codes, first_byte) for i in odd.tolist()]
    which = np.arange(len(parts))
    which[odd] = len(parts) + np.arange(len(odd))
    sizes = np.concatenate([sizes, np.fromiter(map(len, spelt), np.int64, len(odd))])
    return _spread(np.concatenate([ids, *(np.array(x, np.int32) for x in spelt)]), sizes, which)[0], sizes[which]


class _Parts:
    """The words of texts, cut between characters that are neighbours in no piece (BPE only: there each part is merged by itself, while
    the sums of Viterbi start with the word), each different part once, numbered from 0."""

    def __init__(self, table: PieceTable):
        self.table, self.codes = table, dict(table.rows)
        self.beginnings = {piece[:n] for piece in self.codes for n in range(1, len(piece) + 1)}
        inner = np.array(sorted({ord(a) << 21 | ord(b) for piece in self.codes for a, b in zip(piece, piece[1:])}), np.int64)
        self.inner = _Places(inner, inner)
        self.parts: dict[str, int] = {}
        self.new: list[str] = []

    def _cut(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of words (with blanks for their marks), one after another, and how many each word has."""
        ends, octets = _octets(words)
        begins = np.flatnonzero(octets & 0xC0 != 0x80)  # of characters
        text = np.frombuffer(octets.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        text[text == 32] = ord(SPACE)
        first = np.searchsorted(begins, ends[:-1])
        cut = np.ones(len(text), bool)
        cut[1:] = self.inner.of(text[:-1] << 21 | text[1:]) < 0 if self.table.kind == "BPE" else False
        cut[first] = True
        at = np.flatnonzero(cut)
        long = at[np.diff(at, append=len(text)) > LATTICE_CHARS]
        if len(long):
            # The library takes whole words only: it puts a mark before what it is given.
            word = np.unique(np.searchsorted(first, long, "right") - 1)
            for a, b in zip(first[word], np.append(first, len(text))[word + 1]):
                cut[a + 1 : b] = False
            at = np.flatnonzero(cut)
        return _strings(begins[at], octets), np.diff(np.searchsorted(at, first), append=len(at))

    def _numbered(self, parts: pa.StringArray) -> np.ndarray:
        """The numbers of different parts."""
        known, count = self.parts, len(self.parts)
        names = pc.replace_substring(parts, " ", SPACE).to_pylist()
        numbers = np.fromiter((known.setdefault(name, len(known)) for name in names), np.int32, len(names))
        self.new += [names[i] for i in np.flatnonzero(numbers >= count)]
        return numbers

    def of(self, texts: pa.StringArray) -> pa.ListArray:
        """The numbers of each text's parts."""
        ends, octets = _octets(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", pc.replace_substring(texts, SPACE, " "), "")))
        blank = octets == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        begins = np.flatnonzero(begins)
        words = _strings(begins, octets).dictionary_encode()
        parts, sizes = self._cut(words.dictionary)
        parts = parts.dictionary_encode()
        numbers = self._numbered(parts.dictionary)[parts.indices.to_numpy()]
        places, offsets = _spread(numbers, sizes, words.indices.to_numpy())
        return pa.ListArray.from_arrays(pa.array(offsets[np.searchsorted(begins, ends)], pa.int32()), pa.array(places, pa.int32()))

    def _lattices(self, parts: list[str], done: pa.Array) -> pa.MapArray:
        """Of each part that isn't done the substrings that are pieces: start * 64 + length, and code."""
        spans, codes, ends, get = [], [], [0], self.codes.get
        for part, well in zip(parts, done.is_valid().to_pylist()):
            if well:
                ends.append(len(spans))
                continue
            n = len(part)
            for start in range(n if n <= LATTICE_CHARS else 0):
                for end in range(start + 1, n + 1):
                    piece = part[start:end]
                    if piece not in self.beginnings:
                        break
                    code = get(piece)
                    if code is not None:
                        spans.append(start * 64 + end - start)
                        codes.append(code)
            ends.append(len(spans))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spans, pa.int32()), pa.array(codes, pa.int64()))

    def taken(self) -> pa.RecordBatch:
        """The parts that are new: number, part, its lattice (substrings joined to the piece table) with edges in the order of their turns
        or, if that isn't known, in any; and the library's ids of long ones."""
        first, parts = len(self.parts) - len(self.new), self.new
        ids = [_model(self.table.path).encode(x[1:].replace(SPACE, " ")) if len(x) > LATTICE_CHARS else None for x in parts]
        turns = self.table.merges.lattices(parts) if self.table.merges else pa.nulls(len(parts), pa.list_(pa.struct([(c, pa.int64()) for c in _EDGE.fieldNames()])))
        columns = [pa.array(range(first, first + len(parts)), pa.int32()), pa.array(parts, pa.string()), turns, self._lattices(parts, turns), pa.array(ids, pa.list_(pa.int32()))]
        self.new = []
        return pa.RecordBatch.from_arrays(columns, names=["number", "part", "turns", "edges", "known"])


def _octets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends (from 0) in the bytes of all, and these."""
    _, ends, octets = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    octets = np.frombuffer(octets, np.uint8)[ends[0] : ends[-1]] if octets else np.zeros(0, np.uint8)
    return ends - ends[0], octets


def _strings(begins: np.ndarray, octets: np.ndarray) -> pa.StringArray:
    """The strings that bytes hold, one from each place to the next."""
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(octets)).astype(np.int32)), pa.py_buffer(octets))


def _spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists (laid end to end in flat) of the given numbers, one after another, and where each begins and the last ends."""
    starts, size = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(starts[which] - ends[:-1], size) + np.arange(ends[-1])], ends


def _free(name: str, columns: list[str]) -> str:
    """The name, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def encode(rows: DataFrame, text: str, path: str, read: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, returns: T.StructType | None = None) -> DataFrame:
    """rows with `ids`: the library's ids of the text column. A null or empty text has no ids; rows stay as many as they are; a
    column `ids` of rows is replaced. With `read`, the result is what it makes (of schema `returns`) of each batch of these rows, in the task that has it.

    Nothing is shuffled or stored. A task sends each batch of rows after the parts that are new in it, with their lattices; Spark
    folds those rows; and what reads them next, in the same order, puts the ids of the parts in the place of their numbers."""
    table = _table(path)
    kept = [c for c in rows.columns if c.lower() != "ids"]
    own = ["__text", "__numbers", "__number", "__part", "__turns", "__edges", "__known", "__path"]
    own = [_free(c, rows.columns) for c in own]
    text_, numbers_, number_, part_, turns_, edges_, known_, path_ = own
    sent = rows.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text_))
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in sent.schema.fields[:-1]])
    schema = T.StructType(loose.fields + [
        T.StructField(numbers_, T.ArrayType(T.IntegerType())), T.StructField(number_, T.IntegerType()), T.StructField(part_, T.StringType()),
        T.StructField(turns_, T.ArrayType(_EDGE)), T.StructField(edges_, T.MapType(T.IntegerType(), T.LongType())), T.StructField(known_, T.ArrayType(T.IntegerType())),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(table)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if len(parts.parts) > PARTS:
                    parts = _Parts(table)
                numbers = parts.of(batch.column(batch.num_columns - 1))
                new, columns = parts.taken(), batch.columns[:-1]
                for part in (new.slice(i, PIECE_ROWS) for i in range(0, new.num_rows, PIECE_ROWS)):
                    n = part.num_rows
                    none = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.nulls(0, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, c.type) for c in columns] + [none, *part.columns], names=schema.names)
                yield pa.RecordBatch.from_arrays([*columns, numbers, *[pa.nulls(batch.num_rows, c.type) for c in new.columns]], names=schema.names)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = dict(table.rows)
        pieces = pa.array(codes, pa.string())
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for batch in batches:
            columns, (asked, numbers, part, path, ids) = batch.columns[:-5], batch.columns[-5:]
            number, is_part = numbers.to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(np.diff(is_part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if a == b:
                    continue
                if is_part[a]:
                    first = np.flatnonzero(number[a:b] == 0)
                    if len(first):  # numbers begin anew; nothing before is asked for again
                        a, flat, sizes = a + int(first[-1]), [], []
                    some, way = ids.slice(a, b - a), path.slice(a, b - a)
                    walked = way.is_valid()
                    values, counts = _all_along(part.slice(a, b - a).filter(walked), way.drop_null().to_numpy(), pieces, codes, table.first_byte)
                    if way.null_count:
                        some = some.filter(way.is_null())
                        values, counts = np.concatenate([values, some.flatten().to_numpy()]), np.concatenate([counts, pc.list_value_length(some).to_numpy()])
                        which = np.argsort(np.argsort(~walked.to_numpy(zero_copy_only=False), kind="stable"))
                        values, counts = _spread(values, counts, which)[0], counts[which]
                    flat.append(values)
                    sizes.append(counts.astype(np.int64))
                    continue
                flat, sizes = [np.concatenate(flat)], [np.concatenate(sizes)]
                rows_ = asked.slice(a, b - a)
                values, ends = _spread(flat[0], sizes[0], rows_.flatten().to_numpy(zero_copy_only=False))
                offsets = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(rows_).to_numpy(zero_copy_only=False))])]
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                done = pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in columns], out], names=[*loose.names, "ids"])
                yield read(done) if read else done

    part, edges, turns = F.col(part_), F.col(edges_), F.col(turns_)
    fold = _viterbi(part, edges, table) if table.kind == "UNIGRAM" else _merged(part, edges, table.first_byte)
    path = F.when(turns.isNotNull(), _path(part, turns))
    # Lists are empty, not null, in the rows that have none: Spark asks for a batch's size at each row, and that walks over all null lists since the last other one.
    ids = F.when(F.col(number_).isNotNull() & turns.isNull(), F.coalesce(known_, fold)).otherwise(F.array().cast("array<int>"))
    folded = sent.mapInArrow(cut, schema).select(*kept, numbers_, number_, part_, path.alias(path_), ids.alias(known_))
    return folded.mapInArrow(put, returns or T.StructType([*loose.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def joined(ids: pa.ListArray, spelt: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """What the ids of each list are spelt as, joined; no list is null."""
    whole = spelt.take(ids.flatten())
    begins = np.frombuffer(whole.buffers()[1], np.int64) if len(whole) else np.zeros(1, np.int64)
    ends = begins[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), whole.buffers()[2]])


def decoded(ids: pa.ListArray, octets: pa.LargeBinaryArray) -> pa.StringArray:
    """The text of each list of ids; octets: the bytes of each id."""
    texts = joined(ids.fill_null([]) if ids.null_count else ids, octets)
    try:
        texts = texts.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
    texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
    return pc.if_else(ids.is_valid(), texts, None) if ids.null_count else texts


def piece_octets(path: str) -> pa.LargeBinaryArray:
    return _table(path).octets


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; byte pieces that are no UTF-8 together give the replacement character."""
    octets = piece_octets(path)

    def texts(ids: pa.Array) -> pa.Array:
        return decoded(ids, octets)

    return F.arrow_udf(texts, "string")(ids)
