"""BPE encoding and decoding by a table-driven automaton that is compiled from the merges.

The automaton's arcs are labelled with tokens. It starts as one state with an
arc for every byte. Each merge (a, b) -> c, in order of rank, adds a gadget: the
state that arcs labelled ``a`` lead to is copied, the copy loses its ``b`` arc,
all ``a`` arcs lead to the copy, and wherever ``a`` could be followed by ``b``
an arc ``c`` now leads to where ``b`` led. After the last merge the automaton
accepts, for any string of bytes, exactly one string of tokens: the one that
applying the merges in order gives.

All arcs with one label lead to one state, so states are numbered by label. A
copy shares what it doesn't change, so the compiled form has one entry for each
merge, in flat integer arrays:

* ``left``, ``right``, ``born``: the two arcs that an arc stands for, and when;
* ``lost``: (state, arc) -> when the state lost the arc;
* ``arcs``: the arcs' labels as a trie, (node, byte) -> node, and ``ends``, the arc that ends at a node.

``follows`` is the transition function: the state of ``a`` has an arc ``b`` if no
copy on the way lost an arc that ``b`` grew from.

The accepting path over a prefix of a word ends in one arc, whatever follows. So
a word is read once, from left to right, without stepping back: at each place
the arcs that leave the state there are found in the tables, and each writes
itself down at the place where it ends. The path is then read off from the end.
The distinct words of many texts are read side by side, one place of all of them
at a time; a very long word is read on its own, place by place.

Ids decode to the bytes on the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import added, release, table

#: The split pattern of byte-level tokenizers of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text where this is found is split as a whole; others fall apart before each space.
ODD_SPACE = re.compile(r" \s| \Z").search
#: Longer words (in bytes) are read on their own, in runs of so many places.
LONG, PLACES = 256, 1 << 16
#: Characters that are worked off at a time, characters of a text's segments, and words that a worker remembers.
GROUP, SEGMENT, KNOWN = 1 << 21, 1 << 20, 1 << 18
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """A fixed map of whole numbers to whole numbers in two flat arrays (open addressing); -1 where there is no entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            left, at = left[go], at[go]
        return out


class Automaton:
    """The compiled automaton of a list of merges, over the labels (bytes) of all ids."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.width = np.array([len(x or b"") for x in labels], np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.born = np.full(n, NEVER, np.int64)
        for i, x in enumerate(labels):
            if x is not None and len(x) == 1:
                self.born[i] = -1
        lost: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(merges):  # the gadgets, in order
            lost.setdefault(a << 32 | b, rank)
            if self.born[c] == NEVER:  # a second way to spell a token adds no arc
                self.born[c], self.left[c], self.right[c] = rank, a, b
        self.lost = Table(np.fromiter(lost, np.int64, len(lost)), np.fromiter(lost.values(), np.int64, len(lost)))
        self.arcs, self.ends = self._trie([(labels[i], i) for i in np.flatnonzero(self._sound()).tolist()])
        self.first = self.arcs.get(np.arange(256, dtype=np.int64))
        if (self.first < 0).any() or (self.ends[self.first] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self._plain: tuple | None = None

    def _sound(self) -> np.ndarray:
        """Which arcs the first state has: those made of two arcs that could follow each other when they were merged."""
        sound = self.born == -1
        made = np.flatnonzero((self.born >= 0) & (self.born < NEVER))
        made = made[np.argsort(self.born[made])]
        joins = self.follows(self.left[made], self.right[made], self.born[made])
        for c, ok in zip(made.tolist(), joins.tolist(), strict=True):
            sound[c] = ok and sound[self.left[c]] and sound[self.right[c]]
        return sound

    @staticmethod
    def _trie(labels: list[tuple[bytes, int]]) -> tuple[Table, np.ndarray]:
        nodes: dict[int, int] = {}
        ends = [-1]
        for label, i in labels:
            at = 0
            for byte in label:
                key = at << 8 | byte
                if (to := nodes.get(key)) is None:
                    to = nodes[key] = len(ends)
                    ends.append(-1)
                at = to
            ends[at] = i
        return Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))), np.array(ends, np.int64)

    def follows(self, state: np.ndarray, arc: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the states of labels ``state`` have arcs ``arc`` (as it was before the merges of rank ``until``).

        Goes back in time: whichever of the two is younger is undone, into what stood
        at the border before it was made, unless the older pair was lost before that.
        """
        out = np.ones(len(state), bool)
        at, a, b = np.arange(len(state)), state, arc
        limit = np.full(len(state), NEVER, np.int64) if until is None else until
        while len(at):
            when = self.lost.get(a << 32 | b)
            gone = (when >= 0) & (when < limit)
            out[at[gone]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~gone & ((born_a >= 0) | (born_b >= 0))
            at, a, b, born_a, born_b, limit = at[go], a[go], b[go], born_a[go], born_b[go], limit[go]
            newer = born_a > born_b
            # a loss in the merge that made the arc comes before the arc; the state before its own merge is another
            limit = np.minimum(limit, np.where(newer, born_a, born_b + 1))
            a, b = np.where(newer, self.right[a], a), np.where(newer, b, self.left[b])
        return out

    def fitting(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, arc) of all arcs whose bytes stand at ``starts``, none beyond ``stops``."""
        at, node, size = np.arange(len(starts)), self.first[data[starts]].astype(np.int64), 1
        found, labels = [at[:0]], [at[:0]]
        while len(at):
            arc = self.ends[node]
            ends = arc >= 0
            found.append(at[ends])
            labels.append(arc[ends])
            more = starts[at] + size < stops[at]
            at, node = at[more], node[more]
            node = self.arcs.get(node << 8 | data[starts[at] + size]).astype(np.int64)
            at, node, size = at[node >= 0], node[node >= 0], size + 1
        return np.concatenate(found), np.concatenate(labels)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, offsets into them) of words, given as bytes and offsets; empty words have none."""
        begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        size, data = end - begin, data.astype(np.int64)
        ends = np.full(len(data) + 1, -1, np.int64)  # the labels of the paths, where they end
        short = np.flatnonzero((size > 0) & (size <= LONG))
        at, arc = self.fitting(data, begin[short], end[short])
        whole = self.width[arc] == size[short[at]]  # words that are one arc of the first state
        ends[end[short[at[whole]]]] = arc[whole]
        rest = np.ones(len(short), bool)
        rest[at[whole]] = False
        self._side_by_side(data, begin[short[rest]], end[short[rest]], ends)
        for w in np.flatnonzero(size > LONG).tolist():
            self._alone(data[begin[w] : end[w]], ends[begin[w] : end[w] + 1])
        places = np.flatnonzero(ends >= 0)
        return ends[places], np.searchsorted(places, offsets, "right")

    def _side_by_side(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        if not len(begin):
            return
        size = end - begin
        within = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int16)
        starts = np.repeat(begin, size) + within
        at, arc = self.fitting(data, starts, np.repeat(end, size))
        turn = within[at]
        order = np.argsort(turn, kind="stable")
        starts, arc = starts[at[order]], arc[order]
        stops = starts + self.width[arc]
        bounds = np.cumsum(np.bincount(turn)).tolist()
        last = np.full(len(out), -1, np.int64)  # the arc that the path over a prefix ends in, where it ends
        last[stops[: bounds[0]]] = arc[: bounds[0]]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ok = self.follows(last[starts[a:b]], arc[a:b])
            last[stops[a:b][ok]] = arc[a:b][ok]
        while len(end):
            label = last[end]
            out[end] = label
            end = end - self.width[label]
            go = end > begin
            begin, end = begin[go], end[go]

    def _alone(self, data: np.ndarray, out: np.ndarray) -> None:
        n, width = len(data), self.width.tolist()
        last = [-1] * (n + 1)
        held = [np.zeros(0, np.int64)] * 2  # arcs that end beyond the places read so far: (end, arc)
        for a in range(0, n, PLACES):
            upto = min(n, a + PLACES)
            at, arc = self.fitting(data, np.arange(a, upto), np.full(upto - a, n))
            end, arc = np.concatenate([held[0], at + a + self.width[arc]]), np.concatenate([held[1], arc])
            order = np.lexsort((-self.width[arc], end))
            end, arc = end[order], arc[order]
            k = int(np.searchsorted(end, upto, "right"))
            held = [end[k:], arc[k:]]
            for e, t in zip(end[:k].tolist(), arc[:k].tolist(), strict=True):
                if last[e] < 0 and ((b := e - width[t]) == 0 or (last[b] >= 0 and self._follows_one(last[b], t))):
                    last[e] = t
        at = n
        while at:
            out[at] = last[at]
            at -= width[last[at]]

    def _follows_one(self, a: int, b: int) -> bool:
        """As ``follows``, for a single pair."""
        if self._plain is None:
            self._plain = {k: v for k, v in zip(self.lost.keys.tolist(), self.lost.values.tolist(), strict=True) if k >= 0}, self.born.tolist(), self.left.tolist(), self.right.tolist()
        lost, born, left, right = self._plain
        limit = NEVER
        while lost.get(a << 32 | b, NEVER) >= limit:
            if born[a] > born[b]:
                limit, a = min(limit, born[a]), right[a]
            elif born[b] >= 0:
                limit, b = min(limit, born[b] + 1), left[b]
            else:
                return True
        return False


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``codes`` name, one after the other, and their offsets."""
    size = offsets[codes + 1] - offsets[codes]
    out = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(offsets[codes] - out[:-1], size) + np.arange(out[-1])], out


class Tokenizer:
    """Encodes and decodes whole texts; added tokens are cut out first, then words are split by ``SPLIT``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels: list[bytes | None] = [None] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        for token, i in self.added.items():
            labels[i] = None
        self.machine = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        for token, i in self.added.items():
            labels[i] = token.encode()
        self.labels = pa.array([x or b"" for x in labels], pa.binary())
        self.shown = pa.array([str(i) for i in range(len(labels))], pa.string())
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(SPLIT).findall
        self.forget()

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """(part, id or -1) of a text: added tokens with their id, and what lies between, cut before a space where it is very long."""
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
        for part in parts:
            if part in self.added:
                yield part, self.added[part]
                continue
            at = 0
            while len(part) - at > SEGMENT:
                to = at + SEGMENT
                while (to := part.find(" ", to)) >= 0 and (to + 1 == len(part) or part[to + 1].isspace()):
                    to += 1
                if to < 0:
                    break
                yield part[at:to], -1
                at = to
            if at < len(part):
                yield part[at:], -1

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(labels, offsets into them) of the words that are remembered, and which of them ``words`` are."""
        if len(self.index) > KNOWN or len(self.flat) > 8 * KNOWN:
            self.forget()
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            held = pa.array(new, pa.string()).buffers()
            labels, upto = self.machine.read(np.frombuffer(held[2], np.uint8), np.frombuffer(held[1], np.int32, len(new) + 1))
            self.upto = np.concatenate([self.upto, upto[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, labels.astype(np.int32)])
        return self.flat, self.upto, np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.upto = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(labels, offsets into them) of distinct pieces of texts, and (pieces, offsets into them) of the texts."""
        odd = [ODD_SPACE(x) is not None for x in parts]
        # A single space belongs to what follows it, so most texts fall apart before each: distinct ends are split once.
        even = pa.array([x for x, o in zip(parts, odd, strict=True) if not o], pa.string())
        ends = pc.split_pattern(even, " ")
        codes = ends.flatten().dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        codes = codes.indices.to_numpy().astype(np.int64)
        starts = ends.offsets.to_numpy().astype(np.int64)
        firsts = [distinct[c] for c in codes[starts[:-1]].tolist()]
        codes[starts[:-1]] = len(distinct) + np.arange(len(firsts))  # the first has no space before it
        # what is empty or begins with white space came first in its text, and would run into what stands before it here
        plain = [x if x and not x[0].isspace() else "x" for x in distinct]
        words = self.words("".join([" " + x for x in plain]))
        upto = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        per_piece = np.bincount(np.searchsorted(upto, np.cumsum(size) - size, "right"), minlength=len(distinct)).tolist()
        for x in firsts:
            got = self.words(x)
            words += got
            per_piece.append(len(got))
        sequences, at = [], 0
        for k, o in enumerate(odd):
            if o:
                got = self.words(parts[k])
                sequences.append(np.arange(len(per_piece), len(per_piece) + len(got)))
                words += got
                per_piece += [1] * len(got)
            else:
                sequences.append(codes[starts[at] : starts[at + 1]])
                at += 1
        flat, word_ends = gather(*self.read(words))
        piece_ends = word_ends[np.concatenate([[0], np.cumsum(per_piece)]).astype(np.int64)]
        return flat, piece_ends, np.concatenate(sequences) if sequences else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)

    def groups(self, texts: Iterable[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """(number of the text, parts, ids or -1) of segments, some ``GROUP`` characters at a time."""
        row, part, fixed, size = [], [], [], 0
        for k, text in enumerate(texts):
            for x, i in self.segments(text):
                row.append(k)
                part.append(x)
                fixed.append(i)
                size += len(x)
                if size >= GROUP:
                    yield row, part, fixed
                    row, part, fixed, size = [], [], [], 0
        if row:
            yield row, part, fixed

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for row, part, fixed in self.groups(texts):
            flat, ends, sequence, bounds = self.pieces([x if i < 0 else "" for x, i in zip(part, fixed, strict=True)])
            for k, (r, i) in enumerate(zip(row, fixed, strict=True)):
                out[r].append(np.array([i]) if i >= 0 else gather(flat, ends, sequence[bounds[k] : bounds[k + 1]])[0])
        return [np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32) for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text on the arcs; bytes that are no UTF-8 give the replacement character."""
        return b"".join(self.labels.take(pa.array(ids, pa.int64())).to_pylist()).decode("utf-8", "replace")

    def digest(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of every text: number of ids, SHA-256 of the decimal ids joined by commas, and of the text that they decode to."""
        counts = [0] * len(texts)
        shown, back = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for row, part, fixed in self.groups(texts):
            flat, ends, sequence, bounds = self.pieces([x if i < 0 else "" for x, i in zip(part, fixed, strict=True)])
            size = np.concatenate([[0], np.cumsum((ends[1:] - ends[:-1])[sequence])])[bounds]
            size = (size[1:] - size[:-1]).tolist()
            lists = lambda of: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of.take(pa.array(flat)))
            whole = lambda pieces, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces.take(pa.array(sequence))), by)
            full = pc.equal(pa.array(ends[1:] - ends[:-1]), 0).to_numpy(zero_copy_only=False)
            if full[sequence].any():  # a text that begins with a space has an empty first piece: it has no comma either
                keep = ~full[sequence]
                held = np.concatenate([[0], np.cumsum(keep)])[bounds]
                sequence, bounds = sequence[keep], held
            ids = whole(pc.binary_join(lists(self.shown), ","), ",")
            text = whole(pc.binary_join(lists(self.labels), b""), b"")
            for k, (r, i) in enumerate(zip(row, fixed, strict=True)):
                n, a, b = (1, str(i).encode(), self.labels[i].as_py()) if i >= 0 else (size[k], ids[k].as_buffer(), text[k].as_buffer())
                if n:
                    if counts[r]:
                        shown[r].update(b",")
                    shown[r].update(a)
                    back[r].update(b)
                counts[r] += n
        return counts, [x.hexdigest() for x in shown], [x.hexdigest() for x in back]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) to every row: the whole text's tokens. Null texts count as empty and have no ids.

    Any column named ``ids`` is replaced; all others and all rows, repeated ones too, stay.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(tokenizer(path).encode_all([x or "" for x in texts.to_pylist()]), pa.list_(pa.int32()))]

    return added(docs, "ids array<int>", make, [text])


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of an array of ids. Null arrays give null. Any column named ``decoded`` is replaced."""

    def make(lists: pa.Array) -> list[pa.Array]:
        return [pa.array([tokenizer(path).decode(x.as_py()) if x.is_valid else None for x in lists], pa.string())]

    return added(rows, "decoded string", make, [ids])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row: encode and decode in one pass, ids not kept.

    Null texts count as empty, and the empty text has no token. Rows that repeat give
    equal rows, an empty table none; other columns are not looked at. A text's parts
    of some ``SEGMENT`` characters are worked off one after the other, so memory
    beyond the text itself is bounded unless a single word is very long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        try:
            for b in batches:
                counts, shown, back = t.digest(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # Spark keeps its workers: the words are forgotten, the tables (some MB) stay
            t.forget()
            release()

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
