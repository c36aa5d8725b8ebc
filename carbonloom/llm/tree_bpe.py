"""Operator 2: byte-pair encoding by tree concatenation, and decoding.

A text is cut into halves until the parts are short. Parts are encoded by themselves; then, from the leaves
up, a window around each join is encoded anew and grown until its tokens agree with the left part's on one side
and with the right part's on the other. What lies between replaces the tokens at the join. Two tokens in a
row must agree, with their places: a sequence of tokens is the encoding of its text if each pair of neighbours is, so
that the joined sequence is exact. Texts divide at ASCII white space into units, which no token crosses (checked
when a tokenizer is loaded); leaves look the units up, windows go through the tokenizer as they stand. Windows count units
first and, within a long unit (no white space for hundreds of characters), tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carbonloom.llm.common import binary_lists, map_batches, slices, trim

#: Characters of a leaf of the tree, of a unit that is encoded at once, and of a part that is a row of its own.
LEAF, UNIT, PART = 4096, 256, 32768

#: Two hashes of a long text.
KEY = ["text_k1", "text_k2"]

Tokens = list[tuple[int, int, int]]  # (id, start, end) in characters


class Encoder(dict):
    """Ids of units, as little-endian unsigned 32-bit integers, by their UTF-8 bytes; bounded, for one Python worker."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = np.array([(self.tokenizer.id_to_token(k) or "").encode() for k in range(size)], dtype=object)
        self.check(path)

    def check(self, path: str) -> None:
        """Refuse a tokenizer whose tokens cross ASCII white space or depend on it."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        units = ["a", "word", "1", "don't", "é", "\u0301", "中", "!", "#x", "'s", "<|", "ZZ9"]
        apart = {u: ids(u) for u in units}
        for space in sorted(_SPACE):
            for a in units:
                for b in units:
                    if ids(f"{a}{space}{b}") != apart[a] + apart[b] or ids(f"{space}{a}{space}") != apart[a]:
                        raise ValueError(f"{path}: white space {space!r} between {a!r} and {b!r} is not a border of tokens")
        if any(name.strip() != name or len(name.split()) > 1 for name in self.names):
            raise ValueError(f"{path}: a token holds white space")

    def __missing__(self, unit: bytes) -> bytes:
        text = unit.decode("utf-8", "replace")
        ids = [k for k, _, _ in self.tokens(text)] if len(text) > UNIT else self.tokenizer.encode(text, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(unit) <= 4 * UNIT:
            self[unit] = out
        return out

    def learn(self, texts: list[bytes]) -> None:
        """Encode all short units of the texts that are not known yet, many in one call, parted by a special token."""
        mark = "<|startoftext|>"
        sep = self.tokenizer.token_to_id(mark)
        new = {u for x in texts for u in x.split()}.difference(self)
        new = [] if sep is None else [u for u in new if len(u) <= UNIT and b"<|" not in u]
        if len(self) + len(new) > self.most:
            keep = {u for x in texts for u in x.split()}
            for u in [u for u in self if u not in keep]:
                del self[u]
        groups = [new[k : k + 64] for k in range(0, len(new), 64)]
        for start in range(0, len(groups), 64):
            some = groups[start : start + 64]
            found = self.tokenizer.encode_batch_fast([mark.join(u.decode() for u in g) for g in some], add_special_tokens=False)
            for g, f in zip(some, found, strict=True):
                ids = np.array(f.ids, "<u4")
                edges = [-1, *np.flatnonzero(ids == sep).tolist(), len(ids)]
                data = ids.tobytes()
                self.update((u, data[4 * a + 4 : 4 * b]) for u, a, b in zip(g, edges[:-1], edges[1:], strict=True))

    def nodes(self, texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
        """Ids of the units of each text; units are learnt for about `most` bytes of texts at once, so that they fit."""
        some, size = [], 0
        for k, x in enumerate(texts):
            some.append(x)
            size += len(x)
            if size >= most or k + 1 == len(texts):
                self.learn(some)
                for t in (y.decode("utf-8", "replace") for y in some):
                    yield self.node(t, 0, len(t))
                some, size = [], 0

    # tokens within a unit

    def plain(self, text: str) -> Tokens:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return [(k, a, b) for k, (a, b) in zip(found.ids, found.offsets, strict=True)]

    def tokens(self, text: str) -> Tokens:
        """Tokens of a text of any length, by halves."""
        if len(text) <= UNIT:
            return self.plain(text)
        nodes = [(a, self.plain(text[a : a + UNIT])) for a in range(0, len(text), UNIT)]
        nodes = [(a, [(k, a + s, a + e) for k, s, e in t]) for a, t in nodes]
        while len(nodes) > 1:
            nodes = [(nodes[k][0], self.joined(text, nodes[k][1], nodes[k + 1][1], nodes[k][0], nodes[k + 1][0], nodes[k + 2][0] if k + 2 < len(nodes) else len(text))) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0][1]

    def joined(self, text: str, left: Tokens, right: Tokens, first: int, cut: int, last: int) -> Tokens:
        """Tokens of text[first:last] from those of text[first:cut] and text[cut:last]."""
        width = 8
        while True:
            a = left[-width][1] if width < len(left) else first
            b = right[width - 1][2] if width < len(right) else last
            window = [(k, a + s, a + e) for k, s, e in self.plain(text[a:b])]
            at = {t: k for k, t in enumerate(left)}
            i = 0 if a == first else next((k for k in range(len(window) - 1) if window[k + 1][2] < cut and (p := at.get(window[k])) is not None and p + 1 < len(left) and left[p + 1] == window[k + 1]), None)
            at = {t: k for k, t in enumerate(right[: 2 * width])}
            j = len(window) if b == last else next((k for k in range(len(window) - 1, 0, -1) if window[k - 1][1] >= cut and (p := at.get(window[k])) and right[p - 1] == window[k - 1]), None)
            if i is not None and j is not None:
                head = left[: left.index(window[i])] if a > first else []
                tail = right[at[window[j]] :] if b < last else []
                return head + window[i:j] + tail
            width *= 2

    # units within a text

    def units(self, text: str) -> list[bytes]:
        return [self[u] for u in text.encode("utf-8", "replace").split()]

    def node(self, text: str, first: int, last: int) -> list[bytes]:
        """Ids of the units of text[first:last], by halves."""
        if last - first <= LEAF:
            return self.units(text[first:last])
        cut = (first + last) // 2
        return self.united(text, self.node(text, first, cut), self.node(text, cut, last), first, cut, last)

    def united(self, text: str, left: list[bytes], right: list[bytes], first: int, cut: int, last: int) -> list[bytes]:
        """The window grows by characters to both sides until it holds whole units there that agree with the parts'."""
        reach = 32
        while True:
            a, b = max(first, cut - reach), min(last, cut + reach)
            lead, trail = _whole_from(text, a, cut) if a > first else a, _whole_to(text, b, cut) if b < last else b
            if lead is not None and trail is not None:
                window = self.window(text[lead:trail])
                before, after = len(text[lead:cut].encode("utf-8", "replace").split()), len(text[cut:trail].encode("utf-8", "replace").split())
                # all units but the one at the join agree with the part's
                same_left = lead == first or (before > 1 and window[: before - 1] == left[len(left) - before : -1])
                same_right = trail == last or (after > 1 and window[len(window) - after + 1 :] == right[1:after])
                if same_left and same_right:
                    return left[: len(left) - before] + window + right[after:]
            reach *= 2

    def window(self, text: str) -> list[bytes]:
        """Ids of the units of a text, through the tokenizer as a whole."""
        if len(text) > 8 * UNIT:  # a long unit lies in it
            return self.units(text)
        ends = [m.end() for m in _UNIT.finditer(text)]
        found = self.tokenizer.encode(text, add_special_tokens=False)
        place = np.searchsorted(ends, [a for a, _ in found.offsets], side="right")
        cut = np.searchsorted(place, np.arange(len(ends) + 1))
        ids = np.array(found.ids, "<u4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return b"".join(self.node(text, 0, len(text)))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; this tokenizer has no decoder, so its tokens are joined by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


_SPACE = frozenset("\t\n\x0b\x0c\r ")
_UNIT = re.compile(r"[^\x20\x09-\x0D]+")


def _whole_from(text: str, a: int, cut: int) -> int | None:
    """The first place from a on, before cut, where a unit begins after white space."""
    return next((k + 1 for k in range(a, cut - 1) if text[k] in _SPACE and text[k + 1] not in _SPACE), None)


def _whole_to(text: str, b: int, cut: int) -> int | None:
    """The last place up to b, after cut, where a unit ends before white space."""
    return next((k for k in range(b - 1, cut, -1) if text[k] in _SPACE and text[k - 1] not in _SPACE), None)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def parts_of(text: str) -> list[str]:
    """Equal parts by halving, none above PART characters."""
    n = 1
    while len(text) > n * PART:
        n *= 2
    edges = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def join_parts(own: Encoder, parts: list[tuple[str, bytes, bytes]]) -> bytes:
    """Ids of a text from its parts (text, ids, number of ids in each unit): neighbours are joined level by level."""
    nodes = []
    for text, ids, counts in parts:
        edges = [0, *np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64).tolist()]
        nodes.append((text, [ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]))
    while len(nodes) > 1:
        nodes = [(s + t, own.united(s + t, x, y, 0, len(s), len(s) + len(t))) for (s, x), (t, y) in zip(nodes[::2], nodes[1::2], strict=True)]
    return b"".join(nodes[0][1])


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, bpe_ids binary, bpe_decoded binary) for each row of docs (doc_id, text).

    bpe_ids: the ids that the tokenizer file at `path` gives the whole text without special tokens added, as
    little-endian unsigned 32-bit integers; bpe_decoded: their decoding in UTF-8, special tokens not skipped. Null
    text counts as empty and has no ids. Different texts over PART characters are cut into rows, encoded in parallel
    and joined, each once; repeated rows come out as often as they go in, also where doc_id is null. A
    tokenizer whose tokens cross white space is refused.
    Other columns of docs are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text") > PART, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch], each: Callable[[Encoder, pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in batches:
                for some in slices(batch, "text", 4 << 20):
                    yield each(own, some)
        finally:
            own.clear()  # a worker may go on to tasks of another kind
            trim()

    def whole(own: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [b"".join(units) for units in own.nodes(binary_lists(batch, "text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "bpe_ids", "bpe_decoded"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(*key, i, x) for *key, t in zip(*(batch.column(k).to_pylist() for k in KEY), binary_lists(batch, "text"), strict=True) for i, x in enumerate(parts_of(t.decode("utf-8", "replace")))]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], [*KEY, "part", "text"])

    def part(own: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(own.nodes(binary_lists(batch, "text")))
        counts = [np.array([len(u) // 4 for u in units], "<u4").tobytes() for units in found]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(u) for u in found], pa.binary()), pa.array(counts, pa.binary())], [*batch.schema.names, "ids", "counts"])

    def join(group: pa.Table) -> pa.Table:
        own = encoder(path)
        parts = sorted(group.select(["part", "text", "ids", "counts"]).to_pylist(), key=lambda r: r["part"])
        ids = join_parts(own, [(r["text"], r["ids"], r["counts"]) for r in parts])
        own.clear()
        return pa.table({k: group.column(k)[:1] for k in KEY} | {"bpe_ids": pa.array([ids], pa.binary()), "bpe_decoded": pa.array([own.decode(ids)], pa.binary())})

    out = "bpe_ids binary, bpe_decoded binary"
    short = rows.where(~long).mapInArrow(lambda b: run(b, whole), f"doc_id long, {out}")
    keyed = rows.where(long).select("doc_id", F.xxhash64("text").alias(KEY[0]), F.xxhash64(F.lit(7), "text").alias(KEY[1]), "text")
    cuts = map_batches(keyed.dropDuplicates(KEY).select(*KEY, "text"), cut, "text_k1 long, text_k2 long, part int, text string", by="text")
    parts = cuts.repartition(*KEY, "part").mapInArrow(lambda b: run(b, part), "text_k1 long, text_k2 long, part int, text string, ids binary, counts binary")
    joined = parts.groupBy(*KEY).applyInArrow(join, f"text_k1 long, text_k2 long, {out}")
    return short.unionByName(keyed.drop("text").join(joined, KEY).drop(*KEY))
