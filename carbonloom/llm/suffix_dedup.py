"""Operator 6: byte strings that repeat across documents, by two-stage suffix sorting.

Suffixes of the whole corpus meet only where they can match. The windows of a text (50 bytes) whose smallest
20-gram hash is the same make a segment; equal windows have equal smallest hashes, so that all places of a
window lie in segments of one hash. Hashes that one text alone has are left out; the segments of the others are dealt to
buckets and sorted: suffixes smaller than their successors directly, the rest induced from them by a scan over the
buckets of first bytes. Common prefixes of neighbours in that order then give the groups of equal windows, and
the smallest document of each.

A hash that very many texts have is cut into parts by document, each sorted by itself. Windows that find no smaller
document in their part are dealt again, each by the hash of its 50 bytes: windows that only stand
around a common phrase part company there, and of equal windows a part sends one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import binary_lists, discard, map_batches, slices, table, text_bytes
from carbonloom.llm.packed import PART_TEXT, bucket_count, edges_of, joined_bytes, mixed, packed_rows, part_rows, part_texts, text_keys, unpack_shared

#: Bytes of a repeated string, and of the grams that lead to it.
WINDOW, GRAM = 50, 20
#: Bytes of segments that a bucket is meant for, and that are sorted at once: whole hashes, that no equal windows part.
BUCKET_BYTES, SORT_BYTES = 3 << 20, 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each 20-gram: polynomial, by doubling."""
    h, base, width, parts = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), _B, 1, []
    while width <= GRAM:
        parts.append((width, base, h))
        if len(h) <= width:
            break
        h = h[:-width] * base + h[width:]
        base, width = np.uint64(int(base) ** 2 % 2**64), 2 * width
    total, done = None, 0
    for width, base, h in reversed(parts):  # 20 = 16 + 4
        if done + width <= GRAM:
            total = h if total is None else total[: len(h) - done] * base + h[done : done + len(total)]
            done += width
    return mixed(total[: len(text) - GRAM + 1])


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows): runs of window starts whose windows have the same smallest gram hash."""
    if len(text) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _gram_hashes(text)
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return mixed(low[starts]), starts, np.diff(np.concatenate([starts, [len(low)]]))


def direct_order(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes at `places` by their first 56 bytes, eight at a time; words[i]: bytes i to i + 7 as a number."""
    order = np.argsort(words[places])
    places, key = places[order], words[places[order]]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, np.arange(len(key), dtype=np.int32), 0)) if len(key) else np.zeros(0, np.int32)
    for k in range(1, 7):
        tied = np.zeros(len(places), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word = words[places[at] + 8 * k]
        order = np.lexsort((word, group[at]))
        places[at], word = places[at[order]], word[order]
        g = group[at]
        edge = np.concatenate([[True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])])
        group[at] = np.maximum.accumulate(np.where(edge, at, 0))
    return places


def suffix_order(chars: np.ndarray, need: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of `need` in the order of their suffixes (to 50 bytes), by two stages.

    chars: bytes plus one, 0 after each segment. `need` must hold, with a suffix larger than its successor,
    that successor too.
    """
    n = len(chars)
    differs = np.flatnonzero(chars[1:] != chars[:-1])
    smaller = np.zeros(n, bool)  # than the successor; a run of one byte is as its last one
    smaller[: differs[-1] + 1 if len(differs) else 0] = np.repeat(chars[differs] < chars[differs + 1], np.diff(differs, prepend=-1))
    smaller |= chars == 0
    first = direct_order(np.flatnonzero(smaller & need), words)
    first = first[np.argsort(chars[first], kind="stable")]
    edges = np.searchsorted(chars[first], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def scan(places: np.ndarray) -> None:
        out.append(places)
        before = places[places > 0] - 1
        before = before[need[before] & ~smaller[before]]
        if len(before):
            c = chars[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cut = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part in np.split(before, cut):
                induced[chars[part[0]]].append(part)

    for c in range(257):
        k = 0
        while k < len(induced[c]):  # grows while it is scanned: runs of one byte
            scan(induced[c][k])
            k += 1
        if edges[c] < edges[c + 1]:
            scan(first[edges[c] : edges[c + 1]])
    return np.concatenate(out) if out else np.zeros(0, int)


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, to 56."""
    same, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(7):
        a, b = words[order[open_] + 8 * k], words[order[open_ - 1] + 8 * k]
        diff = a ^ b
        zero_bytes = np.zeros(len(open_), np.int64)
        for byte in range(1, 9):
            zero_bytes += (diff >> np.uint64(64 - 8 * byte)) == 0
        same[open_] += zero_bytes
        open_ = open_[diff == 0]
    return same


def repeated_windows(docs: np.ndarray, windows: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows that also start in a document of smaller id, in order.

    Segments have their document, their number of windows and, in `raw`, their bytes one after the other.
    """
    sizes = windows + WINDOW  # with a byte that ends it
    n, begin = int(sizes.sum()), (np.cumsum(sizes) - sizes).astype(np.int32)
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    text = np.zeros(n + 65, np.uint8)
    chars = np.zeros(n, np.uint16)
    within = np.ones(n, bool)
    within[begin + sizes - 1] = False
    text[:n][within] = raw
    chars[within] = raw
    chars[within] += 1
    words = np.zeros(n + 56, np.uint64)
    for k in range(8):
        words |= text[k : k + n + 56].astype(np.uint64) << np.uint64(56 - 8 * k)
    place = np.arange(n, dtype=np.int32) - begin[segment]
    valid = place < windows[segment]
    # a needed suffix that is induced needs the following ones up to the next that is sorted directly
    ends = np.flatnonzero((chars == 0) | np.concatenate([chars[1:] > chars[:-1], [True]]))
    stop = ends[np.searchsorted(ends, begin + windows - 1)] - begin
    order = suffix_order(chars, place <= stop[segment], words)
    order = order[valid[order]]
    owner = docs[segment[order]]
    heads = np.flatnonzero(common_prefixes(order, words) < WINDOW)
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.concatenate([heads, [len(order)]])))
    hit = np.sort(order[owner > least])
    return segment[hit], place[hit]


def shared_segments(docs: DataFrame, most: int) -> DataFrame:
    """(k1, k2, places, parts, found): for each different text, where its segments with a hash of two texts or more start, and into
    how many parts of about `most` texts each one's hash is to be cut; found: how many."""
    total = docs.agg(text_bytes(docs)).first()[0]
    of_texts = max(1, -(-total // PART_TEXT))

    def each(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        value, starts, _ = segments(text)
        return value, starts

    def share(group: pa.Table) -> pa.Table:
        keys, h, o, at = unpack_shared(group)
        edges = edges_of(h)
        other = np.ones(len(o), np.int32)
        other[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        texts = np.repeat(np.add.reduceat(other, edges[:-1]), np.diff(edges)) if len(h) else other
        shared = texts > 1
        at = np.zeros(0, "<i4") if at is None else at
        return part_rows(keys, o[shared], of_texts, places=at[shared].astype("<i4"), parts=(-(-texts[shared] // most)).astype("<i4"))

    def gather(packed: pa.Table) -> pa.Table:
        keys, ends, (places, parts) = part_texts(packed, places="<i4", parts="<i4")
        owner = np.repeat(np.arange(len(keys)), np.diff(ends))
        order = np.lexsort((places, owner))
        once = order[edges_of(owner[order], places[order])[:-1]]  # equal texts have equal places
        cut = edges_of(owner[once])
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        packs = [pa.array([c[once[a:b]].tobytes() for a, b in spans], pa.binary()) for c in (places, parts)]
        own = keys[owner[once[cut[:-1]]]]
        return pa.table([*(pa.array(np.ascontiguousarray(own[:, k])) for k in (0, 1)), *packs, pa.array([b - a for a, b in spans], pa.int64())], ["k1", "k2", "places", "parts", "found"])

    packed = packed_rows(docs, lambda texts: [each(x) for x in texts], bucket_count(total)).groupBy("bucket").applyInArrow(share, "part int, keys binary, counts binary, places binary, parts binary")
    return packed.groupBy("part").applyInArrow(gather, "k1 long, k2 long, places binary, parts binary, found long")


#: Segments in packed rows: id and first key of each one's document, start, number of windows, a byte that parts a bucket, and the bytes.
SEGMENTS = "docs binary, starts binary, windows binary, subs binary, bytes binary"
SPANS = "id long, k1 long, starts binary, counts binary"


def _rows(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def dealt(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and a byte that parts the hashes of a bucket."""
    value = mixed(value)
    return (value >> np.uint64(8)) % np.uint64(buckets), (value & np.uint64(255)).astype(np.uint8)


def packed_segments(group: list[np.ndarray], docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, subs: np.ndarray, data: list[bytes], names: list[str]) -> dict[str, list]:
    """Columns `names` and SEGMENTS: one row for each value of the `group` columns."""
    order = np.lexsort(group[::-1])
    cut = edges_of(*(g[order] for g in group))
    out: dict[str, list] = {name: g[order[cut[:-1]]].tolist() for name, g in zip(names, group, strict=True)} | {c.split()[0]: [] for c in SEGMENTS.split(", ")}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        rows = order[a:b]
        for name, column in (("docs", docs.astype("<i8")), ("starts", starts.astype("<i4")), ("windows", windows.astype("<i4")), ("subs", subs)):
            out[name].append(column[rows].tobytes())
        out["bytes"].append(b"".join([data[k] for k in rows.tolist()]))
    return out


def sorted_group(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(docs, starts, windows, raw, segment, offset) of a bucket, some SORT_BYTES at once: the segments and their repeated windows."""
    docs, starts = joined_bytes(group, "docs").view("<i8").reshape(-1, 2), joined_bytes(group, "starts").view("<i4")
    windows, subs, raw = joined_bytes(group, "windows").view("<i4"), joined_bytes(group, "subs"), joined_bytes(group, "bytes")
    sizes = windows + WINDOW - 1
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(subs, kind="stable")
    done = np.cumsum(sizes[order])
    edges = edges_of(subs[order])[1:].tolist()
    first = 0
    for end, after in zip(edges, [*edges[1:], None], strict=True):
        if after is None or done[after - 1] - (done[first - 1] if first else 0) > SORT_BYTES:
            rows = order[first:end]
            size = sizes[rows]
            own = raw[np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            yield docs[rows], starts[rows], windows[rows], own, *repeated_windows(docs[rows, 0], windows[rows], own)
            first = end


def spans_of(docs: np.ndarray, starts: np.ndarray, segment: np.ndarray, offset: np.ndarray) -> dict[str, list]:
    """Columns SPANS: for each document its runs of repeated windows."""
    run = edges_of(segment, starts[segment] + offset - np.arange(len(segment)))
    first, counts = run[:-1], np.diff(run).astype("<i4")
    at = (starts[segment[first]] + offset[first]).astype("<i4")
    who = docs[segment[first]]
    order = np.lexsort((who[:, 1], who[:, 0]))
    who, at, counts = who[order], at[order], counts[order]
    cut = edges_of(who[:, 0], who[:, 1])
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return {"id": who[cut[:-1], 0].tolist(), "k1": who[cut[:-1], 1].tolist(), "starts": [at[a:b].tobytes() for a, b in spans], "counts": [counts[a:b].tobytes() for a, b in spans]}


def open_windows(docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, raw: np.ndarray, segment: np.ndarray, offset: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents, starts and bytes of the windows that are not repeated, each by itself."""
    base = np.cumsum(windows) - windows
    left = np.ones(int(windows.sum()), bool)
    left[base[segment] + offset] = False
    owner = np.repeat(np.arange(len(windows)), windows)[left]
    nth = np.flatnonzero(left) - base[owner]
    sizes = windows + WINDOW - 1
    at = (np.cumsum(sizes) - sizes)[owner] + nth
    return docs[owner].astype("<i8").tobytes(), (starts[owner] + nth).astype("<i4").tobytes(), raw[at[:, None] + np.arange(WINDOW)].tobytes()


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    padded = np.zeros((len(windows), -(-WINDOW // 8) * 8), np.uint8)
    padded[:, :WINDOW] = windows
    out = np.zeros(len(windows), np.uint64)
    for word in padded.view("<u8").T:
        out = mixed(out * _B + word)
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, most: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of docs (doc_id, text).

    Each byte of the UTF-8 text that lies in a string of 50 bytes which also starts in a document with a smaller
    doc_id is removed; strings are judged on the input and do not cross documents. kept: the other bytes,
    which may cut characters; n_spans: maximal removed runs. Null text counts as empty. Rows that repeat a
    doc_id, with equal or other texts, are not smaller than each other. Rows without doc_id keep all and remove nothing.
    Equal texts are compared once: a copy of a text with a smaller doc_id is removed whole, if it has 50 bytes.
    Other columns are not read.

    Hashes that more than `most` texts have are cut into parts of about so many.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    narrow = table(known.select("doc_id", *text_keys(F.col("text"))).distinct(), "suffix-keys")
    classes = table(narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "suffix-classes")
    found = table(shared_segments(known, most).join(classes, ["k1", "k2"]), "suffix-places")
    total = found.agg(F.sum("found")).first()[0] or 0
    buckets = max(1, -(-total * (WINDOW + 16) // BUCKET_BYTES))
    # in order of the keys, so that rows with equal keys come one after the other
    texts = known.select("doc_id", *text_keys(F.col("text")), "text").join(found.hint("merge"), ["k1", "k2"]).where("doc_id = id").select("id", "k1", "k2", "text", "places", "parts")
    schema = f"hot boolean, bucket int, part int, {SEGMENTS}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in (p for batch in batches for p in slices(batch, "text", 4 << 20)):
            columns: tuple[list, ...] = ([], [], [], [], [])
            data: list[bytes] = []
            ids = zip(*(part.column(c).to_pylist() for c in ("id", "k1", "k2")), strict=True)
            for key, text, places, parts in zip(ids, binary_lists(part, "text"), part.column("places").to_pylist(), part.column("parts").to_pylist(), strict=True):
                if key == last:  # a repeated row
                    continue
                last = key
                value, starts, windows = segments(text)
                at = np.searchsorted(starts, np.frombuffer(places, "<i4"))
                parts = np.frombuffer(parts, "<i4").astype(np.uint64)
                own = mixed(np.array([key[0] ^ key[1]], np.int64).view(np.uint64)) % parts
                for column, x in zip(columns, (np.broadcast_to(np.array(key[:2]), (len(at), 2)), value[at], starts[at], windows[at], np.where(parts > 1, own, -1).astype(np.int64)), strict=True):
                    column.append(x)
                data += [text[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + windows[at] + WINDOW - 1).tolist(), strict=True)]
            if data:
                docs, value, starts, windows, own = (np.concatenate(c) for c in columns)
                bucket, sub = dealt(value, buckets)
                yield _rows(packed_segments([own >= 0, bucket.astype(np.int64), np.maximum(own, 0)], docs, starts, windows, sub, data, ["hot", "bucket", "part"]), schema)

    def sort(group: pa.Table) -> pa.Table:
        hot, out = group.column("hot")[0].as_py(), []
        for docs, starts, windows, raw, segment, offset in sorted_group(group):
            spans = spans_of(docs, starts, segment, offset)
            rest = [open_windows(docs, starts, windows, raw, segment, offset)] * hot
            for name, values in zip(("open_docs", "open_starts", "open_bytes"), zip(*rest, strict=True) if rest else ((), (), ()), strict=True):
                spans[name] = [None] * len(spans["id"]) + list(values)
            for name in ("id", "k1", "starts", "counts"):
                spans[name] = spans[name] + [None] * len(rest)
            out.append(_rows(spans, f"{SPANS}, open_docs binary, open_starts binary, open_bytes binary"))
        return pa.Table.from_batches(out)

    first = table(texts.mapInArrow(cut, schema).groupBy("hot", "bucket", "part").applyInArrow(sort, f"{SPANS}, open_docs binary, open_starts binary, open_bytes binary"), "suffix-spans")
    left = first.where("open_starts is not null")
    again = max(1, -(-(left.agg(F.sum(F.octet_length("open_bytes"))).first()[0] or 0) // BUCKET_BYTES))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = np.frombuffer(batch.column("open_bytes")[0].as_py(), np.uint8).reshape(-1, WINDOW)
        bucket, sub = dealt(window_hashes(data), again)
        docs, starts = np.frombuffer(batch.column("open_docs")[0].as_py(), "<i8").reshape(-1, 2), np.frombuffer(batch.column("open_starts")[0].as_py(), "<i4")
        return _rows(packed_segments([bucket.astype(np.int64)], docs, starts, np.ones(len(data), np.int32), sub, [x.tobytes() for x in data], ["bucket"]), f"bucket int, {SEGMENTS}")

    def sort_again(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(spans_of(docs, starts, segment, offset), SPANS) for docs, starts, _, _, segment, offset in sorted_group(group)])

    second = map_batches(left.select("open_docs", "open_starts", "open_bytes"), deal, f"bucket int, {SEGMENTS}", most=1).groupBy("bucket").applyInArrow(sort_again, SPANS)
    spans = first.where("id is not null").select("id", "k1", "starts", "counts").unionByName(second)
    spans = spans.groupBy("id", "k1").agg(F.collect_list(F.struct("starts", "counts")).alias("spans"))
    marks = narrow.join(classes, ["k1", "k2"])
    copies = marks.where("doc_id > id").select("doc_id", "k1", "k2", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<starts:binary,counts:binary>>").alias("spans"))
    firsts = marks.where("doc_id = id").join(spans, ["id", "k1"]).select("doc_id", "k1", "k2", F.lit(False).alias("whole"), "spans")
    marks = table(copies.unionByName(firsts), "suffix-marks")
    discard(narrow, classes, found, first)
    joined = rows.select("doc_id", *text_keys(F.col("text")), "text").join(marks, ["doc_id", "k1", "k2"], "left")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, removed, runs, kept = [], [], [], []
        for text, whole, spans in zip(binary_lists(batch, "text"), batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            n = len(text)
            gone = np.zeros(n, bool)
            if whole:
                gone[:] = n >= WINDOW
            elif spans:
                edge = np.zeros(n + 1, np.int64)
                for s in spans:
                    a = np.frombuffer(s["starts"], "<i4")
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + np.frombuffer(s["counts"], "<i4") + WINDOW - 1, -1)
                gone = np.cumsum(edge[:n]) > 0
            size.append(n)
            removed.append(int(gone.sum()))
            runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(text if not removed[-1] else np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(joined.select("doc_id", "text", "whole", "spans"), drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", by="text")
