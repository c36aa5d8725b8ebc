"""Hashes of short byte sequences, dealt to buckets in packed rows.

A row for each hash would cost several times its bytes in a shuffle. Here a task packs the hashes of some
texts into one row for each bucket: the keys of the texts, how many hashes each has there, and the hashes (and for
some uses their places). A text's key is two 64-bit hashes of it, so that equal texts share one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonloom.llm.common import binary_lists, slices, trim

PACKED = "bucket int, keys binary, counts binary, hashes binary, places binary"
#: Bytes of text whose hashes a bucket is meant for, and whose hashes a task packs at once.
BUCKET_TEXT, AT_ONCE = 12 << 20, 6 << 20


def text_keys(text: Column) -> list[Column]:
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(F.lit(7), filled).alias("k2")]


def bucket_count(total_bytes: int, each: int = BUCKET_TEXT, least: int = 16) -> int:
    """So many that a bucket has the hashes of about `each` bytes of text."""
    return max(least, -(-total_bytes // each))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any of their bits can deal them out."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def edges_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values (in all columns) begin, and the end."""
    n = len(sorted_columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in sorted_columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


def joined_bytes(group: pa.Table, column: str) -> np.ndarray:
    """The bytes of a binary column, in one array."""
    parts = []
    for chunk in group.column(column).cast(pa.binary()).chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def pack(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, places: np.ndarray | None, buckets: int) -> Iterator[tuple]:
    """Rows of PACKED. keys: k1 and k2 of each text; counts: hashes of each; hashes and places: of all, in order."""
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits sort by radix
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        rows = order[edges[b] : edges[b + 1]]
        if len(rows):
            own = owner[rows]
            cut = edges_of(own)
            yield b, keys[own[cut[:-1]]].astype("<i8").tobytes(), np.diff(cut).astype("<i4").tobytes(), hashes[rows].astype("<u8").tobytes(), b"" if places is None else places[rows].astype("<i4").tobytes()


def unpack_shared(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys, hashes, owner, places) of a bucket: only hashes that occur twice, in order of hash, then owner.

    owner is the row of keys, where equal keys are one. Most hashes occur once and are left out before
    anything of their size but one sorted copy is made.
    """
    raw = joined_bytes(group, "keys").view("<i8").reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    cut = edges_of(raw[order, 0], raw[order, 1])
    same = np.empty(len(order), np.int32)
    same[order] = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
    keys = raw[order[cut[:-1]]]
    hashes = joined_bytes(group, "hashes").view("<u8")
    ordered = np.sort(hashes)
    twice = ordered[:-1][ordered[1:] == ordered[:-1]]
    twice = twice[edges_of(twice)[:-1]]
    del ordered
    kept = np.zeros(len(hashes), bool)
    for k in range(0, len(hashes) if len(twice) else 0, 1 << 18):
        some = hashes[k : k + (1 << 18)]
        kept[k : k + len(some)] = twice[np.minimum(np.searchsorted(twice, some), len(twice) - 1)] == some
    hashes, owner = hashes[kept], np.repeat(same, joined_bytes(group, "counts").view("<i4"))[kept]
    places = joined_bytes(group, "places").view("<i4")
    places = places[kept] if len(places) else None
    order = np.lexsort((owner, hashes))
    return keys, hashes[order], owner[order], None if places is None else places[order]


def packed_rows(docs: DataFrame, each: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray | None]]], buckets: int) -> DataFrame:
    """PACKED rows of docs (text): each(texts) gives the hashes of each text and their places or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                found = each(binary_lists(part, "text"))
                keys = np.stack([part.column("k1").to_numpy(), part.column("k2").to_numpy()], axis=1)
                counts = np.array([len(h) for h, _ in found])
                if not counts.sum():
                    continue
                places = None if found[0][1] is None else np.concatenate([p for _, p in found])
                rows = list(pack(keys, counts, np.concatenate([h for h, _ in found]), places, buckets))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["bucket", "keys", "counts", "hashes", "places"])
        trim()

    return docs.select(*text_keys(docs["text"]), "text").mapInArrow(run, PACKED)


#: Bytes of text whose shared hashes a part of the texts is meant for.
PART_TEXT = 8 << 20


def part_of(k1: np.ndarray, parts: int) -> np.ndarray:
    """The part of the texts in which a text is, by its first key."""
    return (mixed(np.ascontiguousarray(k1).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def part_rows(keys: np.ndarray, owner: np.ndarray, of: int, **columns: np.ndarray) -> pa.Table:
    """What a bucket has found for its texts, in one row for each of the parts: part, keys, counts and the columns as bytes. owner: the text (row of keys) of each item."""
    part = part_of(keys[:, 0], of)[owner]
    order = np.lexsort((owner, part))
    owner, part, columns = owner[order], part[order], {name: c[order] for name, c in columns.items()}
    cut = edges_of(part)
    out: dict[str, list] = {name: [] for name in ("part", "keys", "counts", *columns)}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = edges_of(owner[a:b])
        for name, value in (("part", int(part[a])), ("keys", keys[owner[a:b][own[:-1]]].tobytes()), ("counts", np.diff(own).astype("<i4").tobytes()), *((n, c[a:b].tobytes()) for n, c in columns.items())):
            out[name].append(value)
    return pa.table({name: pa.array(v, pa.int32() if name == "part" else pa.binary()) for name, v in out.items()})


def part_texts(packed: pa.Table, **kinds: str) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """(keys, ends, columns) of the rows of a part: its different texts, where the items of each begin and end, and the columns in that order."""
    raw, counts = joined_bytes(packed, "keys").view("<i8").reshape(-1, 2), joined_bytes(packed, "counts").view("<i4")
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    cut = edges_of(raw[order, 0], raw[order, 1])
    text = np.empty(len(order), np.int32)
    text[order] = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
    by_text = np.argsort(np.repeat(text, counts), kind="stable")
    ends = np.cumsum(np.bincount(text, counts, len(cut) - 1)).astype(np.int64).tolist()
    return raw[order[cut[:-1]]], [0, *ends], [joined_bytes(packed, name).view(kind)[by_text] for name, kind in kinds.items()]
