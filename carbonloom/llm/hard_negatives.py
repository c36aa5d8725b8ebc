"""Operator 13: hard negatives from Hilbert-ordered blocks of candidates, chosen by zone maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom.llm.common import discard, map_batches, table
from carbonloom.llm.whitening import by_length, finite

#: Candidates of a block, rows whose anchors make a frame, zone maps of a page, frames that meet a block or a page in one task.
BLOCK, STRETCH, PAGE, FRAMES_AT_ONCE = 1024, 4096, 1024, 32
#: Bits of a dimension on the Hilbert curve.
CURVE_BITS = 4
#: No window begins below or ends above these.
LEAST, MOST = -(2**62), 2**62

_BLOCKS = "block long, dims int, label long, n int, rids array<long>, ids array<long>, x binary, low binary, high binary"


def hilbert_keys(grid: np.ndarray, bits: int) -> list[bytes]:
    """The places on the Hilbert curve of points on a grid [row, dimension] of `bits` bits, as bytes in order.

    Skilling's transform: from the highest bit on, each dimension either flips the lower bits of the first one or
    swaps them with its own; then Gray code over the dimensions, and the bits of one level side by side.
    """
    x = grid.astype(np.uint32).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        below = np.uint32(level - 1)
        for k in range(len(x)):
            set_here = (x[k] & level) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[k]) & below).astype(np.uint32)
            x[0] ^= np.where(set_here, below, swap).astype(np.uint32)
            x[k] ^= swap
        level >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn, level = np.zeros(x.shape[1], np.uint32), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[-1] & level, np.uint32(level - 1), np.uint32(0)).astype(np.uint32)
        level >>= 1
    x ^= turn
    planes = [(x >> b & 1).astype(np.uint8).T for b in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes, axis=1), axis=1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exactly: in doubles where all sums fit, else in longs, else in whole numbers of any size."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max(abs(int(v)) for v in exact.ravel()) >= 2**62:
        raise OverflowError("an inner product has no long: scale the vectors down")
    return exact.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each row a with any point between low and high, by interval arithmetic.

    In doubles; they are widened by more than what rounding may take."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    slack = (np.abs(a).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T) * 2.0**-40 + 0.5
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, columns)


def _bytes(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def quantised(vectors: DataFrame, scale: int, every: int) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; where vec_id divides by `every`, the label moves on by one of ten."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % every == 0, (label + 1) % 10).otherwise(label)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    good = vectors.where(F.col("label").isNotNull() & finite(F.col("embedding")))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))


def ordered(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, x) with dims, in tasks by (dims, label, Hilbert key): neighbours on the curve lie side by side. The curve's grid spans each dimension from its least to its greatest value."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dims, x, _ in by_length(batch, "x"):
                low, high = x.min(axis=0), x.max(axis=0)
                if dims in seen:
                    low, high = np.minimum(low, seen[dims][0]), np.maximum(high, seen[dims][1])
                seen[dims] = low, high
        for dims, (low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["dims", "at", "low", "high"])

    span: dict[int, np.ndarray] = {}
    found = rows.select("x").mapInArrow(spans, "dims int, at int, low long, high long").groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():  # a row for each dimension
        span.setdefault(r["dims"], np.zeros((2, r["dims"])))[:, r["at"]] = r["low"], r["high"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, keys = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
        for d, x, at in by_length(batch, "x"):
            low, high = span[d]
            grid = np.minimum((x - low) / np.maximum(high - low, 1) * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1)
            dims[at] = d
            for k, key in zip(at.tolist(), hilbert_keys(grid, CURVE_BITS), strict=True):
                keys[k] = key
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(keys, pa.binary())], [*batch.schema.names, "dims", "curve"])

    keyed = map_batches(rows, each, "vec_id long, label long, x array<long>, dims int, curve binary", most=4096).where("dims > 0")
    order = ["dims", "label", "curve", "vec_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("curve")


def blocked(rows: DataFrame) -> DataFrame:
    """rows (rid, vec_id, dims, label, x), as they lie, packed into blocks of BLOCK at most, each of one length and label, with the least and greatest value of each dimension."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")][1:]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            x = whole.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1)
            row = [whole.column("dims")[0].as_py(), whole.column("label")[0].as_py(), whole.num_rows, whole.column("rid").to_pylist(), whole.column("vec_id").to_pylist(), _bytes(x), _bytes(x.min(axis=0)), _bytes(x.max(axis=0))]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            # rows go on with those before them: the same length and label, the next rid
            kinds = np.stack([batch.column("dims").to_numpy(), batch.column("label").to_numpy(), batch.column("rid").to_numpy() - np.arange(batch.num_rows)])
            edges = [0, *(np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                while start < end:
                    if held and (any(held[0].column(c)[0] != batch.column(c)[start] for c in ("dims", "label")) or held[-1].column("rid")[-1].as_py() + 1 != batch.column("rid")[start].as_py()):
                        yield block()
                    take = min(end - start, BLOCK - sum(b.num_rows for b in held))
                    held.append(batch.slice(start, take))
                    start += take
                    if sum(b.num_rows for b in held) == BLOCK:
                        yield block()
        if held:
            yield block()

    packed = rows.select("rid", "vec_id", "dims", "label", "x").mapInArrow(pack, _BLOCKS.split(", ", 1)[1])
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


def framed(anchors: DataFrame, windows: int) -> DataFrame:
    """anchors (rid, dims, label, x, since array<long>, until array<long>) packed into frames: those of one length and label from STRETCH rows along the curve, with `windows` windows for each anchor."""

    def pack(group: pa.Table) -> pa.Table:
        dims = group.column("dims")[0].as_py()
        flat = lambda c, width: _bytes(group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        row = [dims, group.column("label")[0].as_py(), group.column("rid").to_pylist(), flat("x", dims), flat("since", windows), flat("until", windows)]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(["dims", "label", "rids", "x", "since", "until"], row, types, strict=True)})

    near = anchors.select("rid", "dims", "label", "x", "since", "until", F.floor(F.col("rid") / STRETCH).alias("stretch"))
    packed = near.groupBy("dims", "label", "stretch").applyInArrow(lambda g: pack(g), "dims int, label long, rids array<long>, x binary, since binary, until binary")
    return packed.select(F.monotonically_increasing_id().alias("frame"), "*")


def paged(blocks: DataFrame) -> DataFrame:
    """(page, dims, zones): the zone maps of blocks of one length, some PAGE to a page."""
    zones = blocks.select("block", "dims", "label", "low", "high")
    pages = zones.groupBy("dims").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    placed = zones.join(pages, "dims").withColumn("page", F.concat_ws("-", "dims", F.pmod(F.xxhash64("block"), F.col("pages"))))
    return placed.groupBy("page", "dims").agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))


def _dealt(frames: DataFrame, others: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """Groups for applyInArrow of one row of `others` (blocks or pages) and the frames that links (by, frame, ...) give it, FRAMES_AT_ONCE or so to a group."""
    many = links.groupBy(by).agg(F.ceil(F.count("*") / FRAMES_AT_ONCE).cast("int").alias("shares"))
    small = links.join(many, by).withColumn("share", F.pmod(F.xxhash64("frame"), F.col("shares")).cast("int")).drop("shares").join(frames, "frame")
    large = many.join(others, by).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return small.unionByName(large, allowMissingColumns=True).groupBy(by, "share")


def chosen(frames: DataFrame, pages: DataFrame, same: bool, windows: int, probe: bool) -> DataFrame:
    """(frame, block, needed): the blocks that the windows of a frame's anchors must read, with one byte for each anchor.

    An anchor needs a block of its own label (same) or of other ones if the interval from the least to the
    greatest inner product with the block's box meets one of its windows; with `probe` only the one of greatest bound among
    those of a page.
    """

    def choose(group: pa.Table) -> pa.Table:
        there = pc.is_valid(group.column("zones"))
        page = group.filter(there).column("zones")[0].as_py()
        out: dict[str, list] = {"frame": [], "block": [], "needed": []}
        for f in group.filter(pc.invert(there)).to_pylist():
            dims = f["dims"]
            x, since, until = _matrix(f["x"], dims), _matrix(f["since"], windows), _matrix(f["until"], windows)
            zones = [z for z in page if (z["label"] == f["label"]) == same]
            if not zones:
                continue
            least, most = bounds(x, *(np.concatenate([_matrix(z[c], dims) for z in zones]) for c in ("low", "high")))
            meets = np.zeros(least.shape, bool)
            for w in range(windows):
                meets |= (most >= since[:, w, None]) & (least <= until[:, w, None]) & (since <= until)[:, w, None]
            if probe:
                meets &= np.arange(len(zones)) == np.where(meets, most, -np.inf).argmax(axis=1)[:, None]
            for k in np.flatnonzero(meets.any(axis=0)).tolist():
                out["frame"].append(f["frame"])
                out["block"].append(zones[k]["block"])
                out["needed"].append(meets[:, k].astype(np.uint8).tobytes())
        return pa.table({n: pa.array(v, pa.binary() if n == "needed" else pa.int64()) for n, v in out.items()})

    links = frames.select("frame", "dims").join(pages.select("page", "dims"), "dims").select("page", "frame")
    dealt = _dealt(frames.select("frame", "dims", "label", "x", "since", "until"), pages.select("page", "zones"), links, "page")
    return dealt.applyInArrow(lambda g: choose(g), "frame long, block long, needed binary")


def read_windows(frames: DataFrame, blocks: DataFrame, links: DataFrame, windows: int, top: int) -> DataFrame:
    """(rid, window, score, vec_id): of each block in links (frame, block, needed) the best `top` rows in each window of the anchors that need it, never the anchor itself."""

    def read(group: pa.Table) -> pa.Table:
        there = pc.is_valid(group.column("ids"))
        block = group.filter(there).to_pylist()[0]
        ids, rows, x = block["ids"], np.array(block["rows"]), _matrix(block["points"], block["dims"])
        ties = np.argsort(np.argsort([2**63 - 1 if v is None else v for v in ids], kind="stable"), kind="stable")
        out = [np.zeros((4, 0), np.int64)]
        for f in group.filter(pc.invert(there)).to_pylist():
            needed = np.flatnonzero(np.frombuffer(f["needed"], np.uint8))
            rids, since, until = np.array(f["rids"])[needed], _matrix(f["since"], windows)[needed], _matrix(f["until"], windows)[needed]
            score = products(_matrix(f["x"], block["dims"])[needed], x)
            other = rids[:, None] != rows[None, :]
            for w in range(windows):
                a, b = np.nonzero(other & (score >= since[:, w, None]) & (score <= until[:, w, None]))
                order = np.lexsort((ties[b], -score[a, b], a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < top
                a, b = a[first], b[first]
                out.append(np.stack([rids[a], np.full(len(a), w), score[a, b], b]))
        rid, window, score, b = np.concatenate(out, axis=1)
        return pa.table({"rid": rid, "window": pa.array(window.astype(np.int32)), "score": score, "vec_id": pa.array([ids[k] for k in b], pa.int64())})

    held = blocks.select("block", "ids", F.col("dims"), F.col("rids").alias("rows"), F.col("x").alias("points"))
    dealt = _dealt(frames.select("frame", "rids", "x", "since", "until"), held, links, "block")
    return dealt.applyInArrow(lambda g: read(g), "rid long, window int, score long, vec_id long")


def best(anchors: DataFrame, blocks: DataFrame, pages: DataFrame, same: bool, windows: int, top: int) -> DataFrame:
    """(rid, window, place, score, vec_id): the first `top` rows (place from 0) of each window of anchors (rid, dims, label, x, since, until) among the rows of their own label (same) or of other ones.

    Higher scores come first, ties by smaller vec_id, none last. A first reading of the block of greatest bound in each page raises
    the beginnings of windows that it fills: no row below the last place found can be wanted.
    """

    def reading(anchors: DataFrame, probe: bool) -> tuple[DataFrame, list[DataFrame]]:
        frames = table(framed(anchors, windows), "negative-frames")
        links = table(chosen(frames, pages, same, windows, probe), "negative-links")
        found = read_windows(frames, blocks, links, windows, top)
        place = F.row_number().over(Window.partitionBy("rid", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))) - 1
        return found.withColumn("place", place).where(F.col("place") < top), [frames, links]

    first, used = reading(anchors, probe=True)
    full = first.where(F.col("place") == top - 1).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))
    full = table(full, "negative-raised")
    discard(*used)
    raised = F.transform("since", lambda v, w: F.greatest(v, F.coalesce(F.try_element_at("full", w), v)))
    second, used = reading(anchors.join(full, "rid", "left").withColumn("since", raised), probe=False)
    second = table(second.select("rid", "window", "place", "score", "vec_id"), "negative-found")
    discard(full, *used)
    return second


def mine(spark: SparkSession, vectors: DataFrame, scale: int = 256, relabel: int = 7, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, embedding, label).

    Parts become floor(scale * x); a score is the whole inner product with the anchor. Anchors are rows whose vec_id divides by
    `every`; their positives the first `positives` other rows of the same label, higher scores first, ties by smaller vec_id.
    For each, the negatives are the first `negatives` rows of other labels with low * positive <= 100 * negative <= high *
    positive. Where vec_id divides by `relabel`, the label is first moved on by one of ten.

    Rows with a null label, a null vector or a null or non-finite part take no part, nor do empty vectors; vectors of
    different lengths never meet. Rows that repeat a vec_id are rows of their own: each is an anchor, and an other row to
    its copies. Rows without vec_id are no anchors, and last of ties. Scores of 2 ** 62 or more are an error.
    An empty table gives no rows. Other columns are not read.

    Rows are ordered along a Hilbert curve within each label and written in blocks, with the least and greatest value
    of each dimension as zone maps. Zone maps meet anchors in pages, and interval bounds say which blocks the anchors' windows
    must read; only those are joined to the anchors. Neither blocks, anchors nor zone maps are collected or broadcast.
    """
    rows = table(ordered(quantised(vectors, scale, relabel)).select("*", F.monotonically_increasing_id().alias("rid")), "negative-rows")
    blocks = table(blocked(rows), "negative-blocks")
    pages = table(paged(blocks), "negative-pages")
    anchors = rows.where(F.col("vec_id") % every == 0)
    everything = {"since": F.array(F.lit(LEAST).cast("long")), "until": F.array(F.lit(MOST).cast("long"))}
    near = best(anchors.withColumns(everything), blocks, pages, True, 1, positives)
    # p * percent / 100 in whole numbers, without leaving the range of a long
    part = lambda percent, more: f"{percent} * (score div 100) + ({percent} * (score % 100) + {more}) div 100"
    side = near.select("rid", "place", F.expr(f"if(score >= 0, {part(low, 99)}, {MOST})").alias("since"), F.expr(f"if(score >= 0, {part(high, 0)}, {LEAST})").alias("until"))
    side = side.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("since", "until")))).alias("of"))
    window = lambda c, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.try_element_at("of", k)[c], F.lit(none).cast("long")))
    asking = anchors.join(side, "rid").select("rid", "dims", "label", "x", window("since", MOST).alias("since"), window("until", LEAST).alias("until"))
    far = best(asking, blocks, pages, False, positives, negatives)
    pairs = anchors.select("rid", F.col("vec_id").alias("anchor_id")).join(near.select("rid", F.col("place").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "rid")
    found = far.select("rid", "window", (F.col("place") + 1).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = table(pairs.join(found, ["rid", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, blocks, pages, near, far)
    return out
