"""Operator 5: near-duplicate embeddings, compared in blocks within the cells of spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import components, discard, map_batches, table

#: The cosine that no two centres reach.
APART = 0.7
#: Rows that the centres are fitted on at most, cells at most, distinct vectors that a cell is meant for.
MOST_FIT, MOST_CELLS, CELL = 20_000, 4096, 1000
#: Bytes of a block of vectors that goes to a task, and rows that are multiplied at once.
BLOCK_BYTES, AT_ONCE = 4 << 20, 1024


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all parts finite, not zero. Null otherwise counts as no."""
    big = F.lit(float("inf"))
    ok = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == big)) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))


def centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres by spherical k-means on unit rows: each round averages and scales the rows nearest by cosine.

    In the end centres of larger cells take over those close to them. Else a group of near copies, which draws
    centres by its size, would be cut into cells finer than the links within it.
    """
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    c = c[np.argsort(-np.bincount((sample @ c.T).argmax(axis=1), minlength=cells), kind="stable")]
    kept = np.zeros(cells, bool)
    for k in range(cells):
        kept[k] = not kept.any() or (c[kept] @ c[k]).max() < APART
    return c[kept]


def _unit(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<f8").reshape(-1, dim)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n rows that each one reaches by the links (a, b)."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (least == before).all():
            break
    return least


def compare(copies: np.ndarray, homes: np.ndarray, cells: np.ndarray, unit: np.ndarray, first: np.ndarray, second: np.ndarray, cell: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows `first` against the rows `second` (equal: each pair once) of one cell: links of each row, and the smallest row that it reaches.

    A pair belongs to a cell if one of both has its home there; if both cells see the pair, the lower one
    counts it. Links count the copies behind the other row. Products are made some rows at a time.
    """
    n, same = len(unit), np.array_equal(first, second)
    links, ends = np.zeros(n), []
    for k in range(0, len(first), AT_ONCE):
        for j in range(k if same else 0, len(second), AT_ONCE):
            some, others = first[k : k + AT_ONCE], second[j : j + AT_ONCE]
            a, b = np.nonzero(unit[some] @ unit[others].T >= bound)
            a, b = some[a], others[b]
            if same and j == k:
                a, b = a[a < b], b[a < b]
            at_a, at_b = homes[a] == cell, homes[b] == cell
            seen = at_a | at_b
            a, b, at_a, at_b = a[seen], b[seen], at_a[seen], at_b[seen]
            other, here = np.where(at_a, homes[b], homes[a]), np.where(at_a, a, b)
            elsewhere = (cells[here] == other[:, None]).any(axis=1)
            count = (at_a & at_b) | ~elsewhere | (cell < other)
            links += np.bincount(a[count], copies[b[count]], n) + np.bincount(b[count], copies[a[count]], n)
            rows = np.unique(np.concatenate([a, b]))  # the links of this product as a forest
            tree = least_linked(len(rows), np.searchsorted(rows, a), np.searchsorted(rows, b))
            ends.append(np.stack([rows, rows[tree]]))
    return links.astype(np.int64), least_linked(n, *np.concatenate(ends, axis=1)) if ends else np.arange(n)


def near_duplicates(spark: SparkSession, vectors: DataFrame, bound: float = 0.9, probes: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors with a cosine of at least `bound` link; n_links counts other rows linked directly, component_id is the
    smallest vec_id reachable, kept marks that one. Vectors that are null, empty, zero or hold null or
    non-finite parts, and rows without vec_id, link with nothing (component_id is their own vec_id). Vectors of different
    lengths do not link. Equal vectors are compared once and counted with their copies; rows that repeat a
    vec_id count as rows, and with other vectors as vectors of their own. Other columns are not read.

    Centres come from a sample of at most MOST_FIT rows; every vector is assigned. It visits the `probes` cells
    nearest to it, and a pair is found if either visits the other's home. Cells are cut into blocks; each pair of
    blocks is one task, which gives sums and a spanning forest, never the pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull())
    v = F.when(F.col("ok"), F.col("v").cast("array<double>"))
    rows = rows.select("vec_id", "ok", v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"), F.size(v).alias("dim"))
    # a class: one vector with its smallest vec_id; id numbers the classes, as vectors may share a vec_id
    classes = rows.where("ok").groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [np.array(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in known), pa.array(raw, pa.binary())], [*known, "vector"])

    known = ["h1", "h2", "dim", "first", "copies"]
    packed = map_batches(classes, pack, "h1 long, h2 long, dim int, first long, copies long, vector binary", most=2000)
    classes = table(packed.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    # centres for each length of vectors that has more than one cell
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()}
    fitted = {}
    for dim, n in sizes.items():
        k = int(min(MOST_CELLS, max(1, round(n / CELL))))
        if k > 1:
            sample = classes.where(F.col("dim") == dim).orderBy("h1", "h2").limit(MOST_FIT).toPandas()
            fitted[dim] = centres(_unit(pa.table({"vector": sample.sort_values(["h1", "h2"])["vector"].tolist()}), dim), min(k, len(sample)))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            if (c := fitted.get(int(dim))) is None:
                near = np.zeros((part.num_rows, 1), np.int64)
            else:
                score = _unit(part, int(dim)) @ c.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            p = near.shape[1]
            take = np.repeat(np.arange(part.num_rows), p)
            part = part.take(pa.array(take))
            home, cells = np.repeat(near[:, 0], p), [x.astype("<i8").tobytes() for x in near]
            out.append(pa.RecordBatch.from_arrays([part.column("dim"), pa.array(near.ravel().astype(np.int32)), pa.array(home.astype(np.int32)), pa.array([cells[k] for k in take], pa.binary()), part.column("id"), part.column("copies"), part.column("vector")], names))
        return pa.concat_batches(out)

    names = ["dim", "cell", "home", "cells", "id", "copies", "vector"]
    visits = table(map_batches(classes, assign, "dim int, cell int, home int, cells binary, id long, copies long, vector binary", most=2000), "vector-visits")
    blocks = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))).cast("int").alias("blocks"))
    placed = visits.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def pairs(group: pa.Table) -> pa.Table:
        dim, cell, low, high = (group.column(c)[0].as_py() for c in ("dim", "cell", "low", "high"))
        group = group.sort_by("id")
        ids, copies, homes, block = (group.column(c).to_numpy() for c in ("id", "copies", "home", "block"))
        cells = np.frombuffer(b"".join(group.column("cells").to_pylist()), "<i8").reshape(len(ids), -1)
        links, least = compare(copies, homes, cells, _unit(group, dim), np.flatnonzero(block == low), np.flatnonzero(block == high), cell, bound)
        hit = (links > 0) | (least != np.arange(len(ids)))
        return pa.table({"id": ids[hit], "links": links[hit], "least": ids[least][hit]})

    found = placed.groupBy("dim", "cell", "low", "high").applyInArrow(pairs, "id long, links long, least long")
    found = table(found.groupBy("id", "least").agg(F.sum("links").alias("links")), "vector-links")
    groups = components(found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    firsts = classes.select("id", "first").join(groups, "id").groupBy("component").agg(F.min("first").alias("least"))
    of_class = classes.select("h1", "h2", "dim", "id", "first", "copies").join(direct, "id", "left").join(groups.join(firsts, "component").select("id", "least"), "id", "left")
    of_class = of_class.select("h1", "h2", "dim", F.coalesce("least", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    of_class = table(of_class, "vector-groups")
    discard(classes, visits, found, groups)
    good = rows.where("ok").select("vec_id", "h1", "h2", "dim").join(of_class, ["h1", "h2", "dim"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
