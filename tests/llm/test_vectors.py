"""Operators on weighted terms and on all vectors: fingerprints, whitening, hard negatives, near duplicates."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from carbonloom.llm import hard_negatives, weighted_sampling, whitening

def vector_frame(spark, rows):
    """rows (vec_id, vector, label) with clashing columns."""
    names = "vec_id long, embedding array<double>, label int, x string, n string, rid string, dims string, block string, window string, score string"
    return spark.createDataFrame([(*r, "x", "n", "r", "d", "b", "w", "s") for r in rows], names)


def odd_vectors(seed, count=300, dims=6):
    """Clusters, ties, repeats, nulls, other lengths and zero vectors."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, dims))
    rows = [(k, (middle[k % 5] + rng.normal(size=dims) * 0.3).tolist(), int(rng.integers(0, 4))) for k in range(count)]
    rows += [(k + 1000, rows[k % 3][1], k % 3) for k in range(40)]  # equal vectors, some of equal labels
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[50][1], 2), (None, rows[7][1], 1), (None, rows[8][1], 2)]
    rows += [(2000, None, 1), (2050, [1.0, None] * (dims // 2), 1), (2100, [float("nan")] * dims, 1), (2150, [float("inf")] + [0.0] * (dims - 1), 1), (2200, [0.0] * dims, 1), (2250, [], 1), (2300, rows[0][1], None)]
    rows += [(3000 + k, [float(k % 7), 1.0 - k % 3], k % 2) for k in range(60)]
    return rows


# hard negatives


def plain_negatives(rows, scale=256):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        good.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(scale * c) for c in v]))
    tie = lambda i: math.inf if i is None else i
    out = []
    for n, (i, label, v) in enumerate(good):
        if i is None or i % 50 or not v:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), tie(j), j, other == label) for m, (j, other, w) in enumerate(good) if m != n and len(w) == len(v))
        for p, _, j, same in [x for x in near if x[3]][:5]:
            fit = [x for x in near if not x[3] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, k + 1, x[2], -p, -x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    for name, size in {"BLOCK": 16, "STRETCH": 40, "PAGE": 3, "FRAMES_AT_ONCE": 2}.items():
        monkeypatch.setattr(hard_negatives, name, size)
    rows = odd_vectors(seed)
    got = hard_negatives.mine(spark, vector_frame(spark, rows))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_negatives(rows)
    assert hard_negatives.mine(spark, vector_frame(spark, rows).limit(0)).count() == 0


def test_blocks_that_no_window_meets_are_not_read(spark, monkeypatch):
    """Of clusters far apart, an anchor's positives need the blocks of its own cluster alone."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rng = np.random.default_rng(4)
    rows = [(k, (np.eye(8)[k % 8] * 50 + rng.normal(size=8)).tolist(), 1) for k in range(1024)]
    whole = hard_negatives.table(hard_negatives.ordered(hard_negatives.quantised(vector_frame(spark, rows), 256, 7).withColumn("label", F.lit(1).cast("long"))).select("*", F.monotonically_increasing_id().alias("rid")), "rows")
    blocks = hard_negatives.table(hard_negatives.blocked(whole), "blocks")
    assert blocks.agg(F.sum("n")).first()[0] == 1024
    anchors = whole.where("vec_id % 50 = 0").withColumns({"since": F.array(F.lit(100_000_000)).cast("array<long>"), "until": F.array(F.lit(2**62))})
    frames = hard_negatives.table(hard_negatives.framed(anchors, 1), "frames")
    links = hard_negatives.chosen(frames, hard_negatives.paged(blocks), True, 1, False)
    needed = sum(sum(bytes(r.needed)) for r in links.collect())
    assert 0 < needed <= 0.3 * anchors.count() * blocks.count()


def test_hilbert_keys_are_neighbours():
    """Along the curve each step of a full grid changes one dimension by one."""
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hard_negatives.hilbert_keys(grid, 3)
    path = grid[sorted(range(len(grid)), key=lambda k: keys[k])]
    assert len(set(keys)) == 512 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("size", [10, 2**27, 2**40])
def test_products_are_exact(size):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-size, size, (5, 3)), rng.integers(-size, size, (4, 3))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    if max(abs(v) for r in want for v in r) < 2**62:
        assert hard_negatives.products(a, b).tolist() == want
    else:
        with pytest.raises(OverflowError):
            hard_negatives.products(a, b)
    least, most = hard_negatives.bounds(a, b.min(axis=0)[None, :], b.max(axis=0)[None, :])
    assert all(least[k, 0] <= min(want[k]) and max(want[k]) <= most[k, 0] for k in range(len(a)))


# whitening


@pytest.mark.parametrize("high", [3, 1000, 2**31, 2**45])
def test_cross_products(high):
    rng = np.random.default_rng(high % 97)
    x = rng.integers(-high, high, (150, 5))
    got = whitening.cross_products(x)
    one = [[1, *map(int, r)] for r in x]
    for i in range(6):
        for j in range(i, 6):
            assert got[i, j] == sum(r[i] * r[j] for r in one)


def test_whitening(spark):
    rows = [r for r in odd_vectors(5) if r[1] is None or len(r[1]) != 2] + [(4000, [1e30] + [0.0] * 5, 1)]
    got = whitening.whiten(spark, vector_frame(spark, rows), components=4).collect()
    good = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in [*good, (2250, [])])
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for i, v in good if i != 4000])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    off = fit - total / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:4]
    ids = [i for i, _ in good if i != 4000]
    of = defaultdict(list)
    for r in got:
        of[str(r.vec_id)].append(r)
    z = (x - total / n) @ vectors[:, order] / np.sqrt(values[order])
    main = [next(r for r in of[str(i)] if r.deviation == int(((n * v - total) ** 2).sum())) for i, v in zip(ids, x, strict=True)]
    white = np.array([r.whitened for r in main])
    sign = np.sign((white * z).sum(axis=0))
    assert np.abs(white * sign - z).max() < 1e-8
    assert {r.n for r in main} == {n} and max(r.identity_error for r in main) < 1e-9
    assert np.allclose(main[0].explained, values[order] / values.sum(), rtol=1e-9)
    empty, far = of["2250"][0], of["4000"][0]
    assert (empty.n, empty.whitened, empty.deviation) == (0, [], 0)
    assert far.whitened is None and far.deviation is None and far.n is None
    assert whitening.whiten(spark, vector_frame(spark, rows).limit(0)).count() == 0


def test_whitening_without_variance(spark):
    """One different vector, and lengths of their own."""
    rows = [(k, [1.0, 2.0], 0) for k in range(5)] + [(10 + k, [float(k), 2.0 * k, 1.0], 0) for k in range(6)]
    got = {r.vec_id: r for r in whitening.whiten(spark, vector_frame(spark, rows)).collect()}
    assert got[0].whitened == [None, None] and got[0].explained == [0.0, 0.0] and got[0].n == 1 and got[0].identity_error == 0
    line = got[12].whitened
    assert got[12].n == 6 and line[0] is not None and line[1:] == [None, None] and math.isclose(got[12].explained[0], 1.0)


# fingerprints


def words_of(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def jaccard(a, b):
    every = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in every) / sum(max(a[w], b[w]) for w in every) if every else 1.0


def test_edited_texts(spark, odd, odd_rows):
    got = weighted_sampling.with_edits(spark, odd).collect()
    assert len(got) == len(odd_rows)
    distinct = {(i, t or "") for i, t, *_ in odd_rows}
    known = [x for x in distinct if x[0] is not None]
    assert sum(1 for i, _ in distinct if i is None) == 2  # these stand first, in the order of their hashes
    tail = sorted(known)
    digests = {}
    for k, (i, t) in enumerate(tail[:-1]):
        after = tail[k + 1][1]
        digests[i] = (len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest(), t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after)
    for r in got:
        if r.doc_id in digests:
            n, sha, text, edited, after = digests[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, sha)
            assert abs(r.near_edited - jaccard(words_of(text), words_of(edited))) <= 0.45
            assert abs(r.near_next - jaccard(words_of(text), words_of(after))) <= 0.45
            assert (r.near_next == 1.0) == (words_of(text) == words_of(after)) or r.near_next < 1
    by_text = defaultdict(set)
    for r in got:
        by_text[next((t or "" for i, t, *_ in odd_rows if i == r.doc_id), "") if r.doc_id is not None else r.edited_sha256].add(tuple(r.signature))
    assert all(len(v) == 1 for v in by_text.values())
    assert weighted_sampling.with_edits(spark, odd.limit(0)).count() == 0
    one = weighted_sampling.with_edits(spark, spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()[:64] or one.n_chars == 7


def test_collisions_equal_weighted_jaccard(spark):
    """Over many samples of words that no two pairs share, the rate comes near the similarity, for counts of 1 to 9."""
    random.seed(6)
    rows = []
    for k in range(60):
        a = [w for j in range(30) for w in [f"p{k}w{j}"] * random.randint(0, 9)]
        b = [w for j in range(30) for w in [f"p{k}w{j}"] * random.randint(0, 9)]
        rows.append((k, " ".join(a), " ".join(b)))
    found = weighted_sampling.signatures(spark.createDataFrame(rows, "k int, a string, b string"), ["k"], ["a", "b"], 64)
    got = {r.k: r.near for r in found.select("k", weighted_sampling.likeness(F.col("a_signature"), F.col("b_signature")).alias("near")).collect()}
    off = [got[k] - jaccard(words_of(a), words_of(b)) for k, a, b in rows]
    assert abs(np.mean(off)) < 4 * 0.5 / math.sqrt(60 * 64) and max(map(abs, off)) < 0.3


def test_fingerprints_run_in_the_jvm(spark, odd):
    plan = weighted_sampling.with_edits(spark, odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
