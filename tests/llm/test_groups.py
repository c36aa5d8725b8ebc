"""Operators that compare rows: lines, passages, near duplicates, vectors, mixing, and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import plain
from tokenizers import Tokenizer

from carbonloom.llm import boosted_rules, common, docstats, jaccard_join, line_dedup, mixing, near_vectors, queries, suffix_dedup
from carbonloom.llm.common import components
from tests.llm.conftest import text_of


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("at_once", [3, 100_000])
def test_components(spark, monkeypatch, at_once):
    """With nearly all work left to the steps over all edges, and with most of it done in the tasks."""
    monkeypatch.setattr(common, "EDGES_AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    random.seed(2)
    pairs = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 960)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    want = roots([p for p in pairs if p[0] != p[1]], {i for p in pairs if p[0] != p[1] for i in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if docs[key(x)] < least or not key(x)]
        out.append((str(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, odd, odd_rows, least):
    rows = line_dedup.drop_shared_lines(spark, odd, min_docs=least, batches=3).collect()
    assert sorted((str(r.doc_id), r.line_count, r.line_dropped, r.text) for r in rows) == plain_lines([r[:2] for r in odd_rows], least)
    assert line_dedup.drop_shared_lines(spark, odd.limit(0)).count() == 0
    assert rows[0].lang in ("en", "de", None)


def test_lines_of_rows_without_doc_id(spark):
    """Each loses its own shared lines only, whatever other rows without doc_id hold."""
    rows = [(None, f"line {k}\nfooter {k % 2}") for k in range(30)] + [(7, f"other {k}\nfooter 0") for k in range(3)] + [(None, "line 3\nfooter 1")] * 3
    got = line_dedup.drop_shared_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10, batches=4).collect()
    assert sorted((str(r.doc_id), r.line_count, r.line_dropped, r.text) for r in got) == plain_lines(rows, 10)


def test_runs_are_merged_as_they_lie(spark):
    """Neither the anti join of a batch nor a merge of runs shuffles or sorts a run."""
    hashes = common.table(spark.range(4000).selectExpr("cast(cast(id % 1500 as string) as binary) h"), "hashes")
    with line_dedup.LineRuns(spark, 2) as runs:
        runs.fan_in = 9
        runs.add(hashes)
        runs.add(hashes)
        new = hashes.groupBy("h").agg(common.F.count("*").alias("n"))
        plan = new.join(spark.table(runs.levels[0][0]).where("n >= 2").select("h").hint("merge"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1  # those of the batch
        plan = runs._merged(runs.levels[0])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan
        assert {bytes(r.h).decode() for r in runs.frequent().collect()} == {str(k) for k in range(1500)}


def plain_repeats(rows):
    out, data = [], [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        gone = np.zeros(len(b), bool)
        if i is not None:
            seen = {o[k : k + 50] for j, o in data if j is not None and j < i for k in range(len(o) - 49)}
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    gone[k : k + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((str(i), len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def test_repeats_of_odd_rows(spark, odd, odd_rows):
    rows = suffix_dedup.remove_repeats(spark, odd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == plain_repeats([r[:2] for r in odd_rows])
    assert suffix_dedup.remove_repeats(spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats_of_mixed_passages(spark, most):
    """Also with doc_ids that several texts share, and cut into parts."""
    random.seed(8)
    pool = ["".join(random.choice(random.choice(["ab", "a", "abc é\n", "xyz"])) for _ in range(random.randint(30, 200))) for _ in range(8)]
    rows = [(k // (1 + k % 3), "".join(random.choice(pool)[random.randint(0, 20) : random.randint(20, 200)] for _ in range(random.randint(0, 6)))) for k in range(60)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), most).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_repeats(rows)


def test_repeats_of_texts_that_share_a_doc_id(spark):
    p, q, r = (text_of(k, 60) for k in (1, 2, 3))
    for rows in ([(0, p), (1, q + r + p), (1, "a short text of some fifty bytes and a little more than that")], [(0, p), (1, p + q), (1, q[:100] + r)], [(2, p + q)] * 3 + [(1, q)] * 2):
        got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == plain_repeats(rows)


def test_a_common_phrase_parts_company(spark):
    """Windows around a phrase of 35 bytes that all texts share, and some copies among them, with small parts."""
    phrase = "this very phrase stands everywhere."
    rows = [(k, f"{text_of(k, 9)} {phrase} {text_of(1000 + k // 2, 9)}") for k in range(90)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == plain_repeats(rows)


def test_two_stage_sort_finds_repeated_windows():
    random.seed(1)
    for _ in range(100):
        data = [b"a" * random.randint(50, 90) if random.random() < 0.3 else bytes(random.choice(b"ab\x00z\xff") for _ in range(random.randint(50, 120))) for _ in range(4)]
        docs = np.array([random.randint(1, 3) for _ in data])
        segment, offset = suffix_dedup.repeated_windows(docs, np.array([len(x) - 49 for x in data]), np.frombuffer(b"".join(data), np.uint8))
        want = {(k, p) for k in range(4) for p in range(len(data[k]) - 49) if any(data[k][p : p + 50] in data[j] for j in range(4) if docs[j] < docs[k])}
        assert set(zip(segment.tolist(), offset.tolist(), strict=True)) == want


def plain_jaccard(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    good = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    order = {k: n for n, k in enumerate(sorted(good, key=lambda k: rows[k][0]))}  # texts that share a doc_id are documents of their own
    pairs = [(order[a], order[b]) for x, a in enumerate(good) for b in good[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component, of = roots(pairs, set(order.values())), {n: rows[k][0] for k, n in order.items()}
    return sorted((str(i), len(s), str(of[component[order[k]]] if k in order else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_shingles_of_many_texts_at_once(monkeypatch):
    """As sets of word n-grams, wherever a text stands among others; words are not hashed one by one."""
    random.seed(11)
    texts = [" ".join(random.choice(["a", "B", "b", "ab", "ba", "é", "\x85", "x" * 40, "c\x00", "c"]) for _ in range(random.choice([0, 1, 3, 4, 5, 6, 40, 300]))) for _ in range(300)]
    texts = [x.replace(" ", random.choice(" \t\n\v\f\r") * random.randint(1, 3)).encode() for x in texts] + [b" ", b" a B\n", b"\tA b c D e "]
    plain = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    calls, digest = [], jaccard_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard_join.xxhash, "xxh3_64_intdigest", lambda *a: calls.append(a) or digest(*a))
    monkeypatch.setattr(jaccard_join, "HASHED", 2000)
    got = jaccard_join.shingles_of(texts, 5)
    assert len(calls) <= sum(0 < len(x.split()) < 5 for x in texts)
    of = {}
    for text, found in zip(texts, got, strict=True):
        want = plain(text.lower().split())
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
        of.setdefault(frozenset(want), set()).add(found.tobytes())
        assert jaccard_join.shingles_of([text], 5)[0].tobytes() == found.tobytes()
    assert all(len(x) == 1 for x in of.values())
    grams = {g for want in of for g in want}
    assert len(np.unique(np.concatenate(got))) == len(grams)


def test_near_duplicates_of_texts_that_share_a_doc_id(spark):
    a, b, c = (text_of(k, 80) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (5, b), (7, b + " end"), (9, a + " end"), (9, c), (3, c + " more")]
    got = jaccard_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_jaccard(rows)


def test_near_duplicates_of_odd_rows(spark, odd, odd_rows):
    rows = jaccard_join.near_duplicates(spark, odd).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_jaccard([r[:2] for r in odd_rows])
    assert jaccard_join.near_duplicates(spark, odd.limit(0)).count() == 0


def test_near_duplicates_in_a_loose_group(spark):
    """Variants of one text, about as far from each other as the bound: many pairs link, many just fail."""
    random.seed(5)
    base = text_of(9, 120).split()
    rows = [(k, " ".join(f"x{random.randint(0, 40)}" if random.random() < random.choice([0.005, 0.02, 0.04]) else w for w in base)) for k in range(120)]
    rows += [(200 + k, " ".join(base[: 60 + k])) for k in range(40)] + [(300, "Few WORDS"), (301, "few words"), (302, "few")]
    got = jaccard_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_jaccard(rows)


def plain_vectors(rows, bound=0.9):
    good = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    order = {k: n for n, k in enumerate(sorted(good, key=lambda k: rows[k][0]))}  # vectors that share a vec_id stand for themselves
    links, pairs = Counter(), []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= bound:
                links[a] += 1
                links[b] += 1
                pairs.append((order[a], order[b]))
    component, of = roots(pairs, set(order.values())), {n: rows[k][0] for k, n in order.items()}
    return sorted((str(i), links[k], str(of[component[order[k]]] if k in order else i)) for k, (i, _) in enumerate(rows))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3])).tolist()) for k in range(300)]
    rows += [(k % 50, (centres[k % 7] + rng.normal(size=16) * 0.1).tolist()) for k in range(60)]  # further vectors of known vec_ids
    rows += [(400, [1.0, 0.0]), (401, [2.0, 0.0]), (402, [0.0, 0.0]), (403, None), (404, [1.0, None]), (405, [float("nan"), 1.0]), (406, [float("inf"), 1.0]), (None, [1.0, 0.0]), (407, []), (400, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, n_links double")
    got = near_vectors.near_duplicates(spark, frame).collect()
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain_vectors(rounded)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors.near_duplicates(spark, frame.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    """Cosines neither overflow nor vanish with the size of the parts."""
    size = {1: 1.0, 2: 1e-200, 3: 1e200, 4: 1e-310, 5: 1.7e308}
    near, far = (1.0, 1.0), (1.0, 0.1)
    rows = [(10 * k + n, [s * v[0], s * v[1]]) for k, s in size.items() for n, v in enumerate((near, far))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 10 + i % 10) for i, _ in rows}


def test_vector_cells_find_the_links(spark, monkeypatch):
    """Many small cells, blocks of a few rows: recall against brute force, and no link counted twice."""
    monkeypatch.setattr(near_vectors, "CELL", 20)
    monkeypatch.setattr(near_vectors, "BLOCK_BYTES", 16 * 8 * 32)
    monkeypatch.setattr(near_vectors, "AT_ONCE", 5)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    rows = [(k, (centres[k % 60] + rng.normal(size=32) * 0.12).tolist()) for k in range(600)] + [(1000 + k, (centres[0] + rng.normal(size=32) * 0.1).tolist()) for k in range(200)]
    got = near_vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = {i: n for i, n, _ in plain_vectors([(i, np.float32(v).astype(float).tolist()) for i, v in rows])}
    found = {str(r.vec_id): r.n_links for r in got}
    assert all(found[i] <= n for i, n in want.items()) and sum(found.values()) >= 0.97 * sum(want.values())


def test_mixing_of_odd_rows(spark, odd, odd_rows):
    rows = mixing.mix(spark, odd).collect()
    assert len(rows) == len(odd_rows) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark, odd).collect()))
    by, size = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.mix_copies <= 2
        by[r.source] += r.mix_copies * r.mix_size
        size[r.source] += r.mix_size
    assert {r.source: r.mix_source_size for r in rows} == dict(size)
    target = {r.source: r.mix_target for r in rows}
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values())) and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert mixing.mix(spark, odd.limit(0)).count() == 0


def test_many_rows_without_doc_id_are_not_one_slice(spark):
    """Their order comes from their texts; each is a document of its own."""
    docs = spark.createDataFrame([(None, text_of(k, 20), "a") for k in range(300)] + [(1, text_of(9, 20), "b")], "doc_id long, text string, source string")
    rows = mixing.mix(spark, docs, carry=("text",)).collect()
    assert len({r.text for r in rows}) == len({text_of(k, 20) for k in range(300)}) and len(rows) == 301
    assert abs(sum(r.mix_copies * r.mix_size for r in rows if r.source == "a") - max(r.mix_target for r in rows if r.source == "a")) <= 40


def test_a_dual_that_does_not_converge_is_an_error(spark):
    sources = spark.createDataFrame([("a", 100, 150.0)], "source string, size long, target double")
    stats = spark.createDataFrame([("a", 10, 10)], "source string, size long, docs long")
    assert abs(mixing.tilts(sources, stats).first().tilt - math.log(1.5)) < 1e-9
    with pytest.raises(RuntimeError, match="converged"):
        mixing.tilts(sources, stats, rounds=1)


def test_mixing_comes_near_the_targets(spark):
    rows = queries.op8_mixing(spark, "/root/testdata/sf0.1").groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 0.02 * r.target for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def test_queries_over_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op7_jaccard_join(spark, d).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_jaccard(docs)
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.op5_near_vectors(spark, d).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain_vectors(vectors)


def plain_verdict(trees, text):
    """Base rules, then the trees from node to node."""
    counts, features = docstats.statistics((text or "").encode())
    total = trees.start
    for k in range(len(trees.feature)):
        at = 0
        for _ in range(trees.depth):
            at = 2 * at + (2 if features[trees.feature[k, at]] > trees.threshold[k, at] else 1)
        total += trees.value[k, at]
    return counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0] and total >= 0


def plain_mix(rows):
    """Copies of each (doc_id, text, source): targets by raising a common level, then rounding along the order."""
    size = lambda t: len((t or "").split())
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, t))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size(t) for _, t in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(own.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * own[s], level * weight[s]) for s in names) < 1.5 * sum(own.values()) else (low, level)
    out = {}
    for s in names:
        rate = round(min(2 * own[s], high * weight[s]) / own[s], 9) if own[s] else 0
        kind = lambda n: n if n < 32 else n.bit_length() * 32 + (n >> (n.bit_length() - 5))
        order = []
        for i, t in by[s]:
            digest = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
            order.append((kind(size(t)), digest[:2], digest, i, t))
        done = 0
        for _, _, _, i, t in sorted(order):
            done += size(t) > 0
            out[i, t] = math.floor(done * rate + 0.5) - math.floor((done - 1) * rate + 0.5) if size(t) else 0
    return out


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given = docs.collect()
    trees = boosted_rules.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        frames.append((name, docs.collect()))
    kept, lines, near, mixed, encoded = (rows for _, rows in frames)
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given if plain_verdict(trees, r.text)) and kept
    assert 0 < len(near) <= len(lines) == len(kept)
    want = plain_lines([(r.doc_id, r.text) for r in kept], 10)
    assert sorted((str(r.doc_id), r.text) for r in lines) == [(w[0], w[3]) for w in want]
    groups = plain_jaccard([(r.doc_id, r.text) for r in lines])
    assert sorted(str(r.doc_id) for r in near) == sorted(i for i, _, c in groups if i == c)
    assert Counter((r.doc_id, r.text) for r in mixed) == +Counter(plain_mix([(r.doc_id, r.text, r.source) for r in near]))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, encoded)) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(want)


def test_pipeline_of_odd_and_empty_tables(spark, odd, odd_rows, tmp_path):
    """Nulls, repeats and columns of clashing names go through; an empty table comes out empty."""
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        rows.withColumn("n_chars", common.F.char_length("text").cast("long")).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in odd_rows} and out
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def stage_rows(spark, rows):
    """(doc_id, text, source) as a stage's table."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_stage_with_repeated_ids(spark):
    """A text goes for its own copies only, not for another text of its doc_id."""
    a, near = text_of(1, 80), text_of(1, 80).replace("dog", "cat", 1)
    rows = [(3, a), (5, near), (5, text_of(2, 80)), (5, text_of(2, 80)), (6, text_of(3, 80)), (6, text_of(3, 80) + " end"), (7, text_of(2, 80)), (None, a), (None, near), (8, None), (8, "")]
    got = corpus_pipeline.near_duplicates(spark, stage_rows(spark, [(*r, "a") for r in rows]), "").collect()
    kept = Counter((r.doc_id, r.text) for r in got)
    of_six = [k for k in kept if k[0] == 6]
    assert len(of_six) == 1 and kept[of_six[0]] == 1
    del kept[of_six[0]]
    assert kept == Counter([rows[0], rows[2], rows[3], *rows[7:]])


def test_mix_stage_with_repeated_and_null_ids(spark):
    """Each row as often as the mix takes it, also where others share its doc_id."""
    rows = [(k // 4, text_of(k, 20 + k % 30), "abc"[k % 3]) for k in range(240)]
    rows += [(None, text_of(500 + k, 25), "c") for k in range(40)] + [(None, None, "c"), (None, "", None), (1, "", "a")]
    rows += [(900, text_of(900, 40), "a")] * 7
    docs = stage_rows(spark, rows)
    size = lambda t: len((t or "").split())
    want, target = Counter(), {}
    for r in mixing.mix(spark, docs).collect():
        want[r.source] += r.mix_copies * r.mix_size
        target[r.source] = r.mix_target
    got = corpus_pipeline.mix(spark, docs, "").collect()
    taken = Counter()
    for r in got:
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items()) and all(abs(taken[s] - n) <= 60 for s, n in want.items())
    assert any(r.doc_id is None for r in got) and all(size(r.text) for r in got)
    per_row = Counter((r.doc_id, r.text) for r in got)
    assert max(n for k, n in per_row.items() if k[0] != 900) <= 2 and 0 < per_row[rows[-1][:2]] <= 14
