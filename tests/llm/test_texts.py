"""Operators that look at one text at a time: encoding, personal data, quality, licenses."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carbonloom.llm import boosted_rules, docstats, license_scan, pii, pu_quality, queries, sampling, tree_bpe
from tests.llm.conftest import text_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_tree_encoding_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "LEAF", 16)
    monkeypatch.setattr(tree_bpe, "UNIT", 12)
    random.seed(4)
    own = tree_bpe.Encoder(PATH)
    pools = ["abcdeéÉ", "ab'stlreSd", "\"'!?.,-'#", "0123456789", " \n\t", "中文字", "́   ", "<|endoftext|>", "ñÑüÜßİ"]
    for k in range(1500):
        pool = "".join(random.sample(pools, random.randint(1, 5)))
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 150)))
        text += "<|endoftext|>" * (k % 7 == 0)
        own.clear()
        if k % 2:
            own.learn([text.encode()])
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_windows_go_through_the_tokenizer(monkeypatch):
    """A part whose tokens at a join are wrong is found out: the window does not agree, and grows past them."""
    monkeypatch.setattr(tree_bpe, "LEAF", 64)
    own = tree_bpe.Encoder(PATH)
    text = text_of(3, 60)
    cut = len(text) // 2
    left, right = own.node(text, 0, cut), own.node(text, cut, len(text))
    want = own.node(text, 0, len(text))
    assert own.united(text, left, right, 0, cut, len(text)) == want
    spoilt = [*left[:-3], b"xxxx", *left[-2:]]
    assert own.united(text, spoilt, right, 0, cut, len(text)) == want
    assert own.window(text) == own.units(text)


def test_a_tokenizer_whose_tokens_cross_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        tree_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoding_of_given_documents(spark, library):
    """The query against the library on all documents of a given table."""
    d = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {}
    for (i, _), f in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        decoded = library.decode(f.ids, skip_special_tokens=False)
        want[i] = (len(f.ids), hashlib.sha256(np.array(f.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op2_tree_bpe(spark, d).collect()} == want


def test_encoding_of_odd_rows(spark, odd, odd_rows, library):
    rows = tree_bpe.encode(spark, odd, PATH).collect()
    want = sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.bpe_ids), "<u4").tolist()) for r in rows) == want
    assert tree_bpe.encode(spark, odd.limit(0), PATH).count() == 0


def test_long_texts_are_joined_from_parts(spark, library, monkeypatch):
    text = ("a" * 5000 + "bc'll " + "x1" * 900) * 12
    frame = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = tree_bpe.encode(spark, frame, PATH).collect()
    want = library.encode(text, add_special_tokens=False).ids
    assert len(text) > tree_bpe.PART and len(rows) == 3
    assert all(np.frombuffer(bytes(r.bpe_ids), "<u4").tolist() == want for r in rows)


def plain_spans(text):
    """The base forms, by the plain expressions."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_expressions():
    random.seed(3)
    for _ in range(20000):
        pool = random.choice(["ab@.-", "0123456789.", "01 -", "+0123 ().-", "a@b.c0+ 1-.", "0.25"])
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_contexts_discover_unseen_identifiers(spark, odd, odd_rows):
    rows = [(k, f"reach me, phone: +1 (555) 010-{1000 + k} today") for k in range(30)] + [(100, "the phone: 555-010-7777 there"), (101, "a code 555-010-8888 stays")]
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == [(3, 11, 23)] and found[101] == [] and not any(found[k] for k in range(30))
    out = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in pii.find(spark, odd).collect())
    assert out == sorted((str(r[0]), plain_spans(r[1] or "")) for r in odd_rows)
    assert pii.find(spark, odd.limit(0)).count() == 0


def test_contexts_on_both_sides_far_away_and_long(spark):
    """A label far before or behind, of any length; labels that only differ late; support from found strings."""
    long = "label" * 30
    rows = [(k, f"reach{' ' * 90}+1 (555) 010-{1000 + k}") for k in range(8)] + [(20, f"reach{' ' * 120}555-010-7777")]
    rows += [(100 + k, f"{long}A: +1 (555) 020-{1000 + k}") for k in range(8)] + [(120, f"{long}A: 555-020-7777"), (121, f"{long}B: 555-020-8888")]
    rows += [(200 + k, f"+1 (555) 030-{1000 + k} mobile") for k in range(8)] + [(220, "555-030-7777 mobile")]
    rows += [(300 + k, f"our hot line +1 (555) 040-{1000 + k}") for k in range(8)] + [(320, "hot line 555-040-7777"), (321, "a line 555-040-8888")] + [(330 + k, "line after line of text") for k in range(9)]
    rows += [(400 + k, f"tel={k}{k}5-555-7777, tel={k}{k}5-555-7777") for k in range(4)] + [(410 + k, f"tel=+1 (555) 050-{1000 + k}") for k in range(8)] + [(420 + k, f"ring {k}{k}5-555-7777") for k in range(4)] + [(430, "ring 335-556-1111")]
    rows += [(500, "reach\n555-010-9999"), (501, None), (501, None), (None, "reach 555-010-7778")]
    found = {}
    for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append([tuple(s) for s in r.found])
    expected = {20: [(3, 125, 137)], 120: [(3, 153, 165)], 121: [], 220: [(3, 0, 12)], 320: [(3, 9, 21)], 321: [], 430: [(3, 5, 17)], 500: []}
    assert {k: found[k][0] for k in expected} == expected
    assert all(len(found[k][0]) == 2 for k in range(400, 404)) and all(len(found[k][0]) == 1 for k in range(420, 424))
    assert found[501] == [[], []] and found[None] == [[(3, 6, 18)]]


def test_context_words_are_counted_as_they_are_named():
    """All words and pairs, and those of a known set only, named as contexts name them."""
    texts = ["a b: c=d  e", "Phone:+1 <x> (y) \"z\" [q]", " ", "Ünï " + "W" * 80 + "\nend a b:", "Ü" * 40 + " " + "é" * 30, ""]
    want = Counter()
    for t in texts:
        words = [m[0] for m in pii._WORD.finditer(t)]
        want.update(pii._named(x).encode() for x in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]])
    raw = [t.encode() for t in texts]
    assert pii.occurrences_of(raw, None) == want
    for known in (frozenset(want), frozenset([b"a b:", b"end", b"q"]), frozenset([pii._named("W" * 80).encode()]), frozenset([pii._named("W" * 80 + " end").encode()]), frozenset([b"no"])):
        assert pii.occurrences_of(raw, known) == Counter({k: n for k, n in want.items() if k in known})


def test_patterns_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(k, f"reach me, phone: +1 (555) 010-{1000 + k} today") for k in range(30)] + [(100, "the phone: 555-010-7777 there"), (101, "a code 555-010-8888 stays")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted((r.doc_id, r.found) for r in pii.find(spark, frame).collect())
    monkeypatch.setattr(pii, "MOST_BROADCAST", 0)
    assert sorted((r.doc_id, r.found) for r in pii.find(spark, frame).collect()) == few


def test_chains_of_patterns_are_followed_to_the_end(spark):
    """Each label stands by four identifiers of the one before: 20 labels take as many rounds; too few rounds are an error."""
    from carbonloom.llm.common import delete
    from carbonloom.sources.shared import shared_folder

    rows = [(k, f"label0: +1 (555) 010-{1000 + k}") for k in range(12)]
    number = lambda step, k: f"{200 + step}-555-{1000 + k}"
    for step in range(20):
        for k in range(6):
            rows += [(1000 + 10 * step + k, f"label{step}: {number(step, k)}"), (2000 + 10 * step + k, f"label{step + 1}: {number(step, k)}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName().rsplit("-", 1)[0] for f in files.listStatus(path)}
    for f in files.listStatus(path):
        if f.getPath().getName().startswith("pii-"):
            delete(spark, f.getPath().toString())
    found = {r.doc_id: len(r.found) for r in pii.find(spark, frame).collect()}
    assert all(found[1000 + 10 * s + k] == found[2000 + 10 * s + k] == 1 for s in range(20) for k in range(6))
    assert not names() & {"pii-graph", "pii-edges", "pii-patterns"}
    with pytest.raises(RuntimeError, match="still change"):
        pii.find(spark, frame, rounds=5)


def test_patterns_without_support_say_nothing(spark):
    """Strings by a label that no fixed form stands by are not held to be personal data; where the label is frequent, rounds must not go back and forth."""
    rows = [(k, f"code 1234 5678 9012 345{k}") for k in range(4)] + [(10 + k, f"serial 2234 5678 9012 345{k}") for k in range(4)] + [(20 + k, "serial " * 10) for k in range(4)]
    out = pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), rounds=20).collect()
    assert len(out) == len(rows) and not any(r.found for r in out)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in many for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_statistics_equal_plain_counts(odd_rows):
    random.seed(6)
    texts = [r[1] or "" for r in odd_rows] + ["\n".join(" ".join(random.choice("ab#é") for _ in range(random.randint(0, 14))) for _ in range(random.randint(0, 6))) for _ in range(800)]
    for text in texts:
        assert docstats.statistics(text.encode())[0] == plain_statistics(text), text[:80]


def test_trees_are_monotonic_and_separate():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=2000) < 0.05)).astype(float)
    t = boosted_rules.fit(x, y, np.ones(2000), np.array([-1, 0, 0]))
    assert ((t.score(x) > 0.5) == y).mean() > 0.93
    grid = np.tile(rng.uniform(size=(50, 1, 3)), (1, 30, 1))
    grid[:, :, 0] = np.linspace(0, 1, 30)
    assert (np.diff(t.score(grid.reshape(-1, 3)).reshape(50, 30), axis=1) <= 1e-12).all()
    assert len(boosted_rules.fit(np.zeros((0, 3)), np.zeros(0), np.zeros(0), np.zeros(3)).score(np.zeros((0, 3)))) == 0


def test_trees_equal_a_walk_from_node_to_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    t = boosted_rules.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), np.ones(400), np.array([1, 0, -1, 0]))
    for row, got in zip(x, t.score(x), strict=True):
        total = t.start
        for k in range(len(t.feature)):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + (2 if row[t.feature[k, at]] > t.threshold[k, at] else 1)
            total += t.value[k, at]
        assert math.isclose(got, 1 / (1 + math.exp(-total)))


@pytest.mark.parametrize("repeats", [("one text", 300), ("many texts", 300)])
def test_samples_are_bounded_where_a_doc_id_repeats(spark, repeats):
    """A doc_id in most of the rows brings no more rows to the driver than the bound; clashing labels count for nothing."""
    kind, n = repeats
    rows = [(7, text_of(k if kind == "many texts" else 7, 30)) for k in range(n)] + [(100 + k, text_of(k, 30)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = sampling.sample(sampling.text_rows(docs).withColumn("part", sampling.F.lit(1)), 50, 1)
    x, y = sampling.fetch(docs, keys, "part")
    assert len(x) == len(y) == (50 if kind == "many texts" else 41)
    clash = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (4, 0), (4, None), (None, 1), (6, 5)], "doc_id long, quality int")
    got = {r.doc_id: r.quality for r in sampling.agreed(clash).collect()}
    assert got == {k: v for k, v in {2: 1, 4: 0}.items() if zlib.crc32(str(k).encode()) % 5}
    assert len(boosted_rules.judge(spark, docs, clash, 20).collect()) == len(pu_quality.score(spark, docs, clash).collect()) == len(rows)


def test_quality_rules_on_odd_rows(spark, odd, labels, odd_rows):
    rows = boosted_rules.judge(spark, odd, labels).collect()
    assert len(rows) == len(odd_rows) and not any(r.kept and r.base_failed for r in rows)
    want = sorted((str(r[0]), *plain_statistics(r[1] or "")) for r in odd_rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert boosted_rules.judge(spark, odd.limit(0), labels.limit(0)).count() == 0


def test_verdicts_do_not_depend_on_the_sample(spark):
    """Borderline texts, 7 in 10 of them good, among clean ones: a capped sample keeps them as the whole does."""
    random.seed(7)
    rows = [(k, text_of(k, 40) + " wow!! so!! good!!" * (k % 10 < 3), int(random.random() < (0.7 if k % 10 < 3 else 0.95))) for k in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    whole, capped = ({r.doc_id: r.kept for r in boosted_rules.judge(spark, docs, known, most).collect()} for most in (8000, 120))
    assert sum(whole.values()) >= 0.95 * len(rows)
    assert sum(whole[k] != capped[k] for k in whole) <= 0.05 * len(rows)


def held_out_accuracy(rows, labelled, score):
    held = [(score(r), labelled[r.doc_id]) for r in rows if r.doc_id in labelled and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(s == y for s, y in held) / len(held)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op1_pu_quality(spark, d).collect()
    assert held_out_accuracy(rows, labelled, lambda r: r.predicted) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert held_out_accuracy(queries.op10_quality_rules(spark, d).collect(), labelled, lambda r: int(r.kept)) > 0.93


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (900, 4))
    mixed = np.concatenate([good[1000:], bad])
    rng.shuffle(mixed)
    prior = pu_quality.estimate_prior(good[:1000], mixed)
    assert abs(prior - 2000 / 2900) < 0.1
    s = pu_quality.fit(good[:1000], mixed, prior)
    assert (s.score(bad) < 0.3).mean() > 0.95 and (s.score(good) >= 0.3).mean() > 0.95


@pytest.mark.parametrize("prior", [None, 0.6, 0.1])
def test_risk_gradient_against_a_loop_over_rows(prior):
    """The first step of the fit goes against the numeric gradient of the risk, summed row by row."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (30, 3)), rng.normal(0, 1, (50, 3))

    def risk(s):
        loss = lambda x, sign: sum(math.log1p(math.exp(-sign * z)) for z in (math.log(q / (1 - q)) for q in s.score(x))) / len(x)
        if prior is None:
            return loss(p, 1) + loss(u, -1)
        negative = loss(u, -1) - prior * loss(p, -1)
        return prior * loss(p, 1) + negative if negative >= 0 else -negative

    start, moved = (pu_quality.fit(p, u, prior, steps=n, rate=1e-5, units=4, decay=0) for n in (0, 1))
    for name in ("w1", "b1", "w2", "b2"):
        a, b = getattr(start, name), getattr(moved, name)
        for k in np.ndindex(a.shape):
            old = a[k]
            sides = []
            for d in (1e-5, -1e-5):
                a[k] = old + d
                sides.append(risk(start))
            a[k] = old
            slope = (sides[0] - sides[1]) / 2e-5
            assert abs(slope) < 1e-6 or np.sign(b[k] - a[k]) == -np.sign(slope)


def test_scores_on_odd_rows(spark, odd, labels, odd_rows):
    rows = pu_quality.score(spark, odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in pu_quality.score(spark, odd, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.score(spark, odd.limit(0), labels).count() == 0


def test_license_notices(spark, odd):
    names = lambda text: [n["license"] for n in license_scan.notices(text.encode())]
    for name, text in license_scan.TEMPLATES.items():
        assert names(text) == [name]
    for text, name in [("Licensed under the Apache License, Version 2.0!", ["Apache-2.0"]), ("Licensed under the Apache License, Version 1.1.", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("A driving licence is needed here.", [])]:
        assert names(text) == name
    for text, name in [("it may be distributed under the terms of the GPL v3, or not", ["GPL-3.0-terms"]), ("# SPDX-License-Identifier: MIT", ["MIT-spdx"]), ("photo by someone, CC BY 4.0, cropped", ["CC-BY-4.0-bare"]), ("https://creativecommons.org/licenses/by/4.0/", ["CC-BY-4.0-page"])]:
        assert names(text) == name
    for text, name in [
        ("Apache License\nVersion 2.0, January 2004", ["Apache-2.0-title"]), ("GNU GENERAL PUBLIC LICENSE\n  Version 3", ["GPL-3.0-name"]), ("# MIT License\n\nCopyright", ["MIT-name"]), ("it is GPLv2 or later", ["GPL-2.0-or-later-name"]),
        ("photo: CC-BY-4.0", ["CC-BY-4.0-id"]), ("Released under the BSD 3-Clause License", ["BSD-3-Clause-name"]), ("Creative Commons Attribution-ShareAlike 3.0 Unported", ["CC-BY-SA-3.0-name"]), ("Eclipse Public License - v 2.0", ["EPL-2.0-name"]),
        ("the Artistic License 2.0", ["Artistic-2.0-name"]), ("GNU Free Documentation License, Version 1.3 or any later version", ["GFDL-1.3-name"]), ("// SPDX-License-Identifier: EPL-2.0", ["EPL-2.0-spdx"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT-spdx", "Apache-2.0-spdx-or"]),
        ("SPDX-License-Identifier: GPL-2.0-only AND (BSD-3-Clause OR MPL-2.0)", ["GPL-2.0-only-spdx", "BSD-3-Clause-spdx-and", "MPL-2.0-spdx-or"]),
    ]:
        assert names(text) == name, text
    header = license_scan.TEMPLATES["Apache-2.0-header"]
    assert names("\n".join(f"// {x}" for x in textwrap.wrap(header, 60)).replace("governing", "covering")) == ["Apache-2.0-header"]
    assert names("Copyright 2020 Someone\n\n" + textwrap.fill(license_scan.TEMPLATES["BSD-3-Clause-full"], 70).replace("COPYRIGHT HOLDERS", "REGENTS")) == ["BSD-3-Clause-full"]
    rows = [(1, "words\nfoo bar. All rights reserved.\nReleased under the MIT License."), (2, None), (3, "license"), (3, "license")]
    out = {r.doc_id: [(n.line, n.sentence, n.license) for n in r.notices] for r in license_scan.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [(1, 1, "reserved"), (2, 0, "MIT")], 2: [], 3: []}
    assert license_scan.scan(spark, odd).count() == odd.count() and license_scan.scan(spark, odd.limit(0)).count() == 0


def test_notices_wrapped_embedded_and_together(spark):
    texts = license_scan.TEMPLATES
    pairs = list(zip(texts, [*texts][1:] + [*texts][:1], strict=True))
    rows = [(name, [name], t) for name, t in texts.items()]
    rows += [(f"{name} wrapped", [name], "some words\n" + "".join(f" * {x}\n" for x in textwrap.wrap(t, 24, break_long_words=False, break_on_hyphens=False)) + "more words") for name, t in texts.items()]
    rows += [(f"{name} upper", [name], t.upper()) for name, t in texts.items()]
    rows += [(f"{name} embedded", [name], f"Copyright (c) 2021 Example Authors, {t.rstrip('.:')} and {text_of(5, 30)}") for name, t in texts.items()]
    rows += [(f"{a} and {b}", [a, b], f"{text_of(6, 40)} {texts[a]} {texts[b]}") for a, b in pairs]
    rows += [("version", [], "Licensed under the Apache License,\nVersion 1.1."), ("twice", ["reserved"] * 2, "All rights\nreserved. All rights reserved."), ("changed", ["MIT-text"], texts["MIT-text"].replace("is hereby granted", "is granted"))]
    frame = spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [n.license for n in r.notices] for r in license_scan.scan(spark, frame).collect()}
    assert {rows[k][0]: v for k, v in got.items()} == {r[0]: r[1] for r in rows}


def test_compression_loses_no_wording():
    """Blocks against the wording alone at every place of a text."""
    random.seed(11)
    scan = license_scan.scanner()
    for k in range(300):
        name = random.choice([*license_scan.TEMPLATES])
        own = list(scan.words[name])
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(own)) if own else 0
            own[at : at + random.randint(0, 1)] = random.choice([[], ["other"], ["2.0"]])
        words = [*license_scan.wording(text_of(k, 30)), *own, *license_scan.wording(text_of(k + 1, 30))]
        want = {n for n in license_scan.TEMPLATES if scan.places(words, n)}
        got = scan.notices(words)
        assert bool(got) == bool(want) and {x[1] for x in got} <= want


def test_query_finds_all_plain_notices(spark):
    d = "/root/testdata/sf0.01"
    exact = {t: n for n, t in license_scan.TEMPLATES.items()}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        hits = [exact[x.strip()] for x in (r.text or "").split("\n") if x.strip() in exact]
        want[r.doc_id] = hits
    got = {r.doc_id: r.notices for r in queries.op9_license_scan(spark, d).collect()}
    assert all(sum(f":{n}" in got[i] for n in set(hits)) == len(set(hits)) for i, hits in want.items())
    assert math.isclose(sum(bool(v) for v in got.values()), sum(bool(v) for v in want.values()), abs_tol=2)


def test_digests(library):
    text = "Hello wörld"
    ids = library.encode(text, add_special_tokens=False).ids
    own = tree_bpe.Encoder(PATH)
    assert hashlib.sha256(own.encode(text)).hexdigest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
