"""Matching against plain versions."""

import difflib
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.operators import airports, keywords, matching, search
from carbonloom.plans import ledger as L
from carbonloom.plans import matcher as M
from carbonloom.sources import facts


def test_contained_in_equals_a_contains_of_all_pairs(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("ab钢板") for _ in range(random.randint(0, n)))
    words, texts = [word(5) for _ in range(60)] + [None, ""], [word(12) for _ in range(60)] + [None, ""]
    got = matching.contained_in(spark.createDataFrame([(w,) for w in words], "w string"), matching.F.col("w"), spark.createDataFrame([(t,) for t in texts], "t string"), matching.F.col("t"))
    assert Counter((r.w, r.t) for r in got.collect()) == Counter((w, t) for w in words for t in texts if w and t and w in t)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_words(spark):
    random.seed(6)
    names = [a for _, a, _ in matching.candidates()]
    words = {n for n in names[::5]} | {"".join(c for c in n if random.random() > 0.2) + random.choice(["", "件", "费"]) for n in names for _ in range(3)}
    words = sorted(w for w in words if w)
    got = {r.w: (r.matched, r.similarity) for r in matching.fuzzy(spark.createDataFrame([(w,) for w in words], "w string"), "w", 0.5).collect()}
    for w in words:
        best = max(((1 - plain_distance(w, a) / max(len(w), len(a)) if w and a else 0.0), -k, s) for k, a, s in matching.candidates())
        assert got[w][0] == (best[2] if best[0] >= 0.5 else None) and (got[w][0] is None or math.isclose(got[w][1], best[0]))


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_similar_pairs_equal_all_pairs(spark, least):
    random.seed(10)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 12)))
    names = sorted({word() for _ in range(150)})
    words = sorted({word() for _ in range(100)} | {n[:k] + random.choice(["", "a", "xy"]) + n[k + 1 :] for n in names[::2] for k in (0, 2, 5)})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None, ""]], f"{c} string")
    got = {(r.word, r.alias): r.similarity for r in matching.similar_pairs(frame(words, "w"), "w", frame(names, "n"), "n", least).collect()}
    want = {(w, n): 1 - plain_distance(w, n) / max(len(w), len(n)) for w in words for n in names if w}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= least}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_rules_of_a_table(spark, monkeypatch, most):
    """With all words in every task, and dealt into shares."""
    monkeypatch.setattr(keywords, "TEXT_BYTES", 300)
    random.seed(13)
    piece = lambda n: "".join(random.choice("ab钢é") for _ in range(random.randint(1, n)))
    rules = [(random.randint(0, 25), piece(3), random.random() < 0.3) for _ in range(60)] + [(7, None, False), (8, "", False), (None, "a", False)]
    texts = [(k, piece(9)) for k in range(80)] + [(k, "zz") for k in range(3)] + [(90, None), (91, ""), (92, "a"), (92, "a")]
    got = keywords.first_rules(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(rules, "rule int, word string, excludes boolean"), most)
    want = []
    for i, t in texts:
        first = min((r for r, w, x in rules if r is not None and w and not x and w in (t or "")), default=None)
        want.append((i, t, first, first is not None and any(r == first and x and w and w in t for r, w, x in rules)))
    assert sorted(map(str, (tuple(r[c] for c in ("id", "t", "rule", "excluded")) for r in got.collect()))) == sorted(map(str, want))
    none = keywords.first_rules(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame([], "rule int, word string, excludes boolean"), most)
    assert none.where("rule is not null or excluded").count() == 0 and none.count() == len(texts)


def all_paths(text, freq, total):
    """Every way through a text, with its weight."""
    if not text:
        return [(0.0, [])]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in freq or n == 1:
            w = math.log(freq.get(text[:n], 1.0) / total)
            out += [(w + rest, [text[:n], *words]) for rest, words in all_paths(text[n:], freq, total)]
    return out


def test_words_of_the_best_path(spark):
    random.seed(14)
    freq = {"南京": 50, "南京市": 30, "市长": 40, "长江": 45, "大桥": 35, "长江大桥": 20, "江": 5, "桥": 3, "ab": 9, "b1": 2, "steel": 7, "bolt": 6, "eel": 5}
    texts = ["南京市长江大桥", "", " ", "abab1", "SteelBolt 42x9", "桥桥桥", "未知", "x", "a1b2c3", "南京 abc"] + ["".join(random.choice(["南京", "市", "长", "江", "大", "桥", "ab", "1"]) for _ in range(6)) for _ in range(20)]
    frame = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "t string")
    got = {r.text: r.words for r in keywords.segmented(frame, "t", spark.createDataFrame([*freq.items(), ("", 3), ("zz", 0)], "word string, freq long")).collect()}
    assert set(got) == set(texts)
    total = sum(freq.values())
    for t in texts:
        ways = all_paths(t.lower(), freq, total)
        best = max(w for w, _ in ways)
        merged = []
        for _, way in [(w, p) for w, p in ways if w > best - 1e-9]:
            out, loose = [], False
            for x in way:
                single = x not in freq and x.isascii() and x.isalnum()
                out = [*out[:-1], out[-1] + x] if loose and single else [*out, x]
                loose = single
            merged.append([x for x in out if x.strip()])
        assert got[t] in merged, t
    assert got["南京市长江大桥"] == ["南京市", "长江大桥"] and got["未知"] == ["未", "知"] and got["SteelBolt 42x9"] == ["steel", "bolt", "42x9"]


@pytest.mark.parametrize("top", [1, 3, 200])
def test_catalogue_search_with_repeated_texts(spark, top):
    random.seed(7)
    rows = [(k, random.choice(["steel bolt", "steel nut", "iron bolt", "bolt", "木 板", "zz"])) for k in range(40)]
    asked = ["bolt steel", "iron", "板", "qq"]
    tokens = lambda t: Counter(c for c in t.lower() if re.match(r"[\w一-鿿]", c))
    df = Counter(c for _, t in rows for c in tokens(t))
    idf = {c: math.log((1 + len(rows)) / (1 + n)) + 1 for c, n in df.items()}

    def unit(t):
        w = {c: n * idf[c] for c, n in tokens(t).items() if c in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {c: x / norm for c, x in w.items()}

    want = set()
    for q in asked:
        scored = sorted(((-round(sum(x * unit(t).get(c, 0) for c, x in unit(q).items()), 12), -k) for k, t in rows))
        want |= {(q, -k, n) for n, (s, k) in enumerate([x for x in scored if x[0] < -0.01][:top], 1)}
    got = matching.tfidf_top(spark.createDataFrame([(q,) for q in asked], "q string"), "q", spark.createDataFrame(rows, "k long, t string"), "k", "t", top, 0.01)
    assert {(r.q, r.k, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("top", [1, 5])
def test_catalogue_search_meets_few_texts(spark, monkeypatch, top):
    """Words of a long-tailed vocabulary: the same rows as brute force, from a small part of the pairs that share a word."""
    monkeypatch.setattr(search, "FIRST_READ", 64)
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(k, " ".join(random.choices(vocabulary, weights, k=random.randint(3, 9)))) for k in range(1500)]
    asked = [" ".join(random.choices(vocabulary, weights, k=4)) for _ in range(30)] + ["w0", "", "none of these"]
    df = Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(t):
        w = {c: n * idf[c] for c, n in Counter(t.split()).items() if c in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {c: x / norm for c, x in w.items()}

    units, want, share = {k: unit(t) for k, t in rows}, set(), 0
    for q in set(asked):
        own = unit(q)
        scored = sorted((-round(sum(x * units[k].get(c, 0) for c, x in own.items()), 12), -k) for k, _ in rows)
        share += sum(s < 0 for s, _ in scored)
        want |= {(q, -k, n) for n, (_, k) in enumerate([x for x in scored if x[0] < 0][:top], 1)}
    met = []
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    got = matching.tfidf_top(spark.createDataFrame([(q,) for q in asked], "q string"), "q", spark.createDataFrame([*rows, (None, None)], "k long, t string").where("k is not null"), "k", "t", top, 0.0, words, met)
    assert {(r.q, r.k, r["rank"]) for r in got.collect()} == want
    assert len(want) <= met[0] <= {1: 0.1, 5: 0.2}[top] * share


def plain_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def plain_suggestions(key, ports, top):
    """ports (pos, code, name key, town key) in place."""
    near = [p for p in ports if key[:4] in p[3]] or ports
    return [(p[1], s) for s, _, p in sorted(((plain_ratio(key, p[2]), -p[0], p) for p in near), reverse=True)][:top]


def port_frame(spark, ports):
    frame = spark.createDataFrame(ports, "iata_code string, ident string, name string, municipality string, iso_country string, latitude_deg double, longitude_deg double, pos int")
    key = lambda t: re.sub(r"[^a-z0-9]+", "", t.lower())
    return facts.airports(frame), [(p[7], p[0], key(p[2]), key(p[3])) for p in ports], key


@pytest.mark.parametrize("seed", [8, 9])
def test_airports_by_similarity(spark, seed):
    """The whole cascade and the suggestions against a plain version: towns in common, names that hold a town, equal ratios, repeated codes, no candidates."""
    random.seed(seed)
    towns = ["Springfield", "Spring Valley", "San Pedro", "San Pablo", "Ville", "Villeneuve", "Beijing"]
    ports = [(f"A{chr(65 + k % 20)}{chr(65 + k % 3)}", f"Z{k:03d}", f"{random.choice(towns)} {random.choice(['Airport', 'Field', 'International', 'Capital Airport'])}", random.choice(towns), "US", 1.0, 2.0, k) for k in range(40)]
    frame, plain, key = port_frame(spark, ports)
    asked = [("springfield airport", None), ("San Ped", None), ("sanpablo field", None), ("Villen", None), ("AAA", None), ("z004", None), ("q", None), ("??", None), ("北京首都机场", "bei jing shou du ji chang"), ("北京", "beijing"), ("上海", "shang hai"), ("springx capital", "spring"), ("San-Ped", None), ("abc", "zzz"), ("春", None)]
    aliases = facts.alias_rows(spark.createDataFrame([("San-Ped", None, "z009", 0), ("q", "QQQ", None, 1)], "zh string, iata_code string, ident string, pos int"))
    codes, idents = {p[0]: p[0] for p in ports}, {p[1]: p[0] for p in ports}

    def resolved(name, spelled):
        up = name.strip().upper()
        if up in codes:
            return up, "iata", 1.0
        if up in idents:
            return idents[up], "ident", 1.0
        if re.sub(r"[-\s]", "", name.lower()) == "sanped":
            return idents["Z009"], "alias", 1.0
        k = key(name)
        if k:
            near = [p for p in plain if k[:6] in p[3]]
            if not near:
                return None, None, None
            best = max(near, key=lambda p: (plain_ratio(k, p[2]), -p[0]))
            if plain_ratio(k, best[2]) >= 0.55:
                return best[1], "similar", plain_ratio(k, best[2])
        k = key((spelled or "").replace(" ", "").replace("shoudu", "capital").replace("jichang", "airport"))
        if not k:
            return None, None, None
        code, score = plain_suggestions(k, plain, 1)[0]
        return (code, "spelled", score) if score >= 0.42 else (None, None, None)

    names = spark.createDataFrame(asked, "name string, spelled string")
    got = {r.name: (r.code, r.how, r.score) for r in airports.resolve(names, "name", frame, aliases, "spelled").collect()}
    assert got == {n: resolved(n, s) for n, s in asked}
    suggested = {(r.name, r.iata_code, r["rank"], r.score, r.answered) for r in airports.suggest(names, "name", frame).collect()}
    want = set()
    for n, _ in asked:
        if key(n):
            top = plain_suggestions(key(n), plain, 3)
            want |= {(n, code, k, s, top[0][1] >= 0.42) for k, (code, s) in enumerate(top, 1)}
    assert suggested == want


def test_suggestions_read_inputs_once(spark):
    """Inputs are read once, however often their keys are used, with the suggestions of the plain version, also for keys that differ in characters of no airport only."""
    ports = [("AAA", "Z1", "Norway City", "Norway", "US", 1.0, 2.0, 0), ("BBB", "Z2", "Gate 7 Airport", "Gate 7", "US", 1.0, 2.0, 1), ("CCC", "Z3", "Lima Field", "Lima 5", "US", 1.0, 2.0, 2), ("DDD", "Z4", "é Town", "Arno", "US", 1.0, 2.0, 3), ("EEE", "Z5", "Norway City", "Oslo", "US", 1.0, 2.0, 4), ("FFF", "Z6", "Norway " + "a1 b" * 60, "Far", "US", 1.0, 2.0, 5)]
    frame, plain, key = port_frame(spark, ports)
    asked = [f"Nowhere {k}" for k in range(100, 160)] + [f"lima{k}" for k in range(8)] + [f"9{k} norway" for k in range(5)] + ["norw q1", "norw q2", "5", "88", "zz", "ima5", "777 gate", "faraway a1ba1b"]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    rows = spark.createDataFrame([(n,) for n in asked], "raw string").select(counted("raw").alias("name"))
    got = {(r.name, r.iata_code, r["rank"], r.score, r.answered) for r in airports.suggest(rows, "name", frame).collect()}
    want = set()
    for n in asked:
        top = plain_suggestions(key(n), plain, 3)
        want |= {(n, code, k, s, top[0][1] >= 0.42) for k, (code, s) in enumerate(top, 1)}
    assert got == want
    assert read.value == len(asked)


def test_similar_names_are_found_without_rating_all_pairs(spark, monkeypatch):
    """The best ratios over all names, from a small part of the pairs."""
    monkeypatch.setattr(search, "FIRST_READ", 32)
    random.seed(12)
    syllables = ["ber", "lin", "ton", "kor", "mad", "ras", "osl", "rio", "qua", "xen", "vil", "jav", "hud", "gri", "fel", "pym"]
    word = lambda: "".join(random.choices(syllables, k=random.randint(2, 5)))
    names = sorted({word() for _ in range(500)})
    keys = sorted({random.choice(names)[1:] + random.choice(["x", "", "ton"]) for _ in range(40)})
    met = []
    found = airports.most_similar(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in names], "name_key string"), 3, met).collect()
    got = {}
    for r in found:
        got.setdefault(r.key, []).append(r.score)
    for k in keys:
        assert sorted(got[k], reverse=True)[:3] == sorted((plain_ratio(k, n) for n in names), reverse=True)[:3]
    assert met[0] <= 0.15 * len(keys) * len(names)


def test_nearest_centroid_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [-1.0, -1.0])], "id long, v array<double>")
    means = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, centroid array<double>")
    got = matching.nearest_centroid(rows, "v", means, "label")
    assert Counter((r.id, r.nearest, r.confidence) for r in got.collect()) == Counter([(1, 0, 1.0), (1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.0)])
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()


def test_centroids_in_blocks(spark, monkeypatch):
    """More centroids than go to one task: each row meets all of them, in blocks."""
    random.seed(15)
    vector = lambda: [random.gauss(0, 1) for _ in range(4)]
    rows = [(k // 2, vector()) for k in range(60)] + [(99, [0.0] * 4), (98, None)]
    frame = spark.createDataFrame([*rows, rows[0]], "id long, v array<double>")
    means = spark.createDataFrame([(k, vector()) for k in range(40)] + [(k + 40, [1.0, 0.0, 0.0, 0.0]) for k in range(3)], "label int, centroid array<double>")
    whole = Counter(map(str, matching.nearest_centroid(frame, "v", means, "label").collect()))
    monkeypatch.setattr(matching, "CLASS_BYTES", 200)
    assert Counter(map(str, matching.nearest_centroid(frame, "v", means, "label").collect())) == whole


def test_region_of_context(spark):
    rows = [(" 华东 ", "x", "y"), ("", "江苏省", "四川省"), (None, "", "四川省"), (None, None, None), ("", "elsewhere", "四川省")]
    frame = spark.createDataFrame(rows, "r string, s string, b string")
    assert [x[0] for x in frame.select(M.region_of_context(*map(M.F.col, "rsb"))).collect()] == ["华东", "华东", "西南", "全国", "全国"]


def test_factor_keys_and_waste_predicate(spark):
    keys = {r.factor_key: r.factor_id for r in M.factor_keys(M.factors(spark)).collect()}
    assert keys["grid:华东"] == dims.GRID_IDS["华东"] and keys["fuel_coal"] == "fuel_coal" and keys["grid:全国"] == "electricity_national"
    frame = spark.createDataFrame([("waste_cat1_msw",), ("waste_cat1",), (None,)], "f string")
    assert [x[0] for x in frame.select(L.is_waste_factor(M.F.col("f"))).collect()] == [True, False, False]


def _largest_method(frame):
    """Bytes of the largest method that Spark generates for a frame; the JVM compiles none over 8,000."""
    jvm = frame.sparkSession._jvm
    stages = getattr(jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(frame._jdf.queryExecution().executedPlan())
    return max([stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())], default=0)


def test_chains_of_rules_stay_out_of_whole_stage_code(spark):
    from pyspark.sql import functions as F

    from carbonloom.plans import ledger as L
    from carbonloom.plans import matcher as M

    text = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    lines = spark.range(3).select(text("i").alias("invoice_id"), text("汽油").alias("name"), text("107").alias("tax_code"), text("s").alias("seller_name"), text("北京").alias("seller_address"), F.col("id").cast("double").alias("quantity"), F.col("id").cast("double").alias("amount"), text("升").alias("unit"))
    assert 0 < _largest_method(L.emissions(L.classify(L.without_junk(lines)))) < 8000
    assert 0 < _largest_method(lines.withColumn("region", M.region_of(F.col("seller_address")))) < 8000


def test_small_fixed_tables_do_not_gather_their_lines(spark):
    """The grid factors are broadcast: a join by level and name would take all lines of the country to one task."""
    from carbonloom.queries import text as Q

    plan = Q.s12_grid_factors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_amounts_are_read_once_for_each_text(spark):
    from carbonloom.queries import text as Q

    plan = Q.o1_o2_amounts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate [s#") and "]" in plan[: plan.index(",")]  # s alone is the key


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_facts_are_worked_out_once_for_all_batches(spark, monkeypatch):
    """each batch worked the lines out again, and sums were taken of a sorted listing."""
    from conftest import DATA

    from carbonloom.queries import ledger as Q
    from carbonloom.sources import facts

    plans, append = [], facts.append_facts
    monkeypatch.setattr(facts, "append_facts", lambda table, rows, key: plans.append(_plan(rows)) or append(table, rows, key))
    assert Q.QUERIES["s20_s23_fact_table"](spark, DATA).count() == 8
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_chains_of_rules_are_compiled_in_pieces(spark):
    """within a lambda a chain is evaluated node by node for each row."""
    from carbonloom.plans import ledger as L

    lines = spark.sql("SELECT concat('i', id) AS invoice_id, concat('汽油', id) AS name, '107' AS tax_code, 's' AS seller_name, 1.0D AS quantity, CAST(id AS DOUBLE) AS amount, '升' AS unit FROM range(3)")
    plan = _plan(L.emissions(L.classify(lines)))
    assert "Contains(" in plan and "transform(array(CASE" not in plan


def test_lines_stay_where_they_are_when_factors_are_matched(spark):
    """lines were dealt out by the few different factors."""
    from carbonloom.plans import matcher as M

    lines = spark.sql("SELECT concat('i', id) AS invoice_id, concat('电', id) AS name, '' AS tax_code, 1.0D AS quantity, 1.0D AS amount, '度' AS unit, '华东' AS region FROM range(3)")
    plan = _plan(M.line_path(lines, M.factors(spark)))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_trail_gathers_each_value_of_a_line_once(spark):
    """the steps of a line are made after lines are gathered and sorted."""
    from carbonloom.operators import audit

    rows = [("i", "b", 2, "f2", "r", 1.25, "activity", "高", "电力"), ("i", "a", 3, "f1", None, 2.5, "expenditure", "低", "EEIO"), ("i", "a", 3, "f1", None, 2.5, "expenditure", "低", "EEIO"), ("j", None, 1, "f1", "r", 0.0, "activity", "中", None)]
    items = spark.createDataFrame(rows, "invoice_id string, name string, factor_scope int, factor_id string, reason string, emissions double, method string, confidence string, category string")
    frame = audit.trails(items, "run")
    assert "collect_list(struct(name" in _plan(frame)
    got = {r.invoice_id: r for r in frame.collect()}
    assert [(s.step, s.input, s.output, s.rules, s.confidence) for s in got["i"].steps][3:] == [("classify", "a", "3", "税号前缀", "低"), ("match", "a", "f1", None, "低"), ("calculate", "f1", "2.5", "expenditure", "低"), ("classify", "b", "2", "税号前缀", "高"), ("match", "b", "f2", "r", "高"), ("calculate", "f2", "1.25", "activity", "高")]
    assert [(x.type, x.source) for x in got["i"].data_sources] == [("EEIO因子", "f1，行业/投入产出"), ("物理因子", "f2，内置/未知")]
    assert got["i"].final_result == '{"total":6.25}' and [x.type for x in got["j"].data_sources] == ["因子来源"]


def test_waste_lines_stay_where_they_are(spark):
    """lines of a few names were sorted by name, each name in one task."""
    from carbonloom import dims, fixtures
    from carbonloom.plans import ledger as L

    lines = spark.sql("SELECT concat('i', id) AS invoice_id, 'small ring' AS name, 'waste_cat1_msw' AS factor_id, 1.0D AS quantity, 1.0D AS amount FROM range(3)")
    routes = spark.createDataFrame(dims.WASTE_ROUTES, "factor_id string, ratio double, product_id string")
    out = L.waste_emissions(lines, spark.sql(fixtures.PRODUCTS), L.waste_intensity(routes, spark.sql(fixtures.CATALOGUE)))
    assert "hashpartitioning" not in _plan(out) and "SortMergeJoin" not in _plan(out)
    assert [r.method for r in out.collect()] == ["waste_allocation"] * 3


@pytest.mark.parametrize("text, codes", [("机票 pek-sha", ("PEK", "SHA")), ("PEK-PEK CAN", ("PEK", "CAN")), ("XPEK -> SHAX", ("PEK", "SHA")), ("PEK-PEK", None), ("from PEK to SHA", ("PEK", "SHA")), ("起飞 CAN 降落 CTU", ("CAN", "CTU")), (None, None)])
def test_airport_pairs_as_before(spark, text, codes):
    """a pair is found in one pass of its pattern."""
    from carbonloom.functions import text as X

    frame = spark.createDataFrame([(text,)], "s string").select(X.iata_pair(M.F.col("s")).alias("p"))
    got = frame.first()[0]
    assert (None if got is None else tuple(got)) == codes
    assert _plan(frame).count("[-–—/→>]+") == 1
