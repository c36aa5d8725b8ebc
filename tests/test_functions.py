"""Functions on literal rows, with expectations worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import longest_prefix
from carbonloom.plans import ledger as L
from carbonloom.plans import matcher as M


def value(spark, column, **inputs):
    return spark.range(1).select(column(*[F.lit(v) for v in inputs.values()]).alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("¥1,234.56", 1234.56), ("￥1,234.56", 1234.56), ("RMB 1,234.56", 1234.56), ("CNY 5000", 5000.0), ("1,234.56元", 1234.56), ("1 234,56", 1234.56), ("1,234,567.89", 1234567.89), ("-12.5", -12.5), ("13%", None), ("", None), (None, None), ("abc", None), ("1,234", 1234.0)])
def test_amount(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(N.amount_cny(F.col("s"))).first()[0] == want


def test_amounts_differ_on_a_decimal_comma(spark):
    row = spark.createDataFrame([("1234,56",)], "s string").select(N.amount_cny(F.col("s")), N.cell_number(F.col("s"))).first()
    assert tuple(row) == (1234.56, 123456.0)


def test_haversine(spark):
    km = spark.range(1).select(N.haversine_km(F.lit(40.0801), F.lit(116.5846), F.lit(31.1979), F.lit(121.3363))).first()[0]
    assert math.isclose(km, 1076.512409813539, rel_tol=1e-12)


def test_js_round_takes_halves_up(spark):
    assert [value(spark, lambda v: N.js_round(v, 2), v=x) for x in (0.125, -0.125, 2.5)] == [0.13, -0.12, 2.5]


@pytest.mark.parametrize(("text", "pair"), [("PEK-SHA", ("PEK", "SHA")), ("from can to lhr", ("CAN", "LHR")), ("出发 PEK 到达 SHA", ("PEK", "SHA")), ("ABC ABC XYZ", ("ABC", "XYZ")), ("PEK-PEK", None), ("机票", None)])
def test_iata_pair(spark, text, pair):
    got = spark.createDataFrame([(text,)], "s string").select(X.iata_pair(F.col("s"))).first()[0]
    assert (tuple(got) if got else None) == pair


def test_names_and_keywords(spark):
    rows = spark.createDataFrame([("螺栓 M6 个",), ("个",), ("*成品油*汽油",), ("技术服务费",), (None,)], "s string")
    got = rows.select(X.clean_name(F.col("s")), X.keywords(F.col("s"))["keywords"]).collect()
    assert [r[0] for r in got] == ["螺栓", "个", "*成品油*汽油", "技术服务费", ""]
    assert [r[1] for r in got][2:] == [["成品油", "汽油"], ["技术服务"], []]


def test_scope_spellings(spark):
    rows = spark.createDataFrame([("Scope 2",), ("范围三",), ("scope 1 x",), ("",), ("?",), (None,)], "s string")
    assert [r[0] for r in rows.select(X.normalised_scope(F.col("s"))).collect()] == ["Scope 2", "Scope 3", "Scope 1", "Scope 1", None, None]


def test_longest_prefix_takes_the_first_of_equal_rules(spark):
    rules = spark.createDataFrame([("10", "a", 0), ("101", "b", 1), ("101", "c", 2)], "prefix string, kind string, rule_pos int")
    codes = spark.createDataFrame([("1015",), ("1099",), ("9",), (None,), (" ",)], "code string")
    assert {(r.code, r.kind) for r in longest_prefix(codes, "code", rules).collect()} == {("1015", "b"), ("1099", "a"), ("9", None), (None, None), (" ", None)}


def lines(spark, rows):
    return spark.createDataFrame(rows, "invoice_id string, line_no int, name string, tax_code string, quantity double, unit string, amount double, seller_name string, seller_address string")


def test_ledger_lines(spark):
    rows = [
        ("a", 1, "电费", None, 5000.0, "度", 3000.0, "x", ""),
        ("a", 2, "办公用品", None, None, None, 11000.0, "x", ""),
        ("a", 3, "天然气", None, 2.0, "立方米", 10.0, "x", ""),
        ("a", 4, "未知", " ", None, None, 10.0, "x", ""),
        ("a", 5, "某物", None, None, None, 10.0, "顺丰速运", ""),
        ("a", 6, "润滑油", "107", 1.0, "升", 10.0, "x", ""),
        ("a", 7, "住宿服务", None, 2.0, "晚", 0.0, "x", ""),
        ("a", 8, "自来水", None, 10.0, "吨", 100.0, "x", ""),
    ]
    out = {r.line_no: r for r in L.emissions(L.classify(lines(spark, rows))).collect()}
    assert math.isclose(out[1].emission_kg, 2888.5) and out[1].scope == "Scope 2" and out[1].method == "activity"
    assert math.isclose(out[2].emission_kg, 1.65) and out[2].method == "eeio"
    assert (out[3].factor_id, out[3].match_type) == ("oil_gas", "keyword")
    assert (out[4].match_type, out[4].factor_id) == ("tax_code", "scope3_default")
    assert (out[5].match_type, out[5].factor_id) == ("seller_keyword", "scope3_service")
    assert (out[6].scope, out[6].match_type) == ("Scope 3", "default")
    assert out[7].match_type == "keyword_accommodation" and math.isclose(out[7].emission_kg, 133.04)
    assert math.isclose(out[8].emission_kg, 100 * 0.00015)
    entries = L.ledger_entries(L.emissions(L.classify(lines(spark, rows))))
    assert math.isclose(sum(r.amount_cny for r in entries.collect()), sum(r.emission_kg for r in out.values()) / 10)


def test_matcher_lines(spark):
    rows = [("a", 1, "冷轧钢板", None, 50.0, "吨", 1.0, "x", ""), ("a", 2, "办公用品", None, None, None, 5000.0, "x", ""), ("a", 3, "杂项费用", None, None, None, 10000.0, "x", ""), ("a", 4, "技术服务", "3040101010000000000", 1.0, "项", 1000.0, "x", "")]
    table = lines(spark, rows).withColumn("region", F.lit("全国"))
    out = {r.line_no: r for r in M.line_path(table, M.factors(spark)).collect()}
    assert [(out[k].match_type, out[k].confidence, round(out[k].emissions, 6)) for k in (1, 2, 3, 4)] == [("物理因子", "高", 100000.0), ("EEIO因子", "中", 0.75), ("默认因子", "低", 1.5), ("物理因子", "高", 2550.0)]
    assert out[4].factor_scope == 1


# the ten demonstration invoices: name, quantity, unit, amount, seller, address, scenario, kg
DEMO = [
    ("电费", 10000.0, "度", 8000.0, "上海电力", "上海市", "electricity", 5500.00), ("自来水", 100.0, "吨", 300.0, "水务", "", "water", 16.80), ("住宿费", None, "", 1200.0, "某酒店", "", "hotel", 244.32), ("办公用品", None, "", 5000.0, "x", "", "logistics", 252.35), ("汽油", 50.0, "升", 400.0, "x", "", "transport", 23.77),
    ("地铁充值", None, "", 200.0, "x", "", "transport", 8.86), ("物流运输费", None, "", 1500.0, "x", "", "logistics", 75.71), ("垃圾清运", None, "", 800.0, "x", "", "logistics", 40.38), ("钢材", None, "", 100000.0, "x", "", "logistics", 5047.00), ("杂项", None, "", 3000.0, "x", "", "logistics", 151.41),
]


def test_scenarios(spark):
    rows = [(str(k), 1, n, None, q, u, a, s, d) for k, (n, q, u, a, s, d, _, _) in enumerate(DEMO)]
    out = {r.invoice_id: (r.scenario, r.kg, r.scope) for r in M.scenarios(M.invoices(lines(spark, rows)), M.factors(spark)).collect()}
    assert [out[str(k)][:2] for k in range(10)] == [(d[6], d[7]) for d in DEMO]
    assert math.isclose(sum(v[1] for v in out.values() if v[2] == 3), 5860.60)


def test_summary_adds_up(spark):
    rows = [(str(k), 1, d[0], None, d[1], d[2], d[3], d[4], d[5]) for k, d in enumerate(DEMO)]
    items = M.line_path(lines(spark, rows).withColumn("region", F.lit("全国")), M.factors(spark))
    total = M.summary(items).first()
    assert math.isclose(total.scope1 + total.scope2 + total.scope3, total.total) and items.count() == len(rows)


def test_factor_table():
    rows = dims.factor_rows()
    assert len(rows) == 54 and len({r[0] for r in rows}) == 54
