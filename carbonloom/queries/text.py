"""Queries of text functions, matching, sources, tables and audit."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom import dims, fixtures
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.operators import airports, audit, keywords, matching, tables
from carbonloom.plans import ledger as L
from carbonloom.plans import matcher as M
from carbonloom.queries import sqltext as S
from carbonloom.queries.matcher import _MATCHED, _REGION, calculated
from carbonloom.sources import facts
from carbonloom.sources import invoices as I
from carbonloom.sources.shared import shared_folder

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_AMOUNTS = "SELECT CASE l_linenumber % 7 WHEN 0 THEN '13%' WHEN 1 THEN concat('¥', CAST(l_partkey AS STRING), ',', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), '.50') WHEN 2 THEN concat('RMB ', CAST(l_partkey AS STRING)) WHEN 3 THEN concat(CAST(l_partkey AS STRING), ',', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), '元') WHEN 4 THEN concat('-', CAST(l_partkey AS STRING), '.25') WHEN 5 THEN 'n/a' ELSE concat(CAST(l_partkey AS STRING), ',', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0')) END AS s, l_linenumber % 7 AS kind, l_partkey AS p, l_suppkey AS q FROM lineitem"


@register(f"""WITH a AS ({_AMOUNTS}) SELECT s, CASE kind WHEN 1 THEN p * 1000 + q % 1000 + 0.5 WHEN 2 THEN p WHEN 3 THEN p + (q % 100) / 100.0 WHEN 4 THEN -p - 0.25 WHEN 6 THEN p * 1000 + q % 1000 END AS amount,
 CASE kind WHEN 1 THEN p * 1000 + q % 1000 + 0.5 WHEN 2 THEN p WHEN 3 THEN p * 100 + q % 100 WHEN 4 THEN -p - 0.25 WHEN 6 THEN p * 1000 + q % 1000 END AS cell, count(*) AS n FROM a GROUP BY ALL""")
def o1_o2_amounts(spark, d):
    """O1 amount of a string, O2 number of a cell (they differ on a decimal comma)."""
    rows = fixtures.sql(spark, d, _AMOUNTS).groupBy("s").agg(F.count("*").alias("n"))
    return rows.select("s", N.amount_cny(F.col("s")).alias("amount"), N.cell_number(F.col("s")).alias("cell"), "n")


_NUMS = "SELECT l_orderkey AS k, concat(CAST(CAST(l_quantity AS INT) AS STRING), ' ', CAST(l_partkey AS STRING), '.25 M6 13% ', CAST(l_suppkey AS STRING), '个') AS s, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS a, l_partkey + 0.25E0 AS b FROM lineitem"


@register(f"WITH r AS ({_NUMS}) SELECT k, 2 * count(*) AS n, sum(a) AS a, sum(b) AS b FROM r GROUP BY k")
def o3_cell_numbers(spark, d):
    """O3 numbers of a mixed cell; tokens with letters or units are skipped."""
    rows = fixtures.sql(spark, d, _NUMS).withColumn("x", N.cell_numbers(F.col("s")))
    return rows.groupBy("k").agg(F.sum(F.size("x")).alias("n"), F.sum(F.get("x", 0)).alias("a"), F.sum(F.get("x", 1)).alias("b"))


@register("""SELECT event_type, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS n_float, round(sum(CASE WHEN event_id % 3 = 0 THEN value END), 3) AS total, round(sum(CASE WHEN event_id % 3 = 0 THEN abs(value) END), 3) AS label_total FROM events GROUP BY event_type""")
def o4_o25_floats(spark, d):
    """O4 strict float, O25 amount read by label."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("s", F.when(F.col("event_id") % 3 == 0, F.format_string("%.17e", "value")).otherwise("x1"))
    label = F.when(F.col("event_id") % 3 == 0, N.label_number(F.concat(F.lit("￥"), F.abs("value").cast("decimal(30,12)").cast("string"))))
    return e.groupBy("event_type").agg(F.count(N.safe_float(F.col("s"))).alias("n_float"), F.round(F.sum(N.safe_float(F.col("s"))), 3).alias("total"), F.round(F.sum(label), 3).alias("label_total"))


@register("""SELECT strftime(l_shipdate, '%Y-%m-%d') AS cn, strftime(l_shipdate, '%Y-%m-%d') AS compact, strftime(l_shipdate, '%Y-%m-%d') AS epoch, count(*) AS n FROM lineitem GROUP BY ALL""")
def o5_o6_dates(spark, d):
    """O5 Chinese date, O6 compact date and epoch milliseconds."""
    t = F.col("l_shipdate")
    cn = N.cn_date(F.concat(F.year(t), F.lit("年"), F.month(t), F.lit("月"), F.dayofmonth(t), F.lit("日")))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(cn.alias("cn"), N.compact_date(F.date_format(t, "yyyyMMdd")).alias("compact"), N.epoch_date(F.unix_millis(F.to_timestamp(t))).alias("epoch"))
    return rows.groupBy("cn", "compact", "epoch").agg(F.count("*").alias("n"))


@register("SELECT CASE l_linenumber % 4 WHEN 0 THEN '冷轧钢板 ' || l_partkey % 50 || 'mm粗' WHEN 1 THEN '螺栓' WHEN 2 THEN '某某商业大厦' ELSE '个' END AS name, count(*) AS n FROM lineitem GROUP BY ALL")
def o7_names(spark, d):
    """O7 cleaned names: unit and spec tokens and certificates go."""
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.lit("冷轧钢板   "), F.col("l_partkey") % 50, F.lit("mm粗 个"))).when(k == 1, F.concat(F.lit(" 螺栓 M"), F.col("l_partkey"), F.lit(" 8*22"))).when(k == 2, "某某商业大厦沪（2019）浦字").otherwise("个")
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(X.clean_name(raw).alias("name")).agg(F.count("*").alias("n"))


_FIGURE = "concat(CAST(l_partkey % 900 + 1 AS STRING), '.', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'))"
_PRINTS = f"SELECT CASE l_linenumber % 7 WHEN 0 THEN concat({_FIGURE}, 'tCO2e / 公吨') WHEN 1 THEN concat({_FIGURE}, 'kgCO2e/kWh') WHEN 2 THEN concat({_FIGURE}, 'gCO2e/千瓦时') WHEN 3 THEN concat({_FIGURE}, 'CO2e/t') WHEN 4 THEN concat({_FIGURE}, ' kg CO2e') WHEN 5 THEN '-' ELSE concat('about ', {_FIGURE}, ' kg CO2e/件') END AS s, l_linenumber % 7 AS kind, l_partkey AS p, l_suppkey AS q FROM lineitem"


@register(f"""WITH r AS ({_PRINTS}), p AS (SELECT s, CASE kind WHEN 5 THEN 5 ELSE kind END AS kind, CASE WHEN kind <> 5 THEN CAST((p % 900 + 1) || '.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS v, count(*) AS n FROM r GROUP BY ALL)
 SELECT s, n, round(CASE kind WHEN 0 THEN v * 1000 WHEN 2 THEN v / 1000 WHEN 5 THEN 0 ELSE v END, 9) AS loose, CASE kind WHEN 0 THEN '公吨' WHEN 1 THEN 'kWh' WHEN 2 THEN '千瓦时' WHEN 3 THEN 't' WHEN 4 THEN '单位' WHEN 5 THEN '' ELSE '件' END AS unit,
 round(CASE kind WHEN 0 THEN v * 1000 WHEN 1 THEN v WHEN 2 THEN v / 1000 WHEN 6 THEN v ELSE 0 END, 9) AS strict, round(CASE kind WHEN 0 THEN v * 1000 WHEN 1 THEN v WHEN 2 THEN v / 1000 ELSE -1 END, 9) AS anchored, round(CASE kind WHEN 0 THEN v * 1000 WHEN 3 THEN v ELSE 0 END, 9) AS per_tonne FROM p""")
def o8_o11_footprints(spark, d):
    """O8, O9, O10 three parsers of a footprint, O11 kg for each tonne."""
    s = F.col("s")
    rows = fixtures.sql(spark, d, _PRINTS).groupBy("s").agg(F.count("*").alias("n")).withColumn("f", N.footprint(s))
    r = lambda c: F.round(c, 9)
    return rows.select("s", r(F.col("f.value")).alias("loose"), "f.unit", r(N.footprint_strict(s)["value"]).alias("strict"), r(F.coalesce(N.footprint_anchored(s)["value"], F.lit(-1.0))).alias("anchored"), r(N.kg_per_tonne(F.col("f"))).alias("per_tonne"), "n")


_CODES = ["PEK", "SHA", "CAN", "CTU", "LHR", "JFK", "NRT", "HRB"]
_CODE_OF = {k: S.case([(f"{k} % 8 = {n}", S.q(c)) for n, c in enumerate(_CODES)]) for k in ("l_partkey", "l_suppkey")}
_TICKETS = f"SELECT a, b, kind, CASE kind WHEN 0 THEN concat('出发 ', a, ' 首都 到达 ', b, ' 虹桥') WHEN 1 THEN concat('from ', a, ' to ', b, ' business') WHEN 2 THEN concat(a, '→', b, ' 头等舱') WHEN 3 THEN concat('航班 ', a, ' 转 ', b, ' 经济舱') ELSE '机票' END AS s FROM (SELECT {_CODE_OF['l_partkey']} AS a, {_CODE_OF['l_suppkey']} AS b, l_linenumber % 5 AS kind FROM lineitem) t"


@register(f"""WITH t AS ({_TICKETS}), p AS (SELECT *, kind IN (0, 1) OR (kind IN (2, 3) AND a <> b) AS paired FROM t)
 SELECT s, CASE WHEN paired THEN a END AS from_code, CASE WHEN paired THEN b END AS to_code, CASE kind WHEN 1 THEN 'business' WHEN 2 THEN 'first' WHEN 3 THEN 'economy' END AS cabin, count(*) AS n FROM p GROUP BY ALL""")
def o12_o15_tickets(spark, d):
    """O12 airport pair, O15 cabin."""
    rows = fixtures.sql(spark, d, _TICKETS).groupBy("s").agg(F.count("*").alias("n")).withColumn("p", X.iata_pair(F.col("s")))
    return rows.select("s", "p.from_code", "p.to_code", X.cabin(F.col("s")).alias("cabin"), "n")


_CELLS = "SELECT l_orderkey * 10 + l_linenumber AS row_no, CAST(100 + l_partkey % 15 AS STRING) AS tax_code, CASE l_linenumber % 6 WHEN 0 THEN '范围一' WHEN 1 THEN 'scope 2 energy' WHEN 2 THEN '范围3' WHEN 3 THEN 'Scope 1' WHEN 4 THEN '?' ELSE '2' END AS scope, CASE l_suppkey % 3 WHEN 0 THEN ' 蜡； 沥青' WHEN 1 THEN '润滑油,蜡;石蜡' ELSE '' END AS exclude, CASE WHEN l_suppkey % 2 = 0 THEN 'coal' ELSE ' ' END AS factor FROM lineitem"


@register(f"""WITH c AS ({_CELLS}) SELECT tax_code, CASE scope WHEN '范围一' THEN 'Scope 1' WHEN 'scope 2 energy' THEN 'Scope 2' WHEN '范围3' THEN 'Scope 3' WHEN 'Scope 1' THEN 'Scope 1' WHEN '2' THEN 'Scope 2' END AS scope2, CASE exclude WHEN ' 蜡； 沥青' THEN '蜡;沥青' WHEN '' THEN '' ELSE '润滑油,蜡;石蜡' END AS exclude_keywords, CASE WHEN factor = 'coal' THEN 'coal' ELSE 'default' END AS factor_id, count(*) AS n FROM c WHERE scope <> '?' GROUP BY ALL""")
def s10_rule_sheet(spark, d):
    """S10 import of a rule sheet, O13 scope spellings, O14 exclusion lists."""
    out = facts.rule_rows(fixtures.sql(spark, d, _CELLS))
    return out.groupBy("tax_code", F.col("scope").alias("scope2"), "exclude_keywords", "factor_id").agg(F.count("*").alias("n"))


@register("SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, count(*) AS n FROM part GROUP BY ALL")
def o16_match_keys(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(X.match_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, floor(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ALL")
def o17_header_fields(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = F.col("o_orderdate")
    text = F.concat(F.lit("发票号码："), "o_orderkey", F.lit(" 开票日期 "), F.year(t), F.lit(" 年 "), F.month(t), F.lit("月"), F.dayofmonth(t), F.lit("日 价税合计（大写） ¥"), F.floor("o_totalprice"))
    h = o.select(I.header_fields(text).alias("h"))
    return h.groupBy("h.invoice_number", "h.invoice_date", "h.total").agg(F.count("*").alias("n"))


_TEXTS = "SELECT o_orderkey AS invoice_id, concat('head', chr(10), '*办公* 纸 ', CAST(o_custkey AS STRING), ' 2.50 ', CAST(o_orderkey AS STRING), '.00 13% 7', chr(10), '续 A4', chr(10), '*服务* 费 ', CAST(o_custkey AS STRING), ' 9') AS text FROM orders"


@register("SELECT o_orderkey AS invoice_id, k AS line_no, CASE k WHEN 1 THEN '*办公* 纸 续 A4' ELSE '*服务* 费' END AS name, CASE k WHEN 1 THEN o_orderkey ELSE o_custkey END::DOUBLE AS amount, (CASE k WHEN 1 THEN o_custkey END)::DOUBLE AS quantity FROM orders, (VALUES (1), (2)) t(k)")
def o18_o19_text_lines(spark, d):
    """O18 lines of an invoice text with continuations, O19 amounts by place."""
    out = tables.text_lines(fixtures.sql(spark, d, _TEXTS)).withColumn("a", N.positional_amounts(F.col("numbers")))
    return out.select("invoice_id", "line_no", "name", "a.amount", "a.quantity")


@register("SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS with_total, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + l_linenumber END) AS rest FROM lineitem GROUP BY l_orderkey")
def o20_subtotals(spark, d):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("r", N.without_subtotal(F.array(q, n, F.when(n % 2 == 0, q + n).otherwise(q + n + 1))))
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count("r").alias("with_total"), F.sum(F.aggregate("r", F.lit(0.0), lambda s, v: s + v)).alias("rest"))


@register("SELECT CASE WHEN l_linenumber % 2 = 0 THEN '65119X' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || 'C' END AS product, count(*) AS n FROM lineitem GROUP BY ALL")
def o21_product_ids(spark, d):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("货运 65119X"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("C 一次"))).otherwise("6511")
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(X.product_id(text).alias("product")).agg(F.count("*").alias("n"))


_ROWS = """SELECT invoice_id, row_pos, cells FROM (SELECT o_orderkey AS invoice_id, 0 AS row_pos, array('项目名称', '数量', '金额', '税额') AS cells FROM orders UNION ALL SELECT l_orderkey, 1 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT), array(concat('P', CAST(l_partkey AS STRING)), CAST(CAST(l_quantity AS INT) AS STRING), concat('¥', CAST(l_partkey * 3 AS STRING)), '1') FROM lineitem
 UNION ALL SELECT o_orderkey, 999, CASE WHEN o_orderkey % 2 = 0 THEN array('价税合计', '', CAST(o_custkey AS STRING), '5') ELSE array('合计', CAST(o_custkey AS STRING), 'x', '5') END FROM orders) t"""


@register("SELECT l_orderkey AS invoice_id, count(*) AS n, sum(CAST(l_quantity AS INT))::DOUBLE AS quantity, sum(l_partkey * 3)::DOUBLE AS amount FROM lineitem JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON o_orderkey = l_orderkey GROUP BY ALL")
def o26_column_roles(spark, d):
    """O26 columns by the words of the header row."""
    rows = tables.role_rows(fixtures.sql(spark, d, _ROWS)).where("name LIKE 'P%'")
    return rows.groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"))


@register("SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 2 = 0 AND o_custkey > 0 THEN o_custkey WHEN o_orderkey % 2 = 0 THEN 5 ELSE greatest(o_custkey, 5) END::DOUBLE AS total FROM orders")
def o27_declared_totals(spark, d):
    return tables.declared_totals(fixtures.sql(spark, d, _ROWS))


@register("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 9) AS sim FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def m2_similarity(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.round(X.similarity(F.col("p_name"), F.col("other")), 9).alias("sim"))


@register("SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m3_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select(F.col("vec_id").alias("a"), F.round(N.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@register("SELECT l_orderkey AS k, sum(floor(l_extendedprice * l_discount * 100 + 0.5))::BIGINT AS cents FROM lineitem GROUP BY l_orderkey")
def m4_js_rounding(spark, d):
    cents = F.round(N.js_round(F.col("l_extendedprice") * F.col("l_discount"), 2) * 100)
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents.cast("bigint")).alias("cents"))


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}) SELECT name, CASE name WHEN '*金属制品*螺栓' THEN '金属制品' WHEN '*成品油*汽油' THEN '成品油|汽油' WHEN '*供电*电费' THEN '供电' WHEN '*石油制品*润滑油' THEN '石油制品' WHEN '冷轧钢板' THEN '钢板' WHEN '办公用品' THEN '办公用品' WHEN '物流运输费' THEN '物流' ELSE '' END AS words,
 CASE WHEN name LIKE '*%' THEN '高' WHEN name IN ('冷轧钢板', '办公用品', '物流运输费') THEN '中' ELSE '低' END AS confidence, count(*) AS n FROM lines GROUP BY ALL""")
def x3_x5_keywords(spark, d):
    """X3 words in stars, X4 dictionary words, X5 both merged."""
    names = fixtures.invoice_lines(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    out = names.withColumn("k", X.keywords(F.col("name")))
    return out.select("name", F.array_join("k.keywords", "|").alias("words"), "k.confidence", "n")


_PREFIX = S.case([(f"starts_with(tax_code, '{p}')", str(c)) for p, c in sorted(dims.CATEGORY_PREFIXES.items(), key=lambda x: -len(x[0]))])
_LABEL = S.case([(f"c = {k}", S.q(v)) for k, v in dims.CATEGORY_LABELS.items()], "'其他'")


@register(f"WITH t AS (SELECT CAST(100 + l_partkey % 900 AS VARCHAR) AS tax_code FROM lineitem), c AS (SELECT tax_code, {_PREFIX} AS c FROM t) SELECT tax_code, c AS category, {_LABEL} AS label, count(*) AS n FROM c GROUP BY ALL")
def x6_x8_category(spark, d):
    """X6 category by prefix, X8 its label."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((100 + F.col("l_partkey") % 900).cast("string").alias("tax_code")).groupBy("tax_code").agg(F.count("*").alias("n"))
    rows = rows.withColumn("category", X.category_of_code(F.col("tax_code")))
    return rows.select("tax_code", "category", X.category_label(F.col("category")).alias("label"), "n")


_WORDS = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 6 WHEN 0 THEN '办公用' WHEN 1 THEN '复印纸张' WHEN 2 THEN '天然汽' WHEN 3 THEN '维修费' WHEN 4 THEN '打印机器' ELSE '苹果' END AS word FROM lineitem"


@register(f"""WITH w AS ({_WORDS}) SELECT word, CASE word WHEN '苹果' THEN NULL WHEN '打印机器' THEN '办公-设备' WHEN '维修费' THEN '服务-维修' WHEN '天然汽' THEN '能源-天然气' ELSE '办公-用品' END AS matched, CASE word WHEN '苹果' THEN NULL WHEN '维修费' THEN 1.0 WHEN '天然汽' THEN 0.666667 ELSE 0.75 END::DOUBLE AS similarity, count(*) AS n FROM w GROUP BY word""")
def x7_fuzzy(spark, d):
    words = fixtures.sql(spark, d, _WORDS)
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    return matching.fuzzy(words, "word", 0.6).join(n, "word").select("word", "matched", F.round("similarity", 6).alias("similarity"), "n")


# Parts with words of the ledger's rules in turn, and their names once more in pieces.
_RULED = "SELECT p_partkey, concat(p_name, ' ', coalesce(a.word, ''), '/', coalesce(b.word, '')) AS text FROM part LEFT JOIN {words} a ON a.k = p_partkey % {n} LEFT JOIN {words} b ON b.k = (p_partkey * 7) % {n}"
_RULE_WORDS = [(k, w, False) for k, (_, _, words, _, _) in enumerate(dims.LEDGER_RULES) for w in words] + [(k, w, True) for k, (_, _, _, words, _) in enumerate(dims.LEDGER_RULES) for w in words]
_WORD_ROWS = S.values([(n, w) for n, (_, w, _) in enumerate(_RULE_WORDS)], "k, word")
_PART_RULES = "SELECT 1000 + min(p_size) AS rule, p_name AS word, false AS excludes FROM part GROUP BY p_name UNION ALL SELECT 1000 + p_size, p_brand, true FROM part"


@register(f"""WITH t AS ({_RULED.format(words=_WORD_ROWS, n=len(_RULE_WORDS))}), d AS (SELECT DISTINCT text FROM t),
 r AS (SELECT rule, word, excludes FROM {S.values([(r, w, int(x)) for r, w, x in _RULE_WORDS], "rule, word, e")} q, LATERAL (SELECT q.e = 1 AS excludes) UNION ALL {_PART_RULES}),
 f AS (SELECT text, min(rule) AS rule FROM d JOIN r ON contains(text, word) AND NOT excludes GROUP BY text),
 x AS (SELECT DISTINCT f.text FROM f JOIN r ON r.rule = f.rule AND r.excludes AND contains(f.text, r.word))
 SELECT t.p_partkey, CAST(f.rule AS BIGINT) AS rule, x.text IS NOT NULL AS excluded FROM t LEFT JOIN f USING (text) LEFT JOIN x USING (text)""")
def x1_rule_table(spark, d):
    """X1 with the ordered rules of F1, J3 and C1 as a table, the ledger's and one for each part name: the first rule, and whether an excluding word stands beside it."""
    fixtures.sql(spark, d, "SELECT * FROM part")
    rules = spark.createDataFrame(_RULE_WORDS, "rule int, word string, excludes boolean").unionByName(spark.sql(_PART_RULES))
    texts = spark.sql(_RULED.format(words=_WORD_ROWS, n=len(_RULE_WORDS)))
    return keywords.first_rules(texts, "text", rules).select("p_partkey", "rule", "excluded")


@register("SELECT p_partkey, list_filter(string_split(p_name, ' ') || [CAST(p_partkey AS VARCHAR) || 'x', '件'], lambda w: w <> '') AS words FROM part".replace("list_filter(", "array_to_string(list_filter(").replace("<> '')", "<> ''), '|')"))
def x2_segmentation(spark, d):
    """X2 words of unspaced names: the best path through the words of all names."""
    p = spark.read.parquet(f"{d}/part.parquet")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    texts = p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_partkey", F.lit("x件")).alias("text"))
    return texts.join(keywords.segmented(texts, "text", words), "text").select("p_partkey", F.array_join("words", "|").alias("words"))


# Names of parts as candidates, in place of their least key; words are names with letters left out, put in or doubled.
_FUZZY_NAMES = "SELECT min(p_partkey) AS pos, p_name AS alias, max(p_type) AS standard FROM part GROUP BY p_name"
_FUZZY_WORDS = "SELECT DISTINCT concat(substr(p_name, 1, CAST(l_suppkey % 9 AS INT)), CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'el' WHEN 4 THEN ' ' WHEN 5 THEN 'zzz' ELSE substr(p_name, 2, 2) END, substr(p_name, CAST(2 + l_suppkey % 9 AS INT), 40)) AS word FROM lineitem JOIN part ON p_partkey = l_partkey"


@register(f"""WITH n AS ({_FUZZY_NAMES}), w AS (SELECT * FROM ({_FUZZY_WORDS}) WHERE trim(word) <> ''), s AS (SELECT word, standard, pos, 1 - levenshtein(trim(word), alias)::DOUBLE / greatest(length(trim(word)), length(alias)) AS sim FROM w, n),
 b AS (SELECT word, arg_max({{'s': standard, 'v': sim}}, {{'v': sim, 'p': -pos}}) AS b FROM s WHERE sim >= 0.8 GROUP BY word) SELECT w.word, b.s AS matched, round(b.v, 6) AS similarity FROM w LEFT JOIN b USING (word)""")
def x7_fuzzy_table(spark, d):
    """X7, M2 with a table of candidates of any size: edit distance behind a join of segments."""
    words, names = fixtures.sql(spark, d, _FUZZY_WORDS), fixtures.sql(spark, d, _FUZZY_NAMES)
    return matching.fuzzy(words, "word", 0.8, names).select("word", "matched", F.round("similarity", 6).alias("similarity"))


_TOKENS = "SELECT k, list_filter(string_split(lower(t), ''), lambda c: regexp_matches(c, '[\\w]')) AS ts FROM"


@register(f"""WITH c AS (SELECT p_partkey AS k, lower(p_name) AS t FROM part), q AS (SELECT DISTINCT p_type AS k, lower(p_type) AS t FROM part), ct AS (SELECT k, unnest(string_split(t, '')) AS w FROM c), qt AS (SELECT k, unnest(string_split(t, '')) AS w FROM q),
 tf AS (SELECT k, w, count(*) AS tf FROM ct WHERE regexp_matches(w, '[a-z0-9_]') GROUP BY ALL), qf AS (SELECT k, w, count(*) AS tf FROM qt WHERE regexp_matches(w, '[a-z0-9_]') GROUP BY ALL),
 idf AS (SELECT w, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY w), cw AS (SELECT k, w, tf * idf AS x FROM tf JOIN idf USING (w)), qw AS (SELECT k, w, tf * idf AS x FROM qf JOIN idf USING (w)),
 cn AS (SELECT k, sqrt(sum(x * x)) AS n FROM cw GROUP BY k), qn AS (SELECT k, sqrt(sum(x * x)) AS n FROM qw GROUP BY k), s AS (SELECT qw.k AS query, cw.k AS key, sum(qw.x / qn.n * cw.x / cn.n) AS score FROM qw JOIN cw USING (w) JOIN cn ON cn.k = cw.k JOIN qn ON qn.k = qw.k GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, key DESC) AS rank FROM s WHERE score > 0 AND score >= 0.01) SELECT query, key, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def v1_t1_catalogue_search(spark, d):
    """V1 TF-IDF cosine, T1 the best rows for each query."""
    part = spark.read.parquet(f"{d}/part.parquet")
    queries = part.select(F.col("p_type").alias("query")).distinct()
    out = matching.tfidf_top(queries, "query", part.select(F.col("p_partkey").alias("key"), "p_name"), "key", "p_name", 5, 0.01)
    return out.select("query", "key", F.round("score", 6).alias("score"), "rank")


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return matching.nearest_centroid(e.select("vec_id", "embedding"), "embedding", matching.centroids(e, "label", "embedding"), "label").drop("embedding")


@register("SELECT label, pos - 1 AS pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def a14_centroids(spark, d):
    means = matching.centroids(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


_NEAREST = """WITH m AS (SELECT label, pos, avg(v) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY label),
 s AS (SELECT vec_id, c.label AS nearest, round(list_cosine_similarity(embedding::DOUBLE[], c), 12) AS sim FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nearest) AS k FROM s), b AS (SELECT vec_id, nearest, greatest(0.0, least(1.0, sim)) AS confidence FROM r WHERE k = 1)"""


@register(_NEAREST + " SELECT vec_id, nearest, round(confidence, 6) AS confidence FROM b")
def v2_nearest_centroid(spark, d):
    return _near(spark, d).select("vec_id", "nearest", F.round("confidence", 6).alias("confidence"))


# A goods name for each vector, and the category of its words.
_GOODS = {0: ("冷轧钢板", 6), 1: ("*金属制品*螺栓", None), 2: ("*成品油*汽油", 5), 3: ("*供电*电费", None), 4: ("办公用品", 2), 5: ("住宿费", None), 6: ("物流运输费", 3), 7: ("*石油制品*润滑油", None), 8: ("复印纸", 2), 9: ("打印机维修", 0)}
_WORD_CATEGORY = S.case([(f"vec_id % 10 = {k}", str(c)) for k, (_, c) in _GOODS.items() if c is not None])


@register(_NEAREST + f""", w AS (SELECT *, {_WORD_CATEGORY} AS word FROM b) SELECT CASE WHEN vec_id % 5 = 1 THEN 'tax_code' WHEN confidence >= 0.7 THEN 'bert' WHEN word IS NOT NULL THEN 'keyword' ELSE 'bert' END AS source, CASE WHEN vec_id % 5 = 1 THEN 5 WHEN confidence >= 0.7 THEN nearest WHEN word IS NOT NULL THEN word ELSE nearest END AS category, count(*) AS n FROM w GROUP BY ALL""")
def c27_hybrid(spark, d):
    """C27 tax code, sure centroid, words, centroid; words come from X5 and X7."""
    near = _near(spark, d)
    names = spark.createDataFrame([(k, name) for k, (name, _) in _GOODS.items()], "k int, name string")
    own = names.select("k", F.posexplode(X.keywords(F.col("name"))["keywords"]).alias("pos", "word"))
    words = matching.category_of_words(own.join(matching.fuzzy(own, "word", 0.6), "word"), "k", "pos")
    code = F.when(F.col("vec_id") % 5 == 1, F.lit("1070101010100000000"))
    out = near.withColumn("k", (F.col("vec_id") % 10).cast("int")).join(words, "k", "left").select(matching.hybrid_category(code, F.col("nearest"), F.col("confidence"), F.col("category"), F.col("similarity")).alias("h"))
    return out.groupBy("h.source", "h.category").agg(F.count("*").alias("n"))


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}) SELECT name, CASE name WHEN '*成品油*汽油' THEN '能源-成品油' WHEN '办公用品' THEN '办公-用品' WHEN '冷轧钢板' THEN '原材料-钢材' WHEN '物流运输费' THEN '运输-物流' END AS matched, count(DISTINCT invoice_id) AS n FROM lines GROUP BY ALL""")
def c28_semantic_enhance(spark, d):
    """C28 the standard names of a line's words."""
    names = fixtures.invoice_lines(spark, d).groupBy("name").agg(F.countDistinct("invoice_id").alias("n"))
    words = names.select("name", F.posexplode(X.keywords(F.col("name"))["keywords"]).alias("pos", "word"))
    hits = words.join(matching.fuzzy(words, "word", 0.8), "word").where("matched IS NOT NULL")
    best = hits.groupBy("name").agg(F.min_by("matched", "pos").alias("matched"))
    return names.join(best, "name", "left").select("name", "matched", "n")


_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT '冷轧' UNION SELECT ''"


@register("""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT '冷轧' UNION SELECT '') SELECT name, CASE name WHEN '冷轧' THEN 'custom' WHEN 'cold anvil' THEN 'cpcd' WHEN 'old anvil' THEN 'cpcd' WHEN 'small ring' THEN 'custom' ELSE 'none' END AS source, CASE name WHEN '冷轧' THEN 2000.0 WHEN 'cold anvil' THEN 2.2 WHEN 'old anvil' THEN 2.2 WHEN 'small ring' THEN 0.2 END AS kg FROM n""")
def j10_match_source(spark, d):
    """J9 custom product, J11 newest catalogue row, J10 the first of both."""
    names = fixtures.sql(spark, d, _NAMES)
    own = L.products_by_name(names, "name", spark.sql(fixtures.PRODUCTS)).select("name", F.col("product.co2_per_unit").alias("own"))
    other = L.footprint_of_keyword(names, "name", spark.sql(fixtures.CATALOGUE)).withColumn("f", N.footprint(F.col("footprint"))).select("name", F.col("f.value").alias("other"))
    out = names.join(own, "name", "left").join(other, "name", "left")
    return out.select("name", F.when(F.col("own").isNotNull(), "custom").when(F.col("other").isNotNull(), "cpcd").otherwise("none").alias("source"), F.round(F.coalesce("own", "other"), 6).alias("kg"))


@register("SELECT p_partkey AS id, p_name AS product_name FROM part WHERE contains(lower(p_name), 'bolt')")
def f13_product_search(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.where(F.contains(F.lower("p_name"), F.lower(F.lit("BoLt")))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"))


# Airports of the fixture and of each nation; the three first letters of a nation may be those of another one.
_PORTS = """SELECT iata_code, concat('Z', iata_code) AS ident, concat(CASE iata_code WHEN 'PEK' THEN 'Beijing Capital' WHEN 'SHA' THEN 'Shanghai Hongqiao' WHEN 'CAN' THEN 'Guangzhou Baiyun' ELSE iata_code END, ' Airport') AS name, CASE iata_code WHEN 'PEK' THEN 'Beijing' WHEN 'SHA' THEN 'Shanghai' WHEN 'CAN' THEN 'Guangzhou' ELSE iata_code END AS municipality, latitude_deg, longitude_deg, pos FROM ({a})
 UNION ALL SELECT substr(n_name, 1, 3), concat('Y', CAST(n_nationkey AS STRING)), concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' International Airport' ELSE ' City' END), n_name, CASE n_nationkey WHEN 24 THEN 95.0E0 ELSE 10.0E0 END, 20.0E0, 100 + CAST(n_nationkey AS INT) FROM nation""".format(a=fixtures.AIRPORTS)
# Names with the syllables of their Chinese characters, where they have some.
_ASK = """SELECT CASE l_partkey % 9 WHEN 0 THEN 'pek' WHEN 1 THEN 'ZSHA' WHEN 2 THEN '白云' WHEN 3 THEN 'Shanghai Hongqiao' WHEN 4 THEN concat('Beijing', CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Capital' ELSE '-Capital Airport' END) WHEN 5 THEN '虹桥' WHEN 6 THEN '首都机场' WHEN 7 THEN '广州' ELSE concat('Nowhere ', CAST(l_suppkey AS STRING)) END AS name,
 CASE l_partkey % 9 WHEN 6 THEN 'beijing shoudu jichang' WHEN 7 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'guang zhou' END END AS spelled FROM lineitem
 UNION ALL SELECT concat(substr(n_name, 1, 5 + CAST(c_custkey % 6 AS INT)), ' ', c_mktsegment), NULL FROM customer JOIN nation ON n_nationkey = c_nationkey"""


_ALIASES = "SELECT * FROM (VALUES (' 白云·机场 ', 'can', NULL, 0), ('白云', NULL, ' zcan ', 1), ('浦东', ' ', NULL, 2), ('虹桥', 'PEK', NULL, 3), ('虹桥', 'SHA', NULL, 4)) AS t(zh, iata_code, ident, pos)"
_KEY = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '', 'g')"
_PLACES = f"ports AS (SELECT pos, upper(iata_code) AS iata_code, upper(ident) AS ident, {_KEY.format('name')} AS nk, {_KEY.format('municipality')} AS mk FROM ({_PORTS}) WHERE latitude_deg <= 90)"
_SPELLED = _KEY.format("replace(replace(replace(replace(lower(spelled), ' ', ''), 'shoudu', 'capital'), 'guoji', 'international'), 'jichang', 'airport')")
# All airports of a town whose key holds the first four characters, else all airports; the best by ratio, the first in place of equals.
_SUGGESTED = """ near AS (SELECT key, p.* FROM keys JOIN ports p ON contains(p.mk, substr(key, 1, 4))),
 cand AS (SELECT * FROM near UNION ALL SELECT key, p.* FROM keys, ports p WHERE key NOT IN (SELECT key FROM near)),
 pairs AS (SELECT DISTINCT key AS a, nk AS b FROM cand MORE),""" + S.RATIOS + """,
 placed AS (SELECT key, iata_code, score, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) AS INTEGER) AS rank FROM cand JOIN ratios ON a = key AND b = nk)"""


@register(f"""WITH RECURSIVE u AS (SELECT name, max({_SPELLED}) AS spelled FROM ({_ASK}) GROUP BY name), k AS (SELECT *, {_KEY.format('name')} AS key0 FROM u), {_PLACES}, keys AS (SELECT DISTINCT spelled AS key FROM k WHERE spelled <> ''),
 direct AS (SELECT key0, p.* FROM (SELECT DISTINCT key0 FROM k WHERE key0 <> '') JOIN ports p ON contains(p.mk, substr(key0, 1, 6))),{_SUGGESTED.replace("MORE", " UNION SELECT key0, nk FROM direct")},
 best AS (SELECT key0, arg_max({{'c': iata_code, 's': score}}, score * 1000000 - pos / 1000.0) AS d FROM direct JOIN ratios ON a = key0 AND b = nk GROUP BY key0),
 joined AS (SELECT k.*, i.iata_code AS ic, z.iata_code AS zc, al.code AS ac, d, CASE WHEN d.s >= 0.55 THEN d.c END AS sc, t.iata_code AS tc, t.score AS ts
  FROM k LEFT JOIN (SELECT DISTINCT iata_code FROM ports) i ON i.iata_code = upper(trim(k.name)) LEFT JOIN ports z ON z.ident = upper(trim(k.name))
  LEFT JOIN (VALUES ('白云机场', 'CAN'), ('白云', 'CAN'), ('虹桥', 'SHA')) al(alias, code) ON al.alias = regexp_replace(lower(trim(k.name)), '[\\s·•．。()（）_-]+', '', 'g')
  LEFT JOIN best USING (key0) LEFT JOIN placed t ON t.key = k.spelled AND t.rank = 1 AND t.score >= 0.42)
 SELECT name, coalesce(ic, zc, ac, sc, CASE WHEN key0 = '' OR d IS NOT NULL THEN tc END) AS code, CASE WHEN ic IS NOT NULL THEN 'iata' WHEN zc IS NOT NULL THEN 'ident' WHEN ac IS NOT NULL THEN 'alias' WHEN sc IS NOT NULL THEN 'similar' WHEN (key0 = '' OR d IS NOT NULL) AND tc IS NOT NULL THEN 'spelled' END AS how,
  round(CASE WHEN coalesce(ic, zc, ac) IS NOT NULL THEN 1.0 WHEN sc IS NOT NULL THEN d.s WHEN key0 = '' OR d IS NOT NULL THEN ts END, 6) AS score FROM joined""".replace("STRING", "VARCHAR"))
def j21_airports(spark, d):
    """S17 airports, S18 aliases, J21 the cascade with its scores."""
    aliases = facts.alias_rows(spark.sql(_ALIASES))
    out = airports.resolve(fixtures.sql(spark, d, _ASK), "name", facts.airports(fixtures.sql(spark, d, _PORTS)), aliases, "spelled")
    return out.select("name", "code", "how", F.round("score", 6).alias("score"))


@register(f"""WITH RECURSIVE k AS (SELECT DISTINCT name, {_KEY.format('name')} AS key FROM ({_ASK})), {_PLACES}, keys AS (SELECT DISTINCT key FROM k WHERE key <> ''),{_SUGGESTED.replace("MORE", "")}
 SELECT name, iata_code, rank, round(score, 6) AS score, max(score) OVER (PARTITION BY name) >= 0.42 AS answered FROM k JOIN placed USING (key) WHERE rank <= 3""".replace("STRING", "VARCHAR"))
def t2_airport_suggestions(spark, d):
    """T2 the three most similar airports at any score, and whether the best one answers."""
    out = airports.suggest(fixtures.sql(spark, d, _ASK), "name", facts.airports(fixtures.sql(spark, d, _PORTS)))
    return out.withColumn("score", F.round("score", 6))


_SEQ = "SELECT l_orderkey AS doc_id, l_linenumber * 10 + k AS pos, CASE WHEN l_orderkey % 3 = 0 THEN concat('*纸* ', CAST(l_partkey AS STRING)) WHEN k = 0 THEN concat('q', CAST(l_partkey AS STRING)) WHEN k = 1 THEN concat('¥', CAST(l_suppkey AS STRING), '.5') ELSE '合计' END AS text, CASE WHEN k = 0 AND l_orderkey % 3 <> 0 THEN 'question' WHEN k = 2 THEN 'other' ELSE 'answer' END AS label FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) + 1 AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) t {join} (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks"


@register("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) + 1 AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey AS doc_id, count(*) * CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n, sum(CASE WHEN l_orderkey % 3 = 0 THEN 2.0 * p ELSE s + 0.5 END) AS amount FROM l GROUP BY l_orderkey""")
def w4_answer_pairs(spark, d):
    """Questions with the answers behind them; documents without any give their star answers."""
    out = tables.answer_pairs(fixtures.sql(spark, d, _SEQ.format(join="CROSS JOIN")))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@register("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 20 OFFSET 40)")
def w5_page(spark, d):
    """W5 a page of a listing, T4 newest first."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return tables.page(p, "p_partkey", 3, 20).select("p_partkey", "p_name", "total")


@register("""WITH n AS (SELECT count(*) AS total FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total FROM r, n WHERE k > (total * 9 // 10) // 100 * 100 AND k <= (total * 9 // 10) // 100 * 100 + 100""")
def w5_deep_page(spark, d):
    """W5 a page behind nine tenths of all lines: only its range of keys is read and sorted."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    number = rows.count() * 9 // 10 // 100 + 1
    return tables.page(rows, "l_orderkey", number, 100, ties=("l_linenumber", "l_partkey", "l_suppkey"))


@register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1")
def w6_latest(spark, d):
    return tables.latest(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@register("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS kg FROM part")
def t3_sorted_products(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("kg"))
    return tables.sorted_by_emission(p, "kg")


# Each line is a change of its part: many changes for each id, most of them of one field; some delete, some add a part.
_CHANGES = "SELECT l_orderkey * 10 + l_linenumber AS version, CASE WHEN l_partkey % 11 = 0 AND l_linenumber = 3 THEN 'delete' WHEN l_linenumber = 5 THEN 'insert' ELSE 'update' END AS op, l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 OR l_linenumber = 5 THEN concat('n', CAST(l_orderkey AS {s})) END AS p_name, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber = 5 THEN l_extendedprice END AS p_retailprice FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey, l_linenumber) t"


@register(f"""WITH c AS ({_CHANGES.format(s="VARCHAR")}), m AS (SELECT id, bool_or(op = 'delete') AS gone, arg_max(p_name, version) FILTER (op = 'update' AND p_name IS NOT NULL) AS nm, arg_max(p_retailprice, version) FILTER (op = 'update' AND p_retailprice IS NOT NULL) AS pr FROM c WHERE op <> 'insert' GROUP BY id)
 SELECT p_partkey AS id, coalesce(nm, p_name) AS p_name, coalesce(pr, p_retailprice) AS p_retailprice FROM part LEFT JOIN m ON m.id = p_partkey WHERE NOT coalesce(gone, FALSE)
 UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY version), p_name, p_retailprice FROM c WHERE op = 'insert'""")
def s25_apply_changes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", "p_retailprice")
    return tables.apply_changes(p, fixtures.sql(spark, d, _CHANGES.format(s="STRING")), ["p_name", "p_retailprice"])


def _json(spark: SparkSession, d: str) -> DataFrame:
    """An invoice text for each order, in two spellings."""
    items = fixtures.sql(spark, d, "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    code = F.lpad(F.col("l_partkey").cast("string"), 19, "1")
    one = F.struct(F.concat(F.lit("P"), "l_partkey").alias("name"), code.alias("taxCode"), F.col("l_suppkey").alias("amount"), F.col("l_quantity").cast("int").cast("string").alias("quantity"))
    two = F.struct(F.concat(F.lit("P"), "l_partkey").alias("hwmc"), code.alias("x"), F.col("l_suppkey").cast("string").alias("je"), F.col("l_quantity").cast("int").alias("sl"))
    even = F.col("o_orderkey") % 2 == 0
    groups = items.groupBy("o_orderkey", "o_custkey")
    grouped = groups.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("one"), two.alias("two")))).alias("x"))
    first = F.struct(F.col("o_orderkey").cast("string").alias("invoiceNumber"), F.concat(F.lit("S"), "o_custkey").alias("sellerName"), F.transform("x", lambda v: v["one"]).alias("items"))
    second = F.struct(F.col("o_orderkey").alias("fpdm"), F.concat(F.lit(" S"), "o_custkey").alias("xfmc"), F.transform("x", lambda v: v["two"]).alias("details"))
    return grouped.select("o_orderkey", F.when(even, F.to_json(first)).otherwise(F.to_json(second)).alias("raw"))


_JSON_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number, 'S' || o_custkey AS seller_name, count(*) AS n, sum(l_suppkey)::DOUBLE AS total_amount, sum(CAST(l_quantity AS INT))::DOUBLE AS quantity, min(lpad(CAST(l_partkey AS VARCHAR), 19, '1')) AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey"""


def _by_invoice(parsed: DataFrame) -> DataFrame:
    lines = I.explode_lines(parsed)
    return lines.groupBy("invoice_number", "seller_name", "total_amount").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.min("tax_code").alias("code"))


@register(_JSON_SQL)
def s1_json_invoices(spark, d):
    """S1 JSON scan, S2 harvested codes, O24 alias getter, W7 k-th code to k-th line, U2 lines of many invoices."""
    return _by_invoice(I.from_json(_json(spark, d)))


def _xml(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.sql(spark, d, "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    item = F.format_string("<Item><name>P%d</name><taxCode> %s </taxCode><amount>%d</amount><quantity>%d</quantity></Item>", "l_partkey", F.lpad(F.col("l_partkey").cast("string"), 19, "1"), "l_suppkey", F.col("l_quantity").cast("int"))
    grouped = rows.groupBy("o_orderkey", "o_custkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("x"))
    return grouped.select("o_orderkey", F.format_string("<Invoice><invoiceNumber>%d</invoiceNumber><sellerName>S%d</sellerName><FPDetail>%s</FPDetail></Invoice>", "o_orderkey", "o_custkey", "x").alias("raw"))


@register(_JSON_SQL)
def s3_s4_xml_invoices(spark, d):
    return _by_invoice(I.from_xml(_xml(spark, d)))


def _zip(batches):
    """A package for each order: its invoice in two members by turns, with members that are none; some packages are no zip, or hold a corrupt member."""
    for batch in batches:
        paths, contents = [], []
        for key, raw in zip(batch.column("o_orderkey").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            paths.append(str(key))
            if key % 7 == 0:
                contents.append(b"no zip")
                continue
            head, lines = raw.split("<FPDetail>")
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("OFD.xml", "<OFD><Version>1</Version></OFD>")
                z.writestr("__MACOSX/._invoice.xml", raw)
                if key % 3 == 0:
                    z.writestr("Doc_0/bad.xml", "<Invoice><sellerName>broken</sellerName></Invoice>")
                    z.writestr("Doc_0/head.xml", head + "</Invoice>")
                    z.writestr("Doc_0/lines.xml", "<Invoice><invoiceNumber>other</invoiceNumber><FPDetail>" + lines)
                else:
                    z.writestr("Doc_0/invoice.xml", raw)
                z.writestr("Doc_0/seal.bin", "x")
            data = buffer.getvalue()
            if key % 3 == 0:
                data = data.replace(b"<Invoice><sellerName>broken", b"<Invoice><sellerName>BROKEN", 1)  # its checksum is wrong now
            contents.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS invoice_number, CASE WHEN o_orderkey % 7 <> 0 THEN 'S' || o_custkey END AS seller_name,
 CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE sum(l_suppkey) END::DOUBLE AS total_amount, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN o_orderkey % 7 <> 0 THEN min(lpad(CAST(l_partkey AS VARCHAR), 19, '1')) END AS code,
 CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END AS members, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS rejected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def s5_zipped_documents(spark, d):
    """S5 one invoice for each package of several XML members, and what could not be read of it."""
    zipped = _xml(spark, d).mapInArrow(_zip, "path string, content binary")
    out = I.from_packages(zipped)
    return out.select("path", "invoice_number", "seller_name", "total_amount", F.size("lines").cast("long").alias("n"), F.array_min("lines.tax_code").alias("code"), "members", "rejected")


@register(_JSON_SQL.replace("SELECT CAST", "SELECT f.file, CAST").replace(" FROM orders", " FROM (VALUES ('json'), ('xml')) f(file), orders").replace("GROUP BY o_orderkey", "GROUP BY f.file, o_orderkey") + " UNION ALL SELECT k || ' rejects', NULL, NULL, count(DISTINCT o_orderkey), NULL, NULL, NULL FROM orders JOIN lineitem ON l_orderkey = o_orderkey, (VALUES ('json'), ('xml')) v(k) GROUP BY k")
def s1_s3_invoice_files(spark, d):
    """S1, S3 files of many invoices, JSON lines and XML elements, read in parts, with the rejects beside them."""
    base = f"{shared_folder(spark)}/invoices-{uuid.uuid4().hex}"
    _json(spark, d).select(F.concat("raw", F.lit("\nno invoice"))).write.text(f"{base}/json")
    _xml(spark, d).select(F.concat(F.lit("<?xml version='1.0'?><!-- batch --><Batch>"), "raw", F.lit("</Batch> stray"))).write.text(f"{base}/xml")
    kinds = {"json": (I.json_records(spark.read, f"{base}/json"), I.from_json), "xml": (I.xml_records(spark.read, f"{base}/xml"), I.from_xml)}
    out = None
    for kind, (records, parse) in kinds.items():
        lines = I.explode_lines(parse(I.with_rejects(records)), rejects=True).withColumn("file", F.when(F.col("reject").isNull(), kind).otherwise(f"{kind} rejects"))
        both = lines.groupBy("file", "invoice_number", "seller_name", F.when(F.col("reject").isNull(), F.col("total_amount")).alias("total_amount")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.min("tax_code").alias("code"))
        out = both if out is None else out.unionByName(both)
    return out


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number, CASE o_orderkey % 3 WHEN 0 THEN 'S' || o_custkey WHEN 1 THEN 'T' END AS seller_name, '纸' AS name, CASE o_orderkey % 3 WHEN 0 THEN o_custkey ELSE 0 END::DOUBLE AS amount FROM orders WHERE o_orderkey % 3 < 2""")
def s6_api_bodies(spark, d):
    """S6 bodies with lines, with plain items, and with empty lines before items."""
    k = F.col("o_orderkey") % 3
    number = F.col("o_orderkey").cast("string").alias("invoice_number")
    lined = F.struct(number, F.struct(F.concat(F.lit("S"), "o_custkey").alias("name")).alias("seller"), F.array(F.struct(F.lit("纸 个").alias("name"), F.col("o_custkey").alias("amount"))).alias("lines"), F.array(F.lit("other")).alias("items"))
    plain = F.struct(number, F.lit("T").alias("seller"), F.array(F.lit("纸")).alias("items"))
    empty = F.struct(number, F.array().cast("array<string>").alias("lines"), F.array(F.lit("纸")).alias("items"))
    raw = F.when(k == 0, F.to_json(lined)).when(k == 1, F.to_json(plain)).otherwise(F.to_json(empty))
    out = I.from_api(spark.read.parquet(f"{d}/orders.parquet").select(raw.alias("raw")))
    return I.explode_lines(out).select("invoice_number", "seller_name", "name", "amount")


@register("SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, o_custkey * 1000 + 0.5 AS total_amount, o_custkey * 1000 + 0.5 AS amount, 2.0 AS quantity FROM orders")
def s7_ocr_results(spark, d):
    t = F.col("o_orderdate")
    amount = F.concat(F.lit("¥"), "o_custkey", F.lit(",000.50"))
    line = F.struct(F.lit("纸").alias("item_name"), F.lit(" 2 ").alias("item_number"), amount.alias("item_amount"), F.lit("13%").alias("item_tax_rate"))
    raw = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("invoice_number"), F.concat(F.year(t), F.lit("年"), F.month(t), F.lit("月"), F.dayofmonth(t), F.lit("日")).alias("issue_date"), amount.alias("tax_exclusive_total_amount"), F.array(line).alias("items")))
    out = I.from_ocr(spark.read.parquet(f"{d}/orders.parquet").select(raw.alias("raw")))
    return I.explode_lines(out).select("invoice_number", "invoice_date", "total_amount", "amount", "quantity")


@register("SELECT CASE o_orderkey % 3 WHEN 2 THEN 'page_info' ELSE 'ok' END AS state, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_orderkey AS VARCHAR) END AS invoice_number, CASE WHEN o_orderkey % 3 <> 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date, CASE WHEN o_orderkey % 3 = 1 AND o_custkey = 0 THEN 1.0 WHEN o_orderkey % 3 <> 2 THEN o_custkey::DOUBLE END AS total_amount FROM orders")
def s8_expense_envelopes(spark, d):
    """S8 envelopes with both kinds of lines; those without a page are rejects."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    millis = F.unix_millis(F.to_timestamp("o_orderdate")).cast("string")
    detail = F.struct(F.col("o_orderkey").cast("string").alias("No"), F.array(F.struct(F.lit("茶").alias("Name"), F.col("o_custkey").cast("string").alias("Amount"))).alias("Items"))
    first = F.struct(F.array(F.struct(millis.alias("receipt_date"), detail.alias("invoice_detail"))).alias("page_info"))
    page = F.struct(millis.alias("receipt_date"), F.col("o_orderkey").cast("string").alias("invoice_num"), F.col("o_custkey").cast("string").alias("receipt_amount"), F.array(F.struct(F.lit("差旅").alias("comments"), F.lit("1").alias("receipt_amount"))).alias("items"))
    second = F.struct(F.struct(F.array(page).alias("page_info")).alias("data"))
    k = F.col("o_orderkey") % 3
    good, bad = I.from_erp(o.select(F.when(k == 0, F.to_json(first)).when(k == 1, F.to_json(second)).otherwise('{"x": 1}').alias("raw")))
    none = F.lit(None).cast("string")
    return good.select(F.lit("ok").alias("state"), "invoice_number", "invoice_date", "total_amount").unionByName(bad.select(F.col("reject_reason").alias("state"), none.alias("invoice_number"), none.alias("invoice_date"), F.lit(None).cast("double").alias("total_amount")))


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}), g AS (SELECT * FROM {S.values([('national', '全国', dims.GRID_NATIONAL)] + [('region', k, v) for k, v in dims.GRID_REGIONS.items()] + [('province', k, v) for k, v in dims.GRID_PROVINCES.items()], 'level, name, kg')})
 SELECT level, g.name, count(*) AS n, round(sum(quantity * kg), 3) AS kg FROM lines JOIN g ON g.level = 'national' OR (g.level = 'region' AND g.name = {_REGION}) OR (g.level = 'province' AND starts_with(seller_address, g.name)) GROUP BY ALL""")
def s12_grid_factors(spark, d):
    """The kilowatt hours of all lines by the factor of the country, of the region and of the province of the seller."""
    address = F.col("seller_address")
    keys = F.array(F.struct(F.lit("national").alias("level"), F.lit("全国").alias("grid")), F.struct(F.lit("region").alias("level"), M.region_of(address).alias("grid")), F.struct(F.lit("province").alias("level"), F.substring(address, 1, 2).alias("grid")))
    lines = fixtures.invoice_lines(spark, d).select("quantity", F.explode(keys).alias("k")).select("quantity", F.col("k.level").alias("level"), F.col("k.grid").alias("name"))
    return lines.join(F.broadcast(facts.grid_rows(spark)), ["level", "name"]).groupBy("level", "name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("quantity") * F.col("kg_per_kwh")), 3).alias("kg"))


@register("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'gasoline' WHEN 1 THEN 'waste' ELSE 'hotel' END AS key, round(sum(l_quantity * CASE l_linenumber % 3 WHEN 0 THEN 633.96 * 0.75 / 1000 WHEN 1 THEN 0.0419 ELSE 0.2036 END), 4) AS kg FROM lineitem GROUP BY ALL")
def s14_scene_factors(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("key", F.element_at(F.array(F.lit("gasoline"), F.lit("waste"), F.lit("hotel")), (F.col("l_linenumber") % 3 + 1).cast("int")))
    return rows.join(F.broadcast(facts.scene_rows(spark)), "key").groupBy("key").agg(F.round(F.sum(F.col("l_quantity") * F.col("kg")), 4).alias("kg"))


@register("SELECT p_partkey % 40 AS id, min(p_partkey) AS list_pos, arg_max(p_name, p_partkey) AS name FROM part GROUP BY ALL")
def s15_first_by_id(spark, d):
    """S15 first place, last value."""
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 40).alias("id"), F.col("p_partkey").alias("list_pos"), F.col("p_name").alias("name"))
    return M.first_by_id(p)


@register("SELECT 'kept' AS state, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem WHERE l_linenumber % 3 <> 0")
def s11_factor_file(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("kg_co2e_per_unit"), F.lit("x").alias("description"))
    return facts.factor_rows(rows).groupBy(F.lit("kept").alias("state")).agg(F.count("*").alias("n"), F.round(F.sum("kg_co2e_per_unit"), 4).alias("total"))


@register("SELECT row_number() OVER (ORDER BY src, pos) - 1 AS rule_pos, name FROM (SELECT 0 AS src, p_partkey AS pos, p_name AS name FROM part WHERE p_size > 25 UNION ALL SELECT 1, p_partkey, p_name FROM part WHERE p_size <= 25)")
def u1_stacked_rules(spark, d):
    """U1 sources under each other, T5 order kept."""
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = lambda c: p.where(c).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("rule_pos"))
    return facts.stacked(facts.with_fallback(rows("p_size > 25")), rows("p_size <= 25")).select("rule_pos", "name")


_RULES = "SELECT p_partkey AS row_no, CAST(100 + p_partkey AS STRING) AS code, CASE p_size % 4 WHEN 0 THEN '范围一' WHEN 1 THEN 'Scope 2' WHEN 2 THEN 'scope 3 x' ELSE '?' END AS scope, CASE p_partkey % 3 WHEN 0 THEN '蜡；沥青' WHEN 1 THEN '' END AS exclude, CASE WHEN p_partkey % 2 = 0 THEN concat('f', CAST(p_size AS STRING)) END AS factor FROM part"
_SCOPED = "CASE scope WHEN '范围一' THEN 'Scope 1' WHEN 'Scope 2' THEN 'Scope 2' WHEN 'scope 3 x' THEN 'Scope 3' END"


@register(f"""WITH r AS ({_RULES}), n AS (SELECT *, {_SCOPED} AS own, CASE WHEN exclude = '蜡；沥青' THEN '蜡|沥青' ELSE '' END AS words, coalesce(factor, 'default') AS f FROM r)
 SELECT 'table' AS state, code AS prefix, own AS scope, words, f AS factor_id, row_number() OVER (ORDER BY -length(code)) * 0 AS k FROM n WHERE own IS NOT NULL
 UNION ALL SELECT 'sheet', code, own, words, f, row_no FROM n WHERE own IS NOT NULL
 UNION ALL SELECT 'listed', '1' || code, CASE WHEN scope = 'Scope 2' THEN scope ELSE 'Scope 3' END, '', f, 0 FROM n UNION ALL SELECT 'listed', '2' || code, CASE WHEN scope = 'Scope 2' THEN scope ELSE 'Scope 3' END, '', f, 0 FROM n UNION ALL SELECT 'listed', code, scope, CASE WHEN exclude = '蜡；沥青' THEN exclude ELSE '' END, f, 0 FROM n WHERE scope = 'Scope 2'
 UNION ALL SELECT 'keywords', code, CASE WHEN scope = 'Scope 2' THEN scope ELSE 'Scope 3' END, '', f, row_no FROM n WHERE row_no % 5 = 0""")
def s9_rule_sources(spark, d):
    """S9 the imported table before the sheet (columns found by their names) before the listed rules with the prefix file; keywords from the listed rules."""
    r = fixtures.sql(spark, d, _RULES)
    table = r.select(F.col("code").alias("tax_code"), "scope", F.col("exclude").alias("exclude_keywords"), F.col("factor").alias("emission_factor_id"))
    sheet = r.select("row_no", F.col("factor").alias("因子"), F.col("scope").alias(" 排放范围 "), F.col("code").alias("货物编码"), F.col("exclude").alias("排除词"))
    listed = r.select("row_no", "scope", F.array(F.concat(F.lit("1"), "code"), F.concat(F.lit("2"), "code")).alias("tax_code_prefixes"), F.when(F.col("row_no") % 5 == 0, F.array("code")).alias("keywords"), F.lit(None).cast("array<string>").alias("exclude_keywords"), F.col("factor").alias("emission_factor_id"))
    file = r.select("row_no", F.col("code").alias("prefix"), "scope", F.lit("x").alias("description"), "exclude", "factor")
    by_table, words = facts.load_rules(listed, table, sheet, file)
    by_sheet, _ = facts.load_rules(listed, table.where("false"), sheet, file)
    by_list, _ = facts.load_rules(listed, table.where("false"), sheet.where("false"), file)
    out = lambda rules, state, k: rules.select(F.lit(state).alias("state"), "prefix", "scope", F.array_join("exclude", "|").alias("words"), "factor_id", k.cast("long").alias("k"))
    zero = F.lit(0)
    rows = out(by_table, "table", zero).unionByName(out(by_sheet, "sheet", F.col("rule_pos"))).unionByName(out(by_list, "listed", zero))
    return rows.unionByName(out(words.withColumn("prefix", F.get("keywords", 0)), "keywords", F.col("rule_pos")))


@register("SELECT p_partkey AS row_index, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_retailprice || 'kgCO2e/件' AS carbon_footprint, 2000 + p_size AS data_year, p_brand FROM part")
def s16_catalogue(spark, d):
    """S16 catalogue columns by their Chinese names; others keep theirs."""
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = p.select(F.col("p_partkey").alias("row_index"), F.col("p_partkey").cast("string").alias("产品ID"), F.col("p_name").alias(" 产品名称"), F.concat(F.col("p_retailprice").cast("string"), F.lit("kgCO2e/件")).alias("碳足迹"), (2000 + F.col("p_size")).alias("数据年份"), "p_brand")
    return facts.catalogue_rows(rows)


_IDS = S.case([("key = 'grid'", S.case([(f"region = {S.q(k)}", S.q(v)) for k, v in [*dims.GRID_IDS.items(), ("全国", "electricity_national")]], "'electricity_national'"))], "key")
_STEPS = f"""{_MATCHED}, ids AS (SELECT *, {_IDS} AS factor_id FROM calc),
 st AS (SELECT invoice_id, 'classify' AS step, name AS input, CAST(factor_scope AS VARCHAR) AS output, confidence, NULL AS kg FROM ids UNION ALL SELECT invoice_id, 'match', name, factor_id, confidence, NULL FROM ids UNION ALL SELECT invoice_id, 'calculate', factor_id, '', confidence, CAST(floor(emissions * 10000 + 0.5) AS BIGINT) FROM ids)"""


@register(f"{_STEPS} SELECT step, input, output, confidence, count(*) AS n, count(DISTINCT invoice_id) AS invoices, sum(kg) / 10000.0 AS kg FROM st GROUP BY ALL")
def d1_audit_trails(spark, d):
    """D1 the steps of all trails, with what went in and came out."""
    steps = audit.trails(calculated(spark, d), "run").select("invoice_id", F.explode("steps").alias("s"))
    last = F.col("s.step") == "calculate"
    rows = steps.select("invoice_id", "s.step", "s.input", F.when(last, "").otherwise(F.col("s.output")).alias("output"), "s.confidence", F.when(last, F.round(F.col("s.output").cast("double") * 10000).cast("long")).alias("kg"))
    return rows.groupBy("step", "input", "output", "confidence").agg(F.count("*").alias("n"), F.countDistinct("invoice_id").alias("invoices"), (F.sum("kg") / 10000).alias("kg"))


@register(f"""{_STEPS}, pairs AS (SELECT DISTINCT invoice_id, factor_id, category FROM ids) SELECT CASE WHEN category IN ('电力', '燃料燃烧', '材料') THEN '物理因子' WHEN category = 'EEIO' THEN 'EEIO因子' ELSE '因子来源' END AS type,
 CASE WHEN category IN ('电力', '燃料燃烧', '材料') THEN factor_id || '，内置/未知' WHEN category = 'EEIO' THEN factor_id || '，行业/投入产出' ELSE '内置/未知' END AS source, '因子ID: ' || factor_id AS reference, count(*) AS invoices FROM pairs GROUP BY ALL""")
def d3_data_sources(spark, d):
    """D3 provenance of factors, A12 each once for a trail."""
    found = audit.trails(calculated(spark, d), "run").select("invoice_id", F.explode("data_sources").alias("p"))
    return found.groupBy("p.type", "p.source", "p.reference").agg(F.count("*").alias("invoices"))


@register(_MATCHED + " SELECT invoice_id, 3 * count(*) AS n_steps, round(round(sum(emissions), 2), 1) AS total, count(DISTINCT CASE WHEN key = 'grid' THEN region ELSE key END) AS n_sources FROM calc GROUP BY invoice_id")
def s24_json_reports(spark, d):
    """S24 a JSON report for each invoice, read back."""
    reports = audit.to_json(audit.trails(calculated(spark, d), "run"))
    schema = "invoice_id string, steps array<struct<step:string>>, final_result string, data_sources array<struct<type:string>>"
    got = reports.select("invoice_id", F.from_json("json", schema).alias("r")).where(F.col("invoice_id") == F.col("r.invoice_id"))
    total = F.get_json_object("r.final_result", "$.total").cast("double")
    return got.select("invoice_id", F.size("r.steps").cast("long").alias("n_steps"), F.round(total, 1).alias("total"), F.size("r.data_sources").cast("long").alias("n_sources"))


_YEARS = {i: y for i, _, _, _, _, _, y, _ in dims.factor_rows()}


@register(f"{_STEPS} SELECT factor_id, '来源: ' || CASE WHEN category = '电力' THEN '电网' ELSE '未知' END || {S.case([(f'factor_id = {S.q(i)}', S.q(f' ({y})' if y else '')) for i, y in _YEARS.items()])} || '; 单位: ' || {S.case([(f'factor_id = {S.q(r[0])}', S.q(r[4])) for r in dims.factor_rows()])} AS trace, count(*) AS n FROM ids GROUP BY ALL")
def o23_source_traces(spark, d):
    """O23 the trace of the factor of each line; no source is unknown."""
    years = M.factors(spark).select(F.col("id").alias("factor_id"), "year")
    rows = calculated(spark, d).join(years, "factor_id")
    trace = audit.source_trace(F.when(F.col("category") == "电力", "电网"), F.col("year"), F.col("factor_unit"))
    return rows.groupBy("factor_id", trace.alias("trace")).agg(F.count("*").alias("n"))


@register(_MATCHED + " SELECT invoice_id, count(*) AS n FROM calc WHERE invoice_id = (SELECT min(invoice_id) FROM calc) GROUP BY ALL")
def d2_find_trail(spark, d):
    """D2 the trail of one invoice: its lines are picked before trails are built."""
    rows = calculated(spark, d)
    least = rows.agg(F.min("invoice_id").alias("invoice_id"))
    trails = audit.trails(rows.join(least, "invoice_id", "left_semi"), "run")
    return trails.select("invoice_id", (F.size("steps") / 3).cast("long").alias("n"))
