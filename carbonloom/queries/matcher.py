"""Queries of the matcher path and its scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom import dims, fixtures
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import prefixes_first
from carbonloom.plans import matcher as M
from carbonloom.queries import sqltext as S
from carbonloom.sources import facts

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = f"WITH lines AS ({fixtures.INVOICE_LINES})"
_REGION = S.case([*[(f"contains(seller_address, '{p}')", S.q(r)) for p, r in dims.PROVINCE_GRIDS.items()], *[(S.any_of("seller_address", ws), S.q(r)) for ws, r in dims.REGION_NAMES]], "'全国'")
_GRID = S.case([(f"{_REGION} = '{r}'", f"{v}::DOUBLE") for r, v in dims.GRID_REGIONS.items()], "0.5777::DOUBLE")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.invoice_lines(spark, d).withColumn("region", M.region_of(F.col("seller_address")))


def calculated(spark: SparkSession, d: str) -> DataFrame:
    return M.line_path(lines(spark, d), M.factors(spark))


_N, _C = "trim(coalesce(name, ''))", "trim(coalesce(tax_code, ''))"
_SCOPE = S.case([(S.any_of(_N, dims.EXCLUSION_WORDS), "3"), *[(f"starts_with({_C}, '{p}')", str(s)) for p, s, _, _ in prefixes_first(dims.MATCHER_PREFIXES)], *[(S.any_of(_N, ws), str(s)) for ws, s in dims.MATCHER_KEYWORDS]], "3")
_CONF = S.case([(S.any_of(_N, dims.EXCLUSION_WORDS), "'高'"), *[(f"starts_with({_C}, '{p}')", S.q(c)) for p, _, _, c in prefixes_first(dims.MATCHER_PREFIXES)], *[(S.any_of(_N, ws), "'中'") for ws, s in dims.MATCHER_KEYWORDS]], "'低'")
_VALUES = {i: (v, u, c) for i, _, c, v, u, *_ in dims.factor_rows()}
_HAS = "(quantity > 0 AND trim(coalesce(unit, '')) <> '')"
_PHYS = [(f"{_HAS} AND {S.any_of(_N, ws)} AND {S.any_of('lower(unit)', [u.lower() for u in us])}", "'grid'" if c == "电力" else S.q(M._MATERIAL_FACTOR[m])) for ws, m, c, us in dims.PHYSICAL_MATERIALS]
_KEY = S.case([*_PHYS, (f"regexp_matches({_C}, '^[1-4]')", "'fuel_coal'"), (f"starts_with({_C}, '5')", "'grid'"), (f"{_C} <> ''", "'eeio_paper'"), *[(f"amount > 0 AND {S.any_of(_N, ws)}", S.q(dims.EEIO_INDUSTRIES[i])) for ws, i in dims.EEIO_NAMES]], "'eeio_default'")
_TYPE = S.case([(" OR ".join(f"({c})" for c, _ in _PHYS), "'物理因子'"), (f"regexp_matches({_C}, '^[1-5]')", "'物理因子'"), (f"{_C} <> ''", "'EEIO因子'"), *[(f"amount > 0 AND {S.any_of(_N, ws)}", "'EEIO因子'") for ws, _ in dims.EEIO_NAMES]], "'默认因子'")
_MATERIAL = S.any_of(_N, sorted({w for ws, *_ in dims.PHYSICAL_MATERIALS for w in ws} | {w for ws, _ in dims.EEIO_NAMES for w in ws}))
_MATCHED = f"""{LINES}, m AS (SELECT *, {_KEY} AS key, {_TYPE} AS match_type, {_REGION} AS region, {_GRID} AS grid FROM lines),
 f AS (SELECT *, CASE WHEN key = 'grid' THEN grid ELSE {S.case([(f"key = '{i}'", f"{v}::DOUBLE") for i, (v, _, c) in _VALUES.items() if c != '电力'])} END AS value, CASE WHEN key = 'grid' THEN '电力' ELSE {S.case([(f"key = '{i}'", S.q(c)) for i, (_, _, c) in _VALUES.items() if c != '电力'])} END AS category,
  CASE WHEN {_HAS} AND {_MATERIAL} AND match_type = '物理因子' THEN '高' WHEN {_HAS} AND {_MATERIAL} THEN '中' WHEN match_type = 'EEIO因子' AND ({_C} <> '' OR {_MATERIAL}) THEN '中' ELSE '低' END AS confidence FROM m),
 calc AS (SELECT *, CASE WHEN match_type = '物理因子' AND quantity > 0 THEN 'activity' ELSE 'expenditure' END AS method, greatest(0, value * CASE WHEN match_type = '物理因子' AND quantity > 0 THEN quantity ELSE greatest(coalesce(amount, 0), 0) END) AS emissions,
  CASE category WHEN '燃料燃烧' THEN 1 WHEN '电力' THEN 2 ELSE 3 END AS factor_scope FROM f)"""


@register(f"{LINES} SELECT name, tax_code, {_SCOPE} AS scope, {_CONF} AS confidence, count(*) AS n FROM lines GROUP BY ALL")
def j2_scope_rules(spark, d):
    rows = lines(spark, d).withColumn("s", M.classify_scope(F.col("tax_code"), F.col("name")))
    return rows.groupBy("name", "tax_code", "s.scope", "s.confidence").agg(F.count("*").alias("n"))


@register(f"{LINES} SELECT seller_address, {_REGION} AS region, {_GRID} AS factor, count(*) AS n FROM lines GROUP BY ALL")
def j5_j8_region_factor(spark, d):
    """J8 region of an address, J5 factor of category and region, S12 grid factors."""
    rows = lines(spark, d).withColumn("category", F.lit("电力"))
    out = M.with_category_factor(rows, "category", "region", M.factors(spark))
    return out.groupBy("seller_address", "region", F.col("factor.value").alias("factor")).agg(F.count("*").alias("n"))


_ASKED = "SELECT CASE l_partkey % 6 WHEN 0 THEN '钢材' WHEN 1 THEN '水泥' WHEN 2 THEN 'fuel_diesel' WHEN 3 THEN '电网' WHEN 4 THEN '铝' ELSE '茶' END AS query, l_quantity FROM lineitem"


@register(f"""WITH f AS (SELECT * FROM {S.values([(i, n, v, k) for k, (i, n, _, v, *_) in enumerate(dims.factor_rows())], 'id, name, value, pos')}), a AS ({_ASKED}),
 r AS (SELECT query, id, value, row_number() OVER (PARTITION BY query ORDER BY name <> query AND id <> query, pos) AS k FROM (SELECT DISTINCT query FROM a) JOIN f ON contains(name, query) OR contains(id, query))
 SELECT a.query, id, count(*) AS n, round(sum(l_quantity * value), 4) AS kg FROM a LEFT JOIN r ON r.query = a.query AND k = 1 GROUP BY ALL""")
def j6_factor_by_name(spark, d):
    rows = fixtures.sql(spark, d, _ASKED)
    out = rows.join(M.factor_by_name(M.factors(spark), rows, "query"), "query")
    return out.groupBy("query", "factor.id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("factor.value")), 4).alias("kg"))


@register("""SELECT industry, CASE industry WHEN '造纸厂' THEN 'eeio_paper' WHEN '钢铁业' THEN 'eeio_steel' WHEN '水泥制品' THEN 'eeio_cement' WHEN '默认' THEN 'eeio_default' ELSE 'eeio_paper' END AS factor_id, count(*) AS n
 FROM (SELECT CASE l_partkey % 6 WHEN 0 THEN '造纸厂' WHEN 1 THEN '钢铁业' WHEN 2 THEN '水泥制品' WHEN 3 THEN '默认' WHEN 4 THEN '' ELSE '农业' END AS industry FROM lineitem) GROUP BY ALL""")
def j7_industry_factor(spark, d):
    rows = fixtures.sql(spark, d, "SELECT CASE l_partkey % 6 WHEN 0 THEN '造纸厂' WHEN 1 THEN '钢铁业' WHEN 2 THEN '水泥制品' WHEN 3 THEN '默认' WHEN 4 THEN '' ELSE '农业' END AS industry FROM lineitem")
    return rows.groupBy("industry", M.industry_factor(F.col("industry")).alias("factor_id")).agg(F.count("*").alias("n"))


@register(f"{LINES} SELECT name, {_HAS} IS TRUE AS has_quantity, count(*) AS n FROM lines GROUP BY ALL")
def f11_has_quantity(spark, d):
    return lines(spark, d).groupBy("name", M.has_quantity().alias("has_quantity")).agg(F.count("*").alias("n"))


@register(_MATCHED + " SELECT name, region, match_type, confidence, round(value, 6) AS value, count(*) AS n FROM f GROUP BY ALL")
def c12_match_factor(spark, d):
    """C12 match, C13 confidence."""
    out = M.match_factors(lines(spark, d), M.factors(spark))
    return out.groupBy("name", "region", "match_type", "confidence", F.round("value", 6).alias("value")).agg(F.count("*").alias("n"))


@register(_MATCHED + " SELECT name, method, factor_scope, count(*) AS n, round(sum(emissions), 2) AS kg FROM calc GROUP BY ALL")
def c14_calculate(spark, d):
    return calculated(spark, d).groupBy("name", "method", "factor_scope").agg(F.count("*").alias("n"), F.round(F.sum("emissions"), 2).alias("kg"))


_UNITS = """SELECT CASE l_partkey % 9 WHEN 0 THEN '兆瓦时' WHEN 1 THEN 'kWh' WHEN 2 THEN ' 吨 ' WHEN 3 THEN '公升' WHEN 4 THEN '平方' WHEN 5 THEN '万元' WHEN 6 THEN '' WHEN 7 THEN 'GJ' ELSE 'Box' END AS unit, l_quantity AS quantity FROM lineitem"""


@register(f"""WITH u AS ({_UNITS}) SELECT unit, CASE trim(unit) WHEN '兆瓦时' THEN 'MWh' WHEN 'kWh' THEN 'kWh' WHEN '吨' THEN 't' WHEN '公升' THEN 'L' WHEN '平方' THEN 'm3' WHEN '万元' THEN 'CNY' WHEN '' THEN 'unit' WHEN 'GJ' THEN 'GJ' ELSE 'box' END AS standard,
 round(sum(CASE WHEN unit = '兆瓦时' THEN quantity * 1000 ELSE quantity END), 2) AS kwh FROM u GROUP BY ALL""")
def c15_units(spark, d):
    rows = fixtures.sql(spark, d, _UNITS)
    return rows.groupBy("unit", N.activity_unit(F.col("unit")).alias("standard")).agg(F.round(F.sum(N.factor_quantity(F.col("quantity"), F.col("unit"), F.lit("kgCO2e/kWh"))), 2).alias("kwh"))


@register(_MATCHED + " SELECT invoice_id, coalesce(sum(CAST(floor(emissions * 10000 + 0.5) AS BIGINT)) FILTER (WHERE factor_scope = 1), 0) / 10000.0 AS scope1, coalesce(sum(CAST(floor(emissions * 10000 + 0.5) AS BIGINT)) FILTER (WHERE factor_scope = 2), 0) / 10000.0 AS scope2, coalesce(sum(CAST(floor(emissions * 10000 + 0.5) AS BIGINT)) FILTER (WHERE factor_scope = 3), 0) / 10000.0 AS scope3 FROM calc GROUP BY invoice_id")
def a3_invoice_summary(spark, d):
    """C29 line path, A3 summary by invoice."""
    rows = calculated(spark, d).withColumn("units", F.floor(F.col("emissions") * 10000 + 0.5))
    return M.summary(rows, "invoice_id", kg="units").select("invoice_id", *[(F.col(f"scope{k}") / 10000).alias(f"scope{k}") for k in (1, 2, 3)])


@register(_MATCHED + " SELECT count(DISTINCT invoice_id) AS invoices, round(coalesce(sum(emissions) FILTER (WHERE factor_scope = 1), 0), 1) AS scope1, round(coalesce(sum(emissions) FILTER (WHERE factor_scope = 2), 0), 1) AS scope2, round(sum(emissions), 1) AS total, product_line FROM calc GROUP BY product_line")
def a4_batch_summary(spark, d):
    rows = calculated(spark, d)
    n = rows.groupBy("product_line").agg(F.countDistinct("invoice_id").alias("invoices"))
    return M.summary(rows, "product_line").join(n, "product_line").select("invoices", *[F.round(c, 1).alias(c) for c in ("scope1", "scope2", "total")], "product_line")


@register(_MATCHED + " SELECT product_line, count(*) FILTER (WHERE confidence = '高') AS high, count(*) FILTER (WHERE confidence = '中') AS medium, count(*) FILTER (WHERE confidence NOT IN ('高', '中')) AS low, count(*) AS total FROM calc GROUP BY product_line")
def a10_confidence_counts(spark, d):
    return M.confidence_counts(calculated(spark, d), "product_line")


@register(_MATCHED + " SELECT invoice_id, name AS item_name, confidence, count(*) AS n FROM calc WHERE confidence = '低' GROUP BY ALL")
def f12_needs_review(spark, d):
    return M.needs_review(calculated(spark, d)).groupBy("invoice_id", "item_name", "confidence").agg(F.count("*").alias("n"))


_INV = f"""{LINES}, inv AS (SELECT invoice_id, list(struct_pack(name := name, quantity := quantity, amount := amount, unit := coalesce(unit, '')) ORDER BY line_no, name, quantity NULLS FIRST, amount) AS items, min(seller_name) AS seller_name, min(seller_address) AS seller_address,
  sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS total, string_agg(name, ' ') AS texts FROM lines GROUP BY invoice_id),
 x AS (SELECT *, {_REGION} AS region, {_GRID} AS grid, list_filter(items, lambda i: i.quantity > 0 AND (i.unit = '度' OR (contains(i.name, '电') AND i.unit = '')))[1].quantity AS kwh,
  CASE WHEN total > 0 THEN total ELSE items[1].amount END AS amt, list_filter(items, lambda i: i.quantity > 0 AND (contains(i.unit, '升') OR contains(i.name, '油')))[1].quantity AS fuel FROM inv)"""
_R2 = "floor(({}) * 100 + 0.5) / 100"
_GAS, _ROAD, _HOTEL = f"({dims.litre_factor('gasoline')!r}::DOUBLE)", f"({dims.scene_factor('road')!r}::DOUBLE)", f"({dims.scene_factor('hotel')!r}::DOUBLE)"
_SCEN = f"""{_INV}, s AS (SELECT *, CASE WHEN kwh > 0 THEN 'electricity' WHEN contains(texts, '住宿') AND amt > 0 THEN 'hotel' WHEN (contains(texts, '汽油') OR contains(texts, '成品油')) AND fuel IS NOT NULL THEN 'transport' WHEN amt > 0 THEN 'logistics' END AS scenario FROM x),
 k AS (SELECT *, CASE scenario WHEN 'electricity' THEN {_R2.format('kwh * grid')} WHEN 'hotel' THEN {_R2.format(f'amt * {_HOTEL}')} WHEN 'transport' THEN {_R2.format(f'fuel * {_GAS}')} WHEN 'logistics' THEN {_R2.format(f'amt * {_ROAD}')} END AS kg FROM s)"""


def scenario_rows(spark: SparkSession, d: str) -> DataFrame:
    return M.scenarios(M.invoices(fixtures.invoice_lines(spark, d)), M.factors(spark))


@register(_SCEN + " SELECT invoice_id, scenario, kg FROM k")
def c24_scenarios(spark, d):
    """C16 electricity, C17 water, C18 hotel, C20 transport, C21 logistics, C23 waste in the cascade C24."""
    return scenario_rows(spark, d).select("invoice_id", "scenario", "kg")


@register(_INV + f" SELECT invoice_id, kwh, region, {_R2.format('kwh * grid')} AS kg FROM x WHERE kwh > 0")
def c16_electricity(spark, d):
    rows = scenario_rows(spark, d).where("scenario = 'electricity'")
    return rows.select("invoice_id", "kwh", "region", "kg")


_WATER = """SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CASE WHEN l_linenumber % 2 = 0 THEN '自来水费' ELSE concat('用量 ', CAST(l_partkey % 90 AS STRING), '吨') END AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS quantity, CASE WHEN l_linenumber % 4 = 0 THEN '立方米' ELSE '' END AS unit, 0.0E0 AS amount, 's' AS seller_name, '' AS seller_address FROM lineitem"""


@register(f"""WITH w AS ({_WATER}), i AS (SELECT invoice_id, list(quantity ORDER BY line_no, name, quantity NULLS FIRST) FILTER (WHERE quantity > 0) AS qs, max(CASE WHEN line_no % 2 = 1 THEN TRY_CAST(regexp_extract(name, '([0-9]+)吨', 1) AS DOUBLE) END) AS best FROM w GROUP BY invoice_id),
 c AS (SELECT invoice_id, CASE WHEN qs[1] IS NOT NULL THEN qs[1] WHEN best > 0 THEN best END AS water FROM i) SELECT invoice_id, water, {_R2.format('water * 0.168::DOUBLE')} AS kg FROM c""")
def c17_water(spark, d):
    rows = M.invoices(fixtures.sql(spark, d, _WATER)).withColumn("water", M.water_tonnes())
    return rows.select("invoice_id", "water", N.js_round(F.col("water") * dims.SCENE_WATER, 2).alias("kg"))


_STAYS = """SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, concat('住宿', CAST(1 + l_partkey % 5 AS STRING), '晚') AS name, CAST(NULL AS DOUBLE) AS quantity, '' AS unit, CASE WHEN l_orderkey % 2 = 0 THEN 0.0E0 ELSE l_extendedprice END AS amount, concat(CASE l_suppkey % 4 WHEN 0 THEN '北京' WHEN 1 THEN '上海' WHEN 2 THEN '西安' ELSE '拉萨' END, '饭店') AS seller_name, '' AS seller_address FROM lineitem"""
_STAY_SQL = f"""WITH h AS ({_STAYS}), i AS (SELECT invoice_id, min(seller_name) AS seller, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS total, list(name ORDER BY line_no, name)[1] AS name FROM h GROUP BY invoice_id),
 n AS (SELECT *, CAST(regexp_extract(name, '([0-9]+)晚', 1) AS INT) AS nights, CASE substr(seller, 1, 2) WHEN '北京' THEN 500 WHEN '上海' THEN 500 WHEN '西安' THEN 350 END AS rate, CASE substr(seller, 1, 2) WHEN '北京' THEN 68.5 WHEN '上海' THEN 65.2 WHEN '西安' THEN 42.5 ELSE 50.0 END AS factor FROM i)"""


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return M.invoices(fixtures.sql(spark, d, _STAYS)).withColumn("city", M.hotel_city(F.col("seller_name")))


@register(f"{_STAY_SQL} SELECT invoice_id, CASE WHEN total > 0 THEN {_R2.format(f'total * {_HOTEL}')} ELSE {_R2.format('nights * 66.52::DOUBLE')} END AS kg FROM n")
def c18_hotel(spark, d):
    return _stays(spark, d).select("invoice_id", M.hotel_kg().alias("kg"))


@register(f"{_STAY_SQL} SELECT substr(seller, 1, 2) AS place, factor, CASE WHEN rate > 0 AND total > 0 THEN CAST(greatest(1, floor(total / rate)) AS INT) ELSE -1 END AS nights, count(*) AS n FROM n GROUP BY ALL")
def c19_hotel_nights(spark, d):
    """J19 city and rate, J20 factor of the city, C19 nights: none (-1) for a city without a rate or an invoice without an amount."""
    rows = _stays(spark, d)
    nights = M.estimated_nights(F.col("total_amount"), F.col("city"))
    return rows.groupBy(F.substring("seller_name", 1, 2).alias("place"), M.hotel_factor(F.col("city")).alias("factor"), F.coalesce(nights, F.lit(-1)).alias("nights")).agg(F.count("*").alias("n"))


_RIDES = """SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CASE l_partkey % 5 WHEN 0 THEN '出租车费' WHEN 1 THEN '滴滴 新能源' WHEN 2 THEN '地铁充值' WHEN 3 THEN '柴油' ELSE '打车 燃油' END AS name, CASE WHEN l_partkey % 5 = 3 THEN l_quantity END AS quantity, CASE WHEN l_partkey % 5 = 3 THEN '升' ELSE '' END AS unit, l_extendedprice AS amount, 's' AS seller_name, '' AS seller_address FROM lineitem"""



@register(f"""WITH r AS ({_RIDES}), i AS (SELECT invoice_id, list(quantity ORDER BY line_no, name, quantity) FILTER (WHERE name = '柴油')[1] AS litres, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS total, bool_or(name = '地铁充值') AS metro, bool_or(name = '滴滴 新能源') AS ev, bool_or(name = '打车 燃油') AS fuel FROM r GROUP BY invoice_id)
 SELECT invoice_id, CASE WHEN litres > 0 THEN 'fuel' WHEN metro THEN 'public' ELSE 'taxi' END AS kind, {_R2.format(f"CASE WHEN litres > 0 THEN litres * {dims.litre_factor('diesel')!r}::DOUBLE WHEN metro THEN total * {dims.scene_factor('public_transit')!r}::DOUBLE WHEN ev THEN total * {dims.scene_factor('taxi_ev')!r}::DOUBLE WHEN fuel THEN total * {dims.scene_factor('taxi_fuel')!r}::DOUBLE ELSE total * {dims.scene_factor('taxi')!r}::DOUBLE END")} AS kg FROM i""")
def c20_transport(spark, d):
    rows = M.invoices(fixtures.sql(spark, d, _RIDES)).withColumn("t", M.transport())
    return rows.select("invoice_id", "t.kind", "t.kg")


_FREIGHT = """SELECT l_orderkey AS invoice_id, CAST(l_quantity AS DOUBLE) AS tonne_km, CASE l_linenumber % 3 WHEN 0 THEN 'rail' WHEN 1 THEN 'air' ELSE 'road' END AS mode, CASE WHEN l_partkey % 4 = 0 THEN '65119X0452024C' END AS product_id, CASE l_suppkey % 3 WHEN 0 THEN '用 重型柴油货车 运输 一次' WHEN 1 THEN '中型冷链纯电动货车运输' ELSE '普通' END AS text FROM lineitem"""


@register(f"""WITH f AS ({_FREIGHT}), r AS (SELECT *, CASE mode WHEN 'rail' THEN 0.006502 WHEN 'air' THEN 0.921 ELSE CASE WHEN product_id IS NOT NULL THEN 0.1088 WHEN text LIKE '用%' THEN 0.0978 WHEN text LIKE '中型%' THEN 0.116 ELSE 0.2478 END END AS factor FROM f)
 SELECT mode, product_id, text, factor, count(*) AS n, round(sum(tonne_km * factor::DOUBLE), 3) AS kg FROM r GROUP BY ALL""")
def c22_freight(spark, d):
    """J15 road mode, S13 freight factors, C22 emission."""
    rows = fixtures.sql(spark, d, _FREIGHT).withColumn("factor", M.freight_factor(F.col("mode"), F.col("product_id"), F.col("text")))
    return rows.groupBy("mode", "product_id", "text", "factor").agg(F.count("*").alias("n"), F.round(F.sum(F.col("tonne_km") * F.col("factor")), 3).alias("kg"))


_LOGI = """SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CASE l_partkey % 4 WHEN 0 THEN concat(CAST(1 + l_suppkey % 9 AS STRING), '吨 公里') WHEN 1 THEN concat('铁路 ', CAST(1 + l_suppkey % 9 AS STRING), '吨 至 ', CAST(100 + l_suppkey AS STRING), '公里') WHEN 2 THEN concat('2t x ', CAST(100 + l_suppkey AS STRING), ' km 空运') ELSE '快递' END AS name, CAST(NULL AS DOUBLE) AS quantity, '' AS unit, l_extendedprice AS amount, 's' AS seller_name, '' AS seller_address FROM lineitem"""


_NUM = "([0-9]+\\.?[0-9]*)"


@register(f"""WITH l AS ({_LOGI}), i AS (SELECT invoice_id, string_agg(name, ' ' ORDER BY line_no, name, amount) AS t, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS total FROM l GROUP BY invoice_id),
 p AS (SELECT *, TRY_CAST(regexp_extract(t, '{_NUM}\\s*吨\\s*公里', 1) AS DOUBLE) AS direct, TRY_CAST(regexp_extract(t, '{_NUM}\\s*吨[^0-9]{{0,30}}?{_NUM}\\s*公里', 1) AS DOUBLE) * TRY_CAST(regexp_extract(t, '{_NUM}\\s*吨[^0-9]{{0,30}}?{_NUM}\\s*公里', 2) AS DOUBLE) AS product,
   TRY_CAST(regexp_extract(t, '(?i){_NUM}\\s*t\\s*[x×*]\\s*{_NUM}\\s*km', 1) AS DOUBLE) * TRY_CAST(regexp_extract(t, '(?i){_NUM}\\s*t\\s*[x×*]\\s*{_NUM}\\s*km', 2) AS DOUBLE) AS tkm FROM i),
 k AS (SELECT *, CASE WHEN direct > 0 THEN direct WHEN product > 0 THEN product WHEN tkm > 0 THEN tkm END AS tonne_km, {S.case([(S.any_of('t', ws), S.q(m)) for ws, m in dims.MODE_WORDS], "'road'")} AS mode FROM p)
 SELECT invoice_id, mode, tonne_km, CASE WHEN tonne_km > 0 THEN floor(tonne_km * CASE mode WHEN 'rail' THEN {dims.FREIGHT_RAIL!r}::DOUBLE WHEN 'air' THEN {dims.FREIGHT_AIR!r}::DOUBLE ELSE {dims.FREIGHT_ROAD_DEFAULT!r}::DOUBLE END * 10000 + 0.5) / 10000
   ELSE {_R2.format(f"total * CASE mode WHEN 'rail' THEN {dims.scene_factor('rail')!r}::DOUBLE WHEN 'air' THEN {dims.scene_factor('air')!r}::DOUBLE ELSE {_ROAD} END")} END AS kg FROM k""")
def c21_logistics(spark, d):
    """O22 tonne kilometres from text, C21 emission."""
    rows = M.invoices(fixtures.sql(spark, d, _LOGI))
    return rows.select("invoice_id", X.transport_mode(F.col("texts")).alias("mode"), X.tonne_km(F.col("texts")).alias("tonne_km"), M.logistics()["kg"].alias("kg"))


_TRASH = """SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CASE WHEN l_partkey % 2 = 0 THEN '垃圾清运费' ELSE '茶' END AS name, CAST(NULL AS DOUBLE) AS quantity, '' AS unit, l_extendedprice AS amount, 's' AS seller_name, '' AS seller_address FROM lineitem"""


@register(f"""WITH t AS ({_TRASH}), i AS (SELECT invoice_id, bool_or(name LIKE '垃圾%') AS hit, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS total FROM t GROUP BY invoice_id) SELECT invoice_id, CASE WHEN hit AND total > 0 THEN {_R2.format(f"total * {dims.scene_factor('waste')!r}::DOUBLE")} END AS kg FROM i""")
def c23_waste(spark, d):
    return M.invoices(fixtures.sql(spark, d, _TRASH)).select("invoice_id", M.waste_kg().alias("kg"))


_GOODS = """SELECT CASE l_partkey % 8 WHEN 0 THEN '微型电机' WHEN 1 THEN '冷轧钢板' WHEN 2 THEN '水泥' WHEN 3 THEN 'PVC 管' WHEN 4 THEN '铜线' WHEN 5 THEN '铝合金' WHEN 6 THEN '电缆' ELSE '茶叶' END AS name, CASE l_suppkey % 3 WHEN 0 THEN '吨' WHEN 1 THEN 'kg' ELSE '个' END AS unit, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem"""
_GOOD_FACTORS = [("微型电机", "material_motor", 6.0, "'个'", "高"), ("冷轧钢板", "material_steel", 2000.0, "'吨','kg'", "高"), ("水泥", "eeio_cement", 0.00042, "'吨','kg'", "高"), ("PVC 管", "material_plastic", 3.0, "'吨','kg'", "中"), ("铜线", "material_copper", 4.0, "'吨','kg'", "中"), ("铝合金", "material_aluminum", 10.0, "'吨','kg'", "中")]


@register(f"""WITH g AS ({_GOODS}) SELECT name, unit, {S.case([(f"name = '{n}'", S.q(i)) for n, i, *_ in _GOOD_FACTORS])} AS material_factor, {S.case([(f"name = '{n}'", f"CASE WHEN unit IN ({us}) THEN '{c}' ELSE '中' END") for n, _, _, us, c in _GOOD_FACTORS], "'低'")} AS confidence,
 round(sum(quantity * {S.case([(f"name = '{n}'", f"{v}::DOUBLE") for n, _, v, *_ in _GOOD_FACTORS], '0')}), 3) AS kg FROM g GROUP BY ALL""")
def c25_materials(spark, d):
    """J17 material by keyword, C25 emission."""
    out = M.material_emission(fixtures.sql(spark, d, _GOODS), M.factors(spark))
    return out.groupBy("name", "unit", "material_factor", "confidence").agg(F.round(F.sum("emissions"), 3).alias("kg"))


_SOLD = """SELECT CASE l_partkey % 5 WHEN 0 THEN '空调' WHEN 1 THEN '家用电冰箱' WHEN 2 THEN '电视' WHEN 3 THEN '复印机 A4' ELSE '茶壶' END AS product_type, CAST(l_quantity AS DOUBLE) AS quantity, CASE l_suppkey % 3 WHEN 0 THEN '华东' WHEN 1 THEN '全国' ELSE '四川' END AS region FROM lineitem"""


@register(f"""WITH s AS ({_SOLD}), p AS (SELECT *, CASE product_type WHEN '空调' THEN 12 WHEN '家用电冰箱' THEN 12 WHEN '电视' THEN 8 WHEN '复印机 A4' THEN 5 ELSE 0 END AS years, CASE product_type WHEN '空调' THEN 700.0 WHEN '家用电冰箱' THEN 300.0 WHEN '电视' THEN 150.0 WHEN '复印机 A4' THEN 80.0 ELSE 0.0 END AS annual_kwh, CASE region WHEN '华东' THEN 0.55::DOUBLE WHEN '全国' THEN 0.5777::DOUBLE ELSE 0.1564::DOUBLE END AS f FROM s)
 SELECT product_type, region, years, annual_kwh, round(sum(quantity * years * annual_kwh * f), 2) AS kg FROM p GROUP BY ALL""")
def c26_sold_products(spark, d):
    """S19 energy labels, J18 the label of a product (a local row before the built-in table), C26 emission in use."""
    labels = spark.sql("SELECT * FROM VALUES ('变频空调', 700.0, 12), ('茶壶', NULL, 3) AS t(productType, annualKWh, lifetimeYears)")
    out = M.product_use(fixtures.sql(spark, d, _SOLD), M.factors(spark), local=facts.energy_labels(labels))
    return out.groupBy("product_type", "region", "years", "annual_kwh").agg(F.round(F.sum("emissions"), 2).alias("kg"))
