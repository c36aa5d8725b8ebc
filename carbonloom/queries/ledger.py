"""Queries of the ledger path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom import dims, fixtures
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import longest_prefix
from carbonloom.plans import ledger as L
from carbonloom.queries import sqltext as S
from carbonloom.sources import facts
from carbonloom.sources.shared import forget, shared_folder, stored

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def kept(spark: SparkSession, d: str) -> DataFrame:
    return L.without_junk(fixtures.invoice_lines(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return L.classify(kept(spark, d))


def emitted(spark: SparkSession, d: str) -> DataFrame:
    return L.emissions(classified(spark, d))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.sql(spark, d, S.PRICE)


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@register(S.WITH_LINES + " SELECT name, unit, product_line, count(*) AS n, round(sum(amount), 2) AS amount FROM kept GROUP BY ALL")
def f1_junk_lines(spark, d):
    return _sums(kept(spark, d), "name", "unit", "product_line")


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}) SELECT name, line_no, count(*) AS n, round(sum(amount), 2) AS amount FROM lines WHERE trim(coalesce(name, '')) <> '' AND NOT {S.any_of('name', dims.EXTRACTION_WORDS)}
 AND amount > 0 AND amount <= 1e7 AND NOT (amount = floor(amount) AND amount BETWEEN 20000101 AND 20991231) GROUP BY ALL""")
def f2_extracted_lines(spark, d):
    return _sums(L.extracted_lines(fixtures.invoice_lines(spark, d)), "name", "line_no")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.sql(spark, d, _RATED)


# whole and fractional amounts, many of them equal to a rate
_RATED = "SELECT l_orderkey AS invoice_id, l_partkey AS p, CASE WHEN l_linenumber <= 3 THEN CAST(l_quantity AS DOUBLE) ELSE l_tax * 100 + l_linenumber * 0.25E0 END AS amount FROM lineitem"


@register(f"""WITH r AS ({_RATED}), m AS (SELECT *, bool_or(abs(amount - round_even(amount, 0)) > 1e-9) OVER (PARTITION BY invoice_id) AS mixed FROM r)
 SELECT invoice_id, count(*) AS n, round(sum(amount), 2) AS amount FROM m WHERE NOT (mixed AND abs(amount - round_even(amount, 0)) <= 1e-9 AND round_even(amount, 0) IN (1,3,5,6,9,10,11,13,16,17)) GROUP BY invoice_id""")
def f3_rate_rows(spark, d):
    return _sums(L.without_rate_rows(_rated(spark, d)), "invoice_id")


# each order's lines and, for even orders, a line with their sum
_TOTALLED = """SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS INT) AS line_no, CAST(l_quantity AS DOUBLE) AS amount FROM lineitem
 UNION ALL SELECT l_orderkey, 99, CAST(sum(l_quantity) AS DOUBLE) FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey"""


@register(f"""WITH r AS ({_TOTALLED}), t AS (SELECT *, count(*) OVER i AS c, sum(amount) OVER i AS total FROM r WINDOW i AS (PARTITION BY invoice_id)),
 h AS (SELECT *, c >= 2 AND abs(2 * amount - total) < 0.01 AS hit FROM t), f AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, hit ORDER BY line_no, amount) AS k FROM h)
 SELECT invoice_id, count(*) AS n, round(sum(amount), 2) AS amount FROM f WHERE NOT (hit AND k = 1) GROUP BY invoice_id""")
def f4_total_rows(spark, d):
    return _sums(L.without_total_row(fixtures.sql(spark, d, _TOTALLED), ["line_no", "amount"]), "invoice_id")


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}), k AS (SELECT *, row_number() OVER (PARTITION BY product_line, name, quantity ORDER BY invoice_id, line_no, amount) AS k FROM lines)
 SELECT product_line, name, quantity, invoice_id, line_no, round(amount, 4) AS amount FROM k WHERE k = 1""")
def f5_first_lines(spark, d):
    out = L.first_lines(fixtures.invoice_lines(spark, d), ["product_line", "name", "quantity"], ["invoice_id", "line_no", "amount"])
    return out.select("product_line", "name", "quantity", "invoice_id", "line_no", F.round("amount", 4).alias("amount"))


@register(f"""WITH lines AS ({fixtures.INVOICE_LINES}) SELECT name, {S.any_of('lower(name)', dims.EXCLUSION_WORDS)} AS is_exclusion, {S.any_of('seller_name', dims.LOGISTICS_SELLERS)} AS is_logistics,
 ({S.any_of('name', dims.FLIGHT_WORDS_CN)} OR {S.any_of('lower(name)', dims.FLIGHT_WORDS_EN)}) AS is_flight, regexp_matches(trim(name), '^\\*\\s*[A-Za-z一-鿿\\s]{{2,15}}\\s*\\*') AS is_star, count(*) AS n FROM lines GROUP BY ALL""")
def f6_f9_predicates(spark, d):
    """F6 exclusion words, F7 logistics sellers, F8 flight tickets, F9 star categories."""
    lines = fixtures.invoice_lines(spark, d)
    name = F.col("name")
    flags = {"is_exclusion": X.is_exclusion(F.lit("Scope 1"), name), "is_logistics": X.is_logistics_seller(F.col("seller_name")), "is_flight": X.is_flight_ticket(name), "is_star": X.is_star_category(name)}
    return lines.select("name", *[c.alias(n) for n, c in flags.items()]).groupBy("name", *flags).agg(F.count("*").alias("n"))


# lines that look like units, specs, weights and certificates
_ODD = """SELECT CASE l_linenumber % 6 WHEN 0 THEN '个' WHEN 1 THEN concat('M', CAST(l_linenumber AS STRING)) WHEN 2 THEN concat(CAST(l_partkey % 900 AS STRING), 'g') WHEN 3 THEN concat(CAST(l_partkey % 9 AS STRING), '*22') WHEN 4 THEN '沪（2019）浦字不动产' ELSE '冷轧钢板 规格' END AS s, l_linenumber FROM lineitem"""


@register(f"""WITH o AS ({_ODD}), f AS (SELECT s, length(trim(s)) <= 6 AND (regexp_matches(trim(s), '^[元队型瓶个只支盒包袋箱桶罐条张本台件套号克升度块根卷组副双听粒]$') OR lower(trim(s)) IN ('kg','g','ml','l','pcs','pc','set','box')) AS unit_only,
 length(trim(s)) <= 30 AND (contains(s, '规格') OR regexp_matches(trim(s), '^[A-Za-z]?\\d+(\\.\\d+)?[A-Za-z]*$') OR regexp_matches(trim(s), '^\\d+\\s*\\*\\s*\\d+') OR regexp_matches(trim(s), '\\d+#\\s*-\\s*\\d+\\s*\\*')) AS spec,
 length(trim(s)) <= 15 AND regexp_matches(lower(trim(s)), '^\\d+(\\.\\d+)?\\s*(克|千克|g|kg|ml|l)$') AS weight, {S.any_of('s', ["不动产", "产权", "浦字", "沪（", "㎡", "证号", "权证"])} AS certificate FROM o)
 SELECT unit_only, spec, weight, certificate, count(*) AS n, count(DISTINCT s) AS texts FROM f GROUP BY ALL""")
def f10_line_kinds(spark, d):
    s = F.col("s")
    kinds = {"unit_only": X.is_unit_only(s), "spec": X.is_spec(s), "weight": X.is_weight_volume(s), "certificate": X.is_certificate(s)}
    rows = fixtures.sql(spark, d, _ODD).select("s", *[c.alias(n) for n, c in kinds.items()])
    return rows.groupBy(*kinds).agg(F.count("*").alias("n"), F.countDistinct("s").alias("texts"))


@register(S.WITH_EMITTED + " SELECT invoice_id, line_no, floor(emission_kg * 10000 + 0.5) / 10000 AS kg, floor(emission_kg / 1000 * 100.0 * 10000 + 0.5) / 10000 AS cost, name FROM emitted")
def f14_response_rows(spark, d):
    rows = L.priced(emitted(spark, d))
    return rows.select("invoice_id", "line_no", N.js_round(F.col("emission_kg"), 4).alias("kg"), N.js_round(F.col("carbon_cost"), 4).alias("cost"), X.clean_name(F.col("name")).alias("name"))


@register(S.WITH_EMITTED + " SELECT concat('k-', invoice_id) AS idempotency_key, product_line AS tenant_id, scope, round(sum(emission_kg), 3) AS kg FROM emitted GROUP BY ALL")
def f15_context_echo(spark, d):
    rows = emitted(spark, d).withColumn("idempotency_key", F.concat(F.lit("k-"), "invoice_id")).withColumn("tenant_id", F.col("product_line"))
    return rows.groupBy("idempotency_key", "tenant_id", "scope").agg(F.round(F.sum("emission_kg"), 3).alias("kg"))


@register(f"""WITH codes AS (SELECT l_orderkey, CAST(100 + l_partkey % 15 AS VARCHAR) || CAST(l_suppkey AS VARCHAR) AS tax_code FROM lineitem)
 SELECT {S.CODE_SCOPE} AS scope, {S.CODE_FACTOR} AS factor_id, count(*) AS n FROM codes GROUP BY ALL""")
def j1_longest_prefix(spark, d):
    """The rule table as a DataFrame, joined on prefixes."""
    codes = fixtures.sql(spark, d, "SELECT l_orderkey, concat(CAST(100 + l_partkey % 15 AS STRING), CAST(l_suppkey AS STRING)) AS tax_code FROM lineitem")
    rules = [(p, s, f, k) for k, (s, ps, _, _, f) in enumerate(dims.LEDGER_RULES) for p in ps]
    found = longest_prefix(codes, "tax_code", spark.createDataFrame(rules, "prefix string, scope string, factor_id string, rule_pos int"))
    return found.groupBy(F.coalesce("scope", F.lit("Scope 3")).alias("scope"), F.coalesce("factor_id", F.lit("scope3_default")).alias("factor_id")).agg(F.count("*").alias("n"))


@register(f"WITH kept AS ({fixtures.INVOICE_LINES}) SELECT name, {S._keyword(0)} AS scope, {S._keyword(1)} AS factor_id, count(*) AS n FROM kept GROUP BY ALL")
def j3_keyword_rules(spark, d):
    rows = fixtures.invoice_lines(spark, d).withColumn("r", L.by_keywords(F.col("name")))
    return rows.groupBy("name", "r.scope", "r.factor_id").agg(F.count("*").alias("n"))


@register(S.WITH_CLASSIFIED + f" SELECT factor_id, coalesce(funit, 'CNY') AS unit, coalesce(fvalue, 0.00015) AS factor, count(*) AS n FROM classified LEFT JOIN {S.FACTORS} ON fid = factor_id GROUP BY ALL")
def j4_factor_of_line(spark, d):
    factors = spark.createDataFrame([(f, u, v) for f, _, u, v in dims.LEDGER_FACTORS], "factor_id string, funit string, fvalue double")
    rows = classified(spark, d).join(F.broadcast(factors), "factor_id", "left")
    return rows.groupBy("factor_id", F.coalesce("funit", F.lit("CNY")).alias("unit"), F.coalesce("fvalue", F.lit(0.00015)).alias("factor")).agg(F.count("*").alias("n"))


@register(S.WITH_CLASSIFIED + " SELECT scope, match_type, factor_id, name, count(*) AS n FROM classified GROUP BY ALL")
def c1_classify(spark, d):
    return classified(spark, d).groupBy("scope", "match_type", "factor_id", "name").agg(F.count("*").alias("n"))


_HOTELS = """SELECT l_orderkey AS invoice_id, concat('酒店住宿（', CASE l_partkey % 4 WHEN 0 THEN '俄罗斯联邦' WHEN 1 THEN '日本' WHEN 2 THEN '北京' ELSE '火星' END, '）') AS name, CAST(NULL AS STRING) AS tax_code,
 CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS quantity, '晚' AS unit, l_extendedprice AS amount, 'x' AS seller_name FROM lineitem"""


@register(f"""WITH h AS ({_HOTELS}) SELECT name, CASE WHEN contains(name, '俄罗斯联邦') OR contains(name, '日本') THEN 'cpcd_hotel' ELSE 'scope3_accommodation' END AS factor_id, 'keyword' AS match_type, count(*) AS n FROM h GROUP BY ALL""")
def c2_hotels_abroad(spark, d):
    lines = fixtures.sql(spark, d, _HOTELS).withColumn("region", X.bracket_region(F.col("name")))
    known = L.footprint_of_keyword(lines, "region", spark.sql(fixtures.CATALOGUE))
    lines = lines.join(known, "region", "left")
    out = L.classify(lines, known_region=F.col("footprint").isNotNull())
    return out.groupBy("name", "factor_id", "match_type").agg(F.count("*").alias("n"))


@register(S.WITH_EMITTED + " SELECT scope, method, factor_id, count(*) AS n, round(sum(emission_kg), 3) AS kg FROM emitted GROUP BY ALL")
def c3_c6_emissions(spark, d):
    """C3 dispatch, C4 activity, C5 by amount, C6 accommodation."""
    return emitted(spark, d).groupBy("scope", "method", "factor_id").agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 3).alias("kg"))


@register(f"""WITH h AS ({_HOTELS}), f AS (SELECT *, CASE WHEN contains(name, '俄罗斯联邦') THEN 26.5 WHEN contains(name, '日本') THEN 39.0 ELSE 26.5 END AS factor,
 CASE WHEN quantity > 0 THEN quantity WHEN amount > 0 THEN greatest(1.0, amount / 300) ELSE 1.0 END AS nights FROM h) SELECT name, factor AS factor_used, count(*) AS n, round(sum(factor * nights), 2) AS kg FROM f GROUP BY ALL""")
def c7_hotel_nights_abroad(spark, d):
    out = L.hotel_abroad_emissions(fixtures.sql(spark, d, _HOTELS), spark.sql(fixtures.CATALOGUE))
    return out.groupBy("name", "factor_used").agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 2).alias("kg"))


_DIST = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"


@register(f"""WITH f AS ({fixtures.FLIGHTS}), a AS ({fixtures.AIRPORTS}), p AS (SELECT f.*, substr(name, 4, 3) AS fc, substr(name, 8, 3) AS tc FROM f WHERE substr(name, 4, 3) <> substr(name, 8, 3)),
 j AS (SELECT p.*, x.iso_country AS c1, y.iso_country AS c2, pow(sin(radians(y.latitude_deg - x.latitude_deg) / 2), 2) + cos(radians(x.latitude_deg)) * cos(radians(y.latitude_deg)) * pow(sin(radians(y.longitude_deg - x.longitude_deg) / 2), 2) AS h
  FROM p JOIN a x ON x.iata_code = fc JOIN a y ON y.iata_code = tc)
 SELECT fc AS from_code, tc AS to_code, round({_DIST}, 3) AS km, CASE WHEN c1 = c2 THEN 0.0829 ELSE 0.18362 END AS factor_used, count(*) AS n, round(sum(CASE WHEN c1 = c2 THEN 0.0829::DOUBLE ELSE 0.18362::DOUBLE END * {_DIST} * CASE WHEN quantity > 0 THEN quantity ELSE 1 END), 2) AS kg
 FROM j GROUP BY ALL""")
def c8_flights(spark, d):
    """O12 code pairs, J13 both airports, M1 distance, C8 emission."""
    out = L.flight_emissions(fixtures.sql(spark, d, fixtures.FLIGHTS), F.broadcast(spark.sql(fixtures.AIRPORTS)))
    return out.groupBy("from_code", "to_code", F.round("distance_km", 3).alias("km"), "factor_used").agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 2).alias("kg"))


_WASTE = """SELECT l_orderkey AS invoice_id, CASE l_partkey % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN '螺栓' WHEN 2 THEN '冷轧钢板' ELSE 'gone' END AS name, CASE l_suppkey % 5 WHEN 0 THEN 'waste_cat1_msw' WHEN 1 THEN 'waste_cat2_industrial' WHEN 2 THEN 'waste_cat3_weee' WHEN 3 THEN 'waste_cat4_hw' ELSE 'waste_cat5_agri' END AS factor_id,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS amount FROM lineitem"""
# kg for each tonne of the catalogue's products, from the figure, its mass and its unit
_ROUTES = f"""c AS ({fixtures.CATALOGUE}), one AS (SELECT product_id, arg_min(carbon_footprint, row_index) AS f FROM c GROUP BY product_id),
 i AS (SELECT product_id, TRY_CAST(regexp_extract(f, '^([0-9.]+)', 1) AS DOUBLE) * CASE regexp_extract(f, '^[0-9.]+ ?(t|kg|g)CO2e', 1) WHEN 't' THEN 1000.0 WHEN 'g' THEN 0.001 ELSE 1.0 END * CASE WHEN regexp_matches(f, '/ ?(千克|kg)$') THEN 1000.0 ELSE 1.0 END AS kg FROM one),
 r AS (SELECT * FROM {S.values(dims.WASTE_ROUTES, 'fid, ratio, pid')}), intensity AS (SELECT fid, sum(ratio * coalesce(kg, 0)) AS k FROM r LEFT JOIN i ON pid = product_id GROUP BY fid)"""


@register(f"WITH w AS ({_WASTE}), {_ROUTES} SELECT factor_id, round(k, 6) AS kg_per_tonne, count(*) AS n FROM w JOIN intensity ON fid = factor_id GROUP BY ALL")
def j14_waste_routes(spark, d):
    """J12 footprint by product, O11 kg for each tonne, J14 routes."""
    routes = spark.createDataFrame(dims.WASTE_ROUTES, "factor_id string, ratio double, product_id string")
    used = fixtures.sql(spark, d, _WASTE).groupBy("factor_id").agg(F.count("*").alias("n"))
    return L.waste_intensity(routes, spark.sql(fixtures.CATALOGUE)).join(used, "factor_id").select("factor_id", F.round("kg_per_tonne", 6).alias("kg_per_tonne"), "n")


@register(f"""WITH w AS ({_WASTE}), {_ROUTES}, m AS (SELECT w.*, k, CASE name WHEN 'small ring' THEN 0.4 WHEN '螺栓' THEN 0.02 END AS uw FROM w JOIN intensity ON fid = factor_id),
 e AS (SELECT *, CASE WHEN uw > 0 THEN coalesce(quantity, 1) * uw / 1000 * k ELSE amount * 0.0419::DOUBLE END AS kg FROM m)
 SELECT factor_id, name, CASE WHEN uw > 0 THEN 'waste_allocation' ELSE 'eeio' END AS method, round(CASE WHEN uw > 0 THEN k ELSE 0.0419 END, 6) AS factor_used, count(*) AS n, round(sum(kg), 3) AS kg FROM e GROUP BY ALL""")
def c9_waste(spark, d):
    """J9 product by name, F16 lines with a waste factor, C9 allocation, A15 blended factor."""
    routes = spark.createDataFrame(dims.WASTE_ROUTES, "factor_id string, ratio double, product_id string")
    lines = fixtures.sql(spark, d, _WASTE).unionByName(kept(spark, d).select("invoice_id", "name", F.lit("scope3_default").alias("factor_id"), "quantity", "amount"))
    out = L.waste_emissions(lines, spark.sql(fixtures.PRODUCTS), L.waste_intensity(routes, spark.sql(fixtures.CATALOGUE)))
    return out.groupBy("factor_id", "name", "method", F.round("factor_used", 6).alias("factor_used")).agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 3).alias("kg"))


@register(f"WITH w AS ({_WASTE}) SELECT factor_id, factor_id IN ({', '.join(S.q(f) for f in dims.WASTE_FACTORS)}) AS is_waste, count(*) AS n FROM (SELECT CASE WHEN quantity IS NULL THEN NULL WHEN quantity < 5 THEN concat(factor_id, '_x') ELSE factor_id END AS factor_id FROM w) WHERE factor_id IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, false, count(*) FROM w WHERE quantity IS NULL")
def f16_waste_factors(spark, d):
    """The predicate over known, unknown and missing factors."""
    own = F.when(F.col("quantity") < 5, F.concat("factor_id", F.lit("_x"))).when(F.col("quantity").isNotNull(), F.col("factor_id"))
    return fixtures.sql(spark, d, _WASTE).groupBy(own.alias("factor_id")).agg(F.count("*").alias("n")).select("factor_id", L.is_waste_factor(F.col("factor_id")).alias("is_waste"), "n")


@register(f"{S.WITH_EMITTED}, p AS ({S.PRICE}) SELECT scope, coalesce(price_per_ton, 100.0) AS price, count(*) AS n, round(sum(emission_kg / 1000 * coalesce(price_per_ton, 100.0)), 2) AS cost FROM emitted LEFT JOIN p ON dom = day(invoice_date) GROUP BY ALL")
def j16_daily_price(spark, d):
    """J16 price of the day, C10 cost."""
    out = L.priced(emitted(spark, d), prices(spark, d))
    return out.groupBy("scope", F.col("price_per_ton").alias("price")).agg(F.count("*").alias("n"), F.round(F.sum("carbon_cost"), 2).alias("cost"))


@register("SELECT coalesce((SELECT arg_max(value, ts) FROM events WHERE event_type = 'purchase'), 100.0) AS price, event_type, count(*) AS n FROM events GROUP BY event_type")
def j22_current_price(spark, d):
    """The newest market quote, else the internal price."""
    events = spark.read.parquet(f"{d}/events.parquet")
    quote = events.agg(F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("quote"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(quote), F.lit(True)).select(F.coalesce("quote", F.lit(dims.DEFAULT_PRICE)).alias("price"), "event_type", "n")


@register(f"WITH f AS ({fixtures.FLIGHTS}), a AS ({fixtures.AIRPORTS}) SELECT CASE WHEN x.iso_country = y.iso_country THEN '国内飞机航程' ELSE '国际飞机航程' END AS product, count(*) AS n FROM f JOIN a x ON x.iata_code = substr(name, 4, 3) JOIN a y ON y.iata_code = substr(name, 8, 3) WHERE x.iata_code <> y.iata_code GROUP BY ALL")
def j23_flight_product(spark, d):
    out = L.flight_emissions(fixtures.sql(spark, d, fixtures.FLIGHTS), F.broadcast(spark.sql(fixtures.AIRPORTS)))
    domestic = F.col("factor_used") == dims.FLIGHT_KG_DOMESTIC
    return out.groupBy(F.when(domestic, "国内飞机航程").otherwise("国际飞机航程").alias("product")).agg(F.count("*").alias("n"))


@register(S.WITH_EMITTED + """ SELECT concat('碳成本 ', scope) AS description, scope, CASE WHEN scope IN ('Scope 1', 'Scope 2') THEN '制造费用 - 碳成本' ELSE '管理费用 - 碳成本' END AS debit_account, invoice_id AS ref_invoice_id, count(*) AS n, sum(CAST(floor(emission_kg / 1000 * 100.0 * 10000 + 0.5) AS BIGINT)) / 10000.0 AS amount_cny FROM emitted GROUP BY ALL""")
def c11_ledger_entries(spark, d):
    out = L.ledger_entries(emitted(spark, d))
    return out.groupBy("description", "scope", "debit_account", "ref_invoice_id").agg(F.count("*").alias("n"), (F.sum(F.floor(F.col("amount_cny") * 10000 + 0.5)) / 10000).alias("amount_cny"))


_STATS = " SELECT scope, count(*) AS n_lines, round(coalesce(sum(amount), 0), 2) AS total_amount, round(coalesce(sum(emission_kg), 0), 4) AS total_kg, round(coalesce(sum(emission_kg / 1000 * 100.0), 0), 2) AS total_cost FROM emitted GROUP BY scope"


@register(S.WITH_EMITTED + _STATS)
def a1_stats_by_scope(spark, d):
    return L.stats_by_scope(L.priced(emitted(spark, d)))


@register(S.WITH_EMITTED + """ SELECT 'listed' AS state, scope, 2 * count(*) AS n, round(sum(emission_kg) * 2, 3) AS kg FROM emitted GROUP BY scope UNION ALL SELECT 'exported', scope, 2 * count(*), round(sum(emission_kg) * 2, 3) FROM emitted GROUP BY scope
 UNION ALL SELECT 'truncated', NULL, 2 * count(*), NULL FROM emitted UNION ALL SELECT 'left', NULL, 0, NULL""")
def s20_s23_fact_table(spark, d):
    """S20 two appended batches, one of them sent twice (F15), S21 the listing, S23 its export with all fields quoted, S22 truncation."""
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    rows = stored(L.priced(emitted(spark, d)).select(F.col("invoice_id").cast("long").alias("id"), "name", "scope", "amount", "emission_kg"), "facts-batch")
    table = facts.fact_table(spark, path, "id long, name string, amount double, emission_kg double")
    for key in ("morning", "noon", "morning"):
        facts.append_facts(table, rows, key)
    by_scope = lambda df, state: df.groupBy(F.lit(state).alias("state"), "scope").agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 3).alias("kg")).collect()
    forget(rows)
    listed = table.read().drop("batch_key")
    out = by_scope(listed, "listed")  # sums need no order
    facts.write_csv(facts.newest_first(listed), f"{path}-csv")
    out += by_scope(spark.read.schema("id long, name string, amount double, emission_kg double, created_at string, scope string").csv(f"{path}-csv", header=True), "exported")
    out += [("truncated", None, table.truncate(), None), ("left", None, table.read().count(), None)]
    return spark.createDataFrame([tuple(r) for r in out], "state string, scope string, n long, kg double")


@register(S.WITH_EMITTED + " SELECT s.scope, coalesce(round(sum(emission_kg), 4), 0.0) AS emission_kg FROM (VALUES ('Scope 1'), ('Scope 2'), ('Scope 3')) s(scope) LEFT JOIN emitted e ON e.scope = s.scope GROUP BY s.scope")
def a2_kg_by_scope(spark, d):
    return L.kg_by_scope(emitted(spark, d)).select("scope", F.round("emission_kg", 4).alias("emission_kg"))


@register(S.WITH_EMITTED + " SELECT scope, count(*) AS n, round(sum(emission_kg), 4) AS kg FROM emitted GROUP BY GROUPING SETS ((scope), ())")
def a5_rollup(spark, d):
    return emitted(spark, d).rollup("scope").agg(F.count("*").alias("n"), F.round(F.sum("emission_kg"), 4).alias("kg"))


_FIN = "SELECT product_line, sum(amount) AS revenue, sum(amount) * (0.99 + 0.0005 * CAST(regexp_extract(product_line, '([0-9]+)', 1) AS INT)) AS traditional_cost FROM {src} GROUP BY product_line"
_COSTS = "SELECT product_line, " + ", ".join(f"coalesce(sum(emission_kg) FILTER (WHERE scope = 'Scope {k}'), 0) / 1000 * 100 AS scope{k}_cost" for k in (1, 2, 3)) + " FROM emitted GROUP BY product_line"


def _financials(spark: SparkSession, d: str) -> DataFrame:
    e = kept(spark, d).groupBy("product_line").agg(F.sum("amount").alias("revenue"))
    return e.withColumn("traditional_cost", F.col("revenue") * (0.99 + 0.0005 * F.regexp_extract("product_line", "([0-9]+)", 1).cast("int")))


@register(f"""{S.WITH_EMITTED}, f AS ({_FIN.format(src='kept')}), c AS ({_COSTS}) SELECT product_line, round(revenue, 2) AS revenue, round(scope1_cost, 2) AS scope1_cost, round(scope2_cost, 2) AS scope2_cost, round(scope3_cost, 2) AS scope3_cost,
 round(revenue - traditional_cost, 2) AS gross_profit, round(revenue - traditional_cost - scope1_cost - (scope2_cost + scope3_cost), 2) AS net_carbon_pnl FROM f JOIN c USING (product_line)""")
def a6_profit_statement(spark, d):
    out = L.profit_statement(emitted(spark, d), _financials(spark, d), "product_line")
    return out.select("product_line", *[F.round(c, 2).alias(c) for c in ("revenue", "scope1_cost", "scope2_cost", "scope3_cost", "gross_profit", "net_carbon_pnl")])


@register(S.WITH_EMITTED + " SELECT strftime(invoice_date, '%Y-%m') AS month, '管理费用 - 碳成本' AS debit_account, 'Scope 3' AS scope, round(sum(emission_kg), 3) AS emission_kg, round(sum(emission_kg) / 1000 * 100, 3) AS amount_cny FROM emitted GROUP BY ALL")
def a7_monthly_vouchers(spark, d):
    return L.monthly_vouchers(emitted(spark, d)).select("month", "debit_account", "scope", F.round("emission_kg", 3).alias("emission_kg"), F.round("amount_cny", 3).alias("amount_cny"))


@register(f"""{S.WITH_EMITTED}, f AS ({_FIN.format(src='kept')}), c AS (SELECT product_line, sum(emission_kg) / 1000 * 100 AS cost FROM emitted GROUP BY product_line), p AS (SELECT product_line, (revenue - traditional_cost) / revenue * 100 AS g, (revenue - traditional_cost - cost) / revenue * 100 AS a, cost FROM f JOIN c USING (product_line) WHERE revenue > 0)
 SELECT product_line, round(g, 6) AS gross_pct, round(a, 6) AS adjusted_pct, round(cost, 2) AS carbon_cost, g > 0 AND a < 0 AS is_pseudo_profit FROM p""")
def a8_product_lines(spark, d):
    cost = L.priced(emitted(spark, d)).groupBy("product_line").agg(F.sum("carbon_cost").alias("carbon_cost"))
    out = L.product_line_insight(_financials(spark, d).join(cost, "product_line"))
    return out.select("product_line", F.round("gross_pct", 6).alias("gross_pct"), F.round("adjusted_pct", 6).alias("adjusted_pct"), F.round("carbon_cost", 2).alias("carbon_cost"), "is_pseudo_profit")


@register(S.WITH_EMITTED + """, s AS (SELECT supplier_id, coalesce(sum(emission_kg) FILTER (WHERE scope = 'Scope 3'), 0.0) AS kg, sum(amount) AS p FROM emitted GROUP BY supplier_id)
 SELECT supplier_id, round(kg, 4) AS scope3_kg, round(kg / 1000 * 100, 4) AS scope3_cost, round(p, 2) AS purchase, round(CASE WHEN p > 0 THEN kg / p ELSE 0 END, 8) AS intensity FROM s""")
def a9_suppliers(spark, d):
    out = L.supplier_insight(emitted(spark, d))
    return out.select("supplier_id", *[F.round(c, p).alias(c) for c, p in (("scope3_kg", 4), ("scope3_cost", 4), ("purchase", 2), ("intensity", 8))])


@register(S.WITH_EMITTED + ", l AS (SELECT invoice_id, floor(emission_kg / 1000 * 100 * 10000 + 0.5) / 10000 AS cost, emission_kg FROM emitted) SELECT invoice_id, round(sum(cost), 4) AS cost, round(sum(emission_kg), 4) AS kg FROM l GROUP BY invoice_id")
def a13_invoice_totals(spark, d):
    rows = L.priced(emitted(spark, d)).withColumn("cost", N.js_round(F.col("carbon_cost"), 4))
    return rows.groupBy("invoice_id").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("emission_kg"), 4).alias("kg"))


@register(f"WITH lines AS ({fixtures.INVOICE_LINES}), t AS (SELECT invoice_id, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS s FROM lines GROUP BY invoice_id) SELECT invoice_id, coalesce(nullif(o_totalprice, 0), s) AS total FROM t LEFT JOIN orders ON o_orderkey = CAST(invoice_id AS BIGINT) AND o_orderstatus = 'F'")
def a11_invoice_total(spark, d):
    """The declared total where there is one, else the sum of lines."""
    sums = fixtures.invoice_lines(spark, d).groupBy("invoice_id").agg((F.sum(F.floor(F.col("amount") * 100 + 0.5)) / 100).alias("s"))
    declared = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("invoice_id"), "o_totalprice")
    return sums.join(declared, "invoice_id", "left").select("invoice_id", F.coalesce(F.nullif("o_totalprice", F.lit(0.0)), "s").alias("total"))
