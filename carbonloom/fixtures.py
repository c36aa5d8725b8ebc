"""Invoice lines and small dimensions over the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carbonloom.sources.shared import spread

TABLES = ("nation", "supplier", "part", "lineitem", "events", "documents", "embeddings", "orders", "customer")

INVOICE_LINES = """
WITH goods(noun, goods_name, unit, tax_code) AS (VALUES
 ('anvil','冷轧钢板','吨','1080101010000000000'), ('bolt','*金属制品*螺栓','个',NULL), ('gear','*成品油*汽油','升','1070101010100000000'), ('gizmo','*供电*电费','度','1100101010000000000'),
 ('plate','办公用品',NULL,NULL), ('ring','住宿费','晚',NULL), ('rod','物流运输费','次','3010100000000000000'), ('widget','*石油制品*润滑油','升','1070301010000000000')),
grid(regionkey, address) AS (VALUES (0,'北京市朝阳区'),(1,'江苏省南京市'),(2,'广东省广州市'),(3,'陕西省西安市'),(4,'四川省成都市'))
SELECT CAST(l.l_orderkey AS STRING) AS invoice_id, l.l_linenumber AS line_no, date_trunc('day', l.l_shipdate) AS invoice_date,
 CASE WHEN l.l_linenumber = 7 THEN '价税合计' ELSE g.goods_name END AS name,
 CASE WHEN split_part(p.p_name,' ',1) IN ('new','old') THEN NULL ELSE g.tax_code END AS tax_code,
 CASE WHEN split_part(p.p_name,' ',1) = 'cold' THEN NULL ELSE l.l_quantity END AS quantity, g.unit AS unit,
 CASE WHEN split_part(p.p_name,' ',1) = 'small' THEN 0.0E0 ELSE l.l_extendedprice*(1-l.l_discount) END AS amount,
 CASE WHEN s.s_suppkey % 7 = 0 THEN concat('顺丰', s.s_name) ELSE s.s_name END AS seller_name, r.address AS seller_address,
 l.l_suppkey AS supplier_id, p.p_brand AS product_line
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN goods g ON g.noun = split_part(p.p_name,' ',2)
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN grid r ON r.regionkey = n.n_regionkey"""

# Airports in place order; the last has no country.
AIRPORTS = """SELECT * FROM (VALUES ('PEK', 'CN', 40.0801E0, 116.5846E0, 0), ('SHA', 'CN', 31.1979E0, 121.3363E0, 1), ('CAN', 'CN', 23.3924E0, 113.2988E0, 2), ('CTU', 'CN', 30.5785E0, 103.9471E0, 3),
 ('LHR', 'GB', 51.4706E0, -0.4619E0, 4), ('JFK', 'US', 40.6398E0, -73.7789E0, 5), ('NRT', 'JP', 35.7647E0, 140.3864E0, 6), ('XXA', NULL, 10.0E0, 20.0E0, 7)) AS t(iata_code, iso_country, latitude_deg, longitude_deg, pos)"""

# Flight lines: two airports by keys; equal codes give no pair.
FLIGHTS = f"""SELECT CAST(l.l_orderkey AS STRING) AS invoice_id, l.l_linenumber AS line_no, concat('机票 ', a.iata_code, '-', b.iata_code) AS name, CAST(NULL AS STRING) AS tax_code,
 CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE l.l_quantity END AS quantity, '张' AS unit, l.l_extendedprice AS amount, 'agent' AS seller_name
FROM lineitem l JOIN ({AIRPORTS}) a ON a.pos = l.l_partkey % 8 JOIN ({AIRPORTS}) b ON b.pos = l.l_suppkey % 8"""

# An invented catalogue with the eight usual columns (four kept), and products with and without a weight.
CATALOGUE = """SELECT * FROM (VALUES (0, '94333X0022023A', '机械炉排炉垃圾焚烧', '0.35tCO2e/吨', 2023), (1, '94332X0032013A', '生活垃圾填埋', '0.5 kgCO2e / 千克', 2013), (2, '94339X0132017A', '厨余堆肥', '120kgCO2e/公吨', 2017),
 (3, '94313X0032016A', '废塑料机械回收', '-', 2016), (4, '94311X0102022A', '危险废物焚烧', '1.1tCO2e/公吨', 2022), (5, '94332X0052013A', '填埋无气回收', '300gCO2e/kg', 2013), (6, '94311X0022022A', '污泥干化焚烧', '85kgCO2e/t', 2022),
 (7, '63290X0900001A', '酒店住宿（俄罗斯联邦）', '24.5kgCO2e / 房·晚', 2020), (8, '63290X0900002A', '酒店住宿（俄罗斯联邦）', '26.5kgCO2e / 房·晚', 2022), (9, '63290X0900003A', '酒店住宿（日本）', '39kgCO2e / 房·晚', 2022),
 (10, '30000X0000001A', 'cold anvil', '2.2 kg CO2e/件', 2021), (11, '30000X0000002A', 'steel gear and bolt', '3.5CO2e/t', 2021), (12, '30000X0000003A', 'small ring', '33.53gCO2e/千瓦时', 2020)) AS t(row_index, product_id, product_name, carbon_footprint, data_year)"""
PRODUCTS = """SELECT * FROM (VALUES (1, 'steel anvil cold', '机加工', 1.5E0, '件', 12.0E0), (2, 'Small Ring', '零件', 0.2E0, '个', 0.4E0), (3, '冷轧钢板', '钢', 2000.0E0, '吨', CAST(NULL AS DOUBLE)), (4, '螺栓 M6', '五金', 0.05E0, '个', 0.02E0), (5, 'gizmo', '电', 3.0E0, '件', CAST(NULL AS DOUBLE))) AS t(id, product_name, carbon_type, co2_per_unit, unit, unit_weight_kg)"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the tables of sf_dir; {name} stands for a table."""
    frames = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if f" {t} " in f" {text} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ")}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text)


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INVOICE_LINES)
