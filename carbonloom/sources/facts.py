"""Fact and dimension tables: appended lines, listings, exports, and loaders of rule and factor files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom import dims
from carbonloom.functions import text as X
from carbonloom.operators import tables
from carbonloom.sources.batches import BatchTable


def fact_table(spark: SparkSession, path: str, schema: str) -> BatchTable:
    """The fact table: classified lines by scope with their time, appended in batches that count once."""
    return BatchTable(spark, path, f"{schema}, created_at timestamp, scope string", ("scope",))


def append_facts(table: BatchTable, rows: DataFrame, key: str) -> int:
    """Classified lines as the batch `key` (the caller's idempotency key) with their time; the number of new rows."""
    return table.append(rows.withColumn("created_at", F.current_timestamp()), key)


def newest_first(facts: DataFrame, key: str = "id") -> DataFrame:
    return facts.orderBy(F.desc(key))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)


def factor_rows(lines: DataFrame) -> DataFrame:
    """Factors of a file with columns factor_id, scope, unit, kg_co2e_per_unit, description as strings; rows without a number are left out."""
    value = F.when(F.col("kg_co2e_per_unit").rlike(r"^-?\d*\.?\d+$"), F.col("kg_co2e_per_unit").try_cast("double"))
    return lines.withColumn("kg_co2e_per_unit", value).where("kg_co2e_per_unit IS NOT NULL AND description IS NOT NULL")


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return factor_rows(spark.read.schema("factor_id string, scope string, unit string, kg_co2e_per_unit string, description string").csv(path, header=True))


def grid_rows(spark: SparkSession) -> DataFrame:
    """(level, name, kg_per_kwh): the country, its regions and provinces."""
    rows = [("national", "全国", dims.GRID_NATIONAL)] + [("region", k, v) for k, v in dims.GRID_REGIONS.items()] + [("province", k, v) for k, v in dims.GRID_PROVINCES.items()]
    return spark.createDataFrame(rows, "level string, name string, kg_per_kwh double")


def scene_rows(spark: SparkSession) -> DataFrame:
    """(key, unit, kg): spend factors for each CNY and fuels for each litre."""
    rows = [(k, "CNY", dims.scene_factor(k)) for k in dims.SCENE_SPEND] + [(k, "L", dims.litre_factor(k)) for k in dims.SCENE_LITRES]
    return spark.createDataFrame(rows, "key string, unit string, kg double")


def freight_rows(spark: SparkSession) -> DataFrame:
    rows = [("rail", 0, None, None, dims.FREIGHT_RAIL), ("air", 0, None, None, dims.FREIGHT_AIR), ("road_default", 0, None, None, dims.FREIGHT_ROAD_DEFAULT)]
    rows += [("road_mode", k, p, n, v) for k, (p, n, v) in enumerate(dims.ROAD_MODES)]
    return spark.createDataFrame(rows, "slot string, pos int, product_id string, mode_cn string, kg_per_tonne_km double")


def rule_rows(cells: DataFrame) -> DataFrame:
    """Scope rules from a sheet (row_no, tax_code, scope, exclude, factor): scopes normalised, exclusions split and joined by ;, rows without a code or a scope left out; source_row counts the header."""
    out = cells.withColumn("scope", X.normalised_scope(F.col("scope"))).where("scope IS NOT NULL AND trim(tax_code) <> ''")
    return out.select(F.trim("tax_code").alias("tax_code"), "scope", F.array_join(X.exclusions(F.col("exclude")), ";").alias("exclude_keywords"), F.coalesce(F.nullif(F.trim("factor"), F.lit("")), F.lit("default")).alias("factor_id"), (F.col("row_no") + 2).alias("source_row"))


# The columns of a rule sheet by their usual names; without such names the first is the code, the second the scope.
RULE_COLUMNS = {
    "tax_code": ("税收分类编码", "商品和服务税收分类编码", "税号", "tax_code", "编码", "19位编码"),
    "scope": ("排放范围", "scope", "Scope", "碳排放范围", "范围"),
    "exclude": ("排除关键词", "排除", "exclude_keywords", "排除规则"),
    "factor": ("排放因子", "emission_factor_id", "因子", "因子ID"),
}


def sheet_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first column that has one of the names, else the first that holds the first name that any holds."""
    return next((c for c in columns if c.strip() in names), next((c for n in names for c in columns if n in c), None))


def sheet_rules(sheet: DataFrame) -> DataFrame:
    """Rules (prefix, scope, exclude, factor_id, rule_pos) of a sheet (row_no and cells as strings), its columns found by name; rows without a code or a scope are left out."""
    columns = [c for c in sheet.columns if c != "row_no"]
    at = {k: sheet_column(columns, names) for k, names in RULE_COLUMNS.items()}
    at["tax_code"], at["scope"] = at["tax_code"] or columns[0], at["scope"] or columns[1]
    cell = lambda k: F.col(f"`{at[k]}`") if at[k] else F.lit(None).cast("string")
    out = sheet.select(F.trim(cell("tax_code")).alias("prefix"), X.normalised_scope(cell("scope")).alias("scope"), X.exclusions(cell("exclude")).alias("exclude"), F.coalesce(F.nullif(F.nullif(F.trim(cell("factor")), F.lit("")), F.lit("nan")), F.lit("default")).alias("factor_id"), F.col("row_no").alias("rule_pos"))
    return out.where("scope IS NOT NULL AND prefix <> ''")


def table_rules(rows: DataFrame) -> DataFrame:
    """Rules of an imported table (tax_code, scope, exclude_keywords, emission_factor_id): longest codes first, then as text."""
    out = rows.select(F.trim("tax_code").alias("prefix"), X.normalised_scope(F.col("scope")).alias("scope"), X.exclusions(F.col("exclude_keywords")).alias("exclude"), F.coalesce(F.nullif("emission_factor_id", F.lit("")), F.lit("default")).alias("factor_id"))
    placed = out.where("scope IS NOT NULL AND prefix <> ''").withColumn("__length", -F.char_length("prefix"))
    return tables.numbered(placed, "rule_pos", "__length").drop("__length")


def prefix_file_rules(rows: DataFrame) -> DataFrame:
    """Rules of a file (prefix, scope, description, exclude, factor, row_no): scopes must be spelt in full, exclusions are parted by ;."""
    exclude = F.filter(F.split(F.coalesce("exclude", F.lit("")), ";"), lambda w: w != "")
    out = rows.select(F.trim("prefix").alias("prefix"), F.trim("scope").alias("scope"), exclude.alias("exclude"), F.coalesce(F.trim("factor"), F.lit("default")).alias("factor_id"), F.col("row_no").alias("rule_pos"))
    return out.where(F.col("scope").isin(*dims.SCOPES))


def listed_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rules and keyword rules (keywords, scope, exclude, factor_id, rule_pos) of listed rules (scope, tax_code_prefixes, keywords, exclude_keywords, emission_factor_id, row_no); unknown scopes count as Scope 3."""
    scope = F.when(F.col("scope").isin(*dims.SCOPES), F.col("scope")).otherwise("Scope 3")
    own = rules.withColumns({"scope": scope, "exclude": F.coalesce("exclude_keywords", F.array().cast("array<string>")), "factor_id": F.coalesce("emission_factor_id", F.lit("default"))})
    prefixes = own.select(F.posexplode("tax_code_prefixes").alias("k", "prefix"), "scope", "exclude", "factor_id", "row_no")
    prefixes = prefixes.select(F.trim("prefix").alias("prefix"), "scope", "exclude", "factor_id", (F.col("row_no") * 1000 + F.col("k")).alias("rule_pos"))
    words = own.where(F.size("keywords") > 0).select("keywords", "scope", "exclude", "factor_id", F.col("row_no").alias("rule_pos"))
    return prefixes, words


def load_rules(listed: DataFrame, table: DataFrame | None = None, sheet: DataFrame | None = None, prefix_file: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Prefix rules and keyword rules by precedence of their sources: the imported table, else the sheet, else the listed rules with the prefix file behind them. Keywords always come from the listed rules."""
    prefixes, words = listed_rules(listed)
    if prefix_file is not None:
        prefixes = stacked(prefixes, prefix_file_rules(prefix_file))
    found = [r for r in (table and table_rules(table), sheet and sheet_rules(sheet)) if r is not None]
    return with_fallback(*found, prefixes), words


def with_fallback(*sources: DataFrame) -> DataFrame:
    """The first of some small rule sources that has rows."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def stacked(*sources: DataFrame) -> DataFrame:
    """Rule sources under each other; rule_pos goes on from one to the next by source."""
    parts = [s.withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tables.numbered(out, "rule_pos", "rule_pos", ("source_no",)).drop("source_no")


CATALOGUE_COLUMNS = {"产品ID": "product_id", "产品名称": "product_name", "核算边界": "accounting_boundary", "碳足迹": "carbon_footprint", "企业名称": "company_name", "数据年份": "data_year", "数据类型": "data_type", "是否低碳": "is_low_carbon"}


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """A catalogue with English column names."""
    return rows.toDF(*[CATALOGUE_COLUMNS.get(c.strip(), c.strip()) for c in rows.columns])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file with English column names and row_index in file order (one file)."""
    return catalogue_rows(spark.read.option("header", True).csv(path)).withColumn("row_index", F.monotonically_increasing_id())


def alias_rows(rows: DataFrame) -> DataFrame:
    """(alias, code) of rows (zh, iata_code, ident, pos): the name as a key, its IATA code or else its ident in upper case; of rows with one key the last."""
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    keyed = rows.select(X.alias_key(F.col("zh")).alias("alias"), F.coalesce(clean("iata_code"), clean("ident")).alias("code"), "pos")
    return keyed.where("alias <> '' AND code IS NOT NULL").groupBy("alias").agg(F.max_by("code", "pos").alias("code"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Aliases of a file (zh, iata_code, ident), in file order (one file)."""
    return alias_rows(spark.read.schema("zh string, iata_code string, ident string").csv(path, header=True).withColumn("pos", F.monotonically_increasing_id()))


def energy_labels(rows: DataFrame, most: int = 10_000) -> list[tuple[str, float, int]]:
    """(product type, kWh a year, years) of a small table of energy labels (productType, annualKWh, lifetimeYears), in its order; rows without kWh are left out, years default to 10."""
    got = rows.where("annualKWh IS NOT NULL").select("productType", F.col("annualKWh").cast("double"), F.coalesce(F.col("lifetimeYears").cast("int"), F.lit(10))).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a table of energy labels has more than {most} rows")
    return [tuple(r) for r in got]


def read_energy_labels(spark: SparkSession, path: str) -> list[tuple[str, float, int]]:
    """Energy labels of a JSON file with one array."""
    return energy_labels(spark.read.schema("productType string, annualKWh double, lifetimeYears int").option("multiLine", True).json(path))


def airports(rows: DataFrame) -> DataFrame:
    """Airports with a name and a place on the globe, codes in upper case, with match keys; all rows stay, in place by pos."""
    good = rows.where("trim(name) <> '' AND latitude_deg BETWEEN -90 AND 90 AND longitude_deg BETWEEN -180 AND 180")
    return good.withColumns({"iata_code": F.upper(F.trim("iata_code")), "ident": F.upper(F.trim("ident")), "name_key": X.match_key(F.col("name")), "muni_key": X.match_key(F.col("municipality"))})
