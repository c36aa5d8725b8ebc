"""The matcher path: scope by rules, factor matching, calculation, invoice scenarios and their cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import apart, contains_any, first_match, holds_any, lookup, prefixes_first
from carbonloom.operators.matching import contained_in

FACTOR_SCHEMA = "id string, name string, category string, value double, unit string, region string, year int, factor_type string, list_pos int"


def factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(dims.factor_rows())], FACTOR_SCHEMA)


def first_by_id(rows: DataFrame) -> DataFrame:
    """Rows with the same id become one: the values of the last, at the place of the first."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("list_pos")))
    place = F.min("list_pos").over(Window.partitionBy("id"))
    return rows.withColumn("__n", last).withColumn("__p", place).where("__n = 1").withColumn("list_pos", F.col("__p")).drop("__n", "__p")


def classify_scope(code: Column, name: Column) -> Column:
    """struct(scope, confidence, reason): exclusion words for every code, then the longest prefix, keywords, Scope 3."""
    make = lambda s, c, r: F.struct(F.lit(s).alias("scope"), F.lit(c).alias("confidence"), r.alias("reason"))
    c, n = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    out = [(n.contains(w), make(3, "高", F.concat(F.lit("排除词「"), F.lit(w), F.lit("」")))) for w in dims.EXCLUSION_WORDS]
    out += [(c.startswith(p), make(s, conf, F.concat(F.lit(f"前缀「{p}」"), F.lit(d)))) for p, s, d, conf in prefixes_first(dims.MATCHER_PREFIXES)]
    out += [(n.contains(w), make(s, "中", F.concat(F.lit("关键词「"), F.lit(w), F.lit("」")))) for words, s in dims.MATCHER_KEYWORDS for w in words]
    return first_match(out, make(3, "低", F.lit("默认")))


def region_of(address: Column) -> Column:
    """Grid region of an address: provinces in order, then names of regions, else the whole country."""
    t = F.coalesce(address, F.lit(""))
    return apart(first_match([*[(t.contains(p), F.lit(r)) for p, r in dims.PROVINCE_GRIDS.items()], *[(holds_any(t, ws), F.lit(r)) for ws, r in dims.REGION_NAMES]], F.lit("全国")))


def region_of_context(region: Column, seller: Column, buyer: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.when(blank(region).isNotNull(), F.trim(region)).when(F.coalesce(seller, F.lit("")) != "", region_of(seller)).when(F.coalesce(buyer, F.lit("")) != "", region_of(buyer)).otherwise("全国")


def category_factors(all_factors: DataFrame) -> DataFrame:
    """The first factor of each category and region."""
    return all_factors.groupBy("category", F.coalesce("region", F.lit("全国")).alias("region")).agg(F.min_by(F.struct("id", "value", "unit", "name"), "list_pos").alias("factor"))


def with_category_factor(rows: DataFrame, category: str, region: str, all_factors: DataFrame) -> DataFrame:
    """rows with factor (struct): of the category in the region, else in the whole country."""
    dim = category_factors(all_factors)
    own = dim.select(F.col("category").alias(category), F.col("region").alias(region), F.col("factor").alias("__own"))
    whole = dim.where("region = '全国'").select(F.col("category").alias(category), F.col("factor").alias("__whole"))
    out = rows.join(own, [category, region], "left").join(whole, category, "left")
    return out.select(*rows.columns, F.coalesce("__own", "__whole").alias("factor"))


def factor_by_name(all_factors: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """(query, factor) of distinct queries: a factor whose name or id is the query, else the first that contains it, else null."""
    distinct = queries.select(query).distinct()
    names = all_factors.select("*", F.explode(F.array("name", "id")).alias("__name"))
    hits = contained_in(distinct, F.col(query), names, F.col("__name"))
    exact = (F.col("name") == F.col(query)) | (F.col("id") == F.col(query))
    best = hits.groupBy(query).agg(F.min_by(F.struct("id", "value", "unit"), F.struct(~exact, "list_pos")).alias("factor"))
    return distinct.join(best, query, "left")


def industry_factor(industry: Column) -> Column:
    """Factor id of an industry: exact name, else a name in it, else the first of all."""
    key = F.trim(F.coalesce(industry, F.lit("")))
    part = first_match([(key.contains(k), F.lit(v)) for k, v in dims.EEIO_INDUSTRIES.items()])
    return F.when(key == "", "eeio_paper").otherwise(F.coalesce(lookup(key, dims.EEIO_INDUSTRIES), part, F.lit("eeio_paper")))


def has_quantity() -> Column:
    return F.coalesce((F.col("quantity") > 0) & (F.trim("unit") != ""), F.lit(False))


_MATERIAL_FACTOR = {"钢材": "material_steel", "水泥": "eeio_cement", "汽油": "fuel_gasoline", "原煤": "fuel_coal", "天然气": "fuel_natural_gas"}


#: Rows that a factor list may have.
MOST_FACTORS = 10_000


def factor_keys(all_factors: DataFrame) -> DataFrame:
    """(factor_key, factor_id, value, factor_unit, category, factor_type): each id, and grid:region for the first power factor of a region."""
    rows = all_factors.orderBy("list_pos").limit(MOST_FACTORS + 1).collect()
    if len(rows) > MOST_FACTORS:
        raise ValueError(f"a factor list has more than {MOST_FACTORS} rows")
    own = {r.id: r for r in rows} | {f"grid:{r.region or '全国'}": r for r in reversed(rows) if r.category == "电力"}
    keys = [(k, r.id, r.value, r.unit, r.category, r.factor_type) for k, r in own.items()]
    return all_factors.sparkSession.createDataFrame(keys, "factor_key string, factor_id string, value double, factor_unit string, category string, factor_type string")


def match_factors(lines: DataFrame, all_factors: DataFrame) -> DataFrame:
    """lines (name, tax_code, amount, quantity, unit, region) with factor_id, value, factor_unit, category, match_type, confidence, reason.

    A physical quantity of a known material; else the tax code; else a keyword where there is an amount; else the default.
    """
    name, code, unit = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("tax_code", F.lit(""))), F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    rules = []
    for words, material, category, units in dims.PHYSICAL_MATERIALS:
        key = "grid" if category == "电力" else _MATERIAL_FACTOR[material]
        rules.append((has_quantity() & holds_any(name, words) & holds_any(unit, [u.lower() for u in units]), (key, "物理因子", f"物料 {words[0]}")))
    rules += [
        ((code != "") & code.rlike("^[1-4]"), ("fuel_coal", "物理因子", "税号 燃料")),
        ((code != "") & code.startswith("5"), ("grid", "物理因子", "税号 电力")),
        (code != "", ("eeio_paper", "EEIO因子", "税号 行业")),
    ]
    rules += [((F.col("amount") > 0) & holds_any(name, words), (dims.EEIO_INDUSTRIES[industry], "EEIO因子", f"关键词 {words[0]}")) for words, industry in dims.EEIO_NAMES]
    # the number of the rule first, then its values by that number: each condition stands in the plan once
    results = [r for _, r in rules] + [("eeio_default", "默认因子", "默认")]
    number = first_match([(c, F.lit(k)) for k, (c, _) in enumerate(rules)], F.lit(len(rules)))
    value = F.element_at(F.array(*[F.struct(F.lit(f).alias("factor_key"), F.lit(m).alias("match_type"), F.lit(r).alias("reason")) for f, m, r in results]), F.col("__k") + 1)
    material = holds_any(name, dict.fromkeys(w for ws, *_ in (*dims.PHYSICAL_MATERIALS, *dims.EEIO_NAMES) for w in ws))
    matched = lines.withColumns({"__k": apart(number), "__known": apart(material)}).withColumn("__m", apart(value))
    fuzzy = F.col("__m.match_type") == "默认因子"
    confidence = confidence_score(has_quantity(), F.col("__known"), code != "", F.col("__m.match_type"), fuzzy)
    keys = factor_keys(all_factors)
    national = keys.where("factor_key = 'grid:全国'").select(*[F.col(c).alias(f"__n_{c}") for c in keys.columns])
    wanted = F.when(F.col("__m.factor_key") == "grid", F.concat(F.lit("grid:"), "region")).otherwise(F.col("__m.factor_key"))
    out = matched.withColumn("confidence", confidence).withColumn("factor_key", wanted).join(F.broadcast(keys), "factor_key", "left").join(F.broadcast(national), F.lit(True), "left")
    pick = lambda c: F.coalesce(c, F.when(F.startswith("factor_key", F.lit("grid:")), F.col(f"__n_{c}"))).alias(c)
    return out.select(*lines.columns, *[pick(c) for c in ("factor_id", "value", "factor_unit", "category", "factor_type")], "__m.match_type", "confidence", "__m.reason")


def confidence_score(physical: Column, material: Column, code: Column, match_type: Column, fuzzy: Column) -> Column:
    """高, 中 or 低 from what is known of a line and how its factor was matched."""
    eeio = match_type == "EEIO因子"
    return first_match([(physical & material & (match_type == "物理因子"), F.lit("高")), (physical & material, F.lit("中")), ((code | material) & eeio & ~fuzzy, F.lit("中")), (code & eeio, F.lit("中")), (eeio & material & ~fuzzy, F.lit("中"))], F.lit("低"))


def scope_of_category(category: Column) -> Column:
    return F.when(category == "燃料燃烧", 1).when((category == "电力") | category.contains("热"), 2).otherwise(3)


def calculate(matched: DataFrame) -> DataFrame:
    """Matched lines with emissions, method and factor_scope: by activity for a physical factor and a quantity above 0, else by expenditure."""
    active = F.coalesce(((F.col("match_type") == "物理因子") | F.col("factor_type").contains("物理")) & (F.col("quantity") > 0), F.lit(False))
    q = N.factor_quantity(F.col("quantity"), F.col("unit"), F.col("factor_unit"))
    per_mwh = F.when(F.col("factor_unit") == "kgCO2e/MWh", F.col("value") / 1000).otherwise(F.col("value"))
    spend = F.greatest(F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    kg = F.greatest(F.lit(0.0), per_mwh * F.when(active, q).otherwise(spend))
    return matched.withColumn("emissions", kg).withColumn("method", F.when(active, "activity").otherwise("expenditure")).withColumn("factor_scope", scope_of_category(F.col("category")))


def summary(items: DataFrame, *keys: str, scope: str = "factor_scope", kg: str = "emissions") -> DataFrame:
    """scope1, scope2, scope3 and total by keys; any scope but 1 and 2 counts as 3."""
    s = F.col(scope)
    sums = [F.coalesce(F.sum(F.when(c, F.col(kg))), F.lit(0.0)).alias(n) for n, c in (("scope1", s == 1), ("scope2", s == 2), ("scope3", ~s.isin(1, 2) | s.isNull()))]
    return items.groupBy(*keys).agg(*sums).withColumn("total", F.col("scope1") + F.col("scope2") + F.col("scope3"))


def confidence_counts(items: DataFrame, *keys: str) -> DataFrame:
    c = F.trim("confidence")
    high, medium = F.count(F.when(c == "高", 1)), F.count(F.when(c == "中", 1))
    return items.groupBy(*keys).agg(high.alias("high"), medium.alias("medium"), (F.count("*") - high - medium).alias("low"), F.count("*").alias("total"))


def needs_review(items: DataFrame) -> DataFrame:
    return items.where(F.trim("confidence") == "低").select("invoice_id", F.col("name").alias("item_name"), "reason", "emissions", "confidence")


def line_path(lines: DataFrame, all_factors: DataFrame, invoice_id: str | None = None) -> DataFrame:
    """match, then calculate; the invoice id of the argument wins over the line's."""
    out = calculate(match_factors(lines, all_factors))
    return out if invoice_id is None else out.withColumn("invoice_id", F.lit(invoice_id))


# scenarios of whole invoices


def invoices(lines: DataFrame) -> DataFrame:
    """One row for each invoice: items in order of line_no, their texts, the first amount and the positive total."""
    optional = {c: (F.col(c) if c in lines.columns else F.lit(None).cast("string")) for c in ("remark", "spec")}
    item = F.struct("line_no", "name", "quantity", "amount", F.coalesce("unit", F.lit("")).alias("unit"), *[F.coalesce(v, F.lit("")).alias(k) for k, v in optional.items()])
    grouped = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("seller_name").alias("seller_name"), F.min("seller_address").alias("seller_address"), F.sum(F.floor(F.col("amount") * 100 + 0.5)).alias("cents"))
    names = F.array_join(F.transform("items", lambda i: i["name"]), " ")
    every = F.array_join(F.filter(F.flatten(F.transform("items", lambda i: F.array(i["name"], i["remark"], i["spec"]))), lambda t: t != ""), " ")
    return grouped.select("invoice_id", "items", "seller_name", "seller_address", (F.col("cents") / 100).alias("total_amount"), names.alias("names"), every.alias("texts"))


def _largest(text: Column, pattern: str) -> Column:
    return F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: v.try_cast("double")), lambda v: v > 0))


def _first_quantity(accept) -> Column:
    return F.get(F.filter("items", lambda i: F.coalesce((i["quantity"] > 0) & accept(i), F.lit(False))), 0)["quantity"]


def electricity_kwh() -> Column:
    power = lambda i: i["unit"].rlike("(?i)度|千瓦时|kwh") | (i["name"].rlike("电") & (i["unit"] == ""))
    return F.coalesce(_first_quantity(power), _largest(F.col("texts"), r"(?i)(\d+\.?\d*)\s*(?:kwh|度|千瓦时)"))


def water_tonnes() -> Column:
    wet = lambda i: i["name"].contains("水") & ((i["unit"] == "") | i["unit"].rlike("(?i)吨|m3|立方米|方"))
    return F.coalesce(_first_quantity(wet), _largest(F.col("texts"), r"(?i)(\d+\.?\d*)\s*(?:吨|m3|立方米|方)"))


def hotel_city(text: Column) -> Column:
    return first_match([(text.contains(c), F.lit(c)) for c in dims.CITY_RATES])


def explicit_nights(text: Column) -> Column:
    p = r"(?i)(?:(\d+)\s*[晚夜天]\s*[宿房]?|住宿[：:\s]*(\d+)\s*[晚夜天]?|(\d+)\s*间夜)"
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, k), F.lit("")) for k in (1, 2, 3)]).try_cast("int")
    return F.when(found > 0, found)


def estimated_nights(amount: Column, city: Column) -> Column:
    rate = lookup(city, dims.CITY_RATES)
    return F.when((amount > 0) & (rate > 0), F.greatest(F.lit(1), F.floor(amount / rate)).cast("int"))


def hotel_factor(city: Column) -> Column:
    return F.when(F.trim(city) == "", dims.HOTEL_FACTOR_DEFAULT).otherwise(lookup(F.trim(F.coalesce(city, F.lit(""))), dims.HOTEL_FACTORS, F.lit(dims.HOTEL_FACTOR_DEFAULT)))


def _amount() -> Column:
    first = F.get(F.col("items"), 0)["amount"]
    return F.when(F.col("total_amount") > 0, F.col("total_amount")).when(first > 0, first)


def hotel_kg() -> Column:
    nights = explicit_nights(F.col("texts"))
    return F.when(_amount() > 0, N.js_round(_amount() * dims.scene_factor("hotel"), 2)).when(nights > 0, N.js_round(nights * dims.SCENE_HOTEL_NIGHT, 2))


def fuel_kg(quantity: Column, kind: Column) -> Column:
    return N.js_round(quantity * F.when(kind == "柴油", dims.litre_factor("diesel")).otherwise(dims.litre_factor("gasoline")), 2)


def taxi_kg(amount: Column, hint: Column) -> Column:
    factor = F.when(hint.rlike("电动|电车|新能源"), dims.scene_factor("taxi_ev")).when(hint.rlike("燃油|汽油|柴油|油车"), dims.scene_factor("taxi_fuel")).otherwise(dims.scene_factor("taxi"))
    return N.js_round(amount * factor, 2)


def transport() -> Column:
    """struct(kind, kg) or null: litres of fuel, public transport by amount, taxis by amount."""
    text = F.col("texts")
    line = F.get(F.filter("items", lambda i: F.coalesce((i["quantity"] > 0) & (i["unit"].rlike("(?i)升|L") | i["name"].rlike("汽油|柴油|油")), F.lit(False))), 0)
    diesel = F.when(line["name"].contains("柴油") | line["unit"].contains("柴油"), "柴油").otherwise("汽油")
    make = lambda k, kg: F.struct(F.lit(k).alias("kind"), kg.alias("kg"))
    return first_match(
        [
            (text.rlike("汽油|柴油|加油|燃油|成品油") & line.isNotNull(), make("fuel", fuel_kg(line["quantity"], diesel))),
            (text.rlike("公交|地铁|一卡通|交通卡|轨道交通|充值") & (_amount() > 0), make("public", N.js_round(_amount() * dims.scene_factor("public_transit"), 2))),
            (text.rlike("出租车|网约车|滴滴|快车|专车|打车") & (_amount() > 0), make("taxi", taxi_kg(_amount(), text))),
        ]
    )


def freight_factor(mode: Column, product: Column, text: Column) -> Column:
    """kg CO2e for each tonne kilometre: rail, air, the road mode of a product, else the longest road mode named in the text (4 characters or more), else the default."""
    compact = F.regexp_replace(text, r"[\s ]", "")
    by_product = lookup(product, {p: v for p, _, v in dims.ROAD_MODES})
    names = sorted([(n.replace(" ", ""), v) for _, n, v in dims.ROAD_MODES], key=lambda x: -len(x[0]))
    modes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in names if len(n) >= 4])
    by_name = F.get(F.filter(modes, lambda m: F.contains(compact, m["n"])), 0)["v"]
    return F.when(mode == "rail", dims.FREIGHT_RAIL).when(mode == "air", dims.FREIGHT_AIR).otherwise(F.coalesce(by_product, by_name, F.lit(dims.FREIGHT_ROAD_DEFAULT)))


def logistics() -> Column:
    """struct(kind, kg) or null: tonne kilometres by the mode's factor, else the amount by the mode's spend factor."""
    text = F.col("texts")
    mode = X.transport_mode(text)
    tk = F.coalesce(_first_quantity(lambda i: i["unit"].rlike("吨[-·]?公里")), X.tonne_km(text))
    spend = F.when(mode == "air", dims.scene_factor("air")).when(mode == "rail", dims.scene_factor("rail")).otherwise(dims.scene_factor("road"))
    physical = N.js_round(tk * freight_factor(mode, X.product_id(text), text), 4)
    make = lambda k, kg: F.struct(F.lit(k).alias("kind"), kg.alias("kg"))
    return F.when(tk > 0, make("tonne_km", physical)).when(_amount() > 0, make("eeio_amount", N.js_round(_amount() * spend, 2)))


def waste_kg() -> Column:
    amount = F.when(F.col("total_amount") > 0, F.col("total_amount")).otherwise(F.get(F.filter("items", lambda i: i["amount"] > 0), 0)["amount"])
    return F.when(F.col("names").rlike("垃圾|清运|废弃物|环卫|固废|处置费") & (amount > 0), N.js_round(amount * dims.scene_factor("waste"), 2))


def scenarios(rows: DataFrame, all_factors: DataFrame) -> DataFrame:
    """rows of invoices() with scenario, kind, kg and scope of the first that applies: electricity, water, hotel, transport, logistics, waste. Null: the line path."""
    with_region = rows.withColumn("region", region_of(F.col("seller_address"))).withColumn("category", F.lit("电力"))
    priced = with_category_factor(with_region, "category", "region", all_factors)
    staged = priced.withColumns({"kwh": electricity_kwh(), "water": water_tonnes(), "hotel": hotel_kg(), "transport": transport(), "logistics": logistics(), "waste": waste_kg()})
    hotel_like = F.coalesce(F.col("seller_name"), F.lit("")).rlike("酒店|宾馆|旅馆|住宿") | F.col("names").rlike("酒店|宾馆|住宿")
    make = lambda s, k, kg, scope: F.struct(F.lit(s).alias("scenario"), k.alias("kind"), kg.alias("kg"), F.lit(scope).alias("scope"))
    none = F.lit(None).cast("string")
    chosen = first_match(
        [
            (F.col("kwh") > 0, make("electricity", none, N.js_round(F.col("kwh") * F.coalesce("factor.value", F.lit(dims.GRID_NATIONAL)), 2), 2)),
            (F.col("water") > 0, make("water", none, N.js_round(F.col("water") * dims.SCENE_WATER, 2), 3)),
            (hotel_like & (_amount() > 0) & (F.col("hotel") > 0), make("hotel", none, F.col("hotel"), 3)),
            (F.col("transport").isNotNull(), make("transport", F.col("transport.kind"), F.col("transport.kg"), 3)),
            (F.col("logistics").isNotNull(), make("logistics", F.col("logistics.kind"), F.col("logistics.kg"), 3)),
            (F.col("waste").isNotNull(), make("waste", none, F.col("waste"), 3)),
        ]
    )
    return staged.withColumn("__s", chosen).select("invoice_id", "items", "region", "kwh", "water", "hotel", "waste", "transport", "logistics", "__s.scenario", "__s.kind", "__s.kg", "__s.scope")


# materials, sold products, categories


def material_emission(lines: DataFrame, all_factors: DataFrame) -> DataFrame:
    """Lines with material_factor, emissions and confidence; the first material with a keyword decides, also where it has no factor."""
    name, unit = F.trim(F.coalesce("name", F.lit(""))), F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    rules = []
    for words, factor, units, level in dims.MATERIALS:
        fits = contains_any(unit, [u.lower() for u in units])
        confidence = F.when(fits, level).otherwise("中") if factor else F.lit("低")
        rules.append((contains_any(name, words), F.struct(F.lit(factor).cast("string").alias("factor"), confidence.alias("confidence"))))
    staged = lines.withColumn("__m", first_match(rules, F.struct(F.lit(None).cast("string").alias("factor"), F.lit("低").alias("confidence"))))
    dim = all_factors.select(F.col("id").alias("material_factor"), F.col("value").alias("__value"), F.col("unit").alias("__unit"))
    out = staged.withColumn("material_factor", F.col("__m.factor")).join(dim, "material_factor", "left")
    kg = F.greatest(F.lit(0.0), F.coalesce("quantity", F.lit(0.0)) * F.col("__value"))
    converted = F.greatest(F.lit(0.0), N.factor_quantity(F.coalesce("quantity", F.lit(0.0)), F.col("unit"), F.col("__unit")) * F.col("__value"))
    return out.select(*lines.columns, "material_factor", F.coalesce(converted, kg, F.lit(0.0)).alias("emissions"), F.col("__m.confidence").alias("confidence"))


def energy_label(product: Column, local: list[tuple[str, float, int]] = ()) -> Column:
    """struct(years, annual_kwh, source) of a product type: a local row whose type is or contains it, else the built-in table by name or part of the name."""
    key = F.trim(product)
    make = lambda y, k, s: F.struct(F.lit(y).alias("years"), F.lit(float(k)).alias("annual_kwh"), F.lit(s).alias("source"))
    rules = [(F.contains(F.lit(t), key) & (key != ""), make(y, k, "local")) for t, k, y in local]
    rules += [(key == t, make(y, k, "builtin")) for t, (y, k) in dims.PRODUCT_ENERGY.items()]
    return first_match([*rules, *[(key.contains(t), make(y, k, "builtin")) for t, (y, k) in dims.PRODUCT_ENERGY.items()]])


def product_use(rows: DataFrame, all_factors: DataFrame, local: list[tuple[str, float, int]] = ()) -> DataFrame:
    """rows (product_type, quantity, region) with years, annual_kwh and emissions over the life of the products sold; 0 where unknown."""
    staged = with_category_factor(rows.withColumn("category", F.lit("电力")), "category", "region", all_factors).withColumn("__l", energy_label(F.col("product_type"), local))
    kg = F.col("quantity") * F.col("__l.years") * F.col("__l.annual_kwh") * F.coalesce("factor.value", F.lit(dims.GRID_NATIONAL))
    known = F.col("__l").isNotNull() & (F.col("quantity") > 0)
    return staged.select(*rows.columns, F.when(known, F.col("__l.years")).otherwise(0).alias("years"), F.when(known, F.col("__l.annual_kwh")).otherwise(0.0).alias("annual_kwh"), F.when(known, kg).otherwise(0.0).alias("emissions"))
