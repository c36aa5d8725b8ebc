"""The ledger path: lines without junk, classified to a scope and a factor, emissions, ledger entries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import apart, contains_any, first_match, holds_any, lookup, prefixes_first
from carbonloom.operators.matching import contained_in
from carbonloom.sources.shared import stored

_DEFAULT = ("Scope 3", "scope3_default")


def without_junk(lines: DataFrame) -> DataFrame:
    """Lines of goods: named, not a total, header or date, amount above 0 and below 1e8, no short name with a huge amount."""
    name, amount = F.trim(F.coalesce("name", F.lit(""))), F.coalesce("amount", F.lit(0.0))
    junk = contains_any(name, dims.JUNK_WORDS) | name.rlike(dims.JUNK_DATE)
    return lines.where((name != "") & ~junk & (amount > 0) & (amount < 1e8) & ~((F.char_length(name) <= 2) & (amount > 1e6)))


def extracted_lines(lines: DataFrame) -> DataFrame:
    """The filter after extraction, by line: header words, dates, stamps, amounts out of (0, 1e7] or that are dates of 8 digits."""
    name, amount = F.trim(F.coalesce("name", F.lit(""))), F.col("amount")
    whole = F.floor("amount")
    month, day = F.floor(whole / 100) % 100, whole % 100
    is_date = (F.abs(amount - whole) < 1e-9) & whole.between(20000101, 20991231) & month.between(1, 12) & day.between(1, 31)
    junk = contains_any(name, dims.EXTRACTION_WORDS) | name.rlike(dims.EXTRACTION_DATE) | name.rlike(dims.TAX_AUTHORITY)
    return lines.where((name != "") & ~junk & (amount > 0) & (amount <= 1e7) & ~is_date)


def without_rate_rows(lines: DataFrame) -> DataFrame:
    """In invoices with a fractional amount, whole amounts that equal a VAT rate go."""
    fractional = F.abs(F.col("amount") - F.rint("amount")) > 1e-9
    mixed = F.max(fractional).over(Window.partitionBy("invoice_id"))
    kept = lines.withColumn("__mixed", mixed).where(~(F.col("__mixed") & ~fractional & F.rint("amount").isin(*[float(r) for r in dims.VAT_RATES])))
    return kept.drop("__mixed")


def without_total_row(lines: DataFrame, order: list[str]) -> DataFrame:
    """In invoices of two lines or more, the first line goes that is the sum of the others to a cent. order: columns that place the lines."""
    invoice = Window.partitionBy("invoice_id")
    total, count = F.sum("amount").over(invoice), F.count("*").over(invoice)
    marked = lines.withColumn("__hit", (count >= 2) & (F.abs(2 * F.col("amount") - total) < 0.01))
    first = F.row_number().over(Window.partitionBy("invoice_id", "__hit").orderBy(*order))
    return marked.withColumn("__first", first).where(~(F.col("__hit") & (F.col("__first") == 1))).drop("__hit", "__first")


def first_lines(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One line for each key: the first by order."""
    return lines.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def by_tax_code(code: Column) -> Column:
    """struct(scope, factor_id) of the longest prefix; blank or unknown codes give the default."""
    rules = prefixes_first([(p, scope, factor) for scope, prefixes, _, _, factor in dims.LEDGER_RULES for p in prefixes])
    make = lambda s, f: F.struct(F.lit(s).alias("scope"), F.lit(f).alias("factor_id"))
    t = F.trim(code)
    return first_match([(t.startswith(p), make(s, f)) for p, s, f in rules], make(*_DEFAULT))


def by_keywords(text: Column) -> Column:
    """struct(scope, factor_id) of the first rule with a keyword in the text; an excluded word gives the default."""
    make = lambda s, f: F.struct(F.lit(s).alias("scope"), F.lit(f).alias("factor_id"))
    rules = []
    for scope, _, words, excluded, factor in dims.LEDGER_RULES:
        value = make(scope, factor)
        rules.append((holds_any(text, words), F.when(holds_any(text, excluded), make(*_DEFAULT)).otherwise(value) if excluded else value))
    return first_match(rules, make(*_DEFAULT))


def classify(lines: DataFrame, known_region: Column | None = None, flight: Column | None = None) -> DataFrame:
    """lines (name, tax_code, seller_name, optional tax_name) with scope, match_type and factor_id.

    Order: flight ticket (flight: whether both airports of the name are known), tax code unless an exclusion word
    stands in a Scope 1 name, accommodation words, keywords, logistics sellers, default. known_region: whether
    the catalogue has a hotel factor for the bracketed region of the name.
    """
    name = F.coalesce("name", F.lit(""))
    text = X.text_of(F.col("name"), F.col("tax_name")) if "tax_name" in lines.columns else name
    code, keyword = by_tax_code(F.col("tax_code")), by_keywords(text)
    region = X.bracket_region(text)
    abroad = region.isNotNull() & ~region.isin(*dims.DOMESTIC_HOTEL_CITIES) & (F.lit(False) if known_region is None else F.coalesce(known_region, F.lit(False)))
    stay = contains_any(text, dims.ACCOMMODATION_WORDS)
    make = lambda s, m, f: F.struct(s.alias("scope"), m.alias("match_type"), f.alias("factor_id"))
    three = F.lit("Scope 3")
    hotel = F.when(abroad, "cpcd_hotel").otherwise("scope3_accommodation")
    is_stay_rule = F.col("__kw.factor_id") == "scope3_accommodation"
    named = (F.col("__kw.factor_id") != "scope3_default") | (F.col("__kw.scope") != "Scope 3")
    rules = [
        (F.col("__code").isNotNull() & ~X.is_exclusion(F.col("__code.scope"), text), make(F.col("__code.scope"), F.lit("tax_code"), F.col("__code.factor_id"))),
        (~is_stay_rule & stay, make(three, F.when(abroad, "keyword_accommodation_overseas").otherwise("keyword_accommodation"), hotel)),
        (named, make(F.col("__kw.scope"), F.lit("keyword"), F.when(is_stay_rule, hotel).otherwise(F.col("__kw.factor_id")))),
        (X.is_logistics_seller(F.col("seller_name")), make(three, F.lit("seller_keyword"), F.lit("scope3_service"))),
    ]
    if flight is not None:
        rules.insert(0, (X.is_flight_ticket(name) & F.coalesce(flight, F.lit(False)), make(three, F.lit("flight_ticket"), F.lit("cpcd_flight"))))
    staged = lines.withColumn("__code", apart(F.when(F.coalesce("tax_code", F.lit("")) != "", code))).withColumn("__kw", apart(keyword))
    result = first_match(rules, make(three, F.lit("default"), F.lit("scope3_default")))
    return staged.withColumn("__out", apart(result)).select(*lines.columns, "__out.scope", "__out.match_type", "__out.factor_id")


def _result(quantity: Column, unit: Column, kg: Column, method: str, factor: Column) -> Column:
    return F.struct(quantity.alias("quantity"), unit.alias("unit"), kg.alias("emission_kg"), F.lit(method).alias("method"), factor.alias("factor_used"))


def line_emission() -> Column:
    """struct of the emission of a classified line (quantity, unit, amount, factor_id), null where there is none.

    Accommodation by amount, else by nights; a quantity in the factor's unit by activity; else the amount by the
    factor for each CNY, or by the default one where the factor is for a physical unit.
    """
    units, values = {f: u for f, _, u, _ in dims.LEDGER_FACTORS}, {f: v for f, _, _, v in dims.LEDGER_FACTORS}
    unit, value = lookup(F.col("factor_id"), units, F.lit("CNY")), lookup(F.col("factor_id"), values, F.lit(0.00015))
    amount, quantity = F.coalesce("amount", F.lit(0.0)), F.col("quantity")
    own = F.trim("unit")
    own = lookup(own, dims.LEDGER_UNITS, own)
    night, spend, base = F.lit(dims.HOTEL_KG_PER_NIGHT), F.lit(dims.HOTEL_KG_PER_CNY), F.lit(0.00015)
    stay = F.col("factor_id") == "scope3_accommodation"
    return first_match(
        [
            (stay & (amount > 0), _result(amount, F.lit("CNY"), amount * spend, "eeio", spend)),
            (stay & (quantity > 0), _result(quantity, F.lit("晚"), quantity * night, "activity", night)),
            (stay, F.lit(None)),
            ((quantity > 0) & (F.col("unit") != "") & (own == unit), _result(quantity, F.col("unit"), quantity * value, "activity", value)),
            (amount <= 0, F.lit(None)),
            (unit == "CNY", _result(amount, F.lit("CNY"), amount * value, "eeio", value)),
        ],
        _result(amount, F.lit("CNY"), amount * base, "eeio", base),
    )


def emissions(classified: DataFrame) -> DataFrame:
    """Classified lines with emission_kg (0 where none), emission_quantity, emission_unit, method and factor_used. Flights, hotels abroad and waste have their own functions."""
    e = classified.withColumn("__e", apart(line_emission()))
    names = {"emission_quantity": "quantity", "emission_unit": "unit", "method": "method", "factor_used": "factor_used"}
    return e.select(*classified.columns, F.coalesce("__e.emission_kg", F.lit(0.0)).alias("emission_kg"), *[F.col(f"__e.{f}").alias(n) for n, f in names.items()])


def flight_emissions(lines: DataFrame, airports: DataFrame) -> DataFrame:
    """Flight lines with from_code, to_code, distance_km, emission_kg and factor_used; only those whose two airports are known and apart."""
    pair = lines.withColumn("__p", X.iata_pair(F.col("name"))).where(F.col("__p").isNotNull())
    ends = [airports.select(F.col("iata_code").alias(f"{e}_code"), F.col("iso_country").alias(f"{e}_country"), F.col("latitude_deg").alias(f"{e}_lat"), F.col("longitude_deg").alias(f"{e}_lon")) for e in ("from", "to")]
    pair = pair.select("*", F.col("__p.from_code").alias("from_code"), F.col("__p.to_code").alias("to_code")).drop("__p")
    joined = pair.join(ends[0], "from_code").join(ends[1], "to_code")
    joined = joined.withColumn("distance_km", N.haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))).where("distance_km > 0")
    factor = F.when(F.col("from_country") == F.col("to_country"), dims.FLIGHT_KG_DOMESTIC).otherwise(dims.FLIGHT_KG_INTERNATIONAL)
    passengers = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1.0)
    return joined.withColumn("factor_used", factor).withColumn("emission_kg", factor * F.col("distance_km") * passengers).select(*lines.columns, "from_code", "to_code", "distance_km", "factor_used", "emission_kg")


def footprint_of_keyword(words: DataFrame, word: str, catalogue: DataFrame) -> DataFrame:
    """Distinct words with the footprint of the newest catalogue product that contains them (lowest row first); blank words match nothing."""
    distinct = words.select(word).where(F.trim(word) != "").distinct()
    hits = contained_in(distinct, F.col(word), catalogue.select("product_name", "carbon_footprint", "data_year", "row_index"), F.col("product_name"))
    year = -F.coalesce(F.col("data_year").cast("int"), F.lit(0))
    return hits.groupBy(word).agg(F.min_by("carbon_footprint", F.struct(year, "row_index")).alias("footprint"))


def hotel_abroad_emissions(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Hotel lines with a bracketed region: footprint of the region, else of any hotel, for each night; nights from quantity, else amount / 300 and at least 1."""
    with_region = lines.withColumn("region", X.bracket_region(F.col("name")))
    # footprints are read once for each region, not for each line
    found = footprint_of_keyword(with_region, "region", catalogue).select("region", N.footprint_strict(F.col("footprint")).alias("own"))
    any_hotel = footprint_of_keyword(lines.sparkSession.createDataFrame([("酒店住宿",)], "word string"), "word", catalogue).select(N.footprint_strict(F.col("footprint")).alias("general"))
    joined = with_region.join(found, "region", "left").join(any_hotel, F.lit(True), "left")
    nights = F.when(F.col("quantity") > 0, F.col("quantity")).when(F.col("amount") > 0, F.greatest(F.lit(1.0), F.col("amount") / 300)).otherwise(1.0)
    out = joined.withColumn("__f", F.coalesce("own", "general")).where("__f.value > 0").withColumn("nights", nights)
    return out.select(*lines.columns, "region", "nights", F.coalesce(F.nullif("__f.unit", F.lit("")), F.lit("房·晚")).alias("emission_unit"), F.col("__f.value").alias("factor_used"), (F.col("__f.value") * F.col("nights")).alias("emission_kg"))


def waste_intensity(routes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """kg CO2e for each tonne of a waste profile: ratios times the intensity of the first catalogue row of each route's product."""
    first = catalogue.groupBy(F.trim("product_id").alias("product_id")).agg(F.min_by("carbon_footprint", "row_index").alias("footprint"))
    first = first.withColumn("parsed", N.footprint(F.col("footprint"))).select("product_id", N.kg_per_tonne(F.col("parsed")).alias("intensity"))
    joined = routes.join(first, "product_id", "left")
    return joined.groupBy("factor_id").agg(F.sum(F.col("ratio") * F.coalesce("intensity", F.lit(0.0))).alias("kg_per_tonne"))


def products_by_name(names: DataFrame, name: str, products: DataFrame) -> DataFrame:
    """Distinct names with the custom product of lowest id whose name contains them in any case; blank names match nothing."""
    distinct = names.select(name).where(F.trim(name) != "").distinct()
    hits = contained_in(distinct, F.lower(F.trim(name)), products, F.lower("product_name"))
    return hits.groupBy(name).agg(F.min_by(F.struct(*products.columns), "id").alias("product"))


def is_waste_factor(factor_id: Column) -> Column:
    """Whether a factor is one of the waste profiles, whose emission is allocated to routes of disposal."""
    return F.coalesce(factor_id.isin(*dims.WASTE_FACTORS), F.lit(False))


def waste_emissions(lines: DataFrame, products: DataFrame, intensity: DataFrame) -> DataFrame:
    """The lines with a waste factor: mass by the product's unit weight times the blended intensity, else the amount times the waste factor; else null."""
    lines = lines.where(is_waste_factor(F.col("factor_id")))
    # both sides have few different keys: once their sizes are known, small tables are broadcast and lines stay where they are
    weight = stored(products_by_name(lines, "name", products).select("name", F.col("product.unit_weight_kg").alias("unit_weight_kg")), "waste-weights")
    joined = lines.join(weight, "name", "left").join(stored(intensity, "waste-intensity"), "factor_id", "left")
    mass = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1.0) * F.col("unit_weight_kg") / 1000
    rate = dims.scene_factor("waste")
    kg = F.when(F.col("unit_weight_kg") > 0, mass * F.coalesce("kg_per_tonne", F.lit(0.0))).when(F.col("amount") > 0, F.col("amount") * rate)
    method = F.when(F.col("unit_weight_kg") > 0, "waste_allocation").when(F.col("amount") > 0, "eeio")
    out = joined.withColumn("mass_t", F.when(F.col("unit_weight_kg") > 0, mass)).withColumn("emission_kg", kg).withColumn("method", method)
    used = F.when(F.col("mass_t") > 0, F.col("emission_kg") / F.col("mass_t")).when(F.col("method") == "eeio", rate)
    return out.withColumn("factor_used", used).select(*lines.columns, "mass_t", "emission_kg", "method", "factor_used")


def priced(lines: DataFrame, prices: DataFrame | None = None, day: str = "dom", default: float = dims.DEFAULT_PRICE) -> DataFrame:
    """Lines with price_per_ton and carbon_cost: the day's price where prices (dom, price_per_ton) has one, else the default."""
    if prices is None:
        out = lines.withColumn("price_per_ton", F.lit(default))
    else:
        own = prices.select(F.col(day).alias("__day"), F.col("price_per_ton").alias("__price"))
        out = lines.join(own, F.dayofmonth("invoice_date") == F.col("__day"), "left").withColumn("price_per_ton", F.coalesce("__price", F.lit(default))).drop("__day", "__price")
    return out.withColumn("carbon_cost", N.cost_cny(F.col("emission_kg"), F.col("price_per_ton")))


def debit_account(scope: Column, nature: str = "auto") -> Column:
    fixed = {"manufacturing": "制造费用 - 碳成本", "selling": "销售费用 - 碳成本", "admin": "管理费用 - 碳成本"}
    return F.lit(fixed[nature]) if nature in fixed else F.when(scope.isin("Scope 1", "Scope 2"), fixed["manufacturing"]).otherwise(fixed["admin"])


def ledger_entries(results: DataFrame, price: float = dims.DEFAULT_PRICE, nature: str = "auto") -> DataFrame:
    """An entry for each emission: description, scope, kg, debit account, CNY and the invoice it refers to."""
    cost = N.cost_cny(F.col("emission_kg"), F.lit(price))
    return results.select(F.concat(F.lit("碳成本 "), "scope").alias("description"), "scope", "emission_kg", debit_account(F.col("scope"), nature).alias("debit_account"), cost.alias("amount_cny"), F.col("invoice_id").alias("ref_invoice_id"))


def stats_by_scope(facts: DataFrame) -> DataFrame:
    """Count, amount, kg and cost of each scope, in order of scope."""
    sums = [F.round(F.coalesce(F.sum(c), F.lit(0.0)), p).alias(n) for c, p, n in (("amount", 2, "total_amount"), ("emission_kg", 4, "total_kg"), ("carbon_cost", 2, "total_cost"))]
    return facts.groupBy("scope").agg(F.count("*").alias("n_lines"), *sums).orderBy("scope")


def kg_by_scope(results: DataFrame) -> DataFrame:
    """kg of each of the three scopes, 0 where a scope has no line."""
    sums = results.agg(*[F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("emission_kg"))), F.lit(0.0)).alias(s) for s in dims.SCOPES])
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in dims.SCOPES]), F.array(*[F.col(f"`{s}`") for s in dims.SCOPES]))).alias("scope", "emission_kg"))


def scope_costs(results: DataFrame, keys: list[str], price: float = dims.DEFAULT_PRICE) -> DataFrame:
    return results.groupBy(*keys).agg(*[N.cost_cny(F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("emission_kg"))), F.lit(0.0)), F.lit(price)).alias(f"scope{k}_cost") for k, s in enumerate(dims.SCOPES, 1)])


def profit_statement(results: DataFrame, financials: DataFrame, key: str, price: float = dims.DEFAULT_PRICE) -> DataFrame:
    """financials (key, revenue, traditional_cost, optional carbon_asset_pnl) with carbon costs by scope and the derived profits."""
    asset = F.col("carbon_asset_pnl") if "carbon_asset_pnl" in financials.columns else F.lit(0.0)
    costs = [f"scope{k}_cost" for k in (1, 2, 3)]
    out = financials.join(scope_costs(results, [key], price), key, "left").fillna(0.0, costs)
    out = out.withColumn("gross_profit", F.col("revenue") - F.col("traditional_cost"))
    out = out.withColumn("carbon_adjusted_gross", F.col("gross_profit") - F.col("scope1_cost") - (F.col("scope2_cost") + F.col("scope3_cost")))
    return out.withColumn("net_carbon_pnl", F.col("carbon_adjusted_gross") + asset)


def monthly_vouchers(results: DataFrame, price: float = dims.DEFAULT_PRICE) -> DataFrame:
    """The closing voucher of each month: all kg, booked as Scope 3 to administration."""
    out = results.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(F.sum("emission_kg").alias("emission_kg"))
    return out.select("month", F.lit("当月碳成本结转（碳调整后净利润）").alias("description"), F.lit("Scope 3").alias("scope"), "emission_kg", debit_account(F.lit("Scope 3"), "admin").alias("debit_account"), N.cost_cny(F.col("emission_kg"), F.lit(price)).alias("amount_cny"))


def product_line_insight(lines: DataFrame) -> DataFrame:
    """lines (product_line, revenue, traditional_cost, carbon_cost): margins in percent and whether carbon turns a profit into a loss; no revenue, no row."""
    gross = (F.col("revenue") - F.col("traditional_cost")) / F.col("revenue") * 100
    adjusted = (F.col("revenue") - F.col("traditional_cost") - F.col("carbon_cost")) / F.col("revenue") * 100
    return lines.where("revenue > 0").select("product_line", gross.alias("gross_pct"), adjusted.alias("adjusted_pct"), F.col("carbon_cost"), ((gross > 0) & (adjusted < 0)).alias("is_pseudo_profit"))


def supplier_insight(results: DataFrame, price: float = dims.DEFAULT_PRICE) -> DataFrame:
    """Scope 3 kg, cost, purchases and kg for each CNY by supplier."""
    kg = F.coalesce(F.sum(F.when(F.col("scope") == "Scope 3", F.col("emission_kg"))), F.lit(0.0))
    out = results.groupBy("supplier_id").agg(kg.alias("scope3_kg"), F.sum("amount").alias("purchase"))
    return out.select("supplier_id", "scope3_kg", N.cost_cny(F.col("scope3_kg"), F.lit(price)).alias("scope3_cost"), "purchase", F.when(F.col("purchase") > 0, F.col("scope3_kg") / F.col("purchase")).otherwise(0.0).alias("intensity"))
