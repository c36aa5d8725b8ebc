"""Amounts, dates, footprints, units, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions.rules import let, lookup
from carbonloom.functions.text import group

_PLAIN = r"^-?(\d+\.?\d*|\.\d+)$"


def number(text: Column) -> Column:
    """A plain decimal number, else null."""
    return let(text, lambda t: F.when(t.rlike(_PLAIN), t.try_cast("double")))


def _money(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), "[¥￥]", ""), r"(?i)\b(RMB|CNY)\b", "")


def _no_rate(text: Column, value: Column) -> Column:
    return F.when(~text.rlike(r"\d+(?:\.\d+)?%"), value)


def amount_cny(text: Column) -> Column:
    """CNY from an amount string. Rates (13%) give null; a comma before exactly three last digits parts thousands, else it is the decimal sign."""
    s = F.trim(F.regexp_replace(_money(text), r"元\s*$", ""))
    s = F.replace(F.replace(F.replace(s, F.lit("，"), F.lit(",")), F.lit("。"), F.lit(".")), F.lit("　"), F.lit(" "))
    plain = lambda s: F.when(s.contains(",") & (s.contains(".") | s.rlike(r",\d{3}$")), F.replace(s, F.lit(","), F.lit(""))).when(s.contains(","), F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    return _no_rate(text, number(F.regexp_replace(let(s, plain), r"[^\d.\-]", "")))


def cell_number(text: Column) -> Column:
    """A table cell: all commas and blanks dropped."""
    s = F.trim(F.regexp_replace(_money(text), "元+$", ""))
    return _no_rate(text, number(F.regexp_replace(s, r"[,，\s]", "")))


def cell_numbers(text: Column) -> Column:
    """All numbers of a mixed cell, in order; tokens with letters or units are skipped."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"\d+(?:\.\d+)?%", ""), "[¥￥]", "")
    parts = F.split(F.trim(F.regexp_replace(s, r"[,，\s]+", " ")), " ")
    good = F.filter(parts, lambda p: ~p.rlike("[a-zA-Z]") & ~p.rlike(r"^\d+(?:\.\d+)?[一-鿿]"))
    values = F.transform(good, lambda p: number(F.regexp_replace(p, r"[^\d.\-]", "")))
    return F.filter(values, lambda v: v.isNotNull())


def label_number(text: Column) -> Column:
    """An amount read by label: currency sign, commas and all but digits, point and minus dropped."""
    return number(F.regexp_replace(F.regexp_replace(text, "[¥￥,，]", ""), r"[^0-9.\-]", ""))


def safe_float(text: Column) -> Column:
    return let(F.trim(text), lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))


def cn_date(text: Column) -> Column:
    """The first date such as 2024年1月5日, 2024/1/5 or 2024-1-5 as 2024-01-05; without one unchanged."""
    p = r"(\d{4})[年/\-](\d{1,2})[月/\-](\d{1,2})日?"
    iso = F.concat_ws("-", F.regexp_extract(text, p, 1), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 3), 2, "0"))
    return F.when(text.rlike(p), iso).otherwise(text)


def compact_date(text: Column) -> Column:
    """YYYYMMDD to ISO; anything else unchanged."""
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(text)


def epoch_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


_VALUE = r"(?i)([\d.eE+-]+)\s*"


def _scaled(value: Column, prefix: Column) -> Column:
    p = F.lower(prefix)
    return F.when(p == "t", value * 1000).when(p == "g", value / 1000).otherwise(value)


def footprint(text: Column) -> Column:
    """struct(value in kg, unit): t, kg or g of CO2e for each unit; without a denominator or a mass prefix as a fallback; 0 and '' if unreadable."""
    full, bare, none = _VALUE + r"(t|kg|g)\s*CO2e?\s*[/／]\s*([^\s,;]+)", _VALUE + r"(t|kg|g)\s*CO2e?", _VALUE + r"CO2e?\s*[/／]\s*([^\s,;]+)"
    make = lambda v, u: F.struct(F.coalesce(v, F.lit(0.0)).alias("value"), F.when(v.isNull(), "").otherwise(u).alias("unit"))
    num = lambda p: safe_float(F.regexp_extract(text, p, 1))
    return (
        F.when(text.rlike(full), make(_scaled(num(full), F.regexp_extract(text, full, 2)), F.regexp_extract(text, full, 3)))
        .when(text.rlike(bare), make(_scaled(num(bare), F.regexp_extract(text, bare, 2)), F.lit("单位")))
        .when(text.rlike(none), make(num(none), F.regexp_extract(text, none, 2)))
        .otherwise(F.struct(F.lit(0.0).alias("value"), F.lit("").alias("unit")))
    )


def footprint_strict(text: Column) -> Column:
    """struct(value in kg, unit) where mass prefix and denominator are given, else 0 and ''."""
    full = _VALUE + r"(t|kg|g)\s*CO2e?\s*[/／]\s*([^\s,;]+)"
    value = _scaled(safe_float(F.regexp_extract(text, full, 1)), F.regexp_extract(text, full, 2))
    return F.when(text.rlike(full) & value.isNotNull(), F.struct(value.alias("value"), F.regexp_extract(text, full, 3).alias("unit"))).otherwise(F.struct(F.lit(0.0).alias("value"), F.lit("").alias("unit")))


def footprint_anchored(text: Column) -> Column:
    """struct(value in kg, unit) of a text that is a footprint as a whole, else null."""
    full = r"(?i)^([\d.]+)\s*(t|kg|g)CO2e\s*/\s*(.+)$"
    t = F.trim(text)
    value = _scaled(number(F.regexp_extract(t, full, 1)), F.regexp_extract(t, full, 2))
    return F.when(t.rlike(full) & value.isNotNull(), F.struct(value.alias("value"), F.trim(F.regexp_extract(t, full, 3)).alias("unit")))


def kg_per_tonne(parsed: Column) -> Column:
    """A parsed footprint as kg for each tonne of waste; 0 for other units or null."""
    value, unit = parsed["value"], parsed["unit"]
    low = F.lower(F.trim(unit))
    tonne, kilo = unit.contains("公吨") | (low == "吨") | (unit == "t"), unit.contains("千克") | low.isin("kg", "公斤")
    return F.coalesce(F.when(value <= 0, 0.0).when(tonne, value).when(kilo, value * 1000), F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * dims.EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def js_round(value: Column, places: int) -> Column:
    """Halves up, as Math.round does."""
    return F.floor(value * 10**places + 0.5) / float(10**places)


def cost_cny(kg: Column, price: Column) -> Column:
    return kg / 1000 * price


def activity_unit(unit: Column) -> Column:
    """The standard unit of a quantity: exact names first, then parts of them."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    forms = F.when(u.rlike("(?i)度|kwh|千瓦时"), "kWh").when(u.rlike(r"(?i)吨|t\b|tons"), "t").when(u.rlike(r"(?i)升|l\s*$"), "L").when(u.rlike("(?i)方|立方米|m3"), "m3").when(u.rlike("(?i)元|yuan|cny"), "CNY").otherwise(F.lower(u))
    return F.when(u == "", "unit").otherwise(F.coalesce(lookup(u, dims.ACTIVITY_UNITS), lookup(F.lower(u), dims.ACTIVITY_UNITS), forms))


def factor_quantity(quantity: Column, unit: Column, factor_unit: Column) -> Column:
    """A quantity in the factor's unit; only MWh and kWh convert, other units pass as they are."""
    into = lambda to: let(activity_unit(unit), lambda own: F.when((own == "MWh") & (to == "kWh"), quantity * 1000).when((own == "kWh") & (to == "MWh"), quantity / 1000).otherwise(quantity))
    # the unit is read only where it can matter
    return let(F.regexp_extract(factor_unit, "/(.+)$", 1), lambda to: F.when(to.isin("kWh", "MWh"), into(to)).otherwise(quantity))


def positional_amounts(nums: Column) -> Column:
    """struct(quantity, unit_price, amount) of the numbers of a line by their places."""
    n = F.size(nums)
    a, b, c = (F.get(nums, k) for k in range(3))
    none = F.lit(None).cast("double")
    make = lambda q, p, x: F.struct(q.alias("quantity"), p.alias("unit_price"), x.alias("amount"))
    fits = (a != 0) & (b != 0) & (c > 1e-9) & (F.abs(a * b - c) / c < 0.02)
    return (
        F.when(n >= 4, make(a, F.try_element_at(nums, F.lit(-3)), F.try_element_at(nums, F.lit(-2))))
        .when((n == 3) & fits, make(a, b, c))
        .when(n == 3, make(none, none, b))
        .when(n.isin(1, 2), make(none, none, a))
    )


def without_subtotal(nums: Column) -> Column:
    """The other numbers, if one is the sum of the rest (first such one, to a cent), else null."""
    total = F.aggregate(nums, F.lit(0.0), lambda s, v: s + v)
    at = F.array_position(F.transform(nums, lambda v: F.abs(2 * v - total) < 0.01), F.lit(True))
    return F.when((F.size(nums) >= 2) & (at > 0), F.filter(nums, lambda v, k: k != at - 1))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
