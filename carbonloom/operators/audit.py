"""Audit trails and provenance of calculated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factor_provenance(category: Column, name: Column, source: Column, factor_id: Column) -> Column:
    """struct(type, source, reference) of an emission factor."""
    make = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("source"), F.concat(F.lit("因子ID: "), factor_id).alias("reference"))
    physical = category.isin("电力", "燃料燃烧", "材料")
    return F.when(physical, make("物理因子", F.concat_ws("，", name, source))).when(category == "EEIO", make("EEIO因子", F.concat(name, F.lit("，行业/投入产出")))).otherwise(make("因子来源", source))


def source_trace(source: Column, year: Column, unit: Column) -> Column:
    return F.concat(F.lit("来源: "), F.coalesce(source, F.lit("未知")), F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")), F.lit("; 单位: "), F.coalesce(unit, F.lit("")))


def trails(items: DataFrame, run_id: str) -> DataFrame:
    """One trail for each invoice of calculated items: steps with input, output, rule and confidence, the result as JSON, distinct sources, and an id that is the same at each run of run_id."""
    # lines are gathered with each value once, in the order that their steps would have; the steps are made from the sorted lines
    line = F.struct("name", F.col("factor_scope").cast("string").alias("scope"), "confidence", "factor_id", "reason", F.round("emissions", 4).cast("string").alias("kg"), "method", "category")
    step = lambda name, put, out, rule, conf: F.struct(F.lit(name).alias("step"), put.alias("input"), out.alias("output"), rule.alias("rules"), conf.alias("confidence"))
    steps = lambda x: F.array(
        step("classify", x["name"], x["scope"], F.lit("税号前缀"), x["confidence"]),
        step("match", x["name"], x["factor_id"], x["reason"], x["confidence"]),
        step("calculate", x["factor_id"], x["kg"], x["method"], x["confidence"]),
    )
    source = lambda x: factor_provenance(x["category"], x["factor_id"], F.lit("内置/未知"), x["factor_id"])
    gathered = items.groupBy("invoice_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("emissions").alias("total"))
    factors = F.array_distinct(F.transform("lines", lambda x: F.struct(x["category"].alias("category"), x["factor_id"].alias("factor_id"))))
    grouped = gathered.select("invoice_id", F.flatten(F.transform("lines", steps)).alias("steps"), "total", F.array_sort(F.array_distinct(F.transform(factors, source))).alias("data_sources"))
    result = F.to_json(F.struct(F.round("total", 2).alias("total")))
    return grouped.select(F.sha2(F.concat_ws("|", "invoice_id", F.lit(run_id)), 256).alias("id"), "invoice_id", "steps", result.alias("final_result"), "data_sources")


def find(audit: DataFrame, invoice_id: str | None = None, audit_id: str | None = None) -> DataFrame:
    return audit.where(F.col("invoice_id") == invoice_id if audit_id is None else F.col("id") == audit_id)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select("invoice_id", F.to_json(F.struct("*")).alias("json"))
