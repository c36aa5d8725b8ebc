"""Ordered rules as columns: first match wins, without a join or a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether text holds one of the words; false for null text or no words."""
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """contains_any() as comparisons of bytes, without a pattern: several times as fast and much more code. For chains that stand apart()."""
    return reduce(Column.__or__, [text.contains(w) for w in words], F.lit(False))


def first_match(branches: Iterable[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first branch whose condition holds, else default (null)."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return (out if out is not None else F.lit(None)) if default is None else out.otherwise(default)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def apart(value: Column) -> Column:
    """value, kept out of the code that Spark generates for a whole stage.

    A long chain of rules makes that one method larger than the JVM compiles (8,000 bytes): it is then interpreted for each row,
    with all else in the stage. A lambda beside the chain keeps its projection out of that method; Spark then cuts the chain into
    small methods, which are compiled, where a chain within a lambda would be evaluated node by node.
    """
    return F.when(let(F.lit(True), lambda x: x), value)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """A literal map of a fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def prefixes_first(rules: list[tuple]) -> list[tuple]:
    """Rules by length of their first element, longest first; equal lengths keep their order."""
    return sorted(rules, key=lambda r: -len(r[0]))


def longest_prefix(codes: DataFrame, code: str, rules: DataFrame, prefix: str = "prefix", pos: str = "rule_pos") -> DataFrame:
    """codes joined with the rule of the longest prefix of `code`; without a match the rule's columns are null.

    For large rule tables. Each distinct code gives its prefixes, which meet the rules in an equi join; ties go
    to the lowest pos. Null codes match nothing. Blank ends of codes are ignored.
    """
    trimmed = F.trim(F.col(code))
    distinct = codes.select(trimmed.alias("__code")).where("__code <> ''").distinct()
    parts = distinct.withColumn("__len", F.explode(F.sequence(F.lit(1), F.char_length("__code")))).withColumn("__prefix", F.expr("substring(__code, 1, __len)"))
    keep = [c for c in rules.columns if c not in (prefix, pos)]
    hits = parts.join(rules, F.col("__prefix") == rules[prefix])
    best = hits.groupBy("__code").agg(F.min_by(F.struct(F.col("__prefix").alias(prefix), *keep), F.struct(-F.col("__len"), pos)).alias("__rule"))
    return codes.join(best, trimmed == F.col("__code"), "left").select(*[codes[c] for c in codes.columns], *[F.col(f"__rule.{c}").alias(c) for c in (prefix, *keep)])
