"""Predicates and extractions on names and invoice text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions.rules import contains_any, first_match, let, lookup


def text_of(*parts: Column) -> Column:
    """Parts that are not null or empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def is_exclusion(scope: Column, text: Column) -> Column:
    """Scope 1 goods that are not burnt."""
    return (scope == "Scope 1") & contains_any(F.lower(text), dims.EXCLUSION_WORDS)


def is_logistics_seller(seller: Column) -> Column:
    return contains_any(seller, dims.LOGISTICS_SELLERS)


def is_flight_ticket(text: Column) -> Column:
    return contains_any(text, dims.FLIGHT_WORDS_CN) | contains_any(F.lower(text), dims.FLIGHT_WORDS_EN)


def is_star_category(name: Column) -> Column:
    """*category* in front: 2 to 15 letters, Chinese characters or blanks between the stars."""
    inner = F.trim(F.regexp_extract(F.trim(name), r"^\*([^*]+)\*", 1))
    return F.coalesce(inner.rlike(r"^[A-Za-z一-鿿\s]{2,15}$"), F.lit(False))


def is_unit_only(name: Column) -> Column:
    t = F.trim(name)
    unit = t.rlike(dims.UNIT_CHARACTER) | F.lower(t).isin(*dims.UNIT_WORDS)
    return F.coalesce((F.char_length(t) <= 6) & unit, F.lit(False))


def is_spec(name: Column) -> Column:
    t = F.trim(name)
    forms = reduce(Column.__or__, [t.rlike(p) for p in dims.SPEC_FORMS])
    return F.coalesce((t != "") & (F.char_length(t) <= 30) & forms, F.lit(False))


def is_weight_volume(name: Column) -> Column:
    t = F.trim(name)
    return F.coalesce((F.char_length(t) <= 15) & t.rlike(dims.WEIGHT_FORM), F.lit(False))


def is_certificate(name: Column) -> Column:
    return contains_any(name, dims.CERTIFICATE_WORDS) | F.coalesce(name.rlike(dims.CERTIFICATE_FORM), F.lit(False))


def clean_name(name: Column) -> Column:
    """One line; cut at a certificate mark after the sixth character; unit and spec tokens dropped unless nothing is left."""
    cut = lambda s: first_match([(F.instr(s, sep) > 6, F.trim(F.substring(s, F.lit(1), F.instr(s, sep) - 1))) for sep in dims.CERTIFICATE_CUTS], s)
    kept = lambda c: F.array_join(F.filter(F.split(c, " "), lambda p: ~(is_unit_only(p) | is_spec(p))), " ")
    # a single token stays, whatever it is
    tidy = lambda c: F.when(c.contains(" "), F.coalesce(let(kept(c), lambda k: F.nullif(k, F.lit(""))), c)).otherwise(c)
    return let(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), lambda s: let(cut(s), tidy))


def iata_pair(text: Column) -> Column:
    """struct(from_code, to_code) or null: departure to arrival in Chinese, FROM to TO, AAA-BBB, then the first two different codes."""
    cn, en, dash = dims.AIRPORT_PAIRS
    pair = lambda t, p: F.struct(F.regexp_extract(t, p, 1).alias("from_code"), F.regexp_extract(t, p, 2).alias("to_code"))
    # a match of `dash` begins with one code and ends with the other
    ends = lambda m: F.when((m != "") & (F.left(m, F.lit(3)) != F.right(m, F.lit(3))), F.struct(F.left(m, F.lit(3)).alias("from_code"), F.right(m, F.lit(3)).alias("to_code")))
    two = lambda codes: F.when(F.size(codes) >= 2, F.struct(F.get(codes, 0).alias("from_code"), F.get(codes, 1).alias("to_code")))

    def found(t: Column) -> Column:
        rest = F.coalesce(let(F.regexp_extract(t, dash, 0), ends), let(F.array_distinct(F.regexp_extract_all(t, F.lit(dims.AIRPORT_CODE), 1)), two))
        # the words that a pattern needs are looked for first
        return first_match([((t.contains("出发") | t.contains("起飞")) & t.rlike(cn), pair(t, cn)), (t.contains("FROM") & t.rlike(en), pair(t, en))], rest)

    return let(F.upper(text), found)


def cabin(text: Column) -> Column:
    low = F.lower(text)
    return first_match([(text.contains(cn) | low.contains(en), F.lit(kind)) for cn, en, kind in dims.CABINS])


def bracket_region(text: Column) -> Column:
    """The first text in full-width brackets, else in plain ones; blank counts as none."""
    wide, plain = group(text, "（([^）]+)）"), group(text, r"\(([^)]+)\)")
    return let(F.trim(F.coalesce(wide, plain)), lambda v: F.nullif(v, F.lit("")))


def product_id(text: Column) -> Column:
    return group(text, dims.PRODUCT_ID)


def tonne_km(text: Column) -> Column:
    """Tonne kilometres named in a text, or tonnes times kilometres; null if none is above 0."""
    t = F.regexp_replace(text, " ", " ")
    num = lambda p, k=1: group(t, p, k).try_cast("double")
    direct = [num(p) for p in dims.TONNE_KM_DIRECT]
    product = [num(p, 1) * num(p, 2) for p in dims.TONNE_KM_PRODUCT]
    return F.coalesce(*[F.when(v > 0, v) for v in (*direct, *product)])


def transport_mode(text: Column) -> Column:
    return first_match([(contains_any(text, words), F.lit(mode)) for words, mode in dims.MODE_WORDS], F.lit("road"))


def star_keywords(name: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\*([^*]+)\*"), 1), lambda k: F.trim(k)), lambda k: k != "")


def dictionary_keywords(name: Column) -> Column:
    """Dictionary words in the name, longest first; each hit blanks its first place so that shorter words inside are not found again."""
    terms = sorted([w for words in dims.DICTIONARY.values() for w in words], key=lambda w: -len(w))
    start = F.struct(name.alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(state: Column, word: Column) -> Column:
        rest, at = state["rest"], F.position(word, state["rest"])
        blanked = F.concat(F.substring(rest, F.lit(1), at - 1), F.lit("\u0001"), F.substring(rest, at + F.char_length(word), F.char_length(rest)))
        return F.when(at > 0, F.struct(blanked.alias("rest"), F.concat(state["hits"], F.array(word)).alias("hits"))).otherwise(state)

    return F.aggregate(F.array(*[F.lit(t) for t in terms]), start, step)["hits"]


def keywords(name: Column) -> Column:
    """struct(keywords, confidence): star keywords, then dictionary words, each once."""
    t = F.trim(F.coalesce(name, F.lit("")))
    stars, words = star_keywords(t), dictionary_keywords(t)
    merged = F.array_distinct(F.concat(stars, words))
    level = F.when(F.size(merged) == 0, "低").when(F.size(stars) > 0, "高").otherwise("中")
    return F.struct(merged.alias("keywords"), level.alias("confidence"))


def category_of_code(code: Column) -> Column:
    """Category 0 to 9 by the longest prefix of a tax code, null without one."""
    t = F.trim(code)
    return first_match([(t.startswith(p), F.lit(c)) for p, c in sorted(dims.CATEGORY_PREFIXES.items(), key=lambda x: -len(x[0]))])


def category_label(category: Column) -> Column:
    return lookup(category, dims.CATEGORY_LABELS, F.lit("其他"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 for empty strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def match_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def spelled_key(syllables: Column) -> Column:
    """Match key of spelled-out syllables, with the words of airport names put into English."""
    joined = F.regexp_replace(F.lower(syllables), r"\s+", "")
    return match_key(reduce(lambda s, w: F.replace(s, F.lit(w[0]), F.lit(w[1])), dims.SPELLED_WORDS.items(), joined))


def alias_key(text: Column) -> Column:
    """Lower case without white space, dots, brackets, hyphens and underscores; Chinese characters stay."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s·•．。()（）_-]+", "")


def normalised_scope(value: Column) -> Column:
    """Scope n from spellings such as 'Scope 1', '范围1', '范围一'; a part of 'Scope 1' (also empty text) counts as Scope 1, and so on."""
    s = F.trim(value)
    low = F.lower(s)
    parts = [(s.contains(scope) | F.lit(scope).contains(s), F.lit(scope)) for scope in dims.SCOPES]
    names = [(low.contains(scope.lower()) | s.contains(f"范围{k}") | s.contains(f"范围{cn}"), F.lit(scope)) for scope, k, cn in zip(dims.SCOPES, "123", "一二三", strict=True)]
    return F.when(value.isNotNull(), first_match([*parts, *names]))


def exclusions(value: Column) -> Column:
    """Words of an exclusion cell, split at the first separator that it has of ; ； , ，."""
    s = F.trim(F.coalesce(value, F.lit("")))
    split = first_match([(s.contains(sep), F.split(s, sep)) for sep in (";", "；", ",", "，")], F.array(s))
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
