"""Airports by code, alias and similar name."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom.functions import text as X
from carbonloom.operators import search
from carbonloom.operators.matching import contained_in
from carbonloom.sources.shared import forget, stored

#: The ratio from which a name in Latin letters, and one in spelled-out syllables, is sure.
SURE, SURE_SPELLED = 0.55, 0.42


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters of a that b lacks match nothing, whichever they are: what is alike but for them is rated once in a batch."""
    matchers, known, out = {y: (difflib.SequenceMatcher(None, "", y), set(y)) for y in b.unique()}, {}, []
    for x, y in zip(a, b, strict=True):
        matcher, own = matchers[y]
        form = "".join([c if c in own else "\0" for c in x])
        if (form, y) not in known:
            matcher.set_seq1(x)
            known[form, y] = matcher.ratio()
        out.append(known[form, y])
    return pd.Series(out, dtype="float64")


def letters(key: Column) -> Column:
    """The characters of a key as numbers, each with the number of its occurrence: what two keys share of them bounds what they can match."""
    ordered = F.array(F.array_sort(F.filter(F.split(key, ""), lambda c: c != "")))
    return F.flatten(F.transform(ordered, lambda s: F.transform(s, lambda c, k: F.ascii(c) * F.lit(1 << 31) + k - F.array_position(s, c) + 1)))


def lettered(rows: DataFrame, key: str) -> DataFrame:
    """rows with the letters of a key beside it, taken once for each row and not for each pair."""
    return rows.withColumn(f"{key}_letters", letters(F.col(key)))


def ratio_bound(a: str, b: str) -> Column:
    """The greatest ratio of matching characters that keys of lettered() columns a and b can have: twice their common letters over both lengths."""
    return 2.0 * F.size(F.array_intersect(f"{a}_letters", f"{b}_letters")) / (F.char_length(a) + F.char_length(b))


def _rated(pairs: DataFrame, top: int) -> DataFrame:
    """(key, name_key, score): of pairs (key, name_key, bound) at least those with the `top` best ratios of a key. The pairs of greatest bound are rated first; of the others only those whose bound reaches the last of these."""
    bounded = stored(pairs.select("key", "name_key", "bound"), "airport-bounds")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bound"), "name_key"))
    placed = bounded.withColumn("place", place)
    first = stored(placed.where(F.col("place") <= top).withColumn("score", _ratio("key", "name_key")).select("key", "name_key", "score"), "airport-first")
    floor = first.groupBy("key").agg(F.min("score").alias("floor"))
    rest = placed.where(F.col("place") > top).join(floor, "key").where(F.col("bound") >= F.col("floor")).withColumn("score", _ratio("key", "name_key"))
    return first.unionByName(rest.select("key", "name_key", "score"))


def most_similar(keys: DataFrame, names: DataFrame, top: int, met: list[int] | None = None) -> DataFrame:
    """(key, name_key, score): of keys (key) and all names (name_key) at least those with the `top` best ratios of a key, as far as they have a letter in common.

    Letters meet in an index. Their cosine is no less than the share of common letters, and that no less than the
    ratio: with the ratios of a few names first, the index gives all names that can still get among the best.
    met: gets the number of pairs that are rated.
    """
    tokens = lambda rows, by, key: rows.select(by, F.explode(f"{key}_letters").alias("token"), F.lit(1.0).alias("tf"))
    names = stored(lettered(names.where("name_key <> ''").select("name_key").distinct(), "name_key").withColumn("id", F.monotonically_increasing_id()), "airport-names")
    keys = stored(lettered(keys.where("key <> ''").select("key").distinct(), "key"), "airport-keys")
    index = search.built(tokens(names, "id", "name_key"))
    queries = search.asked(tokens(keys.withColumn("query", F.col("key")), "query", "key"), index)
    named = lambda pairs: pairs.withColumnRenamed("query", "key").join(names, "id").join(keys, "key").select("key", "name_key", ratio_bound("key", "name_key").alias("bound"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))
    floors = _rated(named(search.first_pairs(queries, index)), top).withColumn("place", place).where(F.col("place") == top)
    floors = queries.terms.select("query").join(floors.select(F.col("key").alias("query"), F.col("score").alias("floor")), "query", "left").select("query", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    floors = stored(floors, "airport-floors")
    pairs = named(search.reaching(queries, index, floors)).join(floors.withColumnRenamed("query", "key"), "key").where(F.col("bound") >= F.col("floor") - search.SLACK)
    if met is not None:
        met.append(pairs.count())
    found = stored(_rated(pairs, top), "airport-rated")
    index.delete()
    queries.delete()
    forget(floors, names, keys)
    return found


def suggestions(keys: DataFrame, airports: DataFrame, top: int) -> DataFrame:
    """(key, pos, iata_code, score, rank): for each key the `top` airports of best ratio to their name key, the first in place of equals.

    Compared are airports whose municipality key holds the first four characters of the key; without any, all airports, also
    those without a letter in common, whose score is 0.
    """
    ports = airports.where("name_key <> ''").select("pos", "iata_code", "name_key", "muni_key")
    keys = stored(keys.where("key <> ''").select("key").distinct(), "airport-keys")
    near = contained_in(lettered(keys, "key"), F.substring("key", 1, 4), lettered(ports.select("name_key", "muni_key"), "name_key"), F.col("muni_key"))
    near = stored(near.select("key", "name_key", ratio_bound("key", "name_key").alias("bound")).distinct(), "airport-near")
    alone = keys.join(near.select("key").distinct(), "key", "left_anti")
    best = most_similar(alone, ports, top)
    rated = stored(_rated(near, top).unionByName(best), "airport-all")
    forget(best)
    # only names in the same town are compared; those of equal names elsewhere are not
    local = contained_in(keys, F.substring("key", 1, 4), ports, F.col("muni_key")).join(rated, ["key", "name_key"]).select("key", "pos", "iata_code", "score")
    far = rated.join(alone, "key").join(ports, "name_key").select("key", "pos", "iata_code", "score")
    none = alone.join(F.broadcast(ports.orderBy("pos").limit(top).select("pos", "iata_code", F.lit(0.0).alias("score"))), F.lit(True)).join(far.select("key", "pos"), ["key", "pos"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "pos"))
    found = local.unionByName(far).unionByName(none.select("key", "pos", "iata_code", "score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def suggest(inputs: DataFrame, name: str, airports: DataFrame, top: int = 3, sure: float = SURE_SPELLED) -> DataFrame:
    """(name, iata_code, rank, score, answered) of each distinct name: the most similar airports, at any score. answered says whether the best one reaches `sure`; otherwise they are suggestions with an error."""
    names = stored(inputs.select(name).distinct().withColumn("key", X.match_key(F.col(name))), "airport-asked")
    found = suggestions(names, airports, top).withColumn("answered", F.max("score").over(Window.partitionBy("key")) >= sure)
    return names.join(found, "key").select(name, "iata_code", "rank", "score", "answered")


def resolve(inputs: DataFrame, name: str, airports: DataFrame, aliases: DataFrame, spelled: str | None = None, least: float = SURE) -> DataFrame:
    """Distinct names with code, how and score: by IATA code, ident, alias (keys as in alias_rows()), then by similarity.

    A name with Latin letters is compared with the name keys of airports whose municipality key holds its first six key
    characters; without such airports it stays unresolved. If the best ratio is below `least`, or the name has no
    Latin letters, the column `spelled` counts, the syllables of its Chinese characters, as in suggestions().
    Of rows with one code the last in place counts; the first in place of equal ratios. Unresolved names keep nulls.
    """
    spelled_key = X.spelled_key(F.col(spelled)) if spelled else F.lit("")
    names = inputs.select(name, spelled_key.alias("__spelled")).groupBy(name).agg(F.max("__spelled").alias("__spelled"))
    names = names.withColumns({"__upper": F.upper(F.trim(name)), "key": X.match_key(F.col(name)), "__alias": X.alias_key(F.col(name))})
    ports = stored(airports.select("pos", "iata_code", "ident", "name_key", "muni_key"), "airports")
    last = lambda c, to, code: ports.where(F.coalesce(c, F.lit("")) != "").groupBy(F.col(c).alias(to)).agg(F.max_by("iata_code", "pos").alias(code))
    iata = ports.where(F.col("iata_code").rlike("^[A-Z]{3}$") & (F.col("iata_code") != "NAN")).select(F.col("iata_code").alias("__upper"), F.col("iata_code").alias("by_iata")).distinct()
    ident = last("ident", "__upper", "by_ident")
    code = aliases.select(F.col("alias").alias("__alias"), "code").join(iata.toDF("code", "a"), "code", "left").join(ident.toDF("code", "b"), "code", "left")
    alias = code.select("__alias", F.coalesce("a", "b").alias("by_alias"))
    found = names.join(iata, "__upper", "left").join(ident, "__upper", "left").join(alias, "__alias", "left")
    found = stored(found.select(name, "key", "__spelled", "by_iata", "by_ident", "by_alias"), "airport-asked")
    open_ = found.where(F.coalesce("by_iata", "by_ident", "by_alias").isNull())
    near = contained_in(lettered(open_.where("key <> ''").select("key").distinct(), "key"), F.substring("key", 1, 6), lettered(ports.where("name_key <> ''"), "name_key"), F.col("muni_key"))
    near = stored(near.select("key", "pos", "iata_code", "name_key", ratio_bound("key", "name_key").alias("bound")), "airport-near")
    rated = near.join(_rated(near.select("key", "name_key", "bound").distinct(), 1), ["key", "name_key"])
    best = rated.groupBy("key").agg(F.max_by(F.struct("iata_code", "score"), F.struct("score", -F.col("pos"))).alias("near"))
    tried = found.join(stored(best, "airport-best"), "key", "left")
    by_name = F.when(F.col("near.score") >= least, F.col("near.iata_code"))
    again = tried.where(F.coalesce("by_iata", "by_ident", "by_alias").isNull() & by_name.isNull() & ((F.col("key") == "") | F.col("near").isNotNull()) & (F.col("__spelled") != ""))
    # names spelled alike share an answer
    spelt = suggestions(again.select(F.col("__spelled").alias("key")), ports, 1).where(F.col("score") >= SURE_SPELLED).select(F.col("key").alias("__spelled"), F.col("iata_code").alias("spelt"), F.col("score").alias("spelt_score"))
    spelt = again.select(name, "__spelled").join(spelt, "__spelled").drop("__spelled")
    out = tried.join(spelt, name, "left")
    how = F.when(F.col("by_iata").isNotNull(), "iata").when(F.col("by_ident").isNotNull(), "ident").when(F.col("by_alias").isNotNull(), "alias").when(by_name.isNotNull(), "similar").when(F.col("spelt").isNotNull(), "spelled")
    score = F.when(how.isin("iata", "ident", "alias"), 1.0).when(how == "similar", F.col("near.score")).otherwise(F.col("spelt_score"))
    return out.select(name, F.coalesce("by_iata", "by_ident", "by_alias", by_name, "spelt").alias("code"), how.alias("how"), score.alias("score"))
