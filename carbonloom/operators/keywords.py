"""Keyword rules and dictionaries that are tables: the first rule whose word a text holds, and words of unspaced text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words that go to every task; more are dealt out over groups of tasks.
MOST_BYTES = 4 << 20
#: Bytes of text that meet a share of the words in one task.
TEXT_BYTES = 16 << 20

_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(words: Iterable[tuple[str, int, bool]]) -> ahocorasick.Automaton:
    """All words (word, rule, excludes) in one automaton; a word's value is the list of its rules. Empty words are left out."""
    of: dict[str, list[tuple[int, bool]]] = {}
    for word, rule, excludes in words:
        if word:
            of.setdefault(word, []).append((rule, excludes))
    out = ahocorasick.Automaton()
    for word, rules in of.items():
        out.add_word(word, rules)
    if of:
        out.make_automaton()
    return out


def hits(words: ahocorasick.Automaton, text: str | None) -> tuple[int | None, list[int]]:
    """In one pass over a text: the least rule with a word in it, and the rules with an excluding word in it."""
    if not text or not len(words):
        return None, []
    found = {pair for _, rules in words.iter(text) for pair in rules}
    return min((r for r, excludes in found if not excludes), default=None), sorted({r for r, excludes in found if excludes})


def first_rules(texts: DataFrame, text: str, rules: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """texts with `rule`, the least rule with a word that the text holds (null without one), and `excluded`, whether the text also holds an excluding word of that rule.

    rules: (rule, word, excludes), a table of any size. All words are looked for in one pass over a text, by an automaton.
    Up to `most` bytes of words go to every task, and only the text column goes through Python. Beyond that the words
    are dealt into shares by their hash; each share meets all different texts in groups of TEXT_BYTES or so,
    and the least of the shares' rules counts. Null words and words without characters match nothing.
    """
    rules = rules.where("word <> '' AND rule IS NOT NULL").select(F.col("rule").cast("long").alias("rule"), "word", F.coalesce("excludes", F.lit(False)).alias("excludes")).distinct()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    if size <= most:
        words = sorted((r["word"], r["rule"], r["excludes"]) for r in rules.collect())
        name = hashlib.md5(repr(words).encode()).hexdigest()

        @F.pandas_udf("rule long, excluding array<long>")
        def found(column: pd.Series) -> pd.DataFrame:
            if name not in _automata:
                _automata.clear()
                _automata[name] = automaton(words)
            seen = {t: hits(_automata[name], t) for t in column.unique()}
            return pd.DataFrame([seen[t] for t in column], columns=["rule", "excluding"]).astype({"rule": "Int64"})

        out = texts.withColumn("__hit", found(F.col(text)))
        return out.withColumns({"rule": F.col("__hit.rule"), "excluded": F.coalesce(F.array_contains("__hit.excluding", F.col("__hit.rule")), F.lit(False))}).drop("__hit")
    shares = math.ceil(size / most)
    different = texts.where(F.col(text) != "").select(F.col(text).alias("__text")).distinct()
    groups = different.agg(F.ceil(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)) / TEXT_BYTES)).first()[0] or 1
    dealt = different.withColumn("part", F.pmod(F.xxhash64("__text"), F.lit(groups)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    words = rules.withColumn("share", F.pmod(F.xxhash64(F.lit(3), "word"), F.lit(shares)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(texts: pa.Table, words: pa.Table) -> pa.Table:
        all_ = automaton(zip(words.column("word").to_pylist(), words.column("rule").to_pylist(), words.column("excludes").to_pylist(), strict=True))
        own = texts.column("__text").to_pylist()
        found = [hits(all_, t) for t in own]
        return pa.table({"__text": pa.array(own, pa.string()), "rule": pa.array([r for r, _ in found], pa.int64()), "excluding": pa.array([e for _, e in found], pa.list_(pa.int64()))})

    met = dealt.groupBy("share", "part").cogroup(words.groupBy("share", "part")).applyInArrow(lambda a, b: meet(a, b), "__text string, rule long, excluding array<long>")
    least = met.groupBy("__text").agg(F.min("rule").alias("rule"), F.flatten(F.collect_list("excluding")).alias("excluding"))
    least = least.where("rule IS NOT NULL").select("__text", "rule", F.array_contains("excluding", F.col("rule")).alias("excluded"))
    out = texts.drop("rule", "excluded").join(least, F.col(text) == F.col("__text"), "left").drop("__text")
    return out.withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def best_path(text: str, edges: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The words of the best path through a text: edges (start, length, weight) of known words, and each single character with the weight `unknown`.

    The greatest sum of weights counts, of equal ones the longer first word. Unknown letters and digits side by
    side are one word.
    """
    from_: dict[int, list[tuple[int, float]]] = {}
    for start, length, weight in edges:
        from_.setdefault(start, []).append((length, weight))
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)] * (len(text) + 1)
    for k in range(len(text) - 1, -1, -1):
        ways = [(w + best[k + n][0], n, True) for n, w in from_.get(k, [])]
        if not any(n == 1 for _, n, _ in ways):
            ways.append((unknown + best[k + 1][0], 1, False))
        best[k] = max(ways)
    out, k, loose = [], 0, False
    while k < len(text):
        _, n, known = best[k]
        word = text[k : k + n]
        single = not known and word.isascii() and word.isalnum()
        if loose and single:
            out[-1] += word
        else:
            out.append(word)
        k, loose = k + n, single
    return out


def segmented(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """(text, words): the words of each different text (lower-cased), along the best path through the words of a dictionary (word, freq).

    A word weighs ln(freq / sum of freq), an unknown character ln(1 / sum). The dictionary may have any size: the substrings of
    the texts, up to its longest word, meet it in an equi join; only words that occur come to the path, which is sought for
    one text at a time. Texts without known words fall into characters; white space separates and is no word.
    """
    words = dictionary.where("word <> '' AND freq > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("freq").cast("double").alias("freq"))
    known = words.agg(F.coalesce(F.max(F.char_length("word")), F.lit(0)).alias("longest"), F.coalesce(F.sum("freq"), F.lit(1.0)).alias("total")).first()
    longest, unknown = known["longest"], -math.log(known["total"])
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().withColumn("low", F.lower("text"))
    n = F.char_length("low")
    starts = rows.where("low <> ''").select("text", "low", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    pieces = starts.select("text", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), n - F.col("start") + 1))).alias("length"), "low")
    pieces = pieces.select("text", "start", "length", F.substring("low", F.col("start"), F.col("length")).alias("word"))
    edges = pieces.join(words, "word").groupBy("text").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length", F.ln("freq").alias("weight"))).alias("edges"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def path(low: pd.Series, edges: pd.Series) -> pd.Series:
        def one(t: str, e: object) -> list[str]:
            found = [] if e is None else [(x["start"], x["length"], x["weight"] + unknown) for x in e]
            return [w for w in best_path(t, found, unknown) if w.strip()]

        return pd.Series([one(t, e) for t, e in zip(low, edges, strict=True)])

    return rows.join(edges, "text", "left").select("text", path("low", "edges").alias("words"))
