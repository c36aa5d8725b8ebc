"""Exact search for the best rows by weighted tokens, over postings in blocks with upper bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonloom.sources.shared import forget, stored

#: A posting's weight, from 0 to 1, falls into one of so many levels: the blocks of a token's posting list, in order of impact.
LEVELS = 64
#: Postings that a query reads, about, to find its first floor; blocks larger than this are not read for that.
FIRST_READ = 512
#: The part of the floor that the tokens which bring no texts may make up: more of it reads fewer postings, less of it scores fewer texts.
SILENT = 0.4
#: More than rounding can make of two ways to add up a score.
SLACK = 1e-9


@dataclass
class Index:
    """Unit vectors of texts by token: postings (token, level, id, w), their blocks, whole vectors, and idf."""

    postings: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    idf: DataFrame

    def delete(self) -> None:
        forget(self.postings, self.blocks, self.vectors, self.idf)


def weights(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, token, w): counts (key, token, tf) times idf, each key's vector of length 1. Tokens without idf count for nothing."""
    raw = counts.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "token", (F.col("w") / norm).alias("w"))


def built(counts: DataFrame, copies: DataFrame | None = None) -> Index:
    """The index of texts with counts (id, token, tf), of which copies (id, n) has the numbers of rows. idf is ln((1 + rows) / (1 + df)) + 1, or 1 without copies.

    The level of a posting is its weight in steps of 1 / LEVELS: the blocks of a list come in order of impact
    without sorting or numbering a list in one place.
    """
    if copies is None:
        idf = counts.select("token").distinct().withColumn("idf", F.lit(1.0))
    else:
        total = copies.agg(F.sum("n").alias("rows"))
        df = counts.join(copies, "id").groupBy("token").agg(F.sum("n").alias("df"))
        idf = df.join(F.broadcast(total), F.lit(True)).select("token", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = stored(idf, "search-idf")
    level = F.least(F.floor(F.col("w") * LEVELS), F.lit(LEVELS - 1)).cast("int")
    postings = stored(weights(counts, "id", idf).select("token", level.alias("level"), "id", "w"), "search-postings")
    blocks = stored(postings.groupBy("token", "level").agg(F.count("*").alias("size"), F.min("w").alias("low"), F.max("w").alias("high")), "search-blocks")
    vectors = stored(postings.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("of")), "search-vectors")
    return Index(postings, blocks, vectors, idf)


def _most(wq: Column, low: Column, high: Column) -> Column:
    """The greatest cosine of a unit query with weight wq at a token to unit texts whose weight there lies between low and high.

    wq * w + sqrt(1 - wq^2) * sqrt(1 - w^2) rises up to w = wq and falls behind.
    """
    at = lambda w: wq * w + F.sqrt(F.greatest(F.lit(0.0), 1 - wq * wq)) * F.sqrt(F.greatest(F.lit(0.0), 1 - w * w))
    return F.when(wq < low, at(low)).when(wq > high, at(high)).otherwise(F.lit(1.0))


def _scored(pairs: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query, id, score) of pairs (query, id): cosines, added up token by token in the order of the query's tokens."""
    w = lambda t: t["w"] * F.coalesce(F.try_element_at("of", t["token"]), F.lit(0.0))
    return pairs.join(queries.select("query", "terms"), "query").join(index.vectors, "id").select("query", "id", F.aggregate("terms", F.lit(0.0), lambda total, t: total + w(t)).alias("score"))


@dataclass
class Asked:
    """Queries against an index: unit vectors (query, token, w, share), (query, terms, shares), and the bounds of the blocks that they could read."""

    own: DataFrame
    terms: DataFrame
    blocks: DataFrame

    def delete(self) -> None:
        forget(self.own, self.terms, self.blocks)


def asked(counts: DataFrame, index: Index) -> Asked:
    """Queries with counts (query, token, tf). A token's share is the most that it can add to a score; a block's bound is the lesser of that by the angle and that by what all other tokens can add."""
    own = weights(counts, "query", index.idf)
    reach = index.blocks.groupBy("token").agg(F.max("high").alias("peak"))
    own = stored(own.join(reach, "token").withColumn("share", F.col("w") * F.col("peak")).select("query", "token", "w", "share"), "search-queries")
    terms = own.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("terms"), F.sum("share").alias("shares"))
    terms = stored(terms, "search-terms")
    bound = F.least(_most(F.col("w"), F.col("low"), F.col("high")), F.col("w") * F.col("high") + F.col("shares") - F.col("share"))
    blocks = own.join(terms.select("query", "shares"), "query").join(index.blocks, "token").select("query", "token", "level", F.col("w").alias("wq"), "size", bound.alias("bound"))
    return Asked(own, terms, stored(blocks, "search-bounds"))


def first_pairs(queries: Asked, index: Index) -> DataFrame:
    """(query, id) of some FIRST_READ postings in the blocks of greatest bound, to find a floor from."""
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "size", "token", "level")
    first = queries.blocks.where(F.col("size") <= FIRST_READ).withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") < FIRST_READ)
    return first.join(index.postings, ["token", "level"]).select("query", "id").distinct()


def reaching(queries: Asked, index: Index, floors: DataFrame) -> DataFrame:
    """(query, id): all texts whose cosine can reach the floor of a query, of floors (query, floor), and share a token with it; few others.

    A query's tokens split: those of least share stay silent, as they make up only a part of the floor together. Of the
    others it reads the blocks whose bound reaches the floor, adds up what its texts share with it there, and drops
    those that cannot reach the floor with all that the silent tokens may add.
    """
    floors = floors.select("query", (F.col("floor") - SLACK).alias("floor"))
    rising = Window.partitionBy("query").orderBy("share", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = queries.own.join(floors, "query").withColumn("shared", F.sum("share").over(rising)).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rising)))
    split = split.withColumn("silent", F.least("shared", "norm") < F.col("floor") * SILENT)
    most = lambda c: F.coalesce(F.max(F.when(F.col("silent"), F.col(c))), F.lit(0.0)).alias(c)
    rest = split.groupBy("query").agg(most("shared"), most("norm"))
    loud = split.where(~F.col("silent")).select("query", "token")
    read = queries.blocks.join(loud, ["query", "token"]).join(floors, "query").where(F.col("bound") >= F.col("floor")).select("query", "token", "level", "wq")
    found = read.join(index.postings, ["token", "level"]).groupBy("query", "id").agg(F.sum(F.col("wq") * F.col("w")).alias("part"), F.sum(F.col("w") * F.col("w")).alias("met"))
    # a text of a block that was not read cannot reach the floor anyway, so that its part may lack;
    # the silent tokens add what they share at most, and no more than what is left of the text's length allows
    more = F.least("shared", F.col("norm") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("met"))))
    return found.join(rest, "query").join(floors, "query").where(F.col("part") + more >= F.col("floor")).select("query", "id")


def best(counts: DataFrame, index: Index, top: int, least: float = 0.0, met: list[int] | None = None) -> DataFrame:
    """(query, id, score): of each query with counts (query, token, tf) all texts that can be among its `top` best by cosine, above 0 and at least `least`.

    First a query reads a few blocks of greatest bound; the score of the top-th best text there is its floor. Only texts
    that can reach the floor are scored whole. Ties with the top-th stay. met: gets the number of pairs that are scored whole.
    """
    queries = asked(counts, index)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    floors = _scored(first_pairs(queries, index), queries.terms, index).withColumn("place", place).where(F.col("place") == top).select("query", F.col("score").alias("floor"))
    floor = F.greatest(F.coalesce("floor", F.lit(least)), F.lit(least))
    floors = stored(queries.terms.select("query").join(floors, "query", "left").select("query", floor.alias("floor")), "search-floors")
    pairs = reaching(queries, index, floors)
    if met is not None:
        met.append(pairs.count())
    out = stored(_scored(pairs, queries.terms, index).where((F.col("score") > 0) & (F.col("score") >= least)), "search-found")
    queries.delete()
    forget(floors)
    return out
