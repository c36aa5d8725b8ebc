"""Matching of free text: catalogue search by TF-IDF, edit distance to standard names, nearest centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom import dims
from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.operators import search
from carbonloom.sources.shared import stored


def characters(text: Column) -> Column:
    """Word characters in lower case, each a token."""
    return F.filter(F.split(F.lower(text), ""), lambda c: c.rlike(r"[\w一-鿿]"))


def vectors(docs: DataFrame, key: str, text: str, tokens=characters) -> DataFrame:
    """(key, token, tf): token counts. tokens: a function of the text column, or a table (text, words) of different texts, as keywords.segmented() gives it."""
    if isinstance(tokens, DataFrame):
        rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(tokens, "text")
        return rows.select(F.col("__key").alias(key), F.explode("words").alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("tf"))
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("tf"))


def grams(text: Column, most: int = 3) -> Column:
    """The distinct substrings of 1 to `most` characters."""
    n = F.char_length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, most + 1)]))


def contained_in(words: DataFrame, word: Column, texts: DataFrame, text: Column, most: int = 3) -> DataFrame:
    """Rows of words and texts where text contains word, without comparing all: a word's first characters meet the substrings of the texts. Empty words meet nothing."""
    own = words.withColumn("__word", word).withColumn("__gram", F.substring("__word", 1, most)).where("__word <> ''")
    indexed = texts.withColumn("__text", text).withColumn("__gram", F.explode(grams(F.col("__text"), most)))
    return own.join(indexed, "__gram").where(F.contains("__text", "__word")).drop("__gram", "__word", "__text")


def tfidf_top(queries: DataFrame, query: str, catalogue: DataFrame, key: str, text: str, top: int = 5, least: float = 0.0, tokens=characters, met: list[int] | None = None) -> DataFrame:
    """(query, key, score, rank): the catalogue rows of highest cosine for each query, above 0 and at least `least`.

    idf is ln((1 + n) / (1 + df)) + 1 over the catalogue; queries use the catalogue's idf and their other
    tokens count for nothing. Ties go to the higher key. Each different text of the catalogue is searched once, and stands
    for its best `top` keys. A query reads only blocks of postings whose bound reaches the floor of its
    best texts (search.best), and scores only texts that can get over it; `met` gets their number.
    """
    place = F.row_number().over(Window.partitionBy(text).orderBy(F.desc(key)))
    rows = catalogue.where(F.col(text).isNotNull()).select(key, text)
    texts = stored(rows.groupBy(text).agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "search-texts")
    counts = vectors(texts, "id", text, tokens)
    index = search.built(counts, texts.select("id", "n").unionByName(catalogue.where(F.col(text).isNull()).groupBy().agg(F.lit(-1).cast("long").alias("id"), F.count("*").alias("n"))))
    asked = vectors(queries.select(F.col(query).alias("query")).distinct(), "query", "query", tokens)
    scores = search.best(asked, index, top, least, met).join(texts.select("id", text), "id")
    index.delete()
    best = rows.withColumn("__place", place).where(F.col("__place") <= top).select(text, key)
    order = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), F.desc(by)))
    near = scores.join(best.groupBy(text).agg(F.max(key).alias("__first")), text)
    near = near.withColumn("rank", order("__first")).where(F.col("rank") <= top).drop("rank", "__first")
    found = near.join(best, text).withColumn("rank", order(key)).where(F.col("rank") <= top).select("query", key, "score", "rank")
    return found.withColumnRenamed("query", query)


def candidates() -> list[tuple[int, str, str]]:
    """(pos, alias, standard): standard names and their aliases, in order."""
    rows = [(a, s) for s, aliases in dims.STANDARD_CATEGORIES.items() for a in (s, *aliases)]
    return [(k, a, s) for k, (a, s) in enumerate(rows)]


def similar_pairs(words: DataFrame, word: str, candidates: DataFrame, alias: str, least: float) -> DataFrame:
    """(word, alias, similarity) of different words and candidates whose edit distance over the greater length leaves at least `least`, above 0.5 or so.

    A candidate of length l is cut into d + 1 segments, where d is the number of edits that `least` allows; a word within d
    edits holds one of them whole, at most d places off. Segments and pieces of words meet in an equi join, by lengths
    and the number of the segment; the distance is taken of those pairs only. Both tables may have any size.
    """
    edits = lambda a, b: F.floor(F.greatest(a, b) * (1.0 - least) + 1e-9).cast("int")
    ends = lambda size, parts, k: F.floor(size * k / parts).cast("int")
    own = words.select(F.trim(word).alias("word")).where("word <> ''").distinct().withColumn("m", F.char_length("word"))
    known = candidates.select(F.col(alias).alias("alias")).where("alias <> ''").distinct().withColumn("l", F.char_length("alias"))
    # lengths of the other side that can be near enough
    own = own.select("word", "m", F.explode(F.sequence(F.ceil(F.col("m") * least - 1e-9).cast("int"), F.floor(F.col("m") / least + 1e-9).cast("int"))).alias("l"))
    own = own.withColumn("d", edits(F.col("l"), F.col("m"))).where("abs(l - m) <= d AND l > 0")
    wide = known.withColumn("d", F.explode(F.sequence(edits(F.col("l"), F.lit(0)), edits(F.col("l") / least, F.lit(0)))))
    segment = wide.select("alias", "l", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    begin, end = ends(F.col("l"), F.col("d") + 1, F.col("k")), ends(F.col("l"), F.col("d") + 1, F.col("k") + 1)
    segment = segment.select("alias", "l", "d", "k", F.substring("alias", begin + 1, end - begin).alias("piece"))
    place = own.select("word", "m", "l", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k")).withColumns({"begin": begin, "size": end - begin})
    low, high = F.greatest(F.lit(0), F.col("begin") - F.col("d")), F.least(F.col("m") - F.col("size"), F.col("begin") + F.col("d"))
    place = place.withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    place = place.select("word", "l", "d", "k", F.substring("word", F.col("at") + 1, F.col("size")).alias("piece"))
    met = place.join(segment, ["l", "d", "k", "piece"]).select("word", "alias").distinct()
    return met.withColumn("similarity", X.similarity(F.col("word"), F.col("alias"))).where(F.col("similarity") >= least)


def candidate_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(candidates(), "pos int, alias string, standard string")


def fuzzy(words: DataFrame, word: str, least: float = 0.8, names: DataFrame | None = None) -> DataFrame:
    """Distinct words with matched (standard name) and similarity: the candidate of least edit distance over length, the earliest of equals; null below `least`.

    names: (pos, alias, standard), a table of any size; without it the standard names and their aliases.
    """
    names = candidate_rows(words.sparkSession) if names is None else names
    own = words.select(word).where(F.trim(word) != "").distinct()
    near = similar_pairs(own, word, names, "alias", least).withColumnRenamed("word", "__word").join(names, "alias")
    best = near.groupBy("__word").agg(F.max_by(F.struct("standard", "similarity"), F.struct("similarity", -F.col("pos"))).alias("b"))
    return own.join(best, F.trim(word) == F.col("__word"), "left").select(word, F.col("b.standard").alias("matched"), F.col("b.similarity").alias("similarity"))


def category_of_words(matched: DataFrame, key: str, order: str) -> DataFrame:
    """(key, category, similarity): of a line's matched words the one of highest similarity, the first of equals. matched: (key, order, matched, similarity)."""
    table = [(s, c) for s, c in dims.STANDARD_TO_CATEGORY.items()]
    dim = matched.sparkSession.createDataFrame(table, "matched string, category int")
    hits = matched.join(F.broadcast(dim), "matched")
    return hits.groupBy(key).agg(F.max_by(F.struct("category", "similarity"), F.struct("similarity", -F.col(order))).alias("b")).select(key, "b.category", "b.similarity")


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean of each component over the rows of a label."""
    parts = rows.select(label, F.posexplode(vector)).groupBy(label, "pos").agg(F.avg("col").alias("mean"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("centroid"))


#: Bytes of centroids that go to every task as one array.
CLASS_BYTES = 8 << 20


def nearest_centroid(rows: DataFrame, vector: str, means: DataFrame, label: str) -> DataFrame:
    """rows with nearest label and confidence: cosine to each centroid, cut to 0..1; ties go to the lower label.

    Up to CLASS_BYTES of centroids come to each row as one array: no shuffle. More are dealt into blocks of that size
    by their label; each row meets each block, and the best of its blocks counts. Repeated rows stay.
    """
    size = means.agg(F.coalesce(F.sum(8 * F.size("centroid")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // CLASS_BYTES))
    packed = F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("__classes")
    by_class = F.transform("__classes", lambda c: F.struct(F.round(N.cosine(F.col(vector), c["centroid"]), 12).alias("sim"), (-c["label"]).alias("neg")))
    if blocks == 1:
        best = rows.join(F.broadcast(means.agg(packed)), F.lit(True)).withColumn("__best", F.array_max(by_class))
    else:
        placed = stored(rows.withColumn("__id", F.monotonically_increasing_id()), "centroid-rows")
        classes = means.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("__block")).agg(packed)
        met = placed.select("__id", vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")).join(classes, "__block")
        best = placed.join(met.select("__id", F.array_max(by_class).alias("__best")).groupBy("__id").agg(F.max("__best").alias("__best")), "__id", "left")
    return best.select(*rows.columns, (-F.col("__best.neg")).alias("nearest"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__best.sim"))).alias("confidence"))


def hybrid_category(code: Column, nearest: Column, confidence: Column, word_category: Column, word_similarity: Column, least: float = 0.7) -> Column:
    """struct(category, source, confidence): tax code, then a sure centroid, then matched words, then the centroid."""
    by_code = X.category_of_code(code)
    make = lambda c, s, p: F.struct(c.cast("int").alias("category"), F.lit(s).alias("source"), p.alias("confidence"))
    return F.when(by_code.isNotNull(), make(by_code, "tax_code", F.lit(0.95))).when(confidence >= least, make(nearest, "bert", confidence)).when(word_category.isNotNull(), make(word_category, "keyword", word_similarity)).otherwise(make(nearest, "bert", confidence))
