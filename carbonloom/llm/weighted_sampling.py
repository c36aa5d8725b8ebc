"""Operator 12: document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom.llm.common import table

#: Samples that one row draws; a term makes samples / AT_ONCE rows, so that generated code stays small enough to be compiled.
AT_ONCE = 4
#: Bits of a uniform number; three are cut from one hash.
BITS = 21

WORD_GAP = r"[\x20\x09-\x0D]+"


def _uniform(bits: Column, piece: int) -> Column:
    """In (0, 1), from one third of a hash."""
    return (F.shiftrightunsigned(bits, BITS * piece).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(0.5)) * F.lit(2.0**-BITS)


def _drawn(seed: Column, k: int) -> tuple[Column, Column, Column]:
    """r and ln c, each of a gamma variable of shape 2 (a sum of two exponential ones), and a uniform beta: of a term and a sample alone."""
    one, two = F.xxhash64(F.lit(2 * k), seed), F.xxhash64(F.lit(2 * k + 1), seed)
    return -F.ln(_uniform(one, 0) * _uniform(one, 1)), F.ln(-F.ln(_uniform(two, 0) * _uniform(two, 1))), _uniform(one, 2)


def signatures(rows: DataFrame, key: list[str], texts: list[str], samples: int = 32) -> DataFrame:
    """(key, <text>_signature array<int> for each text column) of rows, in which a key stands once.

    The terms of a text are its words, the weight of a term its count. For each sample k a term draws r and c from
    Gamma(2, 1) and beta from (0, 1), all of (term, k) alone; with t = floor(ln w / r + beta) and ln y = r (t - beta) the
    text takes the term of least ln a = ln c - ln y - r. Two texts take the same term and t with a probability of
    their generalised Jaccard similarity: the sum of smaller weights over the sum of larger ones. As ln a is of (term, t, k) alone, a
    hash of the least ln a stands for that pair. Texts without words (null, empty) hold one fixed value throughout.

    Where rows are dealt by the key already, nothing is shuffled.
    """
    if samples % AT_ONCE:
        raise ValueError(f"samples must be a multiple of {AT_ONCE}")
    texts_of = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(t).alias("t")) for n, t in enumerate(texts)]))
    words = rows.select(*key, texts_of.alias("of")).select(*key, F.col("of.n").alias("n"), F.explode(F.split("of.t", WORD_GAP)).alias("word")).where("word <> ''")
    weights = [F.sum(F.when(F.col("n") == n, F.lit(1)).otherwise(F.lit(0))).alias(f"w{n}") for n in range(len(texts))]
    terms = words.select(*key, "n", F.xxhash64("word").alias("term")).groupBy(*key, "term").agg(*weights)
    terms = terms.select(*key, "term", *[F.ln(F.nullif(f"w{n}", F.lit(0)).cast("double")).alias(f"l{n}") for n in range(len(texts))])
    parts = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(samples // AT_ONCE - 1))))
    parts = parts.select(*key, "part", F.xxhash64("part", "term").alias("seed"), *[f"l{n}" for n in range(len(texts))])
    drawn = {}
    for k in range(AT_ONCE):
        drawn |= dict(zip((f"r{k}", f"c{k}", f"b{k}"), _drawn(F.col("seed"), k), strict=True))
    parts = parts.select(*key, "part", *[f"l{n}" for n in range(len(texts))], *[v.alias(c) for c, v in drawn.items()])

    def least(n: int, k: int) -> Column:
        r, beta = F.col(f"r{k}"), F.col(f"b{k}")
        return F.min(F.col(f"c{k}") - r * (F.floor(F.col(f"l{n}") / r + beta) - beta + F.lit(1.0)))

    per_part = parts.groupBy(*key, "part").agg(*[least(n, k).alias(f"a{n}_{k}") for n in range(len(texts)) for k in range(AT_ONCE)])
    per_part = per_part.select(*key, F.struct("part", *[F.array(*[F.hash(f"a{n}_{k}") for k in range(AT_ONCE)]).alias(f"s{n}") for n in range(len(texts))]).alias("s"))
    whole = per_part.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    none = F.array_repeat(F.hash(F.lit(None).cast("double")), samples)
    found = whole.select(*key, *[F.flatten(f"s.s{n}").alias(f"{t}_signature") for n, t in enumerate(texts)])
    return rows.select(*key).join(found, key, "left").select(*key, *[F.coalesce(f"{t}_signature", none).alias(f"{t}_signature") for t in texts])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures of one length: an estimate of generalised Jaccard similarity, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def in_order(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, copies, n_chars, next_k1, next_k2): the different documents with the keys of the next one, the first after the last.

    The order is that of doc_id (null first), then of the keys. Rows are dealt by ranges of it; the last
    of a range takes the first row of the next range, and only these first rows meet in one place.
    """
    known = docs.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    order = ["doc_id", "k1", "k2"]
    known = table(known.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sampling-order")
    inner = known.withColumn("after", F.lead(F.struct("k1", "k2")).over(Window.partitionBy("range").orderBy(*order)))
    firsts = known.groupBy("range").agg(F.min(F.struct(*order)).alias("least"))
    every = Window.orderBy("range")
    onward = F.coalesce(F.lead("least").over(every), F.first("least").over(every))
    firsts = firsts.select("range", F.struct(onward["k1"].alias("k1"), onward["k2"].alias("k2")).alias("onward"))
    after = F.coalesce("after", "onward")
    return inner.join(firsts, "range").select("k1", "k2", "doc_id", "copies", "n_chars", after["k1"].alias("next_k1"), after["k2"].alias("next_k2"))


def with_edits(spark: SparkSession, docs: DataFrame, samples: int = 32) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next) of docs (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    by doc_id; after the last comes the first. near_edited and near_next are the likeness of a document's signature to
    that of its edited text and of the next document. Null texts are empty. Texts that share a doc_id, or have
    none (they come first), are documents of their own, in the order of their hashes; rows equal in doc_id and
    text are one document, returned as often as it occurs. An empty table gives no rows. Other columns are not read.

    Each different document goes through the joins once, keyed by two hashes of doc_id and text. Texts are
    dealt by that key once; to its predecessor a document sends only the characters that take part. Signatures
    need no further shuffle.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({k: F.xxhash64(F.lit(n), F.col("doc_id").isNull(), "doc_id", "text") for n, k in enumerate(("k1", "k2"))})
    order = table(in_order(keyed.withColumn("n_chars", F.char_length("text").cast("long"))), "sampling-next")
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = order.select(F.col("k1").alias("to_k1"), F.col("k2").alias("to_k2"), half.alias("half"), F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"))
    sent = asked.join(texts, ["k1", "k2"]).select(F.col("to_k1").alias("k1"), F.col("to_k2").alias("k2"), "half", F.substring("text", F.lit(1), F.col("half")).alias("new"))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("half")), F.col("new"))
    both = texts.join(sent, ["k1", "k2"]).select("k1", "k2", "text", edited.alias("edited"))
    found = table(signatures(both, ["k1", "k2"], ["text", "edited"], samples), "sampling-signatures")
    digests = both.select("k1", "k2", F.sha2("edited", 256).alias("edited_sha256"))
    following = found.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("text_signature").alias("next_signature"))
    out = order.join(digests, ["k1", "k2"]).join(found, ["k1", "k2"]).join(following, ["next_k1", "next_k2"])
    near = {"near_edited": likeness(F.col("text_signature"), F.col("edited_signature")), "near_next": likeness(F.col("text_signature"), F.col("next_signature"))}
    out = out.withColumns(near).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text_signature").alias("signature"), "edited_signature", *near)
