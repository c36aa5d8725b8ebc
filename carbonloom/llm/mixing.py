"""Operator 8: mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom.llm.common import WORD, discard, table, without
from carbonloom.sources.shared import shared_folder

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """sources (source, size) with target: budget times all sizes shared by weight, none above `most` times its size.

    Sources take the weights in turn by code point, null last. The excess of capped sources goes to the
    others by weight until none is above its cap: with the sources ordered by cap over weight, the first
    k are capped, where k is the least number that leaves the next one under its cap.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ahead = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(budget) * F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    share = rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    s = s.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "share"))).over(whole)["share"]
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "size", "target")


def tilts(sources: DataFrame, stats: DataFrame, rounds: int = 60, close: float = 1e-13) -> DataFrame:
    """(source, tilt): the dual solution, so that the sum of size * exp(tilt) over a source is its target.

    Entropy balancing makes the rates r of documents as even as the token constraints allow (least
    sum of size * (r log r - r)). Its dual is convex with one multiplier for each constraint; a Newton step is
    tilt - (sum of size * exp(tilt) - target) / (sum of size * exp(tilt)), at most 1 either way. Gradient and
    curvature are sums over `stats` (source, size, docs), the document sizes with their counts. Sources
    without words or target get tilt null. Steps that do not become small within `rounds` are an error.
    """
    shared_folder(sources.sparkSession)
    state = sources.where("size > 0 and target > 0").select("source", "target", F.lit(0.0).alias("tilt"))
    for _ in range(rounds):
        mass = F.sum(F.col("docs") * F.col("size") * F.exp("tilt"))
        found = stats.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(mass.alias("mass"), F.first("target").alias("target"), F.first("tilt").alias("tilt"))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("mass") - F.col("target")) / F.col("mass")))
        state = found.select(F.col("of").alias("source"), "target", (F.col("tilt") - step).alias("tilt"), step.alias("step")).checkpoint()
        off = state.agg(F.max(F.abs("step"))).first()[0]
        state = state.drop("step")
        if off is None or off < close:
            return state.select("source", "tilt")
    raise RuntimeError(f"the dual has not converged in {rounds} rounds: the last step was {off}")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_rate and mix_copies; docs needs doc_id, source and text.
    The columns `carry` come along and set the order of rows with one doc_id.

    A document's rate is exp(tilt of its source). Rates become copies: all get the whole part; the
    fractions are rounded in the order of size class, then a digest of doc_id and text, so that the running sum of copies
    follows that of the rates and taken words come near the target. Null text has size 0; a null source is
    a source of its own, last in order. Documents without words get rate 0 and no copies. Rows that repeat a
    doc_id, or have none, are documents of their own; rows that agree in doc_id and text are in no set order.
    An empty table gives an empty table.
    """
    docs = without(docs, "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "mix_hash", "mix_slice", "mix_class", "mix_part")
    e = F.length(F.bin("mix_size"))
    # the binary exponent and the next four bits: 16 classes in each doubling
    size_class = F.when(e <= 5, F.col("mix_size")).otherwise(e * 32 + F.expr("shiftright(mix_size, greatest(length(bin(mix_size)) - 5, 0))"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    narrow = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("mix_size"), digest.alias("mix_hash"))
    narrow = narrow.withColumn("mix_class", size_class).withColumn("mix_slice", F.substring("mix_hash", 1, 2))
    narrow = table(narrow, "mix-sizes")
    stats = table(narrow.groupBy("source", "mix_size").agg(F.count("*").alias("docs")).withColumnRenamed("mix_size", "size"), "mix-stats")
    sources = table(targets(stats.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("size")), weights, budget, most), "mix-sources")
    by_source = sources.join(tilts(sources, stats).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.coalesce(F.round(F.least(F.exp("tilt"), F.lit(most)), 9), F.lit(0.0)).alias("mix_rate"))

    # where each slice begins in its source's order, from counts of slices
    worded = narrow.where("mix_size > 0")
    slices = worded.groupBy("source", "mix_class", "mix_slice").agg(F.count("*").alias("docs"))
    order = Window.partitionBy("source").orderBy("mix_class", "mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0)))
    slices = slices.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select(F.col("of").alias("s"), F.col("mix_class").alias("c"), F.col("mix_slice").alias("p"), "before", "mix_source_size", "mix_target", "mix_rate")
    slices = table(slices, "mix-slices")
    discard(stats)
    rank = F.row_number().over(Window.partitionBy("source", "mix_class", "mix_slice").orderBy("mix_hash", "doc_id", *carry))
    ranked = worded.withColumn("rank", rank).join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_class") == F.col("c")) & (F.col("mix_slice") == F.col("p")))
    i = F.col("before") + F.col("rank")
    steps = F.floor(i * F.col("mix_rate") + 0.5) - F.floor((i - 1) * F.col("mix_rate") + 0.5)
    columns = ["doc_id", "source", *carry, "mix_size", "mix_source_size", "mix_target"]
    ranked = ranked.select(*columns, "mix_rate", steps.cast("int").alias("mix_copies"))
    # documents without words hold no place
    empty = narrow.where("mix_size = 0").join(by_source.drop("mix_rate"), F.col("source").eqNullSafe(F.col("of")))
    return ranked.unionByName(empty.select(*columns, F.lit(0.0).alias("mix_rate"), F.lit(0).alias("mix_copies")))
