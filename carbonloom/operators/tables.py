"""Operators on extracted tables, token sequences, dimensions and fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonloom.functions import numbers as N
from carbonloom.functions.rules import contains_any


TOTAL_WORDS = ["合计", "价税合计", "小计"]


def column_with(header: Column, words: list[str]) -> Column:
    """Place (from 0) of the first header cell that holds a word, null without one."""
    hits = F.transform(header, lambda h: contains_any(h, words))
    return F.nullif(F.array_position(hits, F.lit(True)).cast("int"), F.lit(0)) - 1


def amount_column(header: Column) -> Column:
    """The column of amounts without tax, else an amount column that does not speak of tax, else that of the total."""
    plain = F.nullif(F.array_position(F.transform(header, lambda h: F.coalesce(h.contains("金额") & ~h.contains("税"), F.lit(False))), F.lit(True)).cast("int"), F.lit(0)) - 1
    return F.coalesce(column_with(header, ["金额（不含税）", "不含税金额", "合计金额"]), plain, column_with(header, ["价税合计"]))


def role_rows(rows: DataFrame) -> DataFrame:
    """rows (invoice_id, row_pos, cells) below their header (row_pos 0) with name, quantity and amount by the header's words."""
    header = rows.where("row_pos = 0").select("invoice_id", column_with(F.col("cells"), ["名称"]).alias("c_name"), column_with(F.col("cells"), ["数量"]).alias("c_qty"), amount_column(F.col("cells")).alias("c_amount"))
    body = rows.where("row_pos > 0").join(header, "invoice_id")
    return body.select("invoice_id", "row_pos", F.get("cells", F.col("c_name")).alias("name"), N.cell_number(F.get("cells", F.col("c_qty"))).alias("quantity"), N.cell_number(F.get("cells", F.col("c_amount"))).alias("amount"))


def declared_totals(rows: DataFrame) -> DataFrame:
    """(invoice_id, total): of the first row with a total word, its amount cell if above 0, else its largest number above 0."""
    header = rows.where("row_pos = 0").select("invoice_id", amount_column(F.col("cells")).alias("c"))
    body = rows.where("row_pos > 0").where(F.exists("cells", lambda c: F.coalesce(c.contains("合计"), F.lit(False)))).join(header, "invoice_id", "left")
    cell = N.cell_number(F.get("cells", F.col("c")))
    largest = F.array_max(F.filter(F.transform("cells", N.cell_number), lambda v: v > 0))
    return body.groupBy("invoice_id").agg(F.min_by(F.coalesce(F.when(cell > 0, cell), largest), "row_pos").alias("total"))


def text_lines(texts: DataFrame) -> DataFrame:
    """(invoice_id, line_no, name, numbers) of texts (invoice_id, text): a line starts with *; other lines continue the one before. Numbers are the tokens that are numbers, names the rest."""
    rows = texts.select("invoice_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.sum(F.col("line").startswith("*").cast("int")).over(Window.partitionBy("invoice_id").orderBy("pos"))
    grouped = rows.withColumn("line_no", number).where("line_no > 0").groupBy("invoice_id", "line_no")
    joined = grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line"))
    tokens = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    is_number = lambda t: t.rlike(r"^-?\d[\d,]*\.?\d*$")
    return joined.select("invoice_id", "line_no", F.array_join(F.filter(tokens, lambda t: ~is_number(t) & ~t.rlike("%$")), " ").alias("name"), F.transform(F.filter(tokens, is_number), N.cell_number).alias("numbers"))


def answer_pairs(tokens: DataFrame) -> DataFrame:
    """(doc_id, question, answer, amount): a question token directly before an answer with an amount in (0, 1e8), totals left out. Documents without any give their star answers with the last number of the text."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    following = tokens.withColumn("next_label", F.lead("label").over(order)).withColumn("next_text", F.lead("text").over(order))
    amount = N.label_number(F.col("next_text"))
    pairs = following.where("label = 'question' AND next_label = 'answer'").withColumn("amount", amount).where("amount > 0 AND amount < 1e8").where(~contains_any(F.col("text"), TOTAL_WORDS))
    pairs = pairs.select("doc_id", F.col("text").alias("question"), F.col("next_text").alias("answer"), "amount")
    stars = tokens.where("label = 'answer' AND contains(text, '*')").where(F.col("text").rlike("[一-鿿]") & ~contains_any(F.col("text"), TOTAL_WORDS)).join(pairs.select("doc_id").distinct(), "doc_id", "left_anti")
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(r"(\d+\.?\d*)"), 1), F.lit(-1)).try_cast("double")
    return pairs.unionByName(stars.select("doc_id", F.lit("").alias("question"), F.col("text").alias("answer"), last.alias("amount")).where("amount > 0"))


#: Ranges that keys are counted in at once; rows of a range that are sorted to cut a page out.
RANGES, FEW = 4096, 50_000


def page(rows: DataFrame, key: str, number: int, size: int, descending: bool = True, ties: tuple[str, ...] = (), read: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Rows of one page (from 1) with total, the number of all rows, in order of the whole number `key`, then of `ties`; null keys are lowest.

    However deep the page, only the rows of its own range of keys are read in the end: keys are counted in at most RANGES
    ranges, and the range in which the page begins again, until it holds FEW rows or one key. The counts (at most RANGES
    numbers at a time) come to the driver, rows never do. If the page runs on beyond its range, the ranges that follow are read too.
    read: gets the bounds of the range that is read, and how many of its rows stand before the page.
    """
    k = F.col(key).cast("long")
    low, high, total, nulls = rows.agg(F.min(k), F.max(k), F.count("*"), F.count_if(k.isNull())).first()
    skip = (number - 1) * size
    order = [(F.desc if descending else F.asc)(key), *ties]
    out = rows.withColumn("total", F.lit(total).cast("long"))
    known = total - nulls
    if skip >= total:
        return out.limit(0)
    # null keys stand at the low end
    if low is None or (skip >= known if descending else skip + size <= nulls):
        return out.where(k.isNull()).orderBy(*ties or [key]).offset(max(0, skip - known) if descending else skip).limit(size)
    if not descending and skip < nulls or descending and skip + size > known:
        return out.orderBy(*order).offset(skip).limit(size)  # the page with the last null key
    before = skip if descending else skip - nulls
    held = known
    while held > FEW and low < high:
        width = (high - low) // RANGES + 1
        at = F.floor((k - F.lit(low)) / width) if width > 1 else k - F.lit(low)
        counts = {r["at"]: r["n"] for r in rows.where(k.between(low, high)).groupBy(at.cast("long").alias("at")).agg(F.count("*").alias("n")).collect()}
        # first the range with the page's first row, then on to that with its last
        passed, begin, end, begun, seen = 0, None, None, 0, 0
        for r in sorted(counts, reverse=descending):
            if passed + counts[r] > before and begin is None:
                begin, begun = r, passed
            passed += counts[r]
            if begin is not None:
                end, seen = r, passed
                if passed >= before + size or passed >= held:
                    break
        first, last = min(begin, end), max(begin, end)
        shrunk = (low + first * width, min(high, low + (last + 1) * width - 1))
        if shrunk == (low, high):
            break
        (low, high), before, held = shrunk, before - begun, seen - begun
    if read is not None:
        read.append((low, high, before))
    return out.where(k.between(low, high)).orderBy(*order).offset(before).limit(size)


def latest(rows: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The newest row of each key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), *[F.desc(t) for t in ties]))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n")


def numbered(rows: DataFrame, name: str, key: str, leading: tuple[str, ...] = (), width: int = 4096) -> DataFrame:
    """rows with `name`: their number from 0 in order of the leading columns, then the whole number `key`; nulls come first.

    Stretches of `width` keys are numbered by themselves; only the counts of the stretches are added up in one place.
    """
    at = ["__at", *[f"__{c}" for c in leading]]
    where = {"__at": F.floor(F.col(key) / width), **{f"__{c}": F.col(c) for c in leading}}
    placed = rows.withColumns(where)
    before = Window.orderBy(*at[1:], "__at").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*at).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"{c}_of") for c in at], "__before")
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*leading, key)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in at]
    out = placed.withColumn("__own", own).join(counts, same)
    return out.select(*rows.columns if name not in rows.columns else [c for c in rows.columns if c != name], (F.col("__before") + F.col("__own")).alias(name))


def apply_changes(products: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """products (id, fields) after changes (version, op, id, fields), as if they were made one after the other by version, a whole number of its own for each.

    Updates set the fields that are not null, so that the last value of each field counts; a delete drops the id, whatever
    updates come before or behind it; inserts get ids above the largest, in order of version. Changes of ids that
    products has not, also of those that the inserts get, do nothing. All changes of an id meet in one aggregate, then the product: an id stays one row.
    """
    last = [F.max_by(f, F.when((F.col("op") == "update") & F.col(f).isNotNull(), F.col("version"))).alias(f"__{f}") for f in fields]
    merged = changes.where("op IN ('update', 'delete')").groupBy("id").agg(F.max(F.col("op") == "delete").alias("__gone"), *last)
    kept = products.join(merged, "id", "left").where(~F.coalesce("__gone", F.lit(False)))
    kept = kept.select("id", *[F.coalesce(f"__{f}", f).alias(f) for f in fields])
    top = products.agg(F.max("id").alias("top"))
    added = numbered(changes.where("op = 'insert'"), "n", "version").join(F.broadcast(top), F.lit(True))
    return kept.unionByName(added.select((F.coalesce("top", F.lit(0)) + F.col("n") + 1).alias("id"), *fields))


def sorted_by_emission(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls count as low."""
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_first(column))
