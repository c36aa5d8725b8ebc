"""Invoices from JSON, XML, OCR, expense systems and zipped documents, as rows with an array of lines."""

from __future__ import annotations

import io
import lzma
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from carbonloom.functions import numbers as N
from carbonloom.functions import text as X
from carbonloom.functions.rules import let

# Spellings of each field, the first that is filled counts.
HEADER = {
    "invoice_number": ["invoiceNumber", "invoice_number", "fpdm", "发票号码"],
    "invoice_date": ["invoiceDate", "invoice_date", "kprq", "开票日期"],
    "seller_name": ["sellerName", "seller_name", "xfmc", "销方名称"],
    "seller_tax_id": ["sellerTaxId", "seller_tax_id", "xfsbh", "销方税号"],
    "buyer_name": ["buyerName", "buyer_name", "gfmc", "购方名称"],
    "buyer_tax_id": ["buyerTaxId", "buyer_tax_id", "gfsbh", "购方税号"],
    "declared_total": ["totalAmount", "total_amount", "hjje", "价税合计", "合计金额"],
}
LINE = {
    "name": ["name", "goodsName", "hwmc", "spmc", "项目名称", "货物或应税劳务名称"],
    "tax_code": ["taxCode", "tax_code", "spbm", "ssflbm", "税收分类编码"],
    "amount": ["amount", "je", "金额"],
    "quantity": ["quantity", "sl", "数量"],
    "unit": ["unit", "dw", "单位"],
    "price": ["price", "dj", "单价"],
}
LISTS = ["items", "lines", "details", "FPDetail", "fpDetail"]
XML_LINE = {
    "name": ["name", "Name", "hwmc", "HWMC", "goodsName", "spmc", "SPMC", "项目名称", "XMMC", "xmmc"],
    "tax_code": ["taxCode", "TaxCode", "spbm", "SPBM", "ssbm", "ssflbm", "税收分类编码"],
    "amount": ["amount", "Amount", "je", "JE", "金额", "XMJE", "xmje"],
    "quantity": ["quantity", "Quantity", "sl", "SL", "数量", "XMSL", "xmsl"],
    "unit": ["unit", "Unit", "dw", "DW", "单位"],
    "price": ["price", "Price", "dj", "DJ", "单价", "XMDJ", "xmdj"],
}
XML_LISTS = ["FPDetail", "FPMX", "fpDetail", "fpmx", "Detail", "Items", "items", "Goods", "goods", "COMMON_FPKJ_XMXXS"]
XML_ROWS = ["Item", "Row", "COMMON_FPKJ_XMXX"]


def first_filled(get, names: list[str]) -> Column:
    """The first field that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(get(n)), F.lit("")) for n in names], F.lit(None).cast("string"))


def _layers(*groups: list[str]) -> list[set[str]]:
    """Sets of names in which no two differ by case alone: a schema can hold one such set."""
    out: list[set[str]] = []
    for name in dict.fromkeys(n for g in groups for n in g):
        layer = next((x for x in out if name.lower() not in {y.lower() for y in x}), None)
        if layer is None:
            out.append(layer := set())
        layer.add(name)
    return out


def _within(fields: dict[str, list[str]], layer: set[str]) -> dict[str, list[str]]:
    return {f: [n for n in names if n in layer] for f, names in fields.items()}


def _schema(fields: dict[str, list[str]]) -> str:
    return ", ".join(f"`{n}` string" for names in fields.values() for n in names)


def _holding(raw: Column, names: list[str], *more: str) -> Column:
    """raw where it holds one of some names (or patterns) at all, else null: a schema of these names alone would find nothing in it."""
    return F.when(raw.rlike("|".join([*more, *(re.escape(n) for n in names)])), raw)


def harvested_codes(raw: Column) -> Column:
    """All 19-digit strings of a JSON text, in order: the k-th is the default code of the k-th line."""
    return F.regexp_extract_all(raw, F.lit(r'"\s*(\d{19})\s*"'), 1)


def _lines(rows: Column, fields: dict[str, list[str]], codes: Column) -> Column:
    def line(row: Column, k: Column) -> Column:
        get = {f: first_filled(lambda n: row[n], names) for f, names in fields.items()}
        number = lambda f: F.coalesce(N.safe_float(get[f]), F.lit(0.0))
        return F.struct(get["name"].alias("name"), F.coalesce(get["tax_code"], F.get(codes, k)).alias("tax_code"), number("amount").alias("amount"), N.safe_float(get["quantity"]).alias("quantity"), get["unit"].alias("unit"), number("price").alias("price"))

    return F.transform(rows, line)


def amount_of(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["amount"])


def _declared(total: Column) -> Column:
    """A declared total, null where it is no number or 0."""
    return F.nullif(N.safe_float(total), F.lit(0.0))


def _with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", F.coalesce(_declared(F.col("declared_total")), amount_of(F.col("lines")))).drop("declared_total")


def from_json(texts: DataFrame, raw: str = "raw") -> DataFrame:
    """One invoice for each JSON text of texts: any spelling of the header and line fields; texts that are not JSON give an invoice without lines."""
    rows = "array<struct<" + ", ".join(f"`{n}`: string" for ns in LINE.values() for n in ns) + ">>"
    layers = _layers(*HEADER.values(), LISTS)
    schema = lambda x: ", ".join([_schema(_within(HEADER, x)), *[f"`{n}` {rows}" for n in LISTS if n in x]]).strip(", ")
    parsed = texts.withColumn("__codes", harvested_codes(F.col(raw))).withColumns({f"__j{k}": F.from_json(_holding(F.col(raw), sorted(x), r"\\") if k else F.col(raw), schema(x)) for k, x in enumerate(layers)})  # a backslash may spell a name
    field = lambda n: next(F.col(f"__j{k}")[n] for k, x in enumerate(layers) if n in x)
    items = F.coalesce(*[F.when(F.size(field(n)) > 0, field(n)) for n in LISTS], F.array().cast(rows))
    out = parsed.select(*texts.columns, *[first_filled(field, names).alias(f) for f, names in HEADER.items()], _lines(items, LINE, F.col("__codes")).alias("lines"))
    return _with_total(out)


def xml_codes(raw: Column) -> Column:
    """All 19-digit values of an XML text, in order."""
    return F.regexp_extract_all(raw, F.lit(r">\s*(\d{19})\s*<"), 1)


def from_xml(texts: DataFrame, raw: str = "raw", codes: str | None = None, total: bool = True) -> DataFrame:
    """One invoice for each XML text: lines under any of the usual list elements. Codes that are not 19 digits are dropped; XML that cannot be read gives no lines.

    codes: a column with the codes of lines that have none, instead of those in the text. Without `total` the
    declared total stays as it is, in place of total_amount.
    """
    header = {f: list(dict.fromkeys(names + [n.upper() for n in names if n.isascii()])) for f, names in HEADER.items()}
    layers = _layers(*header.values(), *XML_LINE.values(), XML_LISTS, XML_ROWS)
    if texts.sparkSession.conf.get("spark.sql.caseSensitive") == "false":
        layers = layers[:1]  # names are found whatever their case: the first set has all of them
    parsed, lines, heads = texts.withColumn("__codes", F.col(codes) if codes else xml_codes(F.col(raw))), [], {f: [] for f in header}
    # list elements of each set meet the line fields of each set
    for k, outer in enumerate(layers):
        for j, inner in enumerate(layers):
            fields, lists, kinds = _within(XML_LINE, inner), [n for n in XML_LISTS if n in outer], [n for n in XML_ROWS if n in layers[0]]
            if not lists or not any(fields.values()):
                continue
            rows = "array<struct<" + ", ".join(f"`{n}`: string" for ns in fields.values() for n in ns) + ">>"
            schema = ", ".join([_schema(_within(header, outer)), *[f"`{n}` struct<" + ", ".join(f"`{r}`: {rows}" for r in kinds) + ">" for n in lists]])
            # what the first set finds is found already: another one can only add what its own names bring
            own = F.col(raw)
            if k:
                own = _holding(own, [*lists, *(n for names in _within(header, outer).values() for n in names)])
            if j:
                own = _holding(own, [n for names in fields.values() for n in names])
            x = f"__x{k}{j}"
            parsed = parsed.withColumn(x, F.from_xml(own, schema, {"mode": "PERMISSIVE"}))
            found = F.coalesce(*[F.when(F.size(F.col(x)[n][r]) > 0, F.col(x)[n][r]) for n in lists for r in kinds])
            lines.append(_lines(found, fields, F.col("__codes")))
            for f, names in _within(header, outer).items():
                heads[f] += [F.col(x)[n] for n in names]
    named = lambda a: F.exists(a, lambda v: v["name"].isNotNull() | (v["amount"] != 0))
    best = F.coalesce(*[F.when(named(a), a) for a in lines], *lines) if len(lines) > 1 else lines[0]
    best = F.transform(best, lambda v: v.withField("tax_code", let(F.regexp_replace(v["tax_code"], r"\D", ""), lambda c: F.when(F.char_length(c) == 19, c))))
    picked = [F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(None).cast("string")).alias(f) for f, cs in heads.items()]
    out = parsed.select(*texts.columns, *picked, best.alias("lines"))
    return _with_total(out) if total else out


def from_api(texts: DataFrame, raw: str = "raw") -> DataFrame:
    """Request bodies of the ledger path: `lines` wins over `items` even if it is empty; a party that is a plain value is its name; an item that is a plain value is a name with amount 0; names are cleaned."""
    j = F.from_json(F.col(raw), "invoice_code string, invoice_number string, date string, total_amount string, seller string, buyer string, lines array<string>, items array<string>")
    party = lambda c: F.coalesce(F.get_json_object(c, "$.name"), F.when(~F.coalesce(c.startswith("{"), F.lit(False)), c))
    get = lambda x, f: F.get_json_object(x, f"$.{f}")

    def line(x: Column) -> Column:
        name = F.when(x.startswith("{"), get(x, "name")).otherwise(x)
        return F.struct(X.clean_name(name).alias("name"), get(x, "tax_classification_code").alias("tax_code"), get(x, "tax_classification_name").alias("tax_name"), N.safe_float(get(x, "quantity")).alias("quantity"), get(x, "unit").alias("unit"), F.coalesce(N.safe_float(get(x, "amount")), F.lit(0.0)).alias("amount"), get(x, "remark").alias("remark"))

    out = texts.withColumn("__j", j)
    rows = F.coalesce("__j.lines", "__j.items", F.array().cast("array<string>"))
    return out.select(*texts.columns, "__j.invoice_code", "__j.invoice_number", F.col("__j.date").alias("invoice_date"), F.coalesce(N.safe_float(F.col("__j.total_amount")), F.lit(0.0)).alias("total_amount"), party(F.col("__j.seller")).alias("seller_name"), party(F.col("__j.buyer")).alias("buyer_name"), F.transform(rows, line).alias("lines"))


def from_ocr(texts: DataFrame, raw: str = "raw") -> DataFrame:
    """Results of an OCR service: renamed fields, Chinese dates, amounts in CNY; tax rate and tax are dropped."""
    item = "struct<item_name: string, item_number: string, item_unit: string, item_price: string, item_amount: string>"
    j = F.from_json(F.col(raw), f"invoice_code string, invoice_number string, issue_date string, tax_exclusive_total_amount string, seller_name string, seller_code string, buyer_name string, buyer_code string, items array<{item}>")
    line = lambda x: F.struct(x["item_name"].alias("name"), N.safe_float(x["item_number"]).alias("quantity"), x["item_unit"].alias("unit"), N.safe_float(x["item_price"]).alias("price"), N.amount_cny(x["item_amount"]).alias("amount"))
    out = texts.withColumn("__j", j)
    return out.select(*texts.columns, "__j.invoice_code", "__j.invoice_number", N.cn_date(F.col("__j.issue_date")).alias("invoice_date"), N.amount_cny(F.col("__j.tax_exclusive_total_amount")).alias("total_amount"), "__j.seller_name", "__j.buyer_name", F.transform("__j.items", line).alias("lines"))


def from_erp(texts: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(invoices, rejects) of expense envelopes: page_info[0], at the top or in data; lines of invoice_detail.Items, else of items. Rejects carry reject_reason."""
    detail = "struct<Items: array<struct<Name: string, Amount: string, Quantity: string, Unit: string, Price: string>>, No: string, Date: string, SummaryAmount: string, Saler: struct<Name: string>, Buyer: struct<Name: string>>"
    expense = "array<struct<material_name: string, comments: string, Name: string, receipt_amount: string, original_amount: string, quantity: string, net_price: string>>"
    page = f"array<struct<receipt_date: string, invoice_num: string, receipt_amount: string, original_amount: string, shop_name: string, saler_name: string, invoice_input: struct<Date: string, No: string>, invoice_detail: {detail}, items: {expense}>>"
    j = F.from_json(F.col(raw), f"page_info {page}, data struct<page_info: {page}>")
    staged = texts.withColumn("__j", j).withColumn("__p", F.get(F.when(F.size("__j.page_info") > 0, F.col("__j.page_info")).otherwise(F.col("__j.data.page_info")), 0))
    zero = lambda c: F.coalesce(N.safe_float(c), F.lit(0.0))
    make = lambda n, a, q, u, p: F.struct(F.trim(F.coalesce(n, F.lit(""))).alias("name"), zero(a).alias("amount"), N.safe_float(q).alias("quantity"), F.nullif(F.trim(u), F.lit("")).alias("unit"), N.safe_float(p).alias("price"))
    first = F.transform("__p.invoice_detail.Items", lambda x: make(x["Name"], x["Amount"], x["Quantity"], x["Unit"], x["Price"]))
    second = F.transform("__p.items", lambda x: make(F.coalesce(F.nullif(x["material_name"], F.lit("")), F.nullif(x["comments"], F.lit("")), x["Name"]), F.coalesce(x["receipt_amount"], x["original_amount"]), x["quantity"], F.lit(None).cast("string"), x["net_price"]))
    staged = staged.withColumn("lines", F.when(F.size(first) > 0, first).when(F.size(second) > 0, second))
    p = lambda c: F.nullif(F.trim(F.col(f"__p.{c}")), F.lit(""))
    date = F.coalesce(N.epoch_date(p("receipt_date").try_cast("bigint")), F.regexp_extract(p("invoice_detail.Date"), r"^(\d{4}-\d{2}-\d{2})", 1), N.compact_date(p("invoice_input.Date")))
    total = F.coalesce(*[F.nullif(N.safe_float(p(c)), F.lit(0.0)) for c in ("receipt_amount", "original_amount", "invoice_detail.SummaryAmount")], F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["amount"]))
    number, seller = F.coalesce(p("invoice_num"), p("invoice_detail.No"), p("invoice_input.No")), F.coalesce(p("shop_name"), p("saler_name"), p("invoice_detail.Saler.Name"))
    good = staged.where(F.col("lines").isNotNull()).select(*texts.columns, number.alias("invoice_number"), date.alias("invoice_date"), total.alias("total_amount"), seller.alias("seller_name"), p("invoice_detail.Buyer.Name").alias("buyer_name"), "lines")
    reason = F.when(F.col("__p").isNull(), "page_info").otherwise("lines")
    return good, staged.where(F.col("lines").isNull()).select(*texts.columns, reason.alias("reject_reason"))


#: Bytes of XML that are handed on at once, and for how many of them the rest of a row counts.
MEMBER_BYTES, ROW_BYTES = 4 << 20, 200


def _members(path: str, data: bytes | None) -> Iterator[tuple]:
    try:
        package = zipfile.ZipFile(io.BytesIO(data or b""))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield path, -1, None, None, f"no zip: {e}"
        return
    names = [n for n in package.namelist() if n.lower().endswith(".xml") and "__MACOSX" not in n]
    if not names:
        yield path, -1, None, None, "no XML member"
    for at, name in enumerate(names):
        try:
            yield path, at, name, package.read(name).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, RuntimeError, NotImplementedError) as e:
            yield path, at, name, None, f"{type(e).__name__}: {e}"


def member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of xml_members() of batches (path, content), some MEMBER_BYTES at once."""
    rows: list[tuple] = []
    size = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c == 1 else pa.string()) for c in range(5)], ["path", "at", "member", "raw", "reject"])
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
            for row in _members(path.as_py(), data.as_py()):
                rows.append(row)
                size += len(row[3] or "") + ROW_BYTES
            if size > MEMBER_BYTES:
                yield out()
                rows.clear()
                size = 0
    if rows:
        yield out()


def xml_members(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, at, member, raw, reject): the XML members of zipped documents (path, content), in their order.

    What cannot be read is a row with the reason in `reject` and no raw: a file that is no zip or has no XML member (at -1), a
    member that is corrupt, locked or packed in an unknown way. Members of __MACOSX are no documents.
    """
    return files.select("path", F.col(content).alias("content")).mapInArrow(member_batches, "path string, at int, member string, raw string, reject string")


def from_packages(files: DataFrame, content: str = "content") -> DataFrame:
    """One invoice for each zipped document (path, content), with path, and the numbers of its XML members and of those that could not be read.

    Members are read in order. Of each header field the first filled one counts, of lines the first member that has any. A line
    without a code takes that of its place among all codes up to its member; without lines, the first code makes a
    line. The last declared total counts, with the lines' amounts on top if they come behind it; without one, their sum. Files
    that are no zip, or hold no readable member, are invoices without lines: xml_members() names the reasons.
    """
    members = xml_members(files, content)
    so_far = Window.partitionBy("path").orderBy("at")
    members = members.withColumn("codes", F.flatten(F.collect_list(F.coalesce(xml_codes(F.col("raw")), F.array().cast("array<string>"))).over(so_far)))
    parsed = from_xml(members, "raw", "codes", total=False).withColumn("declared", _declared(F.col("declared_total")))
    full = F.coalesce(F.size("lines"), F.lit(0)) > 0
    fields = [f for f in HEADER if f != "declared_total"]
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields]
    lines = [F.min_by("lines", F.when(full, F.col("at"))).alias("lines"), F.min(F.when(full, F.col("at"))).alias("lines_at")]
    total = [F.max_by("declared", F.when(F.col("declared").isNotNull(), F.col("at"))).alias("declared"), F.max(F.when(F.col("declared").isNotNull(), F.col("at"))).alias("declared_at")]
    counts = [F.count_if(F.col("at") >= 0).cast("int").alias("members"), F.count_if(F.col("reject").isNotNull()).cast("int").alias("rejected")]
    whole = parsed.groupBy("path").agg(*first, *lines, *total, F.max_by("codes", "at").alias("codes"), *counts)
    kind = parsed.schema["lines"].dataType.simpleString()
    alone = F.array(F.struct(F.lit("").alias("name"), F.get("codes", F.lit(0)).alias("tax_code"), F.lit(0.0).alias("amount"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(0.0).alias("price"))).cast(kind)
    found = F.coalesce("lines", F.when(F.size("codes") > 0, alone), F.array().cast(kind))
    amount = F.coalesce(amount_of(F.col("lines")), F.lit(0.0))
    sum_ = F.when(F.col("declared").isNull(), amount).when(F.col("lines_at") > F.col("declared_at"), F.col("declared") + amount).otherwise(F.col("declared"))
    return whole.select("path", *fields, found.alias("lines"), sum_.alias("total_amount"), "members", "rejected")


def json_records(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """(path, raw, reject) of files with one JSON object to a line, from spark.read or spark.readStream: large files are read in parts. Blank lines are no records; a line that is no JSON object has the reason in `reject`."""
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("raw")).where("raw <> ''")
    good = F.col("raw").startswith("{") & F.from_json("raw", "map<string,string>").isNotNull()
    return rows.withColumn("reject", F.when(~good, F.lit("no JSON object")))


def xml_records(reader: DataFrameReader | DataStreamReader, path: str, tag: str = "Invoice") -> DataFrame:
    """(path, raw, reject) of files with many elements `tag`, none within another, from spark.read or spark.readStream: large files are read in parts, cut behind each end tag.

    An element without its end, one that is not well-formed and text that belongs to no element have the reason in `reject`.
    """
    end = f"</{tag}>"
    rows = reader.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    pieces = F.split("value", rf"(?=<{tag}[\s>/])")  # before each start tag
    rows = rows.select("path", F.posexplode(pieces).alias("at", "raw"), F.size(pieces).alias("of"))
    begins, last = F.col("raw").rlike(rf"^<{tag}[\s>/]"), F.col("at") == F.col("of") - 1
    rows = rows.select("path", F.when(begins & last, F.concat("raw", F.lit(end))).otherwise(F.col("raw")).alias("raw"), begins.alias("begins"), last.alias("last"))
    # around the elements: declarations, comments, and tags of what encloses them
    rows = rows.where(F.col("begins") | (F.regexp_replace("raw", r"(?s)<!--.*?-->|<[?!/]?[^<>]*>|\s+", "") != ""))
    broken = F.from_xml("raw", "_broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})["_broken"].isNotNull()
    reject = F.when(~F.col("begins"), F.lit(f"outside of {tag}")).when(~F.col("last"), F.lit(f"no end of {tag}")).when(broken, F.lit("not well-formed"))
    return rows.select("path", "raw", reject.alias("reject"))


def accepted(records: DataFrame) -> DataFrame:
    return records.where("reject IS NULL").drop("reject")


def rejected(records: DataFrame) -> DataFrame:
    """The reject channel: what no invoice is made of, with the reasons."""
    return records.where("reject IS NOT NULL")


def with_rejects(records: DataFrame) -> DataFrame:
    """All records, without the texts of the rejected ones: for a parser that takes both channels in one reading."""
    return records.withColumn("raw", F.when(F.col("reject").isNull(), F.col("raw")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One invoice for each file."""
    return from_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One invoice for each line."""
    return from_json(accepted(json_records(spark.read, path)))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """One invoice for each file."""
    return from_xml(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))


def read_xml_elements(spark: SparkSession, path: str, tag: str = "Invoice") -> DataFrame:
    """One invoice for each element `tag`."""
    return from_xml(accepted(xml_records(spark.read, path, tag)))


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    return from_packages(spark.read.format("binaryFile").load(path))


def explode_lines(invoices: DataFrame, rejects: bool = False) -> DataFrame:
    """A row for each line, with line_no from 0 and the invoice's own columns. With `rejects` also one, of no line, for each row with the reason in `reject`."""
    keep = [c for c in invoices.columns if c not in ("lines", "raw")]
    # posexplode() would let Spark ask for size(lines) > 0 below the parsing, which parses each text again for every mention of a field
    return invoices.select(*keep, F.posexplode_outer("lines").alias("line_no", "line")).where("line_no IS NOT NULL" + " OR reject IS NOT NULL" * rejects).select(*keep, "line_no", "line.*")


def header_fields(text: Column) -> Column:
    """struct of number, code, date and total named in the text of an invoice."""
    p = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    date = F.when(text.rlike(p), F.concat_ws("-", F.regexp_extract(text, p, 1), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 3), 2, "0")))
    total = N.cell_number(X.group(text, r"价税合计[^¥￥\d]*[¥￥]?\s*([\d,]+\.?\d*)"))
    return F.struct(X.group(text, r"发票号码[：:\s]*(\d+)").alias("invoice_number"), X.group(text, r"发票代码[：:\s]*(\d+)").alias("invoice_code"), date.alias("invoice_date"), total.alias("total"))
