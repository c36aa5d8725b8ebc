"""Invoice sources and sinks on files."""

import random
import zipfile

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from carbonloom.operators import tables
from carbonloom.plans import ledger as L
from carbonloom.queries import text
from carbonloom.sources import facts
from carbonloom.sources import invoices as I
from carbonloom.sources.batches import BatchTable
from carbonloom.streaming import lines as stream

JSON = '{"invoiceNumber": "INV-1", "sellerName": " 某公司 ", "items": [{"name": "技术服务", "taxCode": "3040101010000000000", "amount": 1000, "quantity": 1, "unit": "项", "price": 1000}], "totalAmount": 1060}'
XML = "<Invoice><invoiceNumber>INV-2</invoiceNumber><FPDetail><Item><name>纸</name><taxCode>3040101010000000000</taxCode><amount>10.5</amount></Item><Item><Name>笔</Name><spbm>12</spbm><JE>2</JE></Item></FPDetail></Invoice>"


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(JSON)
    (tmp_path / "b.json").write_text("not json")
    rows = {r.invoice_number: r for r in I.read_json(spark, str(tmp_path)).collect()}
    assert rows["INV-1"].total_amount == 1060 and rows["INV-1"].seller_name == "某公司" and rows["INV-1"].lines[0].tax_code == "3040101010000000000"
    assert rows[None].lines == [] and rows[None].total_amount == 0


def test_xml_and_zip(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text(XML)
    row = I.read_xml(spark, str(tmp_path / "x")).first()
    assert row.invoice_number == "INV-2" and len(row.lines) == 2 and row.lines[0].tax_code == "3040101010000000000"
    with zipfile.ZipFile(tmp_path / "b.ofd", "w") as z:
        z.writestr("Doc/a.xml", XML)
    (tmp_path / "c.ofd").write_text("no zip")
    got = sorted((str(r.invoice_number), len(r.lines), r.total_amount, r.rejected) for r in I.read_zipped(spark, str(tmp_path / "*.ofd")).collect())
    assert got == [("INV-2", 2, 12.5, 0), ("None", 0, 0.0, 1)]


def package(path, members, damage=None):
    """A zip of members; of `damage` the bytes are changed afterwards."""
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    if damage:
        path.write_bytes(path.read_bytes().replace(damage, damage[::-1], 1))


def test_packages_of_several_members(spark, tmp_path):
    """One invoice for each, whatever members it has; what cannot be read is named and stops nothing."""
    items = "<FPDetail><Item><name>纸</name><amount>10.5</amount></Item><Item><name>笔</name><taxCode>1111111111111111111</taxCode><amount>2</amount></Item></FPDetail>"
    package(tmp_path / "a.ofd", [("OFD.xml", "<OFD/>"), ("__MACOSX/._invoice.xml", XML), ("Doc_0/invoice.xml", XML)])
    package(tmp_path / "b.ofd", [("0.xml", "<Invoice><sellerName>甲</sellerName><totalAmount>100</totalAmount><x>2222222222222222222</x></Invoice>"), ("1.xml", f"<Invoice><sellerName>乙</sellerName><fpdm>7</fpdm>{items}</Invoice>"), ("2.XML", XML)])
    package(tmp_path / "c.ofd", [("0.xml", f"<Invoice>{items}</Invoice>"), ("1.xml", "<Invoice><totalAmount>50</totalAmount></Invoice>"), ("2.xml", "<Invoice><unreadable/></Invoice>")], b"<Invoice><unreadable/>")
    package(tmp_path / "d.ofd", [("0.xml", "<Invoice><a>3333333333333333333</a></Invoice>"), ("1.xml", "not XML")])
    package(tmp_path / "e.ofd", [("seal.bin", "x")])
    (tmp_path / "f.ofd").write_bytes(b"PK, but no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.ofd"))
    got = {r.path[-5]: r for r in I.from_packages(files).collect()}
    one = lambda k: (got[k].invoice_number, got[k].seller_name, [(x.name, x.tax_code, x.amount) for x in got[k].lines], got[k].total_amount, got[k].members, got[k].rejected)
    assert one("a") == ("INV-2", None, [("纸", "3040101010000000000", 10.5), ("笔", None, 2.0)], 12.5, 2, 0)
    assert one("b") == ("7", "甲", [("纸", "2222222222222222222", 10.5), ("笔", "1111111111111111111", 2.0)], 112.5, 3, 0)
    assert one("c") == (None, None, [("纸", "1111111111111111111", 10.5), ("笔", "1111111111111111111", 2.0)], 50.0, 3, 1)
    assert one("d") == (None, None, [("", "3333333333333333333", 0.0)], 0.0, 2, 0)
    assert one("e") == (None, None, [], 0.0, 0, 1) and one("f") == (None, None, [], 0.0, 0, 1)
    reasons = {(r.path[-5], r.at): r.reject.split(":")[0] for r in I.rejected(I.xml_members(files)).collect()}
    assert reasons == {("c", 2): "BadZipFile", ("e", -1): "no XML member", ("f", -1): "no zip"}


def test_files_of_many_invoices(spark, tmp_path):
    """A file is read in several tasks, each invoice once, with rejects beside them; as a stream too."""
    one = lambda k: XML.replace("INV-2", f"X{k}")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<?xml version='1.0'?>\n<!-- <b> --><Batch n='1'>\n" + "\n".join(one(k) for k in range(400)) + "<Invoice><invoiceNumber>open</invoiceNumber>" + one(900) + "</Batch>")
    (tmp_path / "x" / "b.xml").write_text(one(901) + "<Invoice><a></Invoice> stray " + one(902) + "<InvoiceBook/>")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text("\n".join([JSON.replace("INV-1", f"J{k}") for k in range(300)] + ["", "[1]", "{broken", "  "]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        records = I.xml_records(spark.read, str(tmp_path / "x"))
        assert records.rdd.getNumPartitions() > 5
        got = [r.invoice_number for r in I.read_xml_elements(spark, str(tmp_path / "x")).where("size(lines) = 2 and total_amount = 12.5").collect()]
        assert sorted(got) == sorted(f"X{k}" for k in [*range(400), 900, 901, 902])
        assert sorted((r.path[-5], r.reject) for r in I.rejected(records).collect()) == [("a", "no end of Invoice"), ("b", "not well-formed"), ("b", "outside of Invoice")]
        rows = I.json_records(spark.read, str(tmp_path / "j"))
        assert rows.rdd.getNumPartitions() > 5 and I.rejected(rows).count() == 2
        assert sorted(r.invoice_number for r in I.read_json_lines(spark, str(tmp_path / "j")).collect()) == sorted(f"J{k}" for k in range(300))
        for name, records, n in (("xml_seen", I.from_xml(I.accepted(I.xml_records(spark.readStream, str(tmp_path / "x")))), 403), ("json_seen", I.from_json(I.accepted(I.json_records(spark.readStream, str(tmp_path / "j")))), 300)):
            query = records.select("invoice_number").writeStream.format("memory").queryName(name).start()
            query.processAllAvailable()
            query.stop()
            assert spark.table(name).distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_facts(spark, tmp_path):
    table = facts.fact_table(spark, str(tmp_path / "facts"), "id long, amount double")
    rows = spark.createDataFrame([(1, "Scope 1", 2.0), (2, "Scope 3", 1.0)], "id long, scope string, amount double")
    assert table.read().count() == 0 and table.truncate() == 0
    assert [facts.append_facts(table, rows, k) for k in ("a", "b", "a")] == [2, 2, 0]
    assert [r.id for r in facts.newest_first(table.read()).collect()] == [2, 2, 1, 1]
    assert sorted((r.id, r.batch_key) for r in table.read().collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert table.truncate() == 4 and table.read().count() == 0
    assert facts.append_facts(table, rows, "b") == 0  # a key counts once for good
    assert facts.append_facts(table, rows, "c") == 2
    assert sorted((r.id, r.scope) for r in table.read().collect()) == [(1, "Scope 1"), (2, "Scope 3")]
    assert table.vacuum() == 2 and table.read().count() == 2
    facts.write_csv(rows.limit(1), str(tmp_path / "csv"))
    assert '"id","scope","amount"' in spark.read.text(str(tmp_path / "csv")).first()[0]


def test_a_batch_that_was_killed_is_repeated_once(spark, tmp_path, monkeypatch):
    """Killed before its entry it shows nothing; repeated it stands once; two writers of one version both get through."""
    table = BatchTable(spark, str(tmp_path / "t"), "id long")
    rows = spark.range(5)
    with monkeypatch.context() as m:
        m.setattr(BatchTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.append(rows, "a")
    assert table.read().count() == 0 and len(list((tmp_path / "t").glob("__batch=*"))) == 1
    assert table.append(rows, "a") == 5 and table.append(rows, "a") == 0
    # another writer takes the version between the look at the log and the entry
    other, taken = BatchTable(spark, str(tmp_path / "t"), "id long"), []
    look = BatchTable._next

    def late(key):
        def run(self):
            version = look(self)
            if not taken:
                taken.append(version)
                other.append(rows, key)
            return version

        return run

    with monkeypatch.context() as m:
        m.setattr(BatchTable, "_next", late("b"))
        assert table.append(rows, "c") == 5
    assert sorted(r.batch_key for r in table.read().collect()) == ["a"] * 5 + ["b"] * 5 + ["c"] * 5
    assert [r.version for r in table.log().orderBy("version").collect()] == [1, 2, 3]
    taken.clear()
    with monkeypatch.context() as m:
        m.setattr(BatchTable, "_next", late("d"))
        assert table.append(rows, "d") == 0  # the other writer's batch of the same key counts
    assert table.read().count() == 20 and table.vacuum() == 1


def test_a_stream_that_repeats_a_batch_adds_it_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "id long")
    spark.range(7).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run has lost its checkpoint: it sends batch 0 again
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(table.each_batch("lines")).option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        query.processAllAvailable()
        query.stop()
    assert table.read().count() == 7


def test_catalogue_and_factor_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("产品ID,产品名称,碳足迹\nA,纸,1kgCO2e/件\nB,笔,2kgCO2e/件\n")
    out = facts.read_catalogue(spark, str(tmp_path / "c.csv")).orderBy("row_index").collect()
    assert [r.product_id for r in out] == ["A", "B"]
    (tmp_path / "f.csv").write_text("factor_id,scope,unit,kg,description\na,Scope 1,t,1.5,x\nb,Scope 1,t,none,x\n")
    assert [r.factor_id for r in facts.read_factors(spark, str(tmp_path / "f.csv")).collect()] == ["a"]
    assert facts.freight_rows(spark).count() == 75


def test_alias_and_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zh,iata_code,ident\n白云 机场,can,\n虹桥,,zsss\n,X,\n虹桥,sha,\n")
    assert sorted((r.alias, r.code) for r in facts.read_aliases(spark, str(tmp_path / "a.csv")).collect()) == [("白云机场", "CAN"), ("虹桥", "SHA")]
    (tmp_path / "l.json").write_text('[{"productType": "空调", "annualKWh": 850, "lifetimeYears": 12},\n {"productType": "冰箱", "annualKWh": 300}, {"productType": "x"}]')
    assert facts.read_energy_labels(spark, str(tmp_path / "l.json")) == [("空调", 850.0, 12), ("冰箱", 300.0, 10)]


def test_numbers_over_stretches(spark):
    """Also with nulls, negative and repeated keys, as a window over all rows would give them."""
    random.seed(3)
    rows = [(random.choice("ab"), random.choice([None, *range(-50, 50)]), k) for k in range(300)]
    frame = spark.createDataFrame(rows, "s string, k long, id long")
    got = sorted((r.n, r.s, r.k is not None, r.k or 0) for r in tables.numbered(frame, "n", "k", ("s",), width=7).collect())
    want = sorted((s, k is not None, k or 0) for s, k, _ in rows)
    assert got == [(n, *w) for n, w in enumerate(want)]


@pytest.mark.parametrize("descending", [True, False])
def test_pages(spark, monkeypatch, descending):
    """Every page equals that of a sort over all rows: repeated, negative, far and null keys, one key with a third of all rows."""
    monkeypatch.setattr(tables, "RANGES", 7)
    monkeypatch.setattr(tables, "FEW", 12)
    random.seed(21)
    keys = [random.randint(-50, 400) for _ in range(60)] + [77] * 40 + [10**15, -(10**15), None, None, None]
    rows = [(k, n) for n, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "k long, n int").repartition(3).cache()
    lowest = lambda k: (k is not None, k or 0)
    ordered = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: lowest(r[0]), reverse=descending)
    for number in (1, 2, 5, 6, 9, 10, 11, 12):
        got = [tuple(r) for r in tables.page(frame, "k", number, 10, descending, ("n",)).collect()]
        assert got == [(*r, len(rows)) for r in ordered[(number - 1) * 10 : number * 10]], number


def test_a_deep_page_reads_one_range(spark, tmp_path):
    spark.range(1_200_000).selectExpr("id * 3 as id").repartitionByRange(8, "id").write.parquet(str(tmp_path / "t"))
    read = []
    out = tables.page(spark.read.parquet(str(tmp_path / "t")), "id", 1_000_000, 1, read=read)
    assert [r.id for r in out.collect()] == [3 * (1_200_000 - 1_000_000)]
    (low, high, before), = read
    assert high - low <= 3 * tables.FEW and before <= tables.FEW
    assert f"GreaterThanOrEqual(id,{low})" in out._jdf.queryExecution().executedPlan().toString()


def plain_changes(products, changes, fields):
    """Changes one after the other, by version; those of ids that only these changes make do nothing."""
    there = {p[0] for p in products}
    out, top = {p[0]: list(p[1:]) for p in products}, max([p[0] for p in products], default=0)
    for _, op, i, *values in sorted(changes, key=lambda c: c[0]):
        if op == "insert":
            top += 1
            out[top] = list(values)
        elif i not in there:
            continue
        elif op == "delete":
            out.pop(i, None)
        elif i in out:
            out[i] = [old if new is None else new for old, new in zip(out[i], values, strict=True)]
    return sorted((i, *v) for i, v in out.items())


def test_changes_in_order_of_version(spark):
    """Several updates of one id, of other fields and of the same; updates before and behind a delete; ids that are not there."""
    products = [(k, f"n{k}", float(k)) for k in range(1, 30)]
    random.seed(9)
    changes = [(v, random.choice(["update"] * 6 + ["delete", "insert"]), random.randint(0, 32), random.choice([None, f"v{v}"]), random.choice([None, v + 0.5])) for v in random.sample(range(500), 120)]
    frame = spark.createDataFrame(changes, "version long, op string, id long, name string, kg double")
    got = tables.apply_changes(spark.createDataFrame(products, "id long, name string, kg double"), frame, ["name", "kg"])
    assert sorted(map(tuple, got.collect())) == plain_changes(products, changes, 2)
    none = tables.apply_changes(spark.createDataFrame([], "id long, name string, kg double"), frame, ["name", "kg"])
    assert sorted(map(tuple, none.collect())) == plain_changes([], [c for c in changes if c[1] == "insert"], 2)


def test_stream_equals_batch(spark, tmp_path):
    schema = "invoice_id string, line_no int, name string, tax_code string, quantity double, unit string, amount double, seller_name string"
    rows = spark.createDataFrame([("a", 1, "电费", None, 10.0, "度", 5.0, "x"), ("a", 2, "合计", None, None, None, 5.0, "x"), ("b", 1, "汽油", "107", 3.0, "升", 9.0, "x")], schema)
    rows.write.parquet(str(tmp_path / "in"))
    query = stream.emissions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("emitted").start()
    query.processAllAvailable()
    query.stop()
    want = L.emissions(L.classify(L.without_junk(rows)))
    assert sorted(map(tuple, spark.table("emitted").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_by_hour_leaves_out_late_lines(spark, tmp_path):
    schema = "scope string, emission_kg double, ts timestamp"
    batches = [[("Scope 1", 1.0, "2024-01-01 10:05:00"), ("Scope 1", 2.0, "2024-01-01 10:55:00"), ("Scope 2", 4.0, "2024-01-01 13:30:00")], [("Scope 2", 16.0, "2024-01-01 13:00:00")], [("Scope 1", 8.0, "2024-01-01 10:30:00"), ("Scope 3", 0.5, "2024-01-01 18:00:00")], [("Scope 3", 0.25, "2024-01-01 18:10:00")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(s, kg, t) for s, kg, t in rows], "scope string, emission_kg double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream.kg_by_hour(source, "ts").writeStream.format("memory").queryName("hours").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.window.start.hour, r.scope): r.emission_kg for r in spark.table("hours").collect()}
    assert got == {(10, "Scope 1"): 3.0, (13, "Scope 2"): 20.0}  # the 8 kg of 10:30 come two batches after 13:30, too late


def test_texts_are_parsed_once_for_each_set_of_names(spark):
    texts = spark.range(2).select(F.concat(F.lit("<Invoice/>"), "id").alias("raw"))
    for parse, name, n in ((I.from_xml, "from_xml", 4), (I.from_json, "from_json", 2)):
        plan = I.explode_lines(parse(texts)).groupBy("invoice_number").count()._jdf.queryExecution().optimizedPlan().toString().lower()
        assert 0 < max(plan.count(name), plan.count("jsontostructs") if name == "from_json" else 0) <= n, name


def test_one_set_of_names_is_enough_without_case(spark):
    """One parser where names are found whatever their case; where case counts, every set is tried."""
    xml = "<Invoice><fpdm>1</fpdm><fpDetail><Item><Name>x</Name><JE>2</JE></Item><Item><name>y</name><Amount>3</Amount></Item></fpDetail></Invoice>"
    frame = spark.createDataFrame([(xml,)], "raw string")
    out = I.from_xml(frame)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [(x.name, x.amount) for x in out.first().lines] == [("x", 2.0), ("y", 3.0)] and out.first().total_amount == 5.0
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        row = I.from_xml(frame).first()
        assert row.invoice_number == "1" and len(row.lines) == 2
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_packages_are_handed_on_in_small_batches():
    """Also those that hold no text; the rows so far are not counted again for each package."""
    n = 60_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)).cast(pa.string()), pa.array([b"no zip"] * n)], ["path", "content"])
    sizes = [out.num_rows for out in I.member_batches([batch])]
    assert sum(sizes) == n and max(sizes) <= I.MEMBER_BYTES // I.ROW_BYTES + 1


def test_files_of_both_channels_are_read_once(spark):
    plan = text.s1_s3_invoice_files(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 2


def test_spellings_of_any_set_are_found(spark):
    """Escaped names, and lists and fields that differ from others by case alone, alone and together."""
    line = lambda name: f"<{name}>x</{name}><Amount>2</Amount>"
    xml = [f"<Invoice><FPDM>{k}</FPDM><{outer}><Item>{line(name)}</Item></{outer}></Invoice>" for k, (outer, name) in enumerate((o, n) for o in ("Items", "items", "FPDetail", "fpDetail", "FPMX", "fpmx") for n in ("name", "Name", "XMMC", "xmmc"))]
    rows = I.from_xml(spark.createDataFrame([(x,) for x in xml], "raw string")).collect()
    assert [(r.invoice_number, r.lines[0].name) for r in sorted(rows, key=lambda r: int(r.invoice_number))] == [(str(k), "x") for k in range(len(xml))]
    json = [(r'{"fpdm": "1", "\u0066pDetail": [{"name": "x"}]}',), ('{"fpdm": "1", "FPDetail": [{"name": "x"}]}',), ('{"fpdm": "1", "fpDetail": [{"name": "x"}]}',)]
    assert [r.lines[0].name for r in I.from_json(spark.createDataFrame(json, "raw string")).collect()] == ["x"] * 3
