from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesora.operators import datasets as ds
from tesora.operators import reconcile as rc
from tesora.operators import spending as sp
from tesora.operators.contracts import Split
from tesora.session import shared_folder
from tesora.sources import delimited as dl
from tesora.sources import files as fl
from tesora.sources import publish as pb
from tesora.sources import store as st
from tesora.sources import web
from tesora.sources import workbook as wb


def folder(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


CONFIG = {
    "source": "fns_7_ndfl",
    "category": "all",
    "separator": ";",
    "period_format": "yyyy-MM-dd",
    "available_at": "2026-06-09",
    "columns": {"oktmo": "code", "period": "year", "indicator": "metric", "value": "amount", "unit": "unit"},
}
GOOD = "code;year;metric;amount;unit\n71876000;2025-12-31;income;1 20,5;rub\n"


def test_mapped_scan(spark, tmp_path):
    path = folder(tmp_path, a__csv=GOOD)
    row = dl.scan_mapped(spark, path, CONFIG).clean.first()
    assert row["value"] == 120.5 and str(row["period"]) == "2025-12-31 00:00:00" and row["is_estimated"] is False
    for change, match in (({"source": "x"}, "unknown source"), ({"category": "food"}, "all-category"), ({"columns": {"oktmo": "a"}}, "exactly")):
        with pytest.raises(ValueError, match=match):
            dl.scan_mapped(spark, path, {**CONFIG, **change})
    with pytest.raises(ValueError, match="renamed"):
        dl.scan_mapped(spark, path, {**CONFIG, "columns": {**CONFIG["columns"], "value": "renamed"}})


def test_mapped_scan_in_another_code_page(spark, tmp_path):
    text = "код;year;metric;amount;unit\n71876000;2025-12-31;доход;7;руб\n".encode("cp1251")
    config = {**CONFIG, "encoding": "cp1251", "columns": {**CONFIG["columns"], "oktmo": "код"}}
    row = dl.scan_mapped(spark, folder(tmp_path, a__csv=text), config).clean.first()
    assert (row["indicator"], row["unit"], row["value"]) == ("доход", "руб", 7.0)


def test_export_scan(spark, tmp_path):
    head = ";".join(sp.EXPORT_COLUMNS)
    path = folder(tmp_path, a__csv="﻿" + head + " \n2024-01-01;1;A;s;Транспорт;Сургут;M;2;RUB;0\n")
    assert dl.scan_export(spark, path, sp.EXPORT_COLUMNS).first()["unit_mult"] == "0"
    with pytest.raises(ValueError, match="extra"):
        dl.scan_export(spark, path, (*sp.EXPORT_COLUMNS, "extra"))


def test_zipped_export(spark, tmp_path):
    def pack(*names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n in names:
                z.writestr(n, "period;value\n2024-01-01;5\n")
        return buffer.getvalue()

    path = folder(tmp_path, a__zip=pack("x.CSV", "readme.txt"))
    row = dl.scan_zipped_export(spark, path, ["period", "value"]).clean.first()
    assert (row["period"], row["value"]) == ("2024-01-01", "5")
    (tmp_path / "b.zip").write_bytes(pack("x.csv", "y.csv"))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    parts = dl.scan_zipped_export(spark, path, ["period", "value"])
    assert parts.clean.count() == 1
    assert {r["path"].rsplit("/", 1)[1]: r["reason_code"] for r in parts.quarantine.collect()} == {"b.zip": "NOT_ONE_CSV", "c.zip": "BAD_ARCHIVE"}


def damaged(content, how):
    """The archive with its members marked encrypted, in an unknown form, or with broken bytes."""
    out = bytearray(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.infolist()[0]
    if how in ("encrypted", "compression"):
        at, bits = (6, 1) if how == "encrypted" else (8, 99)
        for mark, shift in ((b"PK\x03\x04", 0), (b"PK\x01\x02", 2)):
            place = out.find(mark)
            out[place + at + shift] |= bits
    elif how == "corrupt":
        start = info.header_offset + 30 + len(info.filename)
        out[start : start + 8] = b"\xff" * 8
    elif how == "cut":
        del out[len(out) // 2 :]
    return bytes(out)


REASONS = {"encrypted": "ENCRYPTED", "compression": "UNSUPPORTED_COMPRESSION", "corrupt": "CORRUPT", "cut": "BAD_ARCHIVE"}


def test_broken_archives_leave_the_others_alone(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "\ufeff\n\nperiod;value\n" + "2024-01-01;5\n" * 500)
    good = buffer.getvalue()
    path = folder(tmp_path, good__zip=good, none__zip=b"x", **{f"{how}__zip": damaged(good, how) for how in REASONS})
    parts = dl.scan_zipped_export(spark, path, ["period", "value"])
    got = {r["path"].rsplit("/", 1)[1].removesuffix(".zip"): r["reason_code"] for r in parts.quarantine.collect()}
    assert got == REASONS | {"none": "BAD_ARCHIVE"}
    assert {r["path"].rsplit("/", 1)[1] for r in parts.clean.select("path").distinct().collect()} == {"good.zip"}
    files = spark.createDataFrame([("null", None), ("good", bytearray(good))], "path string, content binary")
    assert {r["path"]: r["reason_code"] for r in dl.unpacked_exports(files, ["value"]).quarantine.collect()} == {"null": "BAD_ARCHIVE"}


def test_broken_workbooks_leave_the_others_alone(spark, tmp_path, monkeypatch):
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook([['<c r="A1"><v>7</v></c>']] * 300))) as z, zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("xl/worksheets/sheet1.xml", z.read("xl/worksheets/sheet1.xml"))
    good = buffer.getvalue()
    cell = ['<c r="A1"><v>1</v></c>']
    far = workbook([cell] * 50 + [['<c r="A1" t="s"><v>9</v></c>']], shared=["ab"])
    word = workbook([cell] * 50 + [['<c r="A1" t="s"><v>x</v></c>']], shared=["ab"])
    books = {f"{how}__xlsx": damaged(good, how) for how in REASONS} | {"good__xlsx": good, "far__xlsx": far, "word__xlsx": word}
    books["open__xlsx"] = workbook([cell, ["<c>"]])
    files = fl.binary_files(spark, folder(tmp_path, **books))
    want = REASONS | {"cut": "UNSUPPORTED_WORKBOOK", "far": "BAD_REFERENCE", "word": "BAD_REFERENCE", "open": "UNSUPPORTED_WORKBOOK"}
    parts = wb.workbook_cells(files)
    assert {r["path"].rsplit("/", 1)[1].removesuffix(".xlsx"): r["reason_code"] for r in parts.quarantine.collect()} == want
    assert {(r["path"].rsplit("/", 1)[1], r["num"]) for r in parts.clean.collect()} == {("good.xlsx", 7.0)}
    assert parts.clean.count() == 300


@pytest.mark.parametrize("held", [1, 3, 100])
def test_long_sheets_are_read_twice_and_alike(monkeypatch, held):
    book = workbook([['<c r="A1"><v>7</v></c>']] * 7)
    broken = workbook([['<c r="A1"><v>7</v></c>']] * 7 + [['<c r="A1" t="s"><v>0</v></c>']])
    monkeypatch.setattr(wb, "HELD_CELLS", held)
    assert [c[:2] for c in wb._sound_cells(book, 0)] == [(i, 0) for i in range(7)]
    assert [c[-1] for c in wb._sound_cells(broken, 0)] == ["BAD_REFERENCE"]


def test_uploads_that_break_the_usual_reader(spark, tmp_path):
    """Very long fields and every kind of line end are read; one bad file does not stop the others."""
    path = folder(
        tmp_path, long__csv="name;n\n" + "x" * 200_000 + ";1\n", mac__csv="name;n\ra;2\rb;3\r", dos__csv="name;n\r\nc;4\r\n", bad__csv=b"\xff\xfe\x98;n\n"
    )
    records = dl.scan_unknown_encoding(spark, path, encodings=("utf-8",))
    got = sorted((len(r["name"]), r["n"]) for r in dl.rows_with_header(records, ["name", "n"]).collect())
    assert got == [(1, "2"), (1, "3"), (1, "4"), (200_000, "1")]
    assert [r["problem"] for r in records.where("problem is not null").collect()] == ["UNREADABLE_TEXT"]
    assert "Join" not in dl.rows_with_header(records, ["n"])._jdf.queryExecution().executedPlan().toString()


def test_unknown_encodings(spark, tmp_path):
    path = folder(tmp_path, a__csv="﻿имя;n\nА;1\n", b__csv="имя,n\nБ,2\n".encode("cp1251"), c__csv='имя\tn\n"В\tГ"\t3\n')
    rows = dl.rows_with_header(dl.scan_unknown_encoding(spark, path), ["имя", "n", "нет"])
    assert sorted((r["имя"], r["n"], r["нет"]) for r in rows.collect()) == [("А", "1", None), ("Б", "2", None), ("В\tГ", "3", None)]


def workbook(rows, shared=()):
    cells = "".join(f'<row r="{i + 1}">{"".join(r)}</row>' for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
    return buffer.getvalue()


def test_workbook_cells(spark, tmp_path):
    book = workbook(
        [
            ['<c r="A1" t="inlineStr"><is><t>Имя</t></is></c>', '<c r="AB1" t="s"><v>0</v></c>'],
            ['<c r="A2"><v>12</v></c>', '<c r="B2"><v>1.5</v></c>', '<c r="C2" t="b"><v>1</v></c>', '<c r="D2"/>'],
        ],
        shared=["Общая"],
    )
    files = fl.binary_files(spark, folder(tmp_path, a__xlsx=book, b__xls=b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"))
    parts = wb.workbook_cells(files)
    got = sorted((r["row"], r["col"], r["text"], r["num"]) for r in parts.clean.collect())
    assert got == [(0, 0, "Имя", None), (0, 27, "Общая", None), (1, 0, "12", 12.0), (1, 1, "1.5", 1.5), (1, 2, "True", 1.0)]
    assert parts.quarantine.first()["reason_code"] == "UNSUPPORTED_WORKBOOK"
    kinds = {r["path"].rsplit("/", 1)[1]: r["signature"] for r in fl.file_signatures(files).collect()}
    assert kinds == {"a.xlsx": "ZIP_OR_XLSX", "b.xls": "OLE_COMPOUND"}


def cells(spark, sheets):
    data = [
        ("Town", part, r, c, str(v), float(v) if isinstance(v, (int, float)) else None)
        for part, rows in sheets.items()
        for r, row in enumerate(rows)
        for c, v in enumerate(row)
        if v is not None
    ]
    return spark.createDataFrame(data, "municipality_name string, part string, row int, col int, text string, num double")


SHEETS = {
    "revenue": [
        ["Приложение 1"],
        ["(тыс. рублей)"],
        ["Наименование", "2025 год", "2026 год", "2027"],
        ["НАЛОГОВЫЕ И НЕНАЛОГОВЫЕ ДОХОДЫ", 60, "61,5", 62],
        ["Налоговые и неналоговые доходы, подробно", 1, 2, 3],
        ["ВСЕГО доходов", 100, 101, 102],
    ],
    "financing": [
        ["Источник", "2025", "2026", "2027"],
        ["Изменение остатков средств", 4, -5, 6],
        ["Продажа акций и иных форм участия в капитале", 1, 1, 1],
        ["Всего источников", -30, 31, 32],
    ],
    "expenditure": [
        ["Раздел", "Наименование", "2025", "2026", "2027"],
        ["01", "Общегосударственные вопросы", 70, 71, 72],
        ["13", "Обслуживание государственного и муниципального долга", 5, 6, 7],
        ["13", "Повтор", 9, 9, 9],
        [None, "Всего расходов", 130, 120, 102],
    ],
}


def test_adopted_budget(spark):
    df = cells(spark, SHEETS)
    got = wb.adopted_budget(df).clean.orderBy("year").collect()
    assert [(r["total_revenue"], r["revenue_base"], r["transfers"]) for r in got] == [(100, 60, 40), (101, 61.5, 39.5), (102, 62, 40)]
    assert [r["financing_sources"] for r in got] == [30, 31, 32] and [r["eligible_exceptions"] for r in got] == [5, 1, 7]
    assert [r["debt_service"] for r in got] == [5, 6, 7] and [r["deficit"] for r in got] == [30, 19, 0]
    bad = cells(spark, {**SHEETS, "revenue": SHEETS["revenue"][:3] + SHEETS["revenue"][5:]})
    assert {r["reason_code"] for r in wb.adopted_budget(bad).quarantine.collect()} == {"MISSING_REVENUE_BASE"}


def test_budgets_without_a_usable_header_go_aside(spark):
    low = {k: [["x"]] * 30 + v for k, v in SHEETS.items()}
    for sheets in (low, {k: v[-1:] for k, v in SHEETS.items()}):
        parts = wb.adopted_budget(cells(spark, sheets))
        assert parts.clean.count() == 0
        assert {(r["year"], r["reason_code"]) for r in parts.quarantine.collect()} == {(y, "MISSING_HEADER") for y in wb.ADOPTED_YEARS}
    assert wb.adopted_budget(cells(spark, low), header_rows=40).clean.count() == 3
    untotalled = {**SHEETS, "expenditure": SHEETS["expenditure"][:4]}
    assert {r["reason_code"] for r in wb.adopted_budget(cells(spark, untotalled)).quarantine.collect()} == {"MISSING_EXPENDITURE"}
    expense = lambda sheets: cells(spark, sheets).where("part = 'expenditure'").drop("part")
    assert wb.expenditure_sections(expense(low)).quarantine.first()["reason_code"] == "MISSING_HEADER"
    headed = {"expenditure": [SHEETS["expenditure"][0], SHEETS["expenditure"][4]]}
    assert wb.expenditure_sections(expense(headed)).quarantine.first()["reason_code"] == "MISSING_SECTIONS"
    assert wb.expenditure_sections(expense(SHEETS)).quarantine.count() == 0


def test_sheets_are_found_through_the_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda v: f"<worksheet {ns}><sheetData><row><c><v>{v}</v></c><c><v>8</v></c></row></sheetData></worksheet>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Итог" r:id="rId2"/><sheet name="Data" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(1))
        z.writestr("xl/worksheets/other.xml", sheet(2))
    files = fl.binary_files(spark, folder(tmp_path, a__xlsx=buffer.getvalue()))
    for which, value in ((0, 2.0), (1, 1.0), ("Data", 1.0), ("Итог", 2.0)):
        got = {r["col"]: r["num"] for r in wb.workbook_cells(files, sheet=which).clean.collect()}
        assert got == {0: value, 1: 8.0}
    assert wb.workbook_cells(files, sheet="none").quarantine.count() == 1


def test_sections_scale_and_outputs(spark):
    df = cells(spark, SHEETS)
    expense = df.where("part = 'expenditure'").drop("part")
    sections = wb.expenditure_sections(expense).clean
    got = sorted((r["year"], r["section_code"], r["amount"]) for r in sections.collect())
    assert got[:2] == [(2025, "01", 70.0), (2025, "13", 5.0)] and len(got) == 6
    scale = wb.unit_scale(df.where("part = 'revenue'").drop("part"), ["municipality_name"])
    assert scale.first()["unit_scale"] == 1000.0
    text = "предел на 01.01.2026 в объёме 1 145 352 694,99 рубля; на 01.01.2027 в объеме 10,50; на 01.01.2026 в объеме 2 000,00"
    limits = wb.debt_limits(spark.createDataFrame([("Town", text)], "municipality_name string, text string"), doc=["municipality_name"])
    assert {r["year"]: r["debt_limit"] for r in limits.collect()} == {2025: 2000.0, 2026: 10.5}
    budgets = wb.adopted_budget(df).clean
    plan = {r["year"]: r for r in wb.plan_rows(budgets, scale, limits).collect()}
    assert [plan[y]["stage"] for y in (2025, 2026, 2027)] == ["ADOPTED", "PLAN_PERIOD", "PLAN_PERIOD"]
    assert plan[2025]["debt_upper_limit"] == 2.0 and plan[2027]["debt_upper_limit"] == 0.0
    lines = wb.structure_rows(budgets, sections)
    assert lines.count() == 4 * 3 + 6
    assert lines.where("item_code = '13' and is_debt_service = 1").count() == 3


def test_archives(spark, tmp_path):
    def pack(*names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n in names:
                z.writestr(n, "12345")
        return buffer.getvalue()

    path = folder(tmp_path, good__zip=pack("a/b.txt", "c.txt"), bad__zip=pack("../up.txt"), abs__zip=pack("/root.txt"), no__zip=b"text")
    members = fl.archive_members(fl.binary_files(spark, path))
    flags = {r["path"].rsplit("/", 1)[1]: (r["unsafe"], r["problem"]) for r in members.collect()}
    assert flags == {"good.zip": (False, None), "bad.zip": (True, None), "abs.zip": (True, None), "no.zip": (None, "NOT_AN_ARCHIVE")}
    safe = fl.safe_archives(members).collect()
    assert len(safe) == 1 and (safe[0]["members"], safe[0]["size_bytes"]) == (2, 10)


def test_manifest(spark, tmp_path):
    root = folder(tmp_path, a__csv=b"x\r\ny\r\n", b__csv=b"x\ny\n", c__txt=b"z", d__json=b"{}")
    found = fl.build_manifest(fl.binary_files(spark, root), root=root, exclude=["^d"])
    got = {r["path"]: (r["sha256"], r["size_bytes"]) for r in found.collect()}
    assert set(got) == {"a.csv", "b.csv"} and got["a.csv"] == got["b.csv"] and got["a.csv"][1] == 4
    listed = found.where("path <> 'b.csv'").withColumn("sha256", F.lit("old")).unionByName(
        spark.createDataFrame([("gone.csv", "x", 1)], "path string, sha256 string, size_bytes long")
    )
    assert {r["path"]: r["state"] for r in rc.file_set_diff(listed, found).collect()} == {"a.csv": "changed", "gone.csv": "missing", "b.csv": "unlisted"}
    row = fl.lineage(fl.binary_files(spark, root, "c.txt"), "src").first()
    assert (row["source_id"], row["source_file"], row["size_bytes"]) == ("src", "c.txt", 1)


def test_table_digest_ignores_order(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    a = fl.table_digest(df).first()
    b = fl.table_digest(df.orderBy(F.col("id").desc()).repartition(7)).first()
    c = fl.table_digest(df.where("id <> 5").unionByName(df.where("id = 6"))).first()
    assert a == b and a["snapshot_id"] != c["snapshot_id"] and c["rows"] == 100


def test_dispatch(spark):
    names = ["/x/Расчет по итогам 2024.xlsx", "ст.136 бюджет.xls", "Исполнение.rar", "Свод реестров.xls", "фото.png", "/бюджет/прочее.txt"]
    df = fl.dispatch(spark.createDataFrame([(n,) for n in names], "path string"))
    assert [r["parser_id"] for r in df.collect()] == ["budget_quality", "article136", "budget_execution_archive", "expenditure_obligations", "unknown", "unknown"]
    assert df.where("status = 'QUARANTINE'").count() == 2


def test_links(spark):
    html = """<a href="/f/a.xlsx">Short</a><A class=x HREF='/f/a.xlsx'>A longer <b>title</b>
      &amp; more</A><a href=b.docx>B</a><a href="../c.XLS?x=1#y">C</a><a href="d.pdf">D</a><a name="n">no</a>
      <a href="https://other.example.org/e.xls"></a><a href="//cdn.example.org/g.xls">G</a>"""
    pages = spark.createDataFrame([("https://site.example.org/docs/list/page.html?p=1", html)], "url string, html string")
    got = {r["url"]: (r["title"], r["extension"], r["occurrences"]) for r in web.discover_links(pages).collect()}
    assert got == {
        "https://site.example.org/f/a.xlsx": ("A longer title & more", ".xlsx", 2),
        "https://site.example.org/docs/list/b.docx": ("B", ".docx", 1),
        "https://site.example.org/docs/c.XLS?x=1#y": ("C", ".xls", 1),
        "https://other.example.org/e.xls": ("", ".xls", 1),
        "https://cdn.example.org/g.xls": ("G", ".xls", 1),
    }
    allowed = web.discover_links(pages, hosts=["Site.example.org"])
    assert allowed.count() == 3
    check = spark.range(1).select(web.is_allowed(F.lit("http://site.example.org/a.xls"), ["site.example.org"]).alias("x"))
    assert check.first()["x"] is False


def test_links_with_many_levels_and_named_references(spark):
    html = """<a href="../../../../../x.xlsx">&laquo;A&raquo; &ndash; &#8470; 5</a><a href="./y/.././z/..">&copy=1</a><a href="/p/../../q/./r.xls?a=../b">R</a>"""
    pages = spark.createDataFrame([("https://h/a/b/c/d/e/f/g.html", html)], "url string, html string")
    got = {r["url"]: r["title"] for r in web.discover_links(pages, extensions=None).collect()}
    assert got == {"https://h/a/x.xlsx": "«A» – № 5", "https://h/a/b/c/d/e/f/": "&copy=1", "https://h/q/r.xls?a=../b": "R"}


def test_relative_paths_take_the_root_literally(spark):
    rows = spark.createDataFrame([("file:/data/a+b (1)/x.csv",), ("file:///data/a+b (1)/y/z.csv",), ("/data/aab 1/q.csv",)], "path string")
    got = [r["p"] for r in rows.select(fl.relative_path("path", "/data/a+b (1)").alias("p")).collect()]
    assert got == ["x.csv", "y/z.csv", "/data/aab 1/q.csv"]


def test_drift_closes_the_gate(spark):
    root = shared_folder(spark, "test_drift")
    good = scan(spark)
    first = {"a": {"schema_version": "1", "columns": {"x": "y"}}, "b": {"schema_version": "1"}}
    assert pb.publish_aggregates(spark, {"a": good}, root=root, run_id="1", mappings={"a": first["a"]}).status == "fresh"
    changed = {"a": {"schema_version": "1", "columns": {"x": "z"}}}
    out = pb.publish_aggregates(spark, {"a": good}, root=root, run_id="2", mappings=changed)
    assert (out.status, [r["error"] for r in out.sources.collect()]) == ("stale", ["CONTRACT_DRIFT"])
    raised = {"a": {**changed["a"], "schema_version": "2"}}
    assert pb.publish_aggregates(spark, {"a": good}, root=root, run_id="3", mappings=raised).status == "fresh"
    assert pb.publish_aggregates(spark, {"a": good}, root=root, run_id="4", mappings={"a": first["a"]}).status == "fresh"


def test_record_store(spark):
    product = spark.createDataFrame([("Сургут", 2025, 1), ("Иной", 2024, 2)], "municipality_name string, year int, v int")
    coded = spark.createDataFrame([("Сургут", "71870000", "2025-01")], "object_name string, object_oktmo string, period string")
    registry = spark.createDataFrame([("Сургут", "71876000")], "municipality_name string, oktmo string")
    records = st.build_records({"plan": product, "tax": coded}, registry)
    rows = {(r["dataset"], r["municipality"]): r for r in records.collect()}
    assert rows["plan", "Сургут"]["oktmo"] == "71876000" and rows["plan", "Сургут"]["period"] == "2025"
    assert rows["tax", "Сургут"]["oktmo"] == "71870000" and rows["plan", "Иной"]["oktmo"] == ""
    assert st.page(st.select_records(records, dataset="plan", period="2024"), order=["municipality"], limit=1).count() == 1
    names = {r["name"]: r["identity_status"] for r in st.municipalities(records).collect()}
    assert names == {"Сургут": "code_present_requires_verification", "Иной": "code_missing"}
    assert {r["dataset"]: r["row_count"] for r in st.datasets(records).collect()} == {"plan": 2, "tax": 1}
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            st.page(records, order=["municipality"], **bad)


def test_visibility(spark):
    df = spark.createDataFrame([(c,) for c in ("PUBLIC", "INTERNAL", "BANK_CONFIDENTIAL", "HIGHLY_RESTRICTED", "ODD")], "data_class string")
    seen = {role: st.visible_to(df, role).count() for role in ("BUSINESS_USER", "AUDITOR", "SECURITY_ADMIN", "NOBODY")}
    assert seen == {"BUSINESS_USER": 2, "AUDITOR": 3, "SECURITY_ADMIN": 0, "NOBODY": 0}


def scan(spark, value=120.0, rows=1):
    from test_temporal_reconcile import aggregates

    df = aggregates(spark, [("71876000", f"202{i}-12-31", value, "2026-06-09") for i in range(rows)])
    return Split(df, df.select(F.lit("x").alias("reason_code")).where(F.lit(False)))


def test_publish_keeps_the_last_good_table(spark):
    root = shared_folder(spark, "test")
    good = scan(spark)
    out = pb.publish_aggregates(spark, {"a": good}, root=root, run_id="1")
    assert (out.status, out.rows) == ("fresh", 1) and pb.read_published(spark, root).count() == 1
    out = pb.publish_aggregates(spark, {"a": scan(spark, -10.0)}, root=root, run_id="2")
    assert out.status == "stale" and out.sources.first()["error"] == "BAD_VALUE"
    out = pb.publish_aggregates(spark, {"a": scan(spark, rows=3), "b": TimeoutError("source unavailable")}, root=root, run_id="3")
    assert out.status == "partial" and out.path is None
    assert {r["source"]: r["status"] for r in out.sources.collect()} == {"a": "accepted", "b": "quarantined"}
    assert pb.read_published(spark, root).first()["value"] == 120.0 and pb.read_published(spark, root).count() == 1
    out = pb.publish_aggregates(spark, {"a": good, "b": good}, root=root, run_id="4")
    assert out.status == "stale"  # the same key in two sources
    out = pb.publish_aggregates(spark, {"a": scan(spark, rows=3), "b": ValueError("x")}, root=root, run_id="5", allow_partial=True)
    assert out.status == "partial" and pb.read_published(spark, root).count() == 3


def test_contract_drift(spark):
    now = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("c", "2", "z")], "source string, schema_version string, contract_digest string")
    then = spark.createDataFrame([("a", "1", "x"), ("b", "1", "old"), ("c", "1", "z")], "source string, schema_version string, contract_digest string")
    assert {r["source"]: r["contract_state"] for r in pb.contract_drift(now, then).collect()} == {"a": "SAME", "b": "DRIFTED", "c": "NEW"}
    assert pb.config_digest(CONFIG) != pb.config_digest({**CONFIG, "category": "food"})


def test_versions(spark):
    root = shared_folder(spark, "test")
    df = spark.createDataFrame([(2025, "Сургут", 1.0)], "year int, municipality_name string, rank double")
    report = ds.validation_report(df, "quality_rankings")
    kw = dict(dataset="quality_rankings", root=root, source_name="f", source_digest="d", entities=1, period="2025")
    pb.accept_version(df, ds.quality(report), accepted_at="2026-01-01", **kw)
    pb.accept_version(df.withColumn("rank", F.lit(2.0)), ds.quality(report), accepted_at="2026-01-02", **kw)
    assert pb.read_active(spark, root, "quality_rankings").first()["rank"] == 2.0
    assert pb.read_active(spark, root, "other", fallback=df).first()["rank"] == 1.0
    log = spark.read.parquet(f"{root}/intake_log")
    assert pb.recent_log(log, order=["accepted_at"], limit=1).first()["accepted_at"] == "2026-01-02"
    bad = ds.quality(ds.validation_report(df.drop("rank"), "quality_rankings"))
    with pytest.raises(ValueError, match="rejected"):
        pb.accept_version(df, bad, accepted_at="2026-01-03", **kw)


def report(spark, df, key):
    return {r["rule"]: r["n"] for r in ds.validation_report(df, key).collect()}


def test_validation_verdicts(spark):
    cols = ds.CONTRACTS["reference_core"].required
    good = spark.createDataFrame([(2025, "A", *[1.0] * 9), (2024, "A", *[1.0] * 9)], "year int, municipality_name string, " + ", ".join(f"{c} double" for c in cols[2:]))
    verdict = lambda df, key="reference_core": ds.quality(ds.validation_report(df, key)).first()["quality"]
    assert verdict(good) == "ACCEPTED"
    assert verdict(good.drop("total_expense")) == "REJECTED"
    assert verdict(good.unionByName(good)) == "REVIEW"
    assert report(spark, good.unionByName(good), "reference_core")["DUPLICATE_KEY"] == 4
    assert report(spark, good.withColumn("municipality_name", F.lit("71")), "reference_core")["NUMERIC_NAME"] == 2
    assert verdict(good.limit(0)) == "REJECTED"
    assert ds.dataset_summary(good).first()["period_label"] == "2024–2025"
    assert ds.dataset_status(None, "reference_core", uploaded=False, spark=spark).first()["quality"] == "MISSING"


def test_validation_of_plans(spark):
    cols = ds.CONTRACTS["budget_official_plan"].required
    base = dict.fromkeys(cols, 0.0) | {"year": 2025, "municipality_name": "A", "stage": "S", "source_url": "u", "publication_date": "d"}
    make = lambda **kw: spark.createDataFrame([tuple((base | kw)[c] for c in cols)], ", ".join(f"{c} {'int' if c == 'year' else 'string' if c in ('municipality_name', 'stage', 'source_url', 'publication_date') else 'double'}" for c in cols))
    ok = make(total_revenue=100.0, revenue_base=60.0, transfers=40.05, expenditure=110.0, deficit=10.0)
    assert sum(report(spark, ok, "budget_official_plan").values()) == 0
    off = report(spark, make(total_revenue=100.0, revenue_base=60.0, transfers=41.0, expenditure=110.0, deficit=9.0), "budget_official_plan")
    assert off["TOTAL_MISMATCH"] == 1 and off["DEFICIT_MISMATCH"] == 1
    assert report(spark, make(deficit=-1.0), "budget_official_plan")["NEGATIVE_DEFICIT"] == 1


def test_source_history(spark):
    rows = [
        ("a", 0, "candidate", "", "", None, None),
        ("a", 1, "connected", "me", "file", "d", None),
        ("a", 2, "validated", "me", "report", None, "r"),
        ("b", 0, "candidate", "", "", None, None),
        ("b", 1, "validated", "me", "x", None, "r"),
        ("c", 0, "candidate", "", "", None, None),
        ("c", 1, "connected", "me", "x", None, None),
        ("c", 3, "rejected", "me", "x", None, None),
        ("d", 0, "candidate", "", "", None, None),
        ("d", 1, "rejected", " ", "x", None, None),
    ]
    df = spark.createDataFrame(rows, "source_id string, seq int, status string, actor string, evidence string, artifact_sha256 string, validation_report string")
    got = {(r["source_id"], r["seq"]): r["problem"] for r in pb.check_transitions(df).collect() if r["problem"]}
    assert got == {("b", 1): "TRANSITION_NOT_ALLOWED", ("c", 1): "MISSING_DIGEST", ("c", 3): "SEQUENCE_GAP", ("d", 1): "MISSING_EVIDENCE"}
    assert {r["source_id"]: r["status"] for r in pb.current_status(df).collect()}["a"] == "validated"


def test_small_and_streamed_members_give_the_same_rows_and_one_reading_has_both_sides(spark, monkeypatch):
    from tesora.sources import faults

    def packed(*members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in members:
                archive.writestr(name, text)
        return buffer.getvalue()

    big = packed(("big.csv", "value; period\n" + "7;2024\n" * (faults.SMALL // 4)))
    files = [("a", packed(("a.csv", "period;value;more\n2024;1;x\n2025\n"))), ("b", packed(("b.csv", ""))), ("big", big), ("cut", big[:-30]), ("two", packed(("1.csv", ""), ("2.csv", "")))]
    parts = dl.unpacked_exports(spark.createDataFrame(files, "path string, content binary"), ["period", "value"])
    rows = [tuple(r) for r in parts.clean.where("path = 'a'").orderBy("line_no").collect()]
    assert rows == [("a", 1, "2024", "1"), ("a", 2, "2025", None)]
    assert parts.clean.where("path = 'big' AND period = '2024' AND value = '7'").count() == faults.SMALL // 4
    assert {r.path: r.reason_code for r in parts.quarantine.collect()} == {"cut": "BAD_ARCHIVE", "two": "NOT_ONE_CSV"}
    assert {(r.path, r.reason_code) for r in parts.marked.select("path", "reason_code").distinct().collect()} == {("a", None), ("big", None), ("cut", "BAD_ARCHIVE"), ("two", "NOT_ONE_CSV")}


def test_broken_exports_make_and_read_every_archive_once(spark):
    from tesora.plans.publishing import broken_exports

    plan = broken_exports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1 and "REPARTITION_BY_NUM" in plan
