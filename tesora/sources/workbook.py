"""Spreadsheet cells as rows, and the adopted budget, sections and debt limits found in them."""

from __future__ import annotations

import itertools
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import parse_number
from tesora.operators.contracts import Split
from tesora.sources.faults import member_problem, opened

# Years of the adopted decision, row labels, unit words, and the debt sentence.
ADOPTED_YEARS = (2025, 2026, 2027)
PLAN_NOTES = {
    "exceptions": "PARSED_FROM_OFFICIAL_APP2",
    "limit": "generated from official source files; workbook unit preserved; debt limit parsed from decision DOCX",
    "no_limit": "generated from official source files; workbook unit preserved; debt limit not found in raw DOCX",
    "section": "top-level budget classification section",
}
TOTAL_WORD = "всего"
BASE_WORDS = ("налоговые и неналоговые доходы",)
SERVICE_WORDS = ("обслуживание", "долг")
THOUSANDS_WORDS = ("тыс", "руб")
DEBT_SENTENCE = r"(?i)на\s+01\.01\.(20\d{2})\s+в\s+объеме\s+([0-9 \u00a0]+,[0-9]{2})"
# Defaults of two parameters: rows in which a header and a unit are looked for.
HEADER_ROWS = 25
UNIT_ROWS = 20

#: Cells of one sheet kept until it has proved readable.
HELD_CELLS = 200_000

CELLS = "path string, row int, col int, text string, num double, problem string"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _place(ref: str | None, after: int) -> int:
    """Column of a cell reference in base 26; a cell without one follows its neighbour."""
    letters = (ref or "").rstrip("0123456789")
    if not letters:
        return after + 1
    return sum((ord(letter) - 64) * 26**i for i, letter in enumerate(reversed(letters))) - 1


def _finished(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one name as they end, each forgotten afterwards: a sheet is never whole in memory."""
    steps = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(steps)
    for event, element in steps:
        if event == "end" and element.tag == _NS + tag:
            yield element
            element.clear()
            root.clear()


def _all_text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(_NS + "t"))


def _sheet_member(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The archive member of a sheet, by its name or its place in the workbook."""
    listed = book.namelist()
    if "xl/workbook.xml" not in listed:
        return "xl/worksheets/sheet1.xml"
    sheets = [(s.get("name"), s.get(_REL + "id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet")]
    relation = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return posixpath.normpath(posixpath.join("/xl", targets[relation])).lstrip("/")


def _number(stored: str) -> tuple[str, float | None]:
    try:
        num = float(stored)
    except ValueError:
        return stored, None
    return (str(int(num)) if num.is_integer() else str(num)), num


def _sheet_cells(book: zipfile.ZipFile, sheet: str | int = 0) -> Iterator[tuple[int, int, str | None, float | None]]:
    """Non-empty cells of one sheet; stored results of formulas are read as they are."""
    member, common = _sheet_member(book, sheet), []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            common = [_all_text(item) for item in _finished(stream, "si")]
    readers = {
        "s": lambda v: (common[int(v)], None),
        "b": lambda v: ("True", 1.0) if v == "1" else ("False", 0.0),
    }
    with book.open(member) as stream:
        for r, row in enumerate(_finished(stream, "row")):
            at = -1
            for cell in row.iter(_NS + "c"):
                at = _place(cell.get("r"), at)
                if cell.get("t") == "inlineStr":
                    yield r, at, _all_text(cell), None
                    continue
                stored = cell.findtext(_NS + "v")
                if stored:
                    yield r, at, *readers.get(cell.get("t"), _number)(stored)


def _sound_cells(content: bytes | None, sheet: str | int) -> Iterator[tuple]:
    """All cells of a sheet, or one row with the reason why it cannot be read; never some cells of a broken sheet.

    A sheet of up to ``HELD_CELLS`` cells is kept until its end is reached; a
    longer one is read through once before its cells come out of a second reading.
    """
    with opened(content) as (book, problem):
        if book is None:
            yield None, None, None, None, "UNSUPPORTED_WORKBOOK" if problem == "BAD_ARCHIVE" else problem
            return
        for name in book.namelist():
            if name.endswith((".xml", ".rels")) and (problem := member_problem(book, name)):
                yield None, None, None, None, problem
                return
        try:
            cells = _sheet_cells(book, sheet)
            held = list(itertools.islice(cells, HELD_CELLS))
            if len(held) == HELD_CELLS:
                for _ in cells:
                    pass
                held = _sheet_cells(book, sheet)
        except (KeyError, ElementTree.ParseError):
            yield None, None, None, None, "UNSUPPORTED_WORKBOOK"
            return
        except (IndexError, ValueError):  # a sheet, string or cell that the workbook names and does not have
            yield None, None, None, None, "BAD_REFERENCE"
            return
        for cell in held:
            yield *cell, None


def _scan(batches: Iterator[pd.DataFrame], sheet: str | int = 0) -> Iterator[pd.DataFrame]:
    names = ["path", "row", "col", "text", "num", "problem"]
    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for cell in _sound_cells(content, sheet):
                rows.append((path, *cell))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names).astype({"num": "float64"})
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"num": "float64"})


def workbook_cells(files: DataFrame, *, sheet: str | int = 0) -> Split:
    """Long cells of one sheet, by name or place, of a fleet of workbooks.

    Files that are no xlsx (such as .xls) or lack the sheet go aside, and so do
    encrypted, damaged and inconsistent ones, each with its reason and whole.
    """
    cells = files.select("path", "content").mapInPandas(lambda batches: _scan(batches, sheet), CELLS)
    return Split(
        cells.where(F.col("problem").isNull()).drop("problem"),
        cells.where(F.col("problem").isNotNull()).select("path", F.col("problem").alias("reason_code")),
    )


# ---- row labels --------------------------------------------------------------


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def _has(label: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & label.contains(w)
    return out


def _sheet_rows(cells: DataFrame, on: Sequence[str], years: Sequence[int], header_rows: int) -> DataFrame:
    """One row per sheet row: joined label, (col, amount) of its numbers, and (col, year) if it may be the header.

    A sheet row has a bounded number of cells, which are collected once.
    """
    rows = cells.groupBy(*on, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "num"))).alias("c"))
    words = F.filter(F.transform("c", lambda x: _clean(x["text"])), lambda t: t != "")
    amounts = F.transform("c", lambda x: F.struct(x["col"].alias("col"), F.coalesce(x["num"], parse_number(x["text"])).alias("amount")))
    named = [
        F.struct(F.lit(int(y)).alias("year"), F.array_max(F.transform(F.filter("c", lambda x: x["text"].rlike(rf"(?<!\d){y}(?!\d)")), lambda x: x["col"])).alias("col"))
        for y in years
    ]
    head = F.when(F.col("row") < header_rows, F.filter(F.array(*named), lambda h: h["col"].isNotNull()))
    label = F.array_join(words, " | ")
    return rows.select(
        *on, "row", "c", label.alias("label"), _plain(label).alias("plain"),
        F.filter(amounts, lambda x: x["amount"].isNotNull()).alias("amounts"), F.coalesce(head, F.expr("slice(array(named_struct('year', 0, 'col', 0)), 1, 0)")).alias("head"),
    )


def _header() -> Column:
    """The row naming most of the years, the first such row."""
    n = F.size("head")
    return F.min(F.when(n > 0, F.struct((-n).alias("missed"), F.col("row"), F.col("head")))).alias("best")


def _amount_at(amounts: Column, col: Column) -> Column:
    return F.get(F.transform(F.filter(amounts, lambda x: x["col"] == col), lambda x: x["amount"]), F.lit(0))


def unit_scale(cells: DataFrame, doc: Sequence[str], *, rows: int = UNIT_ROWS) -> DataFrame:
    """1000 when the first ``rows`` rows mention thousands of roubles, otherwise 1; one row per document."""
    head = cells.withColumn("_p", F.when(F.col("row") < rows, _plain(_clean(F.col("text")))))
    said = [F.max(F.col("_p").contains(w)) for w in THOUSANDS_WORDS]
    return head.groupBy(*doc).agg(F.when(said[0] & said[1], 1000.0).otherwise(1.0).alias("unit_scale"))


def adopted_budget(
    cells: DataFrame,
    *,
    doc: Sequence[str] = ("municipality_name",),
    part: str = "part",
    years: Sequence[int] = ADOPTED_YEARS,
    header_rows: int = HEADER_ROWS,
) -> Split:
    """Adopted budget per document and year, from revenue, financing and expenditure sheets.

    ``part`` names the sheet (``revenue``, ``financing``, ``expenditure``); its
    header is looked for in the first ``header_rows`` rows. Every document comes
    out with every year: clean, or aside with what it lacks.
    """
    c, plain, on = F.col, F.col("plain"), [*doc, part]
    sale = plain.contains("продаж") & (plain.contains("акци") | plain.contains("участи") | plain.contains("капитал"))
    marks = {
        "total": plain.contains(TOTAL_WORD),
        "base": (c(part) == "revenue") & _has(plain, BASE_WORDS),
        "service": (c(part) == "expenditure") & _has(plain, SERVICE_WORDS),
        "special": (c(part) == "financing") & (_has(plain, ("изменен", "остат")) | sale),
    }
    rows = _sheet_rows(cells, on, years, header_rows).withColumns(marks)
    wanted = c("total") | c("base") | c("service") | c("special")
    line = F.when(wanted, F.struct(F.length("label").alias("n"), "row", "amounts", *marks))
    sheets = rows.groupBy(*on).agg(_header(), F.sort_array(F.collect_list(line)).alias("lines"))
    sheets = sheets.withColumn("head", F.col("best.head"))
    yearly = lambda x: F.transform("head", lambda h: _amount_at(x["amounts"], h["col"]))
    whole = lambda x: F.forall(yearly(x), lambda a: a.isNotNull())
    first = lambda test: F.get(F.transform(F.filter("lines", test), yearly), F.lit(0))
    # lines are sorted by the length of their label, so the first one is the shortest
    found = sheets.select(
        *on,
        "head",
        first(lambda x: x["total"] & whole(x)).alias("total"),
        first(lambda x: x["base"]).alias("base"),
        first(lambda x: x["service"]).alias("service"),
        F.transform(F.filter("lines", lambda x: x["special"]), yearly).alias("special"),
    )
    dated = found.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    dated = dated.withColumn("at", F.array_position(F.transform("head", lambda h: h["year"]), c("year")).cast("int"))
    pick = lambda name: F.when(c("at") > 0, F.try_element_at(c(name), c("at")))
    above = F.transform("special", lambda a: F.greatest(F.coalesce(F.try_element_at(a, c("at")), F.lit(0.0)), F.lit(0.0)))
    extra = F.when(c("at") > 0, F.aggregate(above, F.lit(0.0), lambda x, y: x + y))
    flat = dated.select(*on, "year", c("at").isNotNull().alias("headed"), *[pick(n).alias(n) for n in ("total", "base", "service")], extra.alias("extra"))
    of = lambda sheet, name: F.max(F.when(c(part) == sheet, c(name)))
    out = flat.groupBy(*doc, "year").agg(
        F.max("headed").alias("headed"),
        of("revenue", "total").alias("total_revenue"),
        of("revenue", "base").alias("revenue_base"),
        of("expenditure", "total").alias("expenditure"),
        F.abs(of("financing", "total")).alias("financing_sources"),
        F.coalesce(of("financing", "extra"), F.lit(0.0)).alias("eligible_exceptions"),
        F.coalesce(of("expenditure", "service"), F.lit(0.0)).alias("debt_service"),
    )
    out = out.withColumns(
        {"transfers": c("total_revenue") - c("revenue_base"), "deficit": F.greatest(c("expenditure") - c("total_revenue"), F.lit(0.0))}
    )
    needed = ("total_revenue", "revenue_base", "expenditure", "financing_sources")
    gap = F.coalesce(F.when(~c("headed"), "MISSING_HEADER"), *[F.when(c(n).isNull(), F.lit(f"MISSING_{n.upper()}")) for n in needed])
    amounts = ("total_revenue", "revenue_base", "transfers", "expenditure", "financing_sources", "eligible_exceptions", "debt_service", "deficit")
    marked = out.select(*doc, "year", *amounts, gap.alias("reason_code"))
    return Split(marked.where(c("reason_code").isNull()).drop("reason_code"), marked.where(c("reason_code").isNotNull()))


def expenditure_sections(
    cells: DataFrame,
    *,
    doc: Sequence[str] = ("municipality_name",),
    years: Sequence[int] = ADOPTED_YEARS,
    header_rows: int = HEADER_ROWS,
) -> Split:
    """Two-digit section rows: code, the next text cell as name, first amount per year and code.

    Documents without a header or without any section go aside.
    """
    rows = _sheet_rows(cells, doc, years, header_rows)
    text = F.transform("c", lambda x: F.struct(x["col"].alias("col"), _clean(x["text"]).alias("t")))
    code = F.get(F.filter(text, lambda x: x["t"].rlike("^[0-9]{2}$")), F.lit(0))
    rows = rows.withColumns({"text": text, "code": code})
    is_name = lambda x: (x["col"] > F.col("code.col")) & (x["t"] != "") & parse_number(x["t"]).isNull() & ~x["t"].rlike("^[0-9]+$")
    rows = rows.withColumn("name", F.get(F.filter("text", is_name), F.lit(0))["t"])
    line = F.when(F.col("name").isNotNull(), F.struct("row", F.col("code.t").alias("code"), "name", "amounts"))
    sheets = rows.groupBy(*doc).agg(_header(), F.collect_list(line).alias("lines"))
    both = sheets.select(*doc, F.col("best.head").alias("head"), F.explode("lines").alias("x")).select(*doc, "x", F.explode("head").alias("h"))
    amount = _amount_at(F.col("x.amounts"), F.col("h.col"))
    found = both.select(*doc, F.col("h.year").alias("year"), F.col("x.code").alias("section_code"), F.struct("x.row", "x.name", amount.alias("amount")).alias("f"))
    first = found.where("f.amount is not null").groupBy(*doc, "year", "section_code").agg(F.min("f").alias("f"))
    clean = first.select(*doc, "year", "section_code", F.col("f.name").alias("section_name"), F.col("f.amount").alias("amount"))
    why = F.when(F.col("best").isNull(), "MISSING_HEADER").when(F.size("lines") == 0, "MISSING_SECTIONS")
    return Split(clean, sheets.select(*doc, why.alias("reason_code")).where("reason_code is not null"))


# ---- decision text -----------------------------------------------------------


def debt_limits(documents: DataFrame, *, doc: Sequence[str], text: str = "text") -> DataFrame:
    """Debt limit per document and year: the sum named for 1 January Y belongs to year Y - 1.

    The last mention of a date counts.
    """
    body = F.translate(F.col(text), "\u00a0ёЁ", " еЕ")
    dates = F.regexp_extract_all(body, F.lit(DEBT_SENTENCE), F.lit(1))
    sums = F.regexp_extract_all(body, F.lit(DEBT_SENTENCE), F.lit(2))
    rows = documents.select(*doc, F.posexplode(F.arrays_zip(dates.alias("d"), sums.alias("s"))).alias("pos", "m"))
    rows = rows.select(*doc, "pos", F.col("m.d").cast("int").alias("d"), parse_number("m.s").alias("amount"))
    rows = rows.where(F.col("amount").isNotNull())
    return rows.groupBy(*doc, (F.col("d") - 1).alias("year")).agg(F.max_by("amount", "pos").alias("debt_limit"))


# ---- plan and structure rows -------------------------------------------------

# Labels and notes of the generated budget rows.
_LINE_TEMPLATES = (
    ("REVENUE", "Собственные доходы", "Доходы без безвозмездных поступлений", "revenue_base", 0,
     "generated from official workbook"),
    ("REVENUE", "Безвозмездные поступления", "Безвозмездные поступления", "transfers", 1,
     "total revenue minus tax and non-tax revenue"),
    ("FINANCING", "Источники финансирования", "Источники финансирования дефицита", "financing_sources", 0,
     "generated from official workbook"),
    ("EXCEPTION", "Допустимые исключения", "Проверенные специальные источники", "eligible_exceptions", 0,
     "positive change in balances / equity-sale receipts parsed by label"),
)


def plan_rows(
    budgets: DataFrame, scales: DataFrame, limits: DataFrame | None, *, doc: Sequence[str] = ("municipality_name",)
) -> DataFrame:
    """Plan rows with stage and debt limit in workbook units. The first year is adopted, the rest planned."""
    first = Window.partitionBy(*doc)
    df = budgets.join(scales, list(doc), "left")
    if limits is not None:
        df = df.join(limits, [*doc, "year"], "left")
    else:
        df = df.withColumn("debt_limit", F.lit(None).cast("double"))
    stage = F.when(F.col("year") == F.min("year").over(first), "ADOPTED").otherwise("PLAN_PERIOD")
    return df.withColumns(
        {
            "stage": stage,
            "debt_upper_limit": F.coalesce(F.col("debt_limit") / F.coalesce("unit_scale", F.lit(1.0)), F.lit(0.0)),
            "exceptions_status": F.lit(PLAN_NOTES["exceptions"]),
            "notes": F.when(F.col("debt_limit").isNotNull(), PLAN_NOTES["limit"]).otherwise(PLAN_NOTES["no_limit"]),
        }
    ).drop("debt_limit", "unit_scale")


def structure_rows(budgets: DataFrame, sections: DataFrame, *, doc: Sequence[str] = ("municipality_name",)) -> DataFrame:
    """Budget lines: four templates per budget, and one line per expenditure section."""
    lines = F.array(
        *[
            F.struct(
                F.lit(side).alias("budget_side"),
                F.lit(group).alias("group"),
                F.lit(item).alias("item_name"),
                F.col(amount).alias("amount"),
                F.lit("").alias("item_code"),
                F.lit(transfer).alias("is_transfer"),
                F.lit(0).alias("is_debt_service"),
                F.lit(note).alias("notes"),
            )
            for side, group, item, amount, transfer, note in _LINE_TEMPLATES
        ]
    )
    fixed = budgets.select(*doc, "year", F.inline(lines))
    spent = sections.select(
        *doc,
        "year",
        F.lit("EXPENDITURE").alias("budget_side"),
        F.col("section_name").alias("group"),
        F.col("section_name").alias("item_name"),
        "amount",
        F.col("section_code").alias("item_code"),
        F.lit(0).alias("is_transfer"),
        _plain(F.col("section_name")).contains("долг").cast("int").alias("is_debt_service"),
        F.lit(PLAN_NOTES["section"]).alias("notes"),
    )
    return fixed.unionByName(spent).withColumns({"is_borrowing": F.lit(0), "flexibility": F.lit("UNKNOWN")})
