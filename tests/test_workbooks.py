"""Workbooks and registers of many years: round trips, other programs' ways of writing, broken files, many rows of a key."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill.sources.registers import register_of_years
from siftmill.sources.workbooks import MAIN, PARTS, column_number, names_under, sheet_lines, workbook, workbook_lines, workbooks


def with_sheet(sheet: str, shared: str | None = None) -> bytes:
    """A workbook with this sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in PARTS.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared is not None:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
    return out.getvalue()


def test_cells_come_back_as_they_were():
    lines = [["a", "b"], ["<&>\"'", None], [" two  blanks ", "line\nline\r\nline"], ["", "ümläut 😀"], []]
    assert [line for _, line in sheet_lines(workbook(lines))] == lines
    assert [n for n, _ in sheet_lines(workbook(lines))] == [1, 2, 3, 4, 5]


def test_places_shared_strings_and_runs():
    assert [column_number(r) for r in ("A1", "Z9", "AA10", "BC2", "XFD1")] == [0, 25, 26, 54, 16383]
    sheet = '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2"><v>4.50</v></c></row><row r="7"><c t="str"><v>f</v></c><c t="b"><v>1</v></c><c/></row>'
    shared = "<si><t>no</t></si><si><r><t>Ac</t></r><r><t>me</t></r><rPh><t>not said</t></rPh></si>"
    assert list(sheet_lines(with_sheet(sheet, shared))) == [(2, [None, "Acme", None, "4.50"]), (7, ["f", "1", None])]


def test_registers_in_workbooks(spark):
    titled = workbook([["Report for 2024", None], ["Province", " EMPLOYER "], ["ON", " Acme "], ["QC", "Acme"], ["QC", None], ["BC", "Beta"], ["short"]])
    other = workbook([["Employer"], ["Gamma"], ["Employer"]])
    files = spark.createDataFrame([("titled", titled), ("other", other), ("no heading", workbook([["x"], ["y"]])), ("broken", b"no zip"), ("none", None), ("empty", workbook([]))], "path string, content binary")
    got = names_under(workbook_lines(files), ["Employer"])
    # below its heading, a name that reads like one is a name
    assert sorted((r["path"], r["name"]) for r in got.collect()) == [("other", "Employer"), ("other", "Gamma"), ("titled", "Acme"), ("titled", "Beta")]


def test_export_splits_what_is_much_and_keeps_all(spark):
    rows = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") < 1_990, F.lit("cold")).alias("k"), "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t\x01<"), "id")).alias("t"))
    books = workbooks(rows, ["id"], ("k",), most=300).collect()
    assert sorted((b["k"] or "", b["book"], b["n_rows"]) for b in books) == [("", 0, 3), ("cold", 0, 300), ("cold", 1, 300), ("cold", 2, 64), *[("hot", n, 300) for n in range(4)], ("hot", 4, 133)]
    back = []
    for b in sorted(books, key=lambda b: (b["k"] or "", b["book"])):
        (_, head), *lines = sheet_lines(b["content"])
        assert head == ["k", "id", "t"] and len(lines) == b["n_rows"]
        back += [(b["k"], line) for _, line in lines]
    want = sorted(((r["k"], [r["k"], str(r["id"]), r["t"] and r["t"].replace("\x01", " ")]) for r in rows.collect()), key=lambda x: (x[0] or "", int(x[1][1])))
    assert back == want
    assert workbooks(rows.limit(0), ["id"], ("k",)).count() == 0


def test_registers_of_other_columns_by_year(spark, tmp_path):
    for year, text in ((2021, "﻿Employer,Town\nAcme,X\n Beta ,Y\n,Z\n"), (2022, "Year, EMPLOYER \n2022,Acme\n2022,Acme\n"), (2023, 'a.b`c,Employer Name\n1,"Gamma, Inc."\n'), (2024, "other\nDelta\n")):
        (tmp_path / f"{year}.csv").write_text(text, encoding="utf-8")
    files = {year: str(tmp_path / f"{year}.csv") for year in (2021, 2022, 2023, 2024)}
    got = register_of_years(spark, files, ["Employer", "employer name"], 3).collect()
    assert sorted(map(tuple, got)) == [("Acme", 2021, 2022, 2), ("Beta", 2021, 2021, 1), ("Gamma, Inc.", 2023, 2023, 1)]
    with pytest.raises(ValueError, match="fewer than 4"):
        register_of_years(spark, files, ["employer", "employer name"], 4)
    with pytest.raises(ValueError, match="no file"):
        register_of_years(spark, {2024: files[2024]}, ["employer"], 1)
