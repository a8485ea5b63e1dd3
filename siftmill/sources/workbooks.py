"""Workbooks (.xlsx) written and read by tasks: exports a person opens, and registers that are published as such."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.ordering import placed
from siftmill.sources.sinks import cell

#: The parts of a workbook with one sheet, and the names of its mark-up.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
ROWS = "path string, row long, cells array<string>"


def column_number(reference: str) -> int:
    """The place, from 0, of the column that a cell's reference begins with: A is 0, AA is 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def workbook(lines: Iterable[list[str | None]]) -> bytes:
    """A workbook of one sheet with these lines of text cells; None is a cell left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in PARTS.items():
            book.writestr(name, XML + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{XML}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for line in lines:
                cells = "".join("<c/>" if text is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>' for text in line)
                sheet.write(f"<row>{cells}</row>".encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _texts(element) -> str:
    """The text of a cell or shared string, without what it says of pronunciation."""
    return "".join(t.text or "" for run in (element, *element.findall(f"{{{MAIN}}}r")) for t in run.findall(f"{{{MAIN}}}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_texts(e) for _, e in ElementTree.iterparse(part) if e.tag == f"{{{MAIN}}}si"]


def sheet_lines(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """The number and the cells of each line of a workbook's first sheet, numbers as they are written."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{{{MAIN}}}sheets/{{{MAIN}}}sheet").get(f"{{{RELATIONS}}}id")
        target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first)
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            at = 0
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                at = int(row.get("r") or at + 1)
                line: list[str | None] = []
                for cell in row.findall(f"{{{MAIN}}}c"):
                    place = column_number(cell.get("r")) if cell.get("r") else len(line)
                    line += [None] * (place + 1 - len(line))
                    value, inline = cell.find(f"{{{MAIN}}}v"), cell.find(f"{{{MAIN}}}is")
                    if inline is not None:
                        line[place] = _texts(inline)
                    elif value is not None and value.text is not None:
                        line[place] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                row.clear()
                yield at, line


def workbooks(df: DataFrame, order: list[Column | str], keys: tuple[str, ...] = (), most: int = 10_000) -> DataFrame:
    """``df`` as workbooks of at most ``most`` rows in an order, for each value of ``keys``: keys, book (from 0), n_rows
    and content. A line of the columns' names comes first. A task holds one book, however many rows a key has."""
    at = placed(df, order, keys)
    texts = [cell(c).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    rows = at.select(*keys, F.floor((F.col("place") - 1) / most).cast("int").alias("_book"), F.col("place").alias("_place"), *texts)
    head = list(df.columns)

    def made(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        body = group[[f"_c{i}" for i in range(len(head))]].itertuples(index=False, name=None)
        content = workbook(chain([head], ([None if pd.isna(t) else t for t in line] for line in body)))
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), group["_book"].iloc[0], len(group), content]])

    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "book int, n_rows long, content binary"])
    return rows.groupBy(*keys, "_book").applyInPandas(made, schema)


def workbook_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The lines of the first sheets of ``files`` (such as Spark's binaryFile reads): path, row and cells. A file that is
    no workbook gives none; each is read by one task, a sheet having at most 2^20 lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                lines: list[tuple[str, int, list[str | None]]] = []
                try:
                    for row, cells in sheet_lines(data if data is not None else b""):
                        lines.append((name, row, cells))
                        if len(lines) == 5_000:
                            yield pd.DataFrame(lines, columns=["path", "row", "cells"])
                            lines = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass  # what was read of a broken sheet stays
                yield pd.DataFrame(lines, columns=["path", "row", "cells"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInPandas(read, ROWS)


def names_under(lines: DataFrame, headings: list[str], most_titles: int = 10) -> DataFrame:
    """The names below a heading: path and name, each once.

    Of each file the first of at most ``most_titles`` lines with a cell that says one of ``headings`` (blanks and case
    apart) is its heading; what stands above is a title. Files without one give nothing, and blank cells are no names."""
    said = F.transform("cells", lambda c: F.lower(F.trim(c)))
    wanted = F.array(*[F.lit(h.strip().lower()) for h in headings])
    place = F.array_min(F.transform(wanted, lambda h: F.nullif(F.coalesce(F.array_position(said, h), F.lit(0)), F.lit(0))))
    heads = lines.filter(F.col("row") <= most_titles).select(F.col("path").alias("_path"), F.col("row").alias("_row"), place.alias("_place")).filter("_place IS NOT NULL")
    heads = heads.groupBy("_path").agg(F.min("_row").alias("_head"), F.min_by("_place", "_row").alias("_place"))
    below = lines.join(heads, lines["path"] == heads["_path"]).filter("row > _head")
    return below.select("path", F.trim(F.expr("try_element_at(cells, CAST(_place AS INT))")).alias("name")).filter("name <> ''").distinct()
