"""Folders of spreadsheet workbooks (xlsx), one task per file.

A workbook is bounded by its format (about a million rows per sheet), so one file is a
sensible unit of work; a folder of any number of files is spread over the cluster.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CELL_SCHEMA = "path string, sheet string, row int, col int, value string"
# Built-in number formats that show dates, and the day zero of serial dates.
DATE_FORMATS = frozenset(range(14, 23)) | frozenset(range(45, 48))
DAY_ZERO = date(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter() if _local(f.tag) == "numFmt"
              and any(c in f.get("formatCode", "").lower() for c in ("yy", "dd"))}
    for block in root:
        if _local(block.tag) == "cellXfs":
            return {i for i, xf in enumerate(block) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | custom}
    return set()


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for node in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
        if _local(node.tag) == "sheet":
            rid = next(v for k, v in node.attrib.items() if _local(k) == "id")
            out.append((node.get("name"), "xl/" + rels[rid].removeprefix("/xl/")))
    return out


def read_cells(path: str, content: bytes) -> Iterator[tuple]:
    """Non-empty cells of all sheets as text; dates as ``yyyy-mm-dd``."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        texts, dates = _texts(archive), _date_styles(archive)
        for name, part in _sheets(archive):
            with archive.open(part) as stream:
                for _, cell in ElementTree.iterparse(stream):
                    tag = _local(cell.tag)
                    if tag == "row":
                        cell.clear()
                    if tag != "c":
                        continue
                    kind = cell.get("t", "n")
                    value = next((v.text for v in cell.iter() if _local(v.tag) == "v"), None)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                    if value is None:
                        continue
                    if kind == "s":
                        value = texts[int(value)]
                    elif kind == "n" and int(cell.get("s", 0)) in dates:
                        value = (DAY_ZERO + timedelta(days=int(float(value)))).isoformat()
                    ref = cell.get("r")
                    yield path, name, int("".join(c for c in ref if c.isdigit())) - 1, _column(ref), value


def parse_workbooks(files: DataFrame) -> DataFrame:
    """``(path, content)`` to long cells."""
    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for path, content in zip(page["path"], page["content"]):
                yield pd.DataFrame(list(read_cells(path, bytes(content))), columns=["path", "sheet", "row", "col", "value"])
    return files.select("path", "content").mapInPandas(batches, CELL_SCHEMA)


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(folder)
    return parse_workbooks(files)


def cells_to_long(cells: DataFrame, key: str = "series_id", value: str = "y_text") -> DataFrame:
    """Header in the first row and dates in the first column, as ``(key, date_text, value)``."""
    by_column = Window.partitionBy("path", "sheet", "col")
    by_row = Window.partitionBy("path", "sheet", "row")
    marked = cells.withColumn("header", F.max(F.when(F.col("row") == 0, F.col("value"))).over(by_column)).withColumn(
        "date_text", F.max(F.when(F.col("col") == 0, F.col("value"))).over(by_row))
    return marked.where((F.col("row") > 0) & (F.col("col") > 0) & F.col("header").isNotNull() & ~F.col("header").contains("Unnamed")).select(
        F.col("header").alias(key), "date_text", F.col("value").alias(value))
