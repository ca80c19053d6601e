"""Glossaries from CSV, ODS and XLSX files; spreadsheets are read with the standard library."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import split_terms
from ..operators.glossary import deduplicated

# Names of glossary columns, by role.
HEADERS = {
    "source": ("source", "source_term", "english", "en", "term", "原文", "英文", "英語", "來源", "source term"),
    "target": ("target", "target_term", "translation", "traditional chinese", "zh", "zh-tw", "zh_tw", "中文", "繁中", "繁體中文", "譯文", "翻譯", "target term"),
    "forbidden": ("forbidden", "forbidden_terms", "禁止", "禁用", "錯誤譯法"),
    "priority": ("priority", "severity", "重要性", "優先", "等級"),
    "domain": ("domain", "領域", "分類", "category"),
    "note": ("note", "備註", "說明", "comment"),
}
_TABLE, _OFFICE, _TEXT = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_MAIN, _LINK = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def roles(columns: list[str]) -> dict[str, int]:
    """Places of the roles among the headers of columns that hold something.

    An equal name counts first, in the order of the names; then the first header that
    contains a name of three and more letters. Without either, the source is the first
    column and the target the second.
    """
    plain = [c.replace("\n", " ").lower().strip() for c in columns]
    out = {}
    for role, names in HEADERS.items():
        equal = [plain.index(n) for n in names if n in plain]
        holds = [i for i, c in enumerate(plain) if any(len(n) >= 3 and n in c for n in names)]
        if equal or holds:
            out[role] = (equal or holds)[0]
    for role, place in (("source", 0), ("target", 1)):
        if place < len(columns):
            out.setdefault(role, place)
    return out


def _ods(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))
    for sheet in root.iter(f"{_TABLE}table"):
        rows = []
        for row in sheet.iter(f"{_TABLE}table-row"):
            cells: list[str] = []
            for cell in row:
                if cell.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                    continue
                text = "\n".join("".join(p.itertext()) for p in cell.findall(f"{_TEXT}p")) or cell.get(f"{_OFFICE}value", "")
                times = int(cell.get(f"{_TABLE}number-columns-repeated", "1"))
                cells += [text] * (times if text else min(times, 64))  # a sheet is padded with empty cells to its right end
            rows += [cells] * (int(row.get(f"{_TABLE}number-rows-repeated", "1")) if any(cells) else 1)
        yield sheet.get(f"{_TABLE}name", ""), rows


def _xlsx(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    shared = [words(e) for e in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    places = {e.get("Id"): e.get("Target", "").removeprefix("/").removeprefix("xl/") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        rows = []
        for row in ET.fromstring(book.read(f"xl/{places[sheet.get(f'{_LINK}id')]}")).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{_MAIN}c"):
                at = 0
                for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                value = cell.findtext(f"{_MAIN}v") or ""
                kind = cell.get("t", "")
                cells[at - 1 if at else len(cells)] = shared[int(value)] if kind == "s" and value else words(cell) if kind == "inlineStr" else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        yield sheet.get("name", ""), rows


def _sheets(name: str, content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        yield "csv", list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
    else:
        yield from {"ods": _ods, "xlsx": _xlsx}[kind](content)


def _entries(name: str, content: bytes) -> Iterator[tuple]:
    for sheet, rows in _sheets(name, content):
        rows = [r for r in rows if any(c.strip() for c in r)]
        if len(rows) < 2:
            continue
        head, body = rows[0], rows[1:]
        full = [i for i in range(len(head)) if any(len(r) > i and r[i].strip() not in ("", "nan") for r in body)]
        where = {role: full[i] for role, i in roles([head[i] for i in full]).items()}
        if not {"source", "target"} <= set(where):
            continue
        for r in body:
            yield (name, sheet, *(r[where[k]].strip() if k in where and where[k] < len(r) else "" for k in HEADERS))


def read_glossaries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entries of all glossaries (files, or folders of them), each entry once, numbered from the longest term down.

    Files are in the order of ``paths``, below a folder by name; a file is parsed in one task. Of equal
    entries (folded term, targets, forbidden terms) the first counts. Rows without a
    term or a target go, as do sheets without both columns; an unknown priority is medium.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_file", "_row", "source_file", "sheet", *HEADERS]
        for pdf in batches:
            for path, order, content in zip(pdf["path"], pdf["_order"], pdf["content"], strict=True):
                yield pd.DataFrame([(order, i, *e) for i, e in enumerate(_entries(path.rsplit("/", 1)[-1], content))], columns=names)

    out = None
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,ods,xlsx}").load(path).withColumn("_order", F.concat(F.lit(f"{k:06d}"), "path"))
        out = files if out is None else out.unionByName(files)
    rows = out.select("path", "_order", "content").mapInPandas(parse, "_file string, _row long, source_file string, sheet string, " + ", ".join(f"{k} string" for k in HEADERS))
    level = F.lower("priority")
    rows = rows.select("_file", "_row", F.col("source").alias("source_term"), split_terms(F.col("target")).alias("target_terms"), split_terms(F.col("forbidden")).alias("forbidden_terms"), F.when(level.isin("high", "medium", "low"), level).otherwise("medium").alias("priority"), "domain", "note", "source_file", "sheet")
    rows = rows.where((F.col("source_term") != "") & (F.lower("source_term") != "nan") & (F.size("target_terms") > 0))
    # A glossary is a dimension, so one window over it is no bottleneck.
    first = deduplicated(rows.withColumn("entry_pos", F.row_number().over(Window.orderBy("_file", "_row"))))
    longest = Window.orderBy(F.desc(F.length("source_term")), "_file", "_row")
    return first.withColumn("entry_pos", F.row_number().over(longest)).drop("_file", "_row")


def report(glossary: DataFrame) -> DataFrame:
    """The entries as a flat table, terms joined by bars."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    return glossary.orderBy("entry_pos").select("source_term", joined("target_terms"), joined("forbidden_terms"), "priority", "domain", "source_file", "sheet", "note")
