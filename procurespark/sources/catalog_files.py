"""Supplier catalogs in files: delimited text, spreadsheets, and documents for an extractor."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.functions.text import strip
from procurespark.schemas import EXTRACTED_PRODUCT
from procurespark.sources.delimited import read_delimited_parts

FIELDS = ["supplier_sku", "name", "category", "brand", "mpn", "pack_size", "cost", "currency", "stock", "lead_time_days", "specs"]
EXTRACTOR_CHARS = 120_000
DEFAULTS = {"currency": "CNY", "specs": "{}"}
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Rows of a delimited file with a header, all strings; a byte order mark is dropped.

    The delimiter is a comma whatever the suffix, as catalogs named .tsv also come.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("sep", delimiter).option("encoding", "UTF-8").csv(path)
    return raw.toDF(*(c.removeprefix("﻿").strip() for c in raw.columns))


def _sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cell values of the active sheet of a workbook, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        workbook = ET.fromstring(book.read("xl/workbook.xml"))
        view = workbook.find("m:bookViews/m:workbookView", _NS)
        sheets = workbook.findall("m:sheets/m:sheet", _NS)
        chosen = sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(f"{{{_NS['r']}}}id")
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen]
        sheet = ET.fromstring(book.read(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)))
    rows = []
    for row in sheet.iterfind("m:sheetData/m:row", _NS):
        cells: list[str | None] = []
        for cell in row.iterfind("m:c", _NS):
            at = 0
            for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                at = 26 * at + ord(letter) - 64
            at = at or len(cells) + 1
            cells += [None] * (at - 1 - len(cells))
            value = cell.find("m:v", _NS)
            if cell.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
            elif value is None:
                cells.append(None)
            else:
                cells.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
        rows.append(cells)
    return rows


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the active sheet of each workbook, cached values by header; a column that a workbook lacks takes its default."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = _sheet_rows(content)
                header = [str(h).strip() if h is not None else "" for h in rows[0]] if rows else []
                absent = [(f, v) for f, v in DEFAULTS.items() if f not in header]
                yield pd.DataFrame({"cells": [[*((h, None if v is None else str(v)) for h, v in zip(header, row, strict=False) if h), *absent] for row in rows[1:]]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "cells array<struct<key:string,value:string>>")
    cells = F.map_from_entries("cells")
    return raw.select(*(F.try_element_at(cells, F.lit(f)).alias(f) for f in FIELDS))


def parsed_specs(text: Column) -> Column:
    """A JSON object of strings; other text is kept under ``_raw``."""
    said = F.nullif(text, F.lit(""))
    return F.coalesce(F.from_json(F.when(F.try_parse_json(said).isNotNull(), said), "map<string,string>"), F.when(said.isNotNull(), F.create_map(F.lit("_raw"), said)))


def coerce_products(raw: DataFrame) -> DataFrame:
    """Strings as typed products and ``valid``.

    Unknown columns are dropped, empty cells are null, and a missing currency or specs
    column takes its default. A row is not valid if a field that must be filled is not
    (an empty cell is not filled, even where a missing column has a default) or a number can't be read.
    """
    have = lambda c: c in raw.columns
    cell = {c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) if have(c) else F.lit(None).cast("string") for c in FIELDS}
    kinds = {"cost": "double", "stock": "int", "lead_time_days": "int"}
    out = {c: cell[c].try_cast(kinds[c]) if c in kinds else cell[c] for c in FIELDS}
    out["specs"] = parsed_specs(cell["specs"]) if have("specs") else F.create_map().cast("map<string,string>")
    out["currency"] = cell["currency"] if have("currency") else F.lit("CNY")
    filled = [out[c].isNotNull() for c in ("supplier_sku", "name", "currency", "specs")]
    numbers = [cell[c].isNull() | out[c].isNotNull() for c in kinds]
    valid = filled[0]
    for c in [*filled[1:], *numbers]:
        valid = valid & c
    return raw.select(*(out[c].alias(c) for c in FIELDS), valid.alias("valid"))


def validated(products: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Valid rows; FAILFAST raises at the first other row, as a whole file is refused, PERMISSIVE leaves them out."""
    if mode == "FAILFAST":
        return products.filter(F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("invalid product row: "), F.to_json(F.struct("supplier_sku", "name")))).cast("boolean"))).drop("valid")
    return products.filter("valid").drop("valid")


def _pieces(text: str, chars: int) -> Iterator[str]:
    """A text in pieces of at most ``chars`` characters, cut behind a line end where there is one, else behind a blank."""
    at = 0
    while len(text) - at > chars:
        end = next((e for e in (text.rfind(mark, at, at + chars) + 1 for mark in ("\n", " ")) if e), at + chars)
        yield text[at:end]
        at = end
    yield text[at:]


def extract_documents(spark: SparkSession, path: str, extract: Callable[[str], list[dict]], chars: int = EXTRACTOR_CHARS) -> DataFrame:
    """Products from unstructured documents by ``extract``, a client's function from text to records.

    Documents are read whole; the function sees at most ``chars`` characters at once, which is
    the extractor's own limit, and longer documents piece by piece, lines kept whole. Records that don't fit the schema are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in (piece for document in frame["value"] for piece in _pieces(document, chars)):
                found = [r for r in extract(text) if r.get("supplier_sku") and r.get("name")]
                rows = [{f: (r.get(f) if f != "specs" else {k: str(v) for k, v in (r.get(f) or {}).items()}) for f in FIELDS} | {"currency": r.get("currency", "CNY")} for r in found]
                yield pd.DataFrame(rows, columns=FIELDS)

    return spark.read.text(path, wholetext=True).mapInPandas(run, EXTRACTED_PRODUCT)


def read_eval_products(spark: SparkSession, path: str) -> DataFrame:
    """Products to evaluate matching with: ``key, category, name, brand, mpn, specs``; other columns are dropped."""
    raw = read_delimited(spark, path)
    cell = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    return raw.select(strip(F.col("key")).alias("key"), *(cell(c).alias(c) for c in ("category", "name", "brand", "mpn")), F.coalesce(parsed_specs(cell("specs")), F.create_map().cast("map<string,string>")).alias("specs"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: ``a_key, b_key, kind``."""
    return read_delimited(spark, path).select(*(strip(F.col(c)).alias(c) for c in ("a_key", "b_key", "kind")))


def read_catalog(spark: SparkSession, path: str, extract: Callable[[str], list[dict]] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Products of a catalog file, by its suffix; anything but a table goes to ``extract``."""
    suffix = posixpath.splitext(path.lower())[1]
    if suffix in (".csv", ".tsv"):
        return validated(coerce_products(read_delimited_parts(spark, path)), mode)
    if suffix in (".xlsx", ".xlsm"):
        return validated(coerce_products(read_spreadsheet(spark, path)), mode)
    if extract is None:
        raise ValueError(f"{suffix or 'this file'} needs an extractor")
    return extract_documents(spark, path, extract)
