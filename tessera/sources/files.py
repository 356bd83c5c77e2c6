"""Folders of files as a DataFrame of texts."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.lexicons import SUFFIXES
from tessera.functions.text import html_to_text, markdown_to_text
from tessera.session import bounded, ship

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``source, suffix, file_modified, size, path`` of the files below a folder that can be indexed.

    Suffixes count in any case. Only the listing is read, not the contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    listed = files.select("path", F.col("modificationTime").alias("file_modified"), F.col("length").alias("size"), suffix.alias("suffix"))
    return listed.filter(F.col("suffix").isin(SUFFIXES)).withColumn("source", relative(F.col("path"), folder))


def relative(path: Column, folder: str) -> Column:
    """The path below the folder; the name alone for files elsewhere."""
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_extract(path, rf"^[a-zA-Z]*:?/*\Q{root}\E/(.*)$", 1)
    return F.when(below != "", below).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def json_text(content: bytes) -> str:
    """JSON with an indent of two."""
    return json.dumps(json.loads(content.decode("utf-8")), indent=2, ensure_ascii=False)


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    told = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.findall(f"{_WORD}p"))
    return "\n".join(p for p in told if p.strip())


def row_text(frame: pd.DataFrame) -> list[str]:
    """``column: value`` of each cell that isn't null; rows of nulls only are left out."""
    lines = (", ".join(f"{c}: {v}" for c, v in row.items() if pd.notna(v)) for _, row in frame.iterrows())
    return [line for line in lines if line]


def csv_text(content: bytes) -> str:
    return "\n".join(row_text(pd.read_csv(io.BytesIO(content))))


def xlsx_text(content: bytes) -> str:
    """Each sheet's name and rows, from the workbook's XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        lines = []
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = links[sheet.get(f"{_LINK}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                cells = {}
                for cell in row.iter(f"{_SHEET}c"):
                    column = "".join(x for x in cell.get("r", "") if x.isalpha())
                    value, inline = cell.find(f"{_SHEET}v"), cell.find(f"{_SHEET}is")
                    if inline is not None:
                        cells[column] = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t"))
                    elif value is not None:
                        cells[column] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                rows.append(cells)
            lines.append(f"Sheet: {sheet.get('name')}")
            head = rows[0] if rows else {}
            for cells in rows[1:]:
                line = ", ".join(f"{head[c]}: {v}" for c, v in cells.items() if c in head)
                if line:
                    lines.append(line)
    return "\n".join(lines)


#: Formats that need a parser; the rest are native expressions.
PARSERS = {".json": json_text, ".docx": docx_text, ".csv": csv_text, ".xlsx": xlsx_text}


@F.pandas_udf(T.StringType())
def _parsed(suffix: pd.Series, content: pd.Series) -> pd.Series:
    def one(kind: str, data: bytes) -> str | None:
        try:
            return PARSERS[kind](bytes(data))
        except Exception:  # a broken file is left out, whatever is wrong with it
            return None

    return pd.Series([one(k, d) for k, d in zip(suffix, content, strict=True)], dtype=object)


#: What a parser gives for each page of a document: its text, its tables' rows of cells, and the sizes of its images.
PAGE = "page int, text string, tables array<array<array<string>>>, images array<struct<width: int, height: int>>"
Parser = Callable[[bytes], list[dict]]
#: Bytes of files, and pages, that leave a task in one batch, about.
PAGES_BYTES, PAGES_ROWS = 4 * 1024 * 1024, 10_000


def pages_of(files: DataFrame, parse: Parser) -> DataFrame:
    """``source, page, text, tables, images`` of ``files(source, content)`` by a parser such as one for PDF.

    ``parse`` takes a file's bytes and returns its pages in order as dicts of ``text``,
    ``tables`` and ``images``, each of which may be lacking; pages are numbered from 1. A file
    that it can't read has no pages.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for source, content in zip(batch.column("source").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = parse(bytes(content))
                except Exception:  # a broken file is left out, whatever is wrong with it
                    continue
                held += [(source, i, p.get("text") or "", p.get("tables") or [], p.get("images") or []) for i, p in enumerate(found, 1)]
                size += len(content)
                if size > PAGES_BYTES or len(held) > PAGES_ROWS:
                    yield _page_batch(held)
                    held, size = [], 0
        if held:
            yield _page_batch(held)

    return bounded(files.select("source", "content")).mapInArrow(read, f"source string, {PAGE}")


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))), pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(x, k, from_pandas=True) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["source", "page", "text", "tables", "images"])


def pages_text(pages: DataFrame, plain: bool = False) -> DataFrame:
    """``source, text`` of ``pages_of``: the pages that have text, then all tables, then all images, each by its page.

    ``plain`` takes the pages' texts alone, a line between them.
    """
    own = F.struct("page", "text", "tables", "images")
    held = pages.groupBy("source").agg(F.sort_array(F.collect_list(own)).alias("p"))  # the pages of one file
    if plain:
        return held.select("source", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    told = F.transform(F.filter("p", lambda x: x["text"] != ""), lambda x: F.concat(F.lit("[Page "), x["page"].cast("string"), F.lit("]\n"), x["text"]))
    body = F.array_join(told, "\n\n")
    tables = F.flatten(F.transform("p", lambda x: F.transform(F.filter(x["tables"], lambda t: F.size(t) > 0), lambda t: table_text(x["page"], t))))
    images = F.flatten(F.transform("p", lambda x: F.transform(x["images"], lambda i: image_text(x["page"], i["width"], i["height"]))))
    first = F.when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))
    return held.select("source", F.array_join(F.concat(first, tables, images), "\n").alias("text"))


def text_of(suffix: Column, content: Column) -> Column:
    """Text of a file; null if it can't be read (.doc and .pdf without a parser, broken archives)."""
    plain = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else content.cast("string")
    plain = F.coalesce(plain, F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", ""))
    return (
        F.when(suffix.isin(*PARSERS), _parsed(suffix, content))
        .when(suffix.isin(".html", ".htm"), html_to_text(plain))
        .when(suffix.isin(".md", ".markdown"), markdown_to_text(plain))
        .when(suffix.isin(".doc", ".pdf", ".xls"), F.lit(None).cast("string"))
        .otherwise(plain)
    )


def read_folder(spark: SparkSession, folder: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``source, text, file_hash, file_modified``; unreadable files have no text and no hash.

    ``parsers`` by suffix (``.pdf``, ``.doc``, ``.xls``) give the pages of formats that have no reader here.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.withColumn("suffix", suffix).filter(F.col("suffix").isin(SUFFIXES)).withColumn("source", relative(F.col("path"), folder))
    text = text_of(F.col("suffix"), F.col("content"))
    read = rows.select("source", "suffix", text.alias("text"), F.md5("content").alias("h"), F.col("modificationTime").alias("file_modified"))
    for kind, parse in (parsers or {}).items():
        paged = pages_text(pages_of(rows.filter(F.col("suffix") == kind), parse)).withColumnRenamed("text", "_paged")
        text = F.when(F.col("suffix") == kind, F.col("_paged")).otherwise(F.col("text"))
        read = read.join(paged, "source", "left").withColumn("text", text).drop("_paged")
    return read.select("source", "text", F.when(F.col("text").isNotNull(), F.col("h")).alias("file_hash"), "file_modified")


def rows_as_text(table: DataFrame, columns: list[str]) -> Column:
    """A table's row as ``column: value`` of what isn't null."""
    return F.concat_ws(", ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def table_text(page: Column, data: Column) -> Column:
    """A page's table for the index: its place, header and first three rows, empty cells left out."""
    line = lambda row: F.array_join(F.filter(row, lambda c: c.isNotNull() & (c != "")), " | ")
    title = F.concat(F.lit("\n[Table on page "), page.cast("string"), F.lit("]"))
    head = F.when(F.size(data) > 0, F.array(F.concat(F.lit("Headers: "), line(F.get(data, F.lit(0)))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(title), head, F.transform(F.slice(data, 2, 3), line)), "\n")


def image_text(page: Column, width: Column, height: Column) -> Column:
    """A placeholder for a page's image."""
    return F.concat(F.lit("\n[Image on page "), page.cast("string"), F.lit(": "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" pixels]"))


def page_text(pages: DataFrame) -> DataFrame:
    """``source, text`` of ``pages(source, page, text)``: each page that isn't blank after its number."""
    told = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    full = pages.filter(F.trim("text") != "")
    return full.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", told.alias("t")))), lambda p: p["t"]), "\n\n").alias("text"))
