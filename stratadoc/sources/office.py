"""XLSX and DOCX as long tables, from their zipped XML; files are parsed where they are read, one at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import language, strip

# XML namespaces of the formats.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_xlsx(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """sheet, sheet number, row, column (from 0), value of the cells that have one."""
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        names = set(held.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ET.fromstring(held.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(held.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ET.fromstring(held.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            at_row = -1
            for row in ET.fromstring(held.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                at_row = int(row.get("r")) - 1 if row.get("r") else at_row + 1
                at_col = -1
                for cell in row.iter(f"{_SHEET}c"):
                    at_col = _column(cell.get("r")) if cell.get("r") else at_col + 1
                    value = cell.find(f"{_SHEET}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    yield sheet.get("name"), number, at_row, at_col, text


def read_docx(content: bytes) -> Iterator[tuple[int, str, str, str, list[list[str]]]]:
    """Body items in order: number, kind (paragraph or table), style name, text, rows of a table."""
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        styles = {}
        if "word/styles.xml" in held.namelist():
            for style in ET.fromstring(held.read("word/styles.xml")).iter(f"{_WORD}style"):
                name = style.find(f"{_WORD}name")
                styles[style.get(f"{_WORD}styleId")] = name.get(f"{_WORD}val") if name is not None else ""
        body = ET.fromstring(held.read("word/document.xml")).find(f"{_WORD}body")

        def text(node: ET.Element) -> str:
            out = []
            for x in node.iter():
                out.append({f"{_WORD}t": x.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(x.tag, ""))
            return "".join(out)

        number = 0
        for child in body if body is not None else ():
            if child.tag == f"{_WORD}p":
                style = child.find(f"{_WORD}pPr/{_WORD}pStyle")
                key = style.get(f"{_WORD}val") if style is not None else ""
                yield number, "paragraph", styles.get(key, key), text(child), []
            elif child.tag == f"{_WORD}tbl":
                rows = [["\n".join(text(p) for p in cell.iter(f"{_WORD}p")) for cell in row.findall(f"{_WORD}tc")] for row in child.findall(f"{_WORD}tr")]
                yield number, "table", "", "", rows
            else:
                continue
            number += 1


def xlsx_cells(files: DataFrame) -> DataFrame:
    """path, sheet, sheet_no, row, col, value of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held = [(path, *cell) for cell in read_xlsx(content)]
                columns = list(zip(*held)) or [()] * 6
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "sheet", "sheet_no", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, sheet_no int, row int, col int, value string")


def docx_items(files: DataFrame) -> DataFrame:
    """path, item_no, kind, style, text, rows of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                columns = list(zip(*((path, *item) for item in read_docx(content)))) or [()] * 6
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "item_no", "kind", "style", "text", "rows"])

    return files.select("path", "content").mapInArrow(run, "path string, item_no int, kind string, style string, text string, rows array<array<string>>")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """path, sheet, row, values (an array without gaps) of the sheets whose name doesn't begin with an underscore."""
    shown = cells.where(~F.col("sheet").startswith("_"))
    wide = shown.groupBy("path", "sheet").agg(F.max("col").alias("last"))
    rows = shown.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m")).join(wide, ["path", "sheet"])
    return rows.select("path", "sheet", "row", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("m", i)).alias("values"))


def sheet_chunks(cells: DataFrame, *, long_text: float = 40.0, header_share: float = 0.7) -> DataFrame:
    """Rows of sheets as text: the first row that is filled to a share is the header, columns of long texts are told.

    path, sheet, row (as the sheet numbers it), ref (the row's first value), text, lang.
    """
    rows = sheet_rows(cells)
    filled = F.size(F.filter("values", lambda v: v.isNotNull() & (strip(v) != "")))
    rows = rows.withColumn("filled", filled)
    sheet = Window.partitionBy("path", "sheet")
    rows = rows.withColumn("header_row", F.min(F.when(F.col("filled") >= F.size("values") * header_share, F.col("row"))).over(sheet))
    rows = rows.withColumn("headers", F.max(F.when(F.col("row") == F.col("header_row"), F.col("values"))).over(sheet))
    data = rows.where(F.col("row") > F.col("header_row"))
    long = data.select("path", "sheet", F.posexplode("values").alias("col", "v")).where("v is not null").groupBy("path", "sheet", "col").agg(F.avg(F.length("v")).alias("mean"))
    long = long.where(F.col("mean") > long_text).groupBy("path", "sheet").agg(F.sort_array(F.collect_list("col")).alias("columns"))
    told = data.where("filled >= 2").join(long, ["path", "sheet"])
    pairs = F.filter(F.transform("columns", lambda c: F.when(strip(F.get("values", c)) != "", F.concat(F.coalesce(F.get("headers", c), F.lit("None")), F.lit(": "), F.get("values", c)))), lambda x: x.isNotNull())
    told = told.withColumn("text", F.array_join(pairs, "\n")).where("text <> ''")
    return told.select("path", "sheet", (F.col("row") + 1).alias("row"), F.get("values", F.lit(0)).alias("ref"), "text", language(F.col("text")).alias("lang"))


def docx_blocks(items: DataFrame) -> DataFrame:
    """Body items as blocks: type by style, tables as reading text.

    items is a row an item, or a row a document (path, items: an array in order); the latter isn't shuffled.
    """
    from ..functions import tables
    from ..functions.text import normalize_ocr, normalize_ocr_all
    from ..operators.pages import paragraph_type

    told = lambda rows: tables.reading_text(tables.padded(rows), F.lit(None).cast("string"))
    kind_of = lambda kind, style: F.when(kind == "table", "table").otherwise(paragraph_type(style))
    if "items" in items.columns:
        texts = normalize_ocr_all(F.transform("items", lambda i: F.when(i["kind"] != "table", i["text"])))
        both = F.zip_with("items", texts, lambda i, t: F.struct(i.alias("i"), F.when(i["kind"] == "table", told(i["rows"])).otherwise(t).alias("t")))
        held = items.select("path", F.posexplode(F.filter(both, lambda b: F.length(b["t"]) > 0)).alias("reading_order", "b")).select("path", "b.i.*", F.col("b.t").alias("t"), "reading_order")
        return held.withColumns({"block_type": kind_of(F.col("kind"), F.col("style")), "text": F.col("t")}).drop("t")
    text = F.when(F.col("kind") == "table", told(F.col("rows"))).otherwise(normalize_ocr(F.col("text")))
    held = items.withColumns({"block_type": kind_of(F.col("kind"), F.col("style")), "text": text})
    held = held.where(F.length("text") > 0)
    return held.withColumn("reading_order", F.row_number().over(Window.partitionBy("path").orderBy("item_no")) - 1)


def plain_chunks(items: DataFrame) -> DataFrame:
    """Fixed windows of a document's paragraphs, tables aside, joined by line breaks: path, index, text, lang.

    items is a row an item, or a row a document (path, items: an array in order); the latter isn't shuffled.
    Windows are of words, so blank paragraphs are nothing to them.
    """
    from ..operators.chunking import fixed_chunks

    if "items" in items.columns:
        texts = F.transform(F.filter("items", lambda i: i["kind"] == "paragraph"), lambda i: i["text"])
        whole = items.select("path", F.array_join(texts, "\n").alias("body"))
    else:
        shown = items.where(F.col("kind") == "paragraph")
        whole = shown.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return fixed_chunks(whole, "body").select("path", F.col("chunk_index").alias("index"), F.col("chunk_text").alias("text"), language(F.col("chunk_text")).alias("lang"))
