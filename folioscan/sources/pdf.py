"""PDF scan into the engine's tables, for installations that have PyMuPDF; without it read_pdf says so.

Each file is opened once, on an executor; a file that can't be read becomes a row with read_error, never a failed job.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from functools import reduce
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .papers import SCHEMAS, Tables, pdf_files

PARTS = [n for n in SCHEMAS if n != "papers"]


def available() -> bool:
    return importlib.util.find_spec("pymupdf") is not None


def embedded(doc, xref: int, depth: int = 0) -> bool:
    """Whether a font program that isn't empty hangs below the font object, at most three references down."""
    if depth > 3 or not 0 < xref < doc.xref_length():
        return False

    def target(key: str) -> int:
        kind, value = doc.xref_get_key(xref, key)
        return int(value.split()[0]) if kind == "xref" else 0

    for base in ("", "FontDescriptor/"):
        for key in ("FontFile", "FontFile2", "FontFile3"):
            if (at := target(base + key)) and at < doc.xref_length() and doc.xref_is_stream(at) and doc.xref_stream(at):
                return True
    if (at := target("FontDescriptor")) and embedded(doc, at, depth + 1):
        return True
    kind, value = doc.xref_get_key(xref, "DescendantFonts")
    below = [int(x.split()[-1]) for x in value.strip("[]").split(" 0 R") if x.strip()] if kind in ("array", "xref") else []
    return bool(below) and all(embedded(doc, x, depth + 1) for x in below)


def box(r) -> dict | None:
    return None if r is None else dict(zip(("x0", "y0", "x1", "y1"), map(float, r), strict=True))


def page_rows(doc, n: int, page) -> dict[str, list[dict]]:
    """The rows of page n for each table, from a page that answers as the PDF library's do."""
    images = page.get_image_info()
    out = {
        "pages": [{"page_num": n, **box(page.rect), "raw_text": page.get_text(), "n_images": len(images), "n_drawings": len(page.get_drawings())}],
        "images": [{"page_num": n, "img_no": k, "bbox": box(i.get("bbox")), "width_px": i.get("width"), "height_px": i.get("height")} for k, i in enumerate(images)],
        "fonts": [{"page_num": n, "xref": f[0], "font_name": f[3], "embedded": embedded(doc, f[0])} for f in page.get_fonts()],
        "links": [{"page_num": n, "link_no": k, "uri": x.get("uri"), "rect": box(x.get("from"))} for k, x in enumerate(page.get_links())],
        "words": [{"page_num": n, "word_no": k, "x0": w[0], "y0": w[1], "x1": w[2], "y1": w[3], "text": w[4]} for k, w in enumerate(page.get_text("words"))],
        "lines": [],
    }
    for b, block in enumerate(page.get_text("dict", flags=0)["blocks"]):
        for k, line in enumerate(block.get("lines", [])):
            spans = line["spans"]
            origins = [s["origin"][1] for s in spans if "origin" in s]
            out["lines"].append({"page_num": n, "block_no": b, "block_type": block.get("type", 0), "line_no": k, "bbox": box(line["bbox"]), "text": "".join(s["text"] for s in spans), "font_size": float(max((s["size"] for s in spans), default=0)), "baseline": float(median(origins)) if origins else None})
    return out


def document_rows(doc) -> dict:
    """The paper's fields and the rows of all its pages, from an open document."""
    meta = doc.metadata or {}
    row = {"page_count": doc.page_count, **{k: meta.get(k) for k in ("author", "creator", "producer")}} | {n: [] for n in PARTS}
    for n, page in enumerate(doc, 1):
        for table, rows in page_rows(doc, n, page).items():
            row[table] += rows
    return row


def scan_file(path: str, content: bytes, open_document=None) -> dict:
    """One row: the paper's fields and a list of rows for each other table. A file that can't be read has its error and no rows."""
    row = {"path": path, "file_bytes": len(content), "read_error": None, "page_count": None, "author": None, "creator": None, "producer": None} | {n: [] for n in PARTS}
    try:
        if open_document is None:
            import pymupdf

            open_document = lambda c: pymupdf.open(stream=c, filetype="pdf")
        return row | document_rows(open_document(content))
    except Exception as e:  # noqa: BLE001  a file that can't be read is a finding
        return row | {"read_error": f"{type(e).__name__}: {e}"}


def read_pdf(spark: SparkSession, paths: list[str], open_document=None) -> Tables:
    """Tables of all PDF files at and below paths, each scanned on an executor; write them with save() before auditing.

    open_document opens the bytes of a file; by default the PDF library does.
    """
    if open_document is None and not available():
        raise RuntimeError("reading PDF files needs PyMuPDF; tables can be read with papers.load()")
    inner = {n: ", ".join(x.strip() for x in SCHEMAS[n].split(",", 1)[1:]).replace("bbox struct", "bbox: struct") for n in PARTS}
    schema = "path string, file_bytes bigint, read_error string, page_count int, author string, creator string, producer string, " + ", ".join(f"{n} array<struct<{inner[n]}>>" for n in PARTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([scan_file(p, bytes(c), open_document) for p, c in zip(f.path, f.content, strict=True)])

    content = reduce(DataFrame.union, (pdf_files(spark, p).select("path", "content") for p in paths))
    scanned = content.mapInPandas(run, schema).withColumn("paper_id", F.xxhash64("path"))
    if len(paths) > 1:
        scanned = scanned.dropDuplicates(["path"])
    part = lambda n: scanned.select("paper_id", F.inline(n))
    return Tables(scanned.select(*(x.split()[0] for x in SCHEMAS["papers"].split(", "))), *(part(n) for n in PARTS))
