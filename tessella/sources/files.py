"""Files to a (doc_id, text) DataFrame: plain text, DOCX, and PDF where a reader is installed."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import char_windows, trim_blank
from tessella.session import ship_package

_W = "{http://schemas.openxmlformats.org" + "/wordprocessingml/2006/main}"
#: Directories that hold stores and caches, never sources; hidden directories are skipped as well.
SKIPPED_DIRS = ("stores", "__pycache__")


def _local(path: str) -> str:
    return path.removeprefix("file://")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, suffix, content) of a file or of all files below a directory.

    The id is the path below the directory, or the name of a single file. A missing local path is an error.
    """
    local = _local(path)
    on_disk = "://" not in local
    if on_disk and not os.path.exists(local):
        raise FileNotFoundError(path)
    single = on_disk and os.path.isfile(local)
    root = os.path.abspath(local) if on_disk else path.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = F.regexp_replace(F.col("path"), "^file:/+", "/") if on_disk else F.col("path")
    named = raw.select(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))).alias("full"), "content") if on_disk else raw.select(full.alias("full"), "content")
    name = F.element_at(F.split("full", "/"), -1)
    doc_id = name if single else F.substring(F.col("full"), len(root) + 2, 1 << 30)
    out = named.select(doc_id.alias("doc_id"), name.alias("name"), "content")
    folders = F.slice(F.split("doc_id", "/"), 1, F.size(F.split("doc_id", "/")) - 1)
    hidden = F.exists(folders, lambda d: d.isin(*SKIPPED_DIRS) | d.startswith("."))
    suffix = F.lower(F.regexp_extract("name", "(\\.[^.]*)$", 1))
    return out.filter(~hidden).select("doc_id", "name", suffix.alias("suffix"), "content")


def decode_text(content: Column) -> Column:
    """UTF-8, undecodable bytes dropped."""

    @F.pandas_udf("string")
    def decode(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: b.decode("utf-8", "ignore"))

    # Valid text, nearly all of it, never leaves the JVM.
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(decode(content))


def docx_text(content: bytes, name: str) -> str:
    """A title line, then paragraphs and tables of a DOCX body in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if "word/document.xml" not in archive.namelist():
            raise ValueError(f"{name} has no word/document.xml")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    body = root.find(f"{_W}body")
    if body is None:
        return ""
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    parts = [f"# {name}"]
    for node in body:
        if node.tag == f"{_W}p":
            parts.append(words(node))
        elif node.tag == f"{_W}tbl":
            rows = [[c for c in map(words, row.iter(f"{_W}tc")) if c] for row in node.iter(f"{_W}tr")]
            parts.append("\n".join("| " + " | ".join(r) + " |" for r in rows if r))
    return "\n\n".join(p for p in parts if p)


def _line(line: dict) -> dict:
    return {"spans": [{k: s.get(k) for k in ("text", "size")} for s in line.get("spans", [])]}


def pdf_pages(content: bytes) -> list[dict]:
    """Raw pages (page, width, blocks) by PyMuPDF, which must be installed where tasks run."""
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs PyMuPDF on the executors") from missing
    out = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for i, page in enumerate(doc, 1):
            blocks = [
                {"type": b.get("type"), "bbox": list(b.get("bbox") or []), "lines": [_line(ln) for ln in b.get("lines", [])]}
                for b in page.get_text("dict")["blocks"]
            ]
            out.append({"page": i, "width": float(page.rect.width), "blocks": blocks})
    return out


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page, width, blocks) of PDF files, for ``operators.layout``."""
    from tessella.operators.layout import RAW_BLOCKS

    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"], strict=True):
                pages = pdf_pages(content)
                yield pd.DataFrame({"doc_id": [doc_id] * len(pages), **{k: [p[k] for p in pages] for k in ("page", "width", "blocks")}})

    return files.filter("suffix = '.pdf'").select("doc_id", "content").mapInPandas(run, f"doc_id string, page int, width double, blocks {RAW_BLOCKS}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of all sources, trimmed, empty ones dropped. No document at all is an error."""
    files = read_files(spark, path)
    ship_package(spark)

    @F.pandas_udf("string")
    def docx(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([docx_text(c, n) for c, n in zip(content, name, strict=True)])

    content, suffix = F.col("content"), F.col("suffix")
    plain = files.filter(~suffix.isin(".docx", ".pdf")).select("doc_id", decode_text(content).alias("text"))
    word = files.filter(suffix == ".docx").select("doc_id", docx("content", "name").alias("text"))
    both = plain.unionByName(word)
    if files.filter(suffix == ".pdf").limit(1).count():
        from tessella.operators.layout import page_markdown

        both = both.unionByName(page_markdown(read_pdf_pages(files)))
    out = both.withColumn("text", trim_blank("text")).filter("text <> ''")
    if not out.limit(1).count():
        raise ValueError(f"no documents in {path}")
    return out


def read_char_windows(docs: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """(chunk_id, source, chunk, content): fixed character windows; the id follows from source and position."""
    windows = docs.select(F.col("doc_id").alias("source"), F.posexplode(char_windows("text", size, overlap)).alias("chunk", "content"))
    return windows.select(F.concat_ws("::w", F.col("source").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), "source", "chunk", "content")


_OCR_KEYS = "rec_texts texts text transcription".split()


def harvest_ocr(result: object) -> list[str]:
    """Texts in an OCR result of any nesting: known keys, (text, score) pairs, lists."""
    if result is None:
        return []
    if isinstance(result, str):
        return [result.strip()] if result.strip() else []
    if isinstance(result, dict):
        for key in _OCR_KEYS:
            if key in result:
                return harvest_ocr(result[key])
        return [t for v in result.values() if isinstance(v, (dict, list, tuple)) for t in harvest_ocr(v)]
    if isinstance(result, (list, tuple)):
        if len(result) == 2 and isinstance(result[0], str) and isinstance(result[1], (int, float)):
            return harvest_ocr(result[0])
        return [t for v in result if not isinstance(v, (int, float)) for t in harvest_ocr(v)]
    return []
