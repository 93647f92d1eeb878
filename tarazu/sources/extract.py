"""Extraction arms over files: one row per page and arm, errors kept as rows.

An arm is a function from the bytes of a file to ``{page: text}``; it raises rather than
return an empty text. Arms that need a library or a program that is absent are not
registered. Errors stand at page 0, with the class and message of the exception.
"""

from __future__ import annotations

import io
import re
import subprocess
import time
from collections.abc import Callable, Iterator
from importlib.util import find_spec
from shutil import which

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarazu.sources.pdf import Pdf

Arm = Callable[[bytes], dict[int, str]]
ARMS: dict[str, Arm] = {}
SCHEMA = "path string, sha256 string, page int, arm string, text string, elapsed_ms long, error string"


def arm(name: str):
    def add(f: Arm) -> Arm:
        ARMS[name] = f
        return f

    return add


@arm("plain")
def plain_text(raw: bytes) -> dict[int, str]:
    """UTF-8 text with form feeds between pages."""
    return dict(enumerate(raw.decode("utf-8").split("\f"), 1))


@arm("content")
def content(raw: bytes) -> dict[int, str]:
    """PDF text in the order of the pages' content, by the reader of this package."""
    doc = Pdf(raw)
    return {i: doc.text(p) for i, p in enumerate(doc.pages(), 1)}


TIMEOUT_S, OCR_DPI = 120, 150

if find_spec("fitz"):

    @arm("pymupdf")
    def pymupdf(raw: bytes) -> dict[int, str]:
        import fitz

        with fitz.open(stream=raw, filetype="pdf") as doc:
            if doc.needs_pass:
                raise ValueError("encrypted")
            return {i + 1: p.get_text() for i, p in enumerate(doc)}


if find_spec("pdfplumber"):

    @arm("pdfplumber")
    def pdfplumber_text(raw: bytes) -> dict[int, str]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as doc:
            return {p.page_number: p.extract_text() or "" for p in doc.pages}


if find_spec("pypdf"):

    @arm("pypdf")
    def pypdf_text(raw: bytes) -> dict[int, str]:
        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(raw))
        if reader.is_encrypted:
            raise ValueError("encrypted")
        return {i: p.extract_text() or "" for i, p in enumerate(reader.pages, 1)}


if which("pdftotext"):

    @arm("pdftotext")
    def pdftotext(raw: bytes) -> dict[int, str]:
        done = subprocess.run(["pdftotext", "-layout", "-enc", "UTF-8", "-", "-"], input=raw, capture_output=True, timeout=TIMEOUT_S, check=True)
        return dict(enumerate(done.stdout.decode("utf-8", "replace").removesuffix("\f").split("\f"), 1))


if find_spec("fitz") and which("tesseract"):

    @arm("ocr")
    def ocr(raw: bytes) -> dict[int, str]:
        import fitz

        out = {}
        with fitz.open(stream=raw, filetype="pdf") as doc:
            for i, page in enumerate(doc, 1):
                image = page.get_pixmap(dpi=OCR_DPI).tobytes("png")
                out[i] = subprocess.run(["tesseract", "-", "-"], input=image, capture_output=True, timeout=TIMEOUT_S, check=True).stdout.decode("utf-8", "replace")
        return out


def is_missing(error: str | BaseException) -> bool:
    """Whether a failure says that the file is not there, by its type, the name of its class or its message."""
    return isinstance(error, FileNotFoundError) or re.search(_MISSING, f"{type(error).__name__}: {error}") is not None


_MISSING = "(?i)FileNotFound|NoSuchFile|no such file|cannot find|does not exist|not found"


def missing(error: Column) -> Column:
    """The same for the ``error`` of an extraction row."""
    return F.coalesce(error.rlike(_MISSING), F.lit(False))


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """All files of a folder tree that are not empty: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def extract(found: DataFrame, arms: dict[str, Arm] | None = None, most_bytes: int = 100 << 20) -> DataFrame:
    """Every arm over every file of at most ``most_bytes``; larger files give an error row."""
    chosen = arms or ARMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for path, raw, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                sha = hashlib.sha256(raw).hexdigest() if raw is not None else None
                for name, f in chosen.items():
                    began = time.monotonic()
                    try:
                        if size > most_bytes:
                            raise ValueError("too large")
                        pages = f(raw)
                        took = int((time.monotonic() - began) * 1000)
                        rows += [(path, sha, p, name, t, took, None) for p, t in pages.items()]
                    except Exception as e:  # an unreadable file is a finding, not a failed job
                        rows.append((path, sha, 0, name, None, int((time.monotonic() - began) * 1000), f"{type(e).__name__}: {e}"[:200]))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return found.select("path", "content", "length").mapInArrow(run, SCHEMA)


AUDIT_SCHEMA = "path string, sha256 string, status string, error string, n_pages int, title string, producer string, creator string, sampled_pages int, text string"
INVENTORY_SCHEMA = "sha256 string, xref long, raw_font_name string, font_name string, font_type string, encoding string, embedded int, has_tounicode int, pages array<int>"
SAMPLE_PAGES, METADATA_CHARS = 30, 60


def sanitized(text: str | None, most: int | None = None) -> str | None:
    """Without unpaired surrogates, which no encoding can hold; pairs become one character. At most ``most`` characters."""
    if text is None:
        return None
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")[:most]


def _rows(found: DataFrame, schema: str, of: Callable[[str, bytes, str], list[tuple]]) -> DataFrame:
    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = [r for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in of(path, raw or b"", hashlib.sha256(raw or b"").hexdigest())]
            if rows:
                arrow = to_arrow_schema(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return found.select("path", "content").mapInArrow(run, schema)


def audit_source(found: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per file: status OK or ERROR, metadata, and the text of up to ``sample_pages`` pages spread over it.

    A file that cannot be read, encrypted ones included, is an ERROR row with its reason.
    """

    def of(path: str, raw: bytes, sha: str) -> list[tuple]:
        try:
            doc = Pdf(raw)
            pages, info = doc.pages(), doc.info()
            n = min(sample_pages, len(pages))
            chosen = [pages[k * len(pages) // n] for k in range(n)]
            meta = [sanitized(info.get(k), METADATA_CHARS) for k in ("Title", "Producer", "Creator")]
            return [(path, sha, "OK", None, len(pages), *meta, n, sanitized("\f".join(map(doc.text, chosen))))]
        except Exception as e:  # an unreadable file is a finding, not a failed job
            return [(path, sha, "ERROR", f"{type(e).__name__}: {e}"[:200], None, None, None, None, 0, None)]

    return _rows(found, AUDIT_SCHEMA, of)


def font_inventory(found: DataFrame) -> DataFrame:
    """Every font object of every file, over all its pages; unreadable files have none."""

    def of(_: str, raw: bytes, sha: str) -> list[tuple]:
        try:
            fonts = Pdf(raw).inventory()
        except Exception:
            return []
        base = lambda name: name.split("+", 1)[1] if "+" in name[:8] else name
        return [(sha, f["xref"], f["raw_font_name"], base(f["raw_font_name"]), f["font_type"], f["encoding"], f["embedded"], f["has_tounicode"], f["pages"]) for f in fonts]

    return _rows(found, INVENTORY_SCHEMA, of)


def font_spans(found: DataFrame) -> DataFrame:
    """``sha256, page, pos, font_name, piece``: what each font shows, in order; the input of the per-font arms."""

    def of(_: str, raw: bytes, sha: str) -> list[tuple]:
        try:
            doc = Pdf(raw)
            return [(sha, p, k, name, text) for p, page in enumerate(doc.pages(), 1) for k, (name, text) in enumerate(doc.spans(page)) if text.strip()]
        except Exception:
            return []

    return _rows(found, "sha256 string, page int, pos int, font_name string, piece string", of)
