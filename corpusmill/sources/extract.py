"""Texts and metadata from file contents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.errors import InvariantError
from corpusmill.operators.chunking import SHEET
from corpusmill.sources.files import TYPES

PART_BYTES = 256 << 20
BOOK_BYTES = 512 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    if book.getinfo(name).file_size > PART_BYTES:
        raise InvariantError(f"{name} unpacks to more than {PART_BYTES} bytes")
    return book.read(name)


def plain(data: bytes) -> str:
    """UTF-8 or nothing; line ends as LF."""
    return data.decode("utf-8").replace("\r\n", "\n")


def docx(data: bytes) -> str:
    """A line per paragraph of the document's body."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = ElementTree.fromstring(_part(book, "word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))
    return "\n".join(lines).rstrip("\n")


def xlsx(data: bytes) -> str:
    """Sheets in workbook order, each led by its name: a line per row, its non-empty cells parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        if sum(i.file_size for i in book.infolist()) > BOOK_BYTES:
            raise InvariantError(f"the workbook unpacks to more than {BOOK_BYTES} bytes")
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in s.iter(_S + "t")) for s in ElementTree.fromstring(_part(book, "xl/sharedStrings.xml")).iter(_S + "si")]
        sheets = []
        for title, part in _sheets(book, names):
            rows = []
            for row in ElementTree.fromstring(_part(book, part)).iter(_S + "row"):
                cells = [_cell(c, strings) for c in row.iter(_S + "c")]
                if line := "\t".join(c for c in cells if c):
                    rows.append(line)
            sheets.append("\n".join([SHEET + title, *rows]))
    return "\n\n".join(sheets)


def _sheets(book: zipfile.ZipFile, names: set[str]) -> list[tuple[str, str]]:
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(_part(book, "xl/_rels/workbook.xml.rels"))}
        listed = [(s.get("name", ""), targets.get(s.get(_R), "")) for s in ElementTree.fromstring(_part(book, "xl/workbook.xml")).iter(_S + "sheet")]
        found = [(n, t.lstrip("/") if t.startswith("/") else "xl/" + t) for n, t in listed if t]
        if found and all(p in names for _, p in found):
            return found
    parts = sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
    return [(p.rsplit("/", 1)[1][:-4], p) for p in parts]


def _cell(cell: ElementTree.Element, strings: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_S + "t")).strip()
    value = (cell.findtext(_S + "v") or "").strip()
    if kind == "s" and value.isdigit() and int(value) < len(strings):
        return strings[int(value)].strip()
    return value


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "text/markdown": plain,
    "text/plain": plain,
    "text/csv": plain,
    TYPES[".docx"]: docx,
    TYPES[".xlsx"]: xlsx,
}


def extractor_for(kind: str | None) -> Callable[[bytes], str] | None:
    """By content type without parameters, letter case ignored; None is unsupported (PDF needs a library that is not here)."""
    return EXTRACTORS.get((kind or "").split(";")[0].strip().lower())


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Metadata between ``---`` lines at the very start, and the rest. Unterminated, there is none.

    ``key: value`` lines; quotes are stripped, ``[a, b]`` becomes ``a,b``; comments, blank lines
    and lines without a colon are skipped; the last of equal keys counts.
    """
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, text
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None)
    if end is None:
        return {}, text
    found = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon and key.strip() and not line.lstrip().startswith("#"):
            found[key.strip()] = _value(value.strip())
    return found, "\n".join(lines[end + 1 :])


def _value(text: str) -> str:
    if text.startswith("[") and text.endswith("]"):
        return ",".join(v for v in (_unquoted(p.strip()) for p in text[1:-1].split(",")) if v)
    return _unquoted(text)


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def extract(files: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """``files`` with text, metadata and error instead of content.

    Front matter of markdown becomes metadata; ``extra`` wins over it; ``mtime`` is added only
    where neither has it. An unsupported type has null text and error ``unsupported``; content
    that cannot be read has the reason.
    """
    given = extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, metas, errors = [], [], []
            for data, kind, mtime in zip(*(batch.column(c).to_pylist() for c in ("content", "content_type", "mtime")), strict=True):
                text, meta, error = None, {}, None
                try:
                    take = extractor_for(kind)
                    if take is None:
                        error = "unsupported"
                    else:
                        text = take(data or b"")
                        if (kind or "").startswith("text/markdown"):
                            meta, text = front_matter(text)
                except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, InvariantError) as e:
                    text, error = None, f"{type(e).__name__}: {e}"[:500]
                meta = meta | given
                if mtime is not None:
                    meta.setdefault("mtime", mtime.strftime("%Y-%m-%dT%H:%M:%SZ"))
                texts.append(text)
                metas.append(list(meta.items()))
                errors.append(error)
            rest = [c for c in batch.schema.names if c != "content"]
            made = [pa.array(texts, pa.string()), pa.array(metas, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "text", "metadata", "error"])

    fields = [f for f in files.schema.fields if f.name != "content"]
    return files.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())]))
