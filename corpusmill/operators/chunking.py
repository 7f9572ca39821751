"""Cutting texts into chunks that follow their structure.

``split`` functions are pure helpers on one text; :func:`chunk_documents` runs them over whole
tables. Sizes are in whatever the token counter counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.functions.text import fixed_windows

Counter = Callable[[str], int]
SHEET = "# Sheet: "
_FENCE = re.compile(r" {0,4}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,4}(#{1,6})(?:[ \t](.*))?$")
_SENTENCE = re.compile(r".*?(?:[.!?](?=[ \n\t])|\Z)", re.S)


def count_words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Piece:
    text: str
    path: tuple[str, ...] = ()

    @property
    def heading_path(self) -> str:
        return " > ".join(self.path)


@dataclass(frozen=True)
class Sizes:
    size: int
    overlap: int = 0
    count: Counter = count_words

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise UsageError("want a size above 0 and an overlap from 0 to below the size")


def _fenced(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Lines, and whether each belongs to a fenced block."""
    mark = ""
    for line in lines:
        m = _FENCE.match(line)
        inside = bool(mark) or bool(m)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            mark = ""
        yield line, inside


def paragraphs(text: str) -> list[str]:
    """What blank lines outside fences part, none of it blank."""
    groups: list[list[str]] = [[]]
    for line, fenced in _fenced(text.split("\n")):
        if fenced or line.strip():
            groups[-1].append(line)
        else:
            groups.append([])
    return [p for p in ("\n".join(g).strip("\n") for g in groups) if p.strip()]


def sentences(text: str) -> list[str]:
    return [s for s in (m[0].strip() for m in _SENTENCE.finditer(text)) if s]


def windows(text: str, s: Sizes) -> list[str]:
    """Runs of words as long as fit, each sharing up to ``overlap`` words with the one before.

    A run's end is found by doubling and halving, so that a word is counted a few times only.
    """
    words, out, start = text.split(), [], 0
    over = lambda end: s.count(" ".join(words[start:end])) > s.size
    while start < len(words):
        reach = 1
        while start + 2 * reach <= len(words) and not over(start + 2 * reach):
            reach *= 2
        ends = range(start + reach + 1, min(start + 2 * reach, len(words)) + 1)
        end = start + reach + bisect_left(ends, True, key=over)
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        start += max(1, end - start - s.overlap)
    return out


def pack(pieces: list[str], join: str, finer: Callable[[str], list[str]], s: Sizes) -> list[str]:
    """Neighbours joined while they fit; what is too large by itself is cut finer."""
    out: list[str] = []
    held = ""
    for piece in pieces:
        if s.count(piece) > s.size:
            out += ([held] if held else []) + finer(piece)
            held = ""
        elif held and s.count(held + join + piece) <= s.size:
            held += join + piece
        else:
            out += [held] if held else []
            held = piece
    return out + ([held] if held else [])


def split_text(text: str, s: Sizes) -> list[Piece]:
    """Paragraphs, then sentences, then words; a text that fits is one piece as it is."""
    if not text.strip():
        return []
    if s.count(text) <= s.size:
        return [Piece(text)]
    by_words = lambda t: windows(t, s)
    by_sentence = lambda t: pack(sentences(t), " ", by_words, s)
    return [Piece(t) for t in pack(paragraphs(text), "\n\n", by_sentence, s)]


def sections(text: str) -> list[Piece]:
    """Sections under ATX headings outside fences, each with its path of headings."""
    out: list[Piece] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []

    def end() -> None:
        body = "\n".join(lines).strip("\n")
        if body.strip():
            out.append(Piece(body, tuple(t for _, t in path)))
        lines.clear()

    for line, fenced in _fenced(text.split("\n")):
        m = None if fenced else _HEADING.match(line)
        if m:
            end()
            level = len(m[1])
            path = [*takewhile(lambda p, level=level: p[0] < level, path), (level, (m[2] or "").strip().rstrip("#").strip())]
        lines.append(line)
    end()
    return out


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(x for x, _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


def split_markdown(text: str, s: Sizes) -> list[Piece]:
    """Neighbouring sections joined while they fit, under the headings they share; a section too large is cut as text."""
    out: list[Piece] = []
    held: Piece | None = None
    for section in sections(text):
        if held and s.count(held.text + "\n\n" + section.text) <= s.size:
            held = Piece(held.text + "\n\n" + section.text, _common(held.path, section.path))
            continue
        if held:
            out.append(held)
        held = section if s.count(section.text) <= s.size else None
        if held is None:
            out += [Piece(p.text, section.path) for p in split_text(section.text, s)]
    return out + ([held] if held else [])


def split_sheet(text: str, s: Sizes) -> list[Piece]:
    """Rows under their sheet's name and header, which every piece repeats; each row once."""
    tables: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if line.startswith(SHEET):
            tables.append((line[len(SHEET) :].strip(), []))
        elif line.strip():
            tables[-1][1].append(line.rstrip(" \t"))
    return [p for name, rows in tables if rows for p in _sheet(name, rows, s)]


def _sheet(name: str, rows: list[str], s: Sizes) -> list[Piece]:
    path = (name,) if name else ()
    lead = "\n".join(([SHEET + name] if name else []) + rows[:1])
    if len(rows) == 1:
        return [Piece(lead, path)]
    room = s.size - s.count(lead + "\n")
    if room <= 0:
        return [Piece(p.text, path) for p in split_text("\n".join(rows), s)]
    inner = Sizes(room, min(s.overlap, room - 1), s.count)
    groups: list[list[str]] = []
    used = room + 1
    for row in rows[1:]:
        n = s.count(row)
        if n > room:
            groups += [[w] for w in windows(row, inner)]
            used = room + 1
        elif used + n > room:
            groups.append([row])
            used = n
        else:
            groups[-1].append(row)
            used += n
    return [Piece("\n".join([lead, *g]), path) for g in groups]


SPLITTERS: dict[str, Callable[[str, Sizes], list[Piece]]] = {
    "text/markdown": split_markdown,
    "text/csv": split_sheet,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": split_sheet,
}


def splitter_for(content_type: str | None) -> Callable[[str, Sizes], list[Piece]]:
    """By content type without parameters, letter case ignored; plain text packing for all others."""
    return SPLITTERS.get((content_type or "").split(";")[0].strip().lower(), split_text)


def chunk_documents(documents: DataFrame, size: int, overlap: int, key: str = "doc_id", count: Counter = count_words, prefix: bool = True) -> DataFrame:
    """(key, seq, text, embed_text, heading_path) of all documents, by content type.

    ``documents``: (key, text, content_type). What is embedded starts with the heading path
    where ``prefix`` is set. Null, empty and blank texts have no chunk.
    """
    s = Sizes(size, overlap, count)
    key_type = documents.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seq, texts, paths = [], [], [], []
            for i, (text, kind) in enumerate(zip(batch.column("text").to_pylist(), batch.column("content_type").to_pylist(), strict=True)):
                for n, p in enumerate(splitter_for(kind)(text, s) if text else []):
                    at.append(i)
                    seq.append(n)
                    texts.append(p.text)
                    paths.append(p.heading_path)
            embed = [f"{h}\n\n{t}" if prefix and h else t for t, h in zip(texts, paths, strict=True)]
            columns = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(seq, pa.int32()), *(pa.array(c, pa.string()) for c in (texts, embed, paths))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "seq", "text", "embed_text", "heading_path"])

    return documents.select(key, "text", "content_type").mapInArrow(cut, f"`{key}` {key_type}, seq int, text string, embed_text string, heading_path string")


def fixed_chunks(documents: DataFrame, size: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """(key, seq, text): windows of words, inside the JVM."""
    Sizes(size, overlap)
    return documents.select(key, F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("seq", "text"))
