"""Splitting oversized texts at natural boundaries.

Balanced targets: the least number of pieces that can hold the text gives equally long
targets; each target is snapped to the strongest boundary near it; where a limit would be
broken the text is cut into one piece more. Sizes are in words or in tokens of a byte-level BPE,
as the text's collection has it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.tokens import VOCABULARY, encoding, ship
from corpusmill.tables import read

WORDS = "words"
# Unicode White_Space.
SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{SPACE}]+")
_BLANK_LINE = re.compile("\n[^\\S\n]*\n|\f|\u2029")
_CLOSERS = "\"')]}»”’*_"
SNAP = 0.25  # how far from its target a cut may lie, as a part of a piece's length


def strength(gap: str, before: str, after: str) -> int:
    """How natural a cut between two words is: 5 before a heading, 4 blank line, 3 line, 2 sentence, 1 clause, 0 none."""
    if any(c in gap for c in "\n\r\f\u2028\u2029"):
        if after.startswith("#"):
            return 5
        return 4 if _BLANK_LINE.search(gap.replace("\r\n", "\n").replace("\r", "\n")) else 3
    end = before.rstrip(_CLOSERS)[-1:]
    if end and end in ".!?…。！？":
        return 2
    return 1 if end and end in ",;:–—" else 0


def cuts(strengths: list[int], costs: list[int], size: int, overlap: int, snap: float = SNAP) -> list[int]:
    """Positions of words at which pieces after the first begin anew, without their overlap.

    ``strengths[i]`` is that of the gap before word i, ``costs[i]`` what the word counts. Every
    piece, with up to ``overlap`` of the piece before, fits ``size``, if every word fits
    ``size - overlap``.
    """
    n, step = len(costs), size - overlap
    upto = [0, *accumulate(costs)]
    total = upto[-1]
    pieces = 1 if total <= size else 1 + -(-(total - size) // step)
    while 1 < pieces <= n:
        found, last = [], 0
        for i in range(1, pieces):
            most = upto[last] + (size if i == 1 else step)
            left = pieces - i
            low = max(last + 1, bisect_left(upto, total - left * step))
            high = min(bisect_right(upto, most) - 1, n - left)
            target, reach = i * total / pieces, snap * total / pieces
            near = range(max(low, bisect_left(upto, target - reach)), min(high, bisect_right(upto, target + reach) - 1) + 1)
            if not near:
                near = range(low, high + 1)
            if not near:
                break
            last = max(near, key=lambda c: (strengths[c], -abs(upto[c] - target), -c))
            found.append(last)
        if len(found) == pieces - 1 and total - upto[last] <= step:
            return found
        pieces += 1
    return list(range(1, n)) if total > size else []


def _atoms(text: str, limit: int, count: Callable[[str], int] | None) -> tuple[list[tuple[int, int]], list[int], list[bool]]:
    """Spans of the words, what each counts with the gap before it, and whether it begins a word.

    A word that alone counts more than ``limit`` is halved until its parts fit; a single
    character is never cut.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    if count is None:
        return spans, [1] * len(spans), [True] * len(spans)
    out, costs, begins, end = [], [], [], 0
    for a, b in spans:
        # With the gap or, at the begin of a piece, without it: the larger of the two.
        cost = max(count(text[end:b]), count(text[a:b]))
        if cost <= limit or b - a == 1:
            out.append((a, b))
            costs.append(cost)
            begins.append(True)
        else:
            parts = [(a, b)]
            while parts:
                x, y = parts.pop()
                own = max(count(text[end:y]), count(text[x:y])) if x == a else count(text[x:y])
                if own <= limit or y - x == 1:
                    out.append((x, y))
                    costs.append(own)
                    begins.append(x == a)
                else:
                    parts += [((x + y) // 2, y), (x, (x + y) // 2)]
        end = b
    return out, costs, begins


def split_text(text: str, size: int, overlap: int, count: Callable[[str], int] | None = None) -> list[tuple[str, int, int, int]]:
    """Pieces in order: (text as stored, first word, one past the last word, words shared with the piece before).

    ``count`` gives the size of a text in the unit of ``size`` and ``overlap``; without it they
    are words. A word that is larger than a piece may be is cut inside; its parts count as words
    of their own then.
    """
    overlap = max(0, min(overlap, size - 1))
    if count is not None and count(text) <= size:
        return [(text, 0, sum(1 for _ in _WORD.finditer(text)), 0)]
    spans, costs, fresh = _atoms(text, size - overlap, count)
    n = len(spans)
    if n <= size and count is None:
        return [(text, 0, n, 0)]
    if n < 2:  # the white space around it was too much
        return [(text[slice(*spans[0])] if n else "", 0, n, 0)]
    strengths = [0] * n
    for i in range(1, n):
        (a, b), (c, d) = spans[i - 1], spans[i]
        strengths[i] = strength(text[b:c], text[a:b], text[c:d]) if fresh[i] else -1
    while True:
        begins = [0, *cuts(strengths, costs, size, overlap)]
        upto, out = [0, *accumulate(costs)], []
        for begin, end in zip(begins, [*begins[1:], n], strict=True):
            start = begin
            if begin and overlap:
                # What is shared begins at the strongest boundary, of equal ones as far back as may be.
                most = min(overlap, size - (upto[end] - upto[begin]))
                low = bisect_left(upto, upto[begin] - most)
                start = max(range(low, begin + 1), key=lambda c: (strengths[c] if c < begin else 0, -c)) if most > 0 else begin
            out.append((text[spans[start][0] : spans[end - 1][1]], start, end, begin - start))
        over = [p for p in out if count is not None and p[2] - p[1] > 1 and count(p[0]) > size]
        if not over:
            return out
        # Parts of a word may count more together than one by one: pieces are added until all fit.
        for _, start, end, _ in over:
            costs[start:end] = [c + 1 for c in costs[start:end]]


def _pieces(path: str):  # noqa: ANN202
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "piece_no", "pieces", "piece_text", "words", "shared_words"]
        tokens = lambda t: len(encoding(path).encode_ordinary(t))
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text, size, overlap, unit in zip(*(batch.column(c).to_pylist() for c in ("_key", "text", "size", "overlap", "unit")), strict=True):
                parts = split_text(text, size, overlap, None if unit == WORDS else tokens)
                for i, (piece, start, end, shared) in enumerate(parts):
                    for col, v in zip(out, (key, i, len(parts), piece, end - start, shared), strict=True):
                        col.append(v)
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return cut


def word_count(text: Column) -> Column:
    """Runs of characters that are not Unicode white space; null counts 0."""
    blank = lambda p, i: (F.element_at(p, i) == "").cast("int")
    count = lambda p: F.size(p) - blank(p, 1) - F.when(F.size(p) > 1, blank(p, -1)).otherwise(0)
    # As a lambda's argument the text is split once, not once for each use.
    return F.coalesce(F.transform(F.array(F.split(text, f"[{SPACE}]+")), count)[0], F.lit(0))


def split_oversized(chunks: DataFrame, key: str = "id", carry: tuple[str, ...] = ("collection", "heading_path"), path: str = VOCABULARY) -> DataFrame:
    """Ordered pieces of every text: (key, carried columns, piece_no, pieces, piece_text, words, shared_words).

    ``chunks`` has ``key`` (unique), ``text``, ``size``, ``overlap``, ``unit`` and the carried
    columns. Size and overlap are in words where ``unit`` is ``words``, null, empty or missing,
    else in tokens of the vocabulary at ``path``, whatever tokenizer it names. A size that is null
    or not positive sets no limit; an overlap that is null or negative is 0, one not below the
    size is size - 1. A text within its limit, empty or null is one piece, as stored; white space at the ends of one
    that is not within it, and a text of nothing else, is left out. Pieces are
    cut between words; only a word larger than a piece may be is cut inside (its parts then count
    as words). An empty table gives an empty result. Each text is split by itself, so neither hot
    collections nor repeated texts matter.
    """
    unit = F.coalesce(F.nullif("unit", F.lit("")), F.lit(WORDS)) if "unit" in chunks.columns else F.lit(WORDS)
    limit = F.when(F.col("size") > 0, F.col("size"))
    # Fewer characters than words and their gaps need cannot be oversized, nor fewer bytes than tokens: the cheap test first.
    in_words = (F.length("text") >= 2 * limit + 1) & (word_count(F.col("text")) > limit)
    over = F.coalesce(F.when(unit == WORDS, in_words).otherwise(F.octet_length("text") > limit), F.lit(False))
    sized = chunks.withColumn("_over", over)
    small = sized.where(~F.col("_over")).select(key, *carry, F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"), F.col("text").alias("piece_text"), word_count(F.col("text")).alias("words"), F.lit(0).alias("shared_words"))
    large = sized.where("_over").select(F.to_json(F.struct(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))).alias("_key"), "text", F.col("size").cast("int").alias("size"), F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap"), unit.alias("unit"))
    ship(chunks.sparkSession, path)
    made = large.mapInArrow(_pieces(path), "_key string, piece_no int, pieces int, piece_text string, words int, shared_words int")
    back = F.from_json("_key", "k {}, {}".format(chunks.schema[key].dataType.simpleString(), ", ".join(f"c{i} {chunks.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))) if carry else f"k {chunks.schema[key].dataType.simpleString()}")
    made = made.withColumn("_b", back).select(F.col("_b.k").alias(key), *(F.col(f"_b.c{i}").alias(c) for i, c in enumerate(carry)), "piece_no", "pieces", "piece_text", "words", "shared_words")
    return small.unionByName(made)


def sized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the size and overlap of their collection, and the unit these are in."""
    specs = read(spark, sf_dir, "collections").groupBy(F.col("name").alias("collection")).agg(F.max("chunker_size").alias("size"), F.max("chunker_overlap").alias("overlap"), F.max("chunker_tokenizer").alias("unit"))
    return read(spark, sf_dir, "chunks").select("id", "collection", "text", "heading_path").join(specs, "collection", "left")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as pieces within its collection's size, in the collection's own unit; rows of one id and piece count once."""
    return split_oversized(sized_chunks(spark, sf_dir)).dropDuplicates(["id", "piece_no"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are cut when all sizes are taken in words."""
    pieces = split_oversized(sized_chunks(spark, sf_dir).drop("unit"))
    return pieces.where("pieces > 1 and piece_no = 0").select(F.col("id").alias("chunk_id")).distinct()


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per collection the chunks cut when all sizes are taken in words, and the words that their pieces hold anew, over all and of the longest."""
    cut = split_oversized(sized_chunks(spark, sf_dir).drop("unit")).where("pieces > 1").dropDuplicates(["id", "piece_no"])
    whole = cut.groupBy("collection", "id").agg(F.sum(F.col("words") - F.col("shared_words")).alias("n"))
    return whole.groupBy("collection").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words"), F.max("n").alias("longest"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per collection, in its own unit: texts cut, pieces made, their mean fill in words and the mean words shared."""
    cut = p5_pieces(spark, sf_dir).where("pieces > 1")
    return cut.groupBy("collection").agg(F.count_distinct("id").alias("texts"), F.count(F.lit(1)).alias("pieces_made"), F.round(F.avg("words"), 6).alias("mean_words"), F.max("words").alias("most_words"), F.round(F.avg("shared_words"), 6).alias("mean_shared"))
