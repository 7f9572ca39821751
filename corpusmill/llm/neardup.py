"""Near-duplicate texts by tensored banding.

Two small collections of sub-keys are computed per text, each sub-key from four minhashes of
its set of words. Every combination of a sub-key of the first collection with one of the second
is the key of a table, so 2 * 16 * 4 = 128 minhashes serve 16 * 16 = 256 tables of eight hashes
each, which would take 2048 minhashes one by one. Only the first collection is shuffled: texts
that share a first sub-key meet, and carry their second collection along in 32 bytes (four bits
a minhash); where a second sub-key agrees too, the pair collides in that table. The same 64
four-bit minhashes estimate the similarity and discard chance collisions. What is left is
verified against the words themselves.

Equal word sets are one class before anything else, so copies cost nothing in the search; the
pairs of ids written out are all of them and grow with the square of a class. A first sub-key
shared by very many texts is not gathered in one task: a sample of the texts tells such keys
before the shuffle, and their texts go straight to the 16 table keys that each opens with its
second collection. The texts of a table key that is still large are cut into blocks of META, and
every block meets every other, each pair of blocks a task of its own: nothing is left out, so the
work on m different texts that all agree in a table grows with m squared, as the links between
them do.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import UsageError
from corpusmill.tables import keep, read

SUB_KEYS = 16  # of each collection
HASHES = 4  # minhashes in a sub-key
SEED = 7
SIMILARITY = 0.6
LEAST_EQUAL = 27  # of 64 four-bit minhashes; at similarity 0.6 40 +- 4 are expected
BUCKET = 20_000  # texts of one first sub-key that are compared in one task
BLOCK = 512  # texts of one table key that are compared where their first sub-key is, and members of a class that are paired at once
META = 4096  # texts of one table key in a block
HOT_SAMPLE = 64  # of so many texts one is counted to find first sub-keys of more than BUCKET texts
HOT_KEYS = 1_000_000  # such keys that are handled before the shuffle, the most frequent ones; others are afterwards
BROADCAST_KEYS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|ins|mark|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-z!?][^<>]*>", re.I | re.S)
def _any_of(*ranges: tuple[int, int]) -> re.Pattern[str]:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


# Code points that show nothing: soft hyphen, joiners, fillers, directions, variation selectors.
_HIDDEN = _any_of((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0))
_MARKS = _any_of((0x300, 0x36F), (0x483, 0x489), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))


def words(text: str | None) -> set[str]:
    """Distinct words: runs of letters or digits without case, accents, compatibility forms, hidden characters and HTML."""
    if not text:
        return set()
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
    return set(_WORD.findall(text.casefold()))


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word, SEED)


def _multipliers() -> np.ndarray:
    n = 2 * SUB_KEYS * HASHES
    return np.random.default_rng(SEED).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value under each of the multiplicative hash functions."""
    return (hashes[:, None] * by[None, :]).min(axis=0) >> np.uint64(20)


def sub_keys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the minhashes: the first collection as 64-bit keys, the second as packed four-bit values."""
    half = SUB_KEYS * HASHES
    first = low[:half].reshape(SUB_KEYS, HASHES)
    mixed = np.arange(1, SUB_KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(HASHES):
        mixed = (mixed ^ first[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    nibbles = (low[half:] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.uint8)
    return mixed, nibbles[0::2] | nibbles[1::2] << np.uint8(4)


def miss_rate(similarity: float) -> float:
    """The chance that a pair agrees in no sub-key of the first collection, or in none of the second, or looks too unlike."""
    nibble = similarity + (1 - similarity) / 16  # four bits agree by chance too
    tables = (1 - (1 - similarity**HASHES) ** SUB_KEYS) * (1 - (1 - nibble**HASHES) ** SUB_KEYS)
    n = SUB_KEYS * HASHES
    unlike = sum(comb(n, i) * nibble**i * (1 - nibble) ** (n - i) for i in range(LEAST_EQUAL))
    return 1 - tables * (1 - unlike)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = _multipliers()
    for batch in batches:
        ids, classes, sketches = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = words(text)
            if key is None or not found:
                continue
            cls, hashes = _class_of(found)
            first, second = sub_keys(minhashes(hashes, by))
            ids.append(key)
            classes.append(cls)
            sketches.append(first.tobytes() + second.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "cls", "sketch"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each first sub-key, with the second collection."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
        first = sketch[:, : 8 * SUB_KEYS].copy().view(np.int64)
        second = np.repeat(sketch[:, 8 * SUB_KEYS :], SUB_KEYS, axis=0)
        docs = np.frombuffer(b"".join(c[:8] for c in batch.column(0).to_pylist()), np.int64)
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(second.shape[1]), len(second), [None, pa.py_buffer(np.ascontiguousarray(second))])
        yield pa.RecordBatch.from_arrays([pa.array(first.ravel()), pa.array(np.repeat(docs, SUB_KEYS)), packed.cast(pa.binary())], names=["bucket", "doc", "second"])


def _alike(docs: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs (a, b) of positions whose estimate is high enough, as sorted document keys."""
    out = []
    for at in range(0, len(a), 200_000):
        i, j = a[at : at + 200_000], b[at : at + 200_000]
        same = second[i] ^ second[j]
        equal = ((same & 15) == 0).sum(axis=1) + ((same >> 4) == 0).sum(axis=1)
        good = (equal >= LEAST_EQUAL) & (docs[i] != docs[j])
        x, y = docs[i[good]], docs[j[good]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _run_pairs(order: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions inside each run of equal keys."""
    left, right = [], []
    for r in np.unique(lengths):
        if r < 2:
            continue
        i, j = np.triu_indices(r, 1)
        at = starts[lengths == r][:, None]
        left.append(order[at + i[None, :]].ravel())
        right.append(order[at + j[None, :]].ravel())
    zero = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (zero, zero)


def _batch(pairs: np.ndarray, keys: np.ndarray, docs: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b), and texts (key, doc, second) of keys that are too large here."""
    n, m = len(pairs), len(keys)
    a = pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(docs)])
    b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())])
    key = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys)])
    rest = pa.array([None] * n + [x.tobytes() for x in second], pa.binary())
    return pa.RecordBatch.from_arrays([a, b, key, rest], names=["a", "b", "key", "second"])


def _table_keys(buckets: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Per text the keys of the tables that its first sub-key opens."""
    own = np.ascontiguousarray(second).view(np.uint16).astype(np.uint64)
    j = np.arange(own.shape[1], dtype=np.uint64) << np.uint64(16)
    mixed = (buckets.astype(np.int64).view(np.uint64)[:, None] ^ (own | j) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def _collide(buckets: np.ndarray, docs: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Pairs among texts of whole buckets, sorted by bucket."""
    keys = _table_keys(buckets, second)
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    inside = flat[order]
    starts = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
    lengths = np.diff(np.r_[starts, len(inside)])
    large = lengths > BLOCK
    row = order // keys.shape[1]
    i, j = _run_pairs(row, starts[~large], lengths[~large])
    over = np.flatnonzero(np.repeat(large, lengths))
    return _batch(_alike(docs, second, i, j), inside[over], docs[row[over]], second[row[over]])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: at most a batch and one bucket of BUCKET texts are held at a time."""
    held: list[np.ndarray] | None = None
    spilled: int | None = None
    width = SUB_KEYS * HASHES // 2

    def spread(b: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        keys = _table_keys(b, s)
        return _batch(np.zeros((0, 2), np.int64), keys.ravel(), np.repeat(d, keys.shape[1]), np.repeat(s, keys.shape[1], axis=0))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        b, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        s = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, width)
        if held is not None:
            b, d, s = np.r_[held[0], b], np.r_[held[1], d], np.concatenate([held[2], s])
            held = None
        if spilled is not None:
            more = b == spilled
            if more.any():
                yield spread(b[more], d[more], s[more])
                b, d, s = b[~more], d[~more], s[~more]
            if not len(b):
                continue
            spilled = None
        last = np.searchsorted(b == b[-1], True)  # the rows of the last bucket may go on in the next batch
        if last:
            yield _collide(b[:last], d[:last], s[:last])
        held = [b[last:], d[last:], s[last:]]
        if len(held[0]) > BUCKET:
            spilled = int(held[0][0])
            yield spread(*held)
            held = None
    if held is not None:
        yield _collide(*held)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table key of the texts of a frequent first sub-key."""
    for batch in batches:
        n = batch.num_rows
        if n:
            second = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1)
            keys = _table_keys(batch.column(0).to_numpy(), second)
            packed = pa.array([x.tobytes() for x in second], pa.binary()).take(pa.array(np.repeat(np.arange(n), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(1).to_numpy(), keys.shape[1])), pa.array(keys.ravel()), packed], names=["a", "key", "second"])


def _block_pairs(docs: np.ndarray, side: np.ndarray, second: np.ndarray, low: int, high: int) -> np.ndarray:
    """Pairs among the texts of two blocks of one table key, or of one block."""
    i, j = np.flatnonzero(side == low), np.flatnonzero(side == high)
    step = max(1, 1_000_000 // max(1, len(j)))
    out = []
    for at in range(0, len(i), step):
        x, y = np.repeat(i[at : at + step], len(j)), np.tile(j, len(i[at : at + step]))
        out.append(_alike(docs, second, x[x < y], y[x < y]) if low == high else _alike(docs, second, x, y))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, low, high): a batch and the rows of one meeting, at most two blocks, are held at a time."""
    held: list[np.ndarray] | None = None

    def met(parts: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        found = [_block_pairs(parts[0][a:b], parts[4][a:b], parts[5][a:b], int(parts[2][a]), int(parts[3][a])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts = [batch.column(c).to_numpy() for c in ("a", "key", "low", "high", "block")]
        parts.append(np.frombuffer(b"".join(batch.column("second").to_pylist()), np.uint8).reshape(n, -1))
        if held is not None:
            parts = [np.concatenate(x) for x in zip(held, parts, strict=True)]
        new = (parts[1][1:] != parts[1][:-1]) | (parts[2][1:] != parts[2][:-1]) | (parts[3][1:] != parts[3][:-1])
        starts = np.flatnonzero(np.r_[True, new])
        yield met(parts, starts[:-1], starts[1:])  # the last meeting may go on in the next batch
        held = [x[starts[-1] :] for x in parts]
    if held is not None:
        yield met(held, np.array([0]), np.array([len(held[0])]))


def _large_keys(over: DataFrame) -> DataFrame:
    """Pairs among texts (key, a, second) of one table key, whatever its size."""
    large = keep(over.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > META).select("key", F.ceil(F.col("n") / META).cast("int").alias("blocks")), "large-keys")
    few = large.count() <= BROADCAST_KEYS  # there are at most a META-th as many as rows
    placed = over.join(F.broadcast(large) if few else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "a", "second", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_blocks, "a long, b long")


def _frequent(one: DataFrame) -> DataFrame:
    """First sub-keys (bucket) of more than BUCKET texts, told from one in HOT_SAMPLE of them.

    A key that the sample misses is found later, in its task: this decides the way, not the result.
    """
    sample = one.where(F.pmod(F.xxhash64("cls"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(_spread, "bucket long, doc long, second binary")
    count = sample.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return keep(count.where(F.col("n") * HOT_SAMPLE >= BUCKET / 2).orderBy(F.desc("n")).limit(HOT_KEYS).select("bucket"), "frequent")


def candidates(sketches: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of class keys, a < b, that collide in a table and look similar enough."""
    one = sketches.groupBy("cls").agg(F.first("sketch").alias("sketch"))
    spread = one.mapInArrow(_spread, "bucket long, doc long, second binary")
    frequent, opened = _frequent(one), None
    if not frequent.isEmpty():
        named = F.broadcast(frequent)  # HOT_KEYS numbers at most
        opened = spread.join(named, "bucket", "left_semi").mapInArrow(_opened, "a long, key long, second binary")
        spread = spread.join(named, "bucket", "left_anti")
    met = keep(spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long, key long, second binary"), "collisions")
    pairs = met.where("b is not null").select("a", "b")
    over = met.where("b is null").select("a", "key", "second")
    over = over if opened is None else over.unionByName(opened)
    if not over.isEmpty():
        pairs = pairs.unionByName(_large_keys(over))
    return pairs.distinct()


def _class_of(found: set[str]) -> tuple[bytes, np.ndarray]:
    """The digest of a set of words, and their sorted hashes."""
    hashes = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    hashes.sort()
    return xxhash.xxh3_128_digest(hashes.tobytes()), hashes


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts that are of the class they are fetched for: an id may have several texts."""
    for batch in batches:
        docs, reps, sets = [], [], []
        for doc, rep, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "rep", "text")), strict=True):
            found = words(text)
            if found and int.from_bytes(_class_of(found)[0][:8], "little", signed=True) == doc:
                docs.append(doc)
                reps.append(rep)
                sets.append(sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(reps, pa.string()), pa.array(sets, pa.list_(pa.string()))], names=["doc", "rep", "words"])


class NearDuplicates:
    """Classes of equal word sets and the links between similar ones, over all of ``texts``.

    ``texts``: (id, text). Null ids, and null or empty texts and those without a word, are
    similar to nothing and have no class. Rows with one id count once per distinct word set.

    ``members``: (id, cls, rep, copies), one row per text with a class: rep is the smallest id
    of the class, copies its size. ``links``: (rep_a, rep_b, similarity), one row per pair of
    classes of at least ``similarity``. Links are sought among all classes, found in 256 tables
    and verified exactly. The tables miss a pair at 0.6 with a chance of 17 %, at 0.68 of 3.3 %,
    at 0.75 of 0.3 % (:func:`miss_rate`). They are laid out for 0.6: a lower ``similarity`` raises,
    since the tables and LEAST_EQUAL would lose many of its links.
    """

    def __init__(self, texts: DataFrame, similarity: float = SIMILARITY):
        if similarity < SIMILARITY:
            raise UsageError(f"links below a similarity of {SIMILARITY} are not sought")
        texts = texts.select("id", "text")
        sketches = keep(texts.mapInArrow(_sketch, "id string, cls binary, sketch binary"), "sketches")
        found = keep(candidates(sketches), "candidates")
        pairs = sketches.select("id", "cls").distinct()
        classes = pairs.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self._texts, self._pairs, self._classes = texts, pairs, classes
        keyed = classes.select("rep", _first_long("cls").alias("doc"))
        wanted = found.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        needed = keyed.join(wanted, "doc").select("doc", "rep")
        # The words again, of those texts only that are in a candidate pair.
        text_of = texts.join(needed, texts.id == needed.rep).select("doc", "rep", "text")
        sets = keep(text_of.mapInArrow(_word_sets, "doc long, rep string, words array<string>").dropDuplicates(["doc"]), "word-sets")
        left = sets.select(F.col("doc").alias("a"), F.col("rep").alias("x"), F.col("words").alias("wx"))
        right = sets.select(F.col("doc").alias("b"), F.col("rep").alias("y"), F.col("words").alias("wy"))
        both = found.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("wx", "wy"))
        scored = both.withColumn("_c", common).withColumn("similarity", F.col("_c") / (F.size("wx") + F.size("wy") - F.col("_c")))
        links = scored.where(F.col("similarity") >= similarity).select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "similarity")
        self.links = keep(links.distinct(), "links")

    @property
    def members(self) -> DataFrame:
        return self._pairs.join(self._classes, "cls")

    def pairs(self, copies: int | None = None) -> DataFrame:
        """Pairs of ids, smaller first: all members of one class, and for a link all members of the one with all of the other.

        Only where ``copies`` is given, of one raw text under more ids than that the smallest id is
        paired with each and alone stands for them in all other pairs. Large classes meet in blocks
        of about BLOCK members, two blocks at a time.
        """
        members, star = self._pairs.join(self._classes, "cls").select("rep", "id"), None
        if copies is not None:
            members, star = self._represented(copies)
        sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        copied = keep(members.join(sizes, "rep").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "copies")
        met = copied.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("rep", "id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        inside = met.alias("l").join(met.alias("r"), ["rep", "low", "high"]).where("l.id < r.id and (low = high or l.block != r.block)")
        inside = inside.select(F.col("l.id").alias("chunk_id_a"), F.col("r.id").alias("chunk_id_b"))

        linked = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
        stand = linked.join(copied, "rep", "left").select("rep", F.coalesce("id", "rep").alias("id"), F.coalesce("block", F.lit(0)).alias("block"))
        large = copied.where("blocks > 1").select("rep", "blocks").distinct()
        blocks = self.links.select("rep_a", "rep_b")
        for side in ("a", "b"):
            of = large.select(F.col("rep").alias(f"rep_{side}"), "blocks")
            blocks = blocks.join(of, f"rep_{side}", "left").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        ends = [blocks.join(stand.select(F.col("rep").alias(f"rep_{side}"), F.col("block").alias(f"block_{side}"), F.col("id").alias(f"id_{side}")), [f"rep_{side}", f"block_{side}"]) for side in ("a", "b")]
        across = ends[0].join(ends[1], ["rep_a", "rep_b", "block_a", "block_b"]).where("id_a != id_b")
        across = across.select(F.least("id_a", "id_b").alias("chunk_id_a"), F.greatest("id_a", "id_b").alias("chunk_id_b"))
        out = across.unionByName(inside)
        return (out if star is None else out.unionByName(star)).distinct()

    def _represented(self, copies: int) -> tuple[DataFrame, DataFrame]:
        """Members (rep, id) without those that another id with the same raw text stands for, and the pairs of these."""
        marked = self._texts.select(F.concat(F.md5("text"), "id").alias("id"), "text").mapInArrow(_sketch, "id string, cls binary, sketch binary")
        marked = marked.select("cls", F.substring("id", 1, 32).alias("raw"), F.expr("substring(id, 33)").alias("id")).distinct()
        sizes = marked.groupBy("cls", "raw").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        marked = keep(marked.join(sizes, ["cls", "raw"]), "raw-copies")
        stays = (F.col("n") <= copies) | (F.col("id") == F.col("least"))
        members = marked.where(stays).select("cls", "id").distinct().join(self._classes, "cls").select("rep", "id")
        return members, marked.where(~stays).select(F.col("least").alias("chunk_id_a"), F.col("id").alias("chunk_id_b"))

    def groups(self) -> DataFrame:
        """(id, rep, copies, links, group_id): class, number of links of the class, and connected group."""
        links = self.links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
        degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        roots = connected(links).select(F.col("u").alias("rep"), F.col("root").alias("group_id"))
        full = self.members.join(degree, "rep", "left").join(roots, "rep", "left")
        return full.select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "rep").alias("group_id"))


def _first_long(col: str) -> Column:
    """The first eight bytes of a binary as a little-endian long."""
    byte = lambda i: F.conv(F.hex(F.substring(col, i, 1)), 16, 10).cast("long")
    out = byte(1)
    for i in range(2, 9):
        out = out.bitwiseOR(F.shiftleft(byte(i), 8 * (i - 1)))
    return out


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(u, root): the smallest vertex of each vertex' component, by alternating large and small stars.

    ``edges``: (u, v). Every round is written to the shared folder; a hub's neighbours are
    aggregated to their minimum before the shuffle and never gathered. Rounds grow with the
    logarithm of the longest path; not converging within ``most_rounds`` raises.
    """
    edges = keep(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from larger to smaller
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("u != v").select("u", "v").distinct()
        edges = keep(small, "edges")
        after = state(edges)
        if after == before:  # a set of edges by its size and two digests
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("v").alias("u"), F.col("u").alias("root"))
    return stars.groupBy("u").agg(F.min("root").alias("root")).unionByName(stars.select(F.col("root").alias("u"), "root").distinct())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(read(spark, sf_dir, "chunks")).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(read(spark, sf_dir, "chunks")).groups().select(F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"), "copies", "links", "group_id")
