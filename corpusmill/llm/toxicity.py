"""Abusive, hateful or sexual language by class-conditional Kneser-Ney models.

Two bigram models are fitted on a bounded sample of reviewed documents: one of toxic passages,
one of ordinary ones. Both fall back on the same lower-order distribution, the continuation
counts of all documents, so that a rare expression neither model knows speaks for neither. A
passage's score is its log-likelihood ratio by length; a document's score is that of its worst
passage. Reviewers judge documents, not passages: which passages of a toxic document are toxic
is settled by fitting and scoring in turns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.mixing import source_key
from corpusmill.tables import keep, read, rows_at, stored

SAMPLE = {"toxic": 4000, "ordinary": 8000}  # reviewed documents the models are fitted on, at most
DISCOUNT = 0.75
TURNS = 4
LEAST_WORDS = 8  # shorter passages are averaged as if so long
BACKOFF = 5.0  # weight of the lower order, in words, beside the discounted ones
COMMON = 0.7  # part of the lower order that all documents give
MOST = 4.0  # what one word may say
LEAST_DOCS = 3  # toxic documents that share a pair with which the fit begins; of few documents, fewer (one more for each PER_DOC)
PER_DOC = 25
USUAL = 0.7  # a threshold that counts as much as USUAL_DOCS toxic documents beside what the labels say
USUAL_DOCS = 100
CHOSEN = 0.6
MORE_OFTEN = 0.9
LEAST_SCORE = 0.5  # a threshold is not set lower
TOXIC = ("abusive", "hateful", "sexual")
PARTS = 3  # of the sample; the threshold comes from documents the models have not seen
PLATEAU = 0.01
PIECE = 64 << 20  # bytes of a model in a row

# Letters of other scripts that pass for Latin ones, and digits and signs that pass for letters.
_LOOKALIKES = str.maketrans(dict(zip(map(chr, (0x430, 0x432, 0x435, 0x43a, 0x43c, 0x43d, 0x43e, 0x440, 0x441, 0x442, 0x443, 0x445, 0x456, 0x458, 0x455, 0x501, 0x51b, 0x51d, 0x4bb, 0x410, 0x412, 0x415, 0x41a, 0x41c, 0x41d, 0x41e, 0x420, 0x421, 0x422, 0x423, 0x425, 0x406, 0x408, 0x405, 0x3bf, 0x3b1, 0x3b5, 0x3b9, 0x3ba, 0x3bd, 0x3c1, 0x3c4, 0x3c5, 0x3c7, 0x39f, 0x391, 0x395, 0x399, 0x131, 0xdf, 0xf8, 0x142)), "abekmhopctyxijsdqwhabekmhopctyxijsoaeikvptuxoaeiisol", strict=True)))
_LEET = str.maketrans("0134578$@!|+", "oieastbsaiit")
_HIDDEN = re.compile("[" + "".join(map(chr, (0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF))) + "]")
_MARKS = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")
_PASSAGE = re.compile(r"([.!?])[\"')*_~]*[^\S\n]+|,\"(?<=[a-z],\")|\s\|\s|[\n\r]+")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([.\-_*~·]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_AIRY = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
# What every spelled-out word holds, searched for first: from a sign or a space both are found fast.
_DOTTED_SIGN = re.compile(r"[.\-_*~·][^\W\d_][.\-_*~·]")
_AIRY_SIGN = re.compile(r" [^\W\d_] [^\W\d_] ")
_MASKED = re.compile(r"[*#](?<=[^\W\d_].)(?:[*#]+|(?=[^\W\d_]))")  # begins with a set of signs, which is searched fast
_TOKEN = re.compile(r"\n|[^\W_](?:[^\W_]|[$@!|+](?=[^\W_])|[$]|_(?=[^\W_]))*|[$@](?=[^\W\d_])(?:[^\W_]|[$@!|])+|[!?]{2,}")
_LONG = re.compile(r"(.)\1{2,}")
_HEADER = re.compile(r"^\W*([^\W\d_]+):\s", re.M)
_PREFIX = re.compile(r"^[^\w\n]*\[?\d{1,2}:\d{2}\]?\s*", re.M)
_MASK = "qzm"  # stands for the masked letters of a word
_HEAD = "qzh"  # marks the word before a colon at a line's begin: "To:" in a mail is not "to"


@lru_cache(maxsize=500_000)
def plain_word(word: str) -> str:
    """A token without disguise: leet signs as letters, drawn-out letters once; numbers are one word."""
    if word.isdigit():
        return "0"
    if _MASK in word:
        return _MASK
    bare = word.replace("_", "")
    if not bare.isalpha() and any(c.isalpha() or c == "$" for c in bare):
        digits = sum(c.isdigit() for c in bare)
        if re.fullmatch(r"[a-z]+\d+|\d+[a-z]{1,3}", bare) and digits > 1 and not re.fullmatch(r"[a-z]+\d[a-z0-9]*[a-z]", bare):
            bare = re.sub(r"\d+", "0", bare)  # identifiers, times and sizes
        else:
            bare = bare.translate(_LEET)
    return _LONG.sub(r"\1", bare)


def plain_text(text: str) -> str:
    """Lower case Latin letters without accents, hidden characters, spelled-out and masked words."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text))).translate(_LOOKALIKES)
    text = text.lower()
    if "*" in text or "#" in text:
        text = _MASKED.sub(_MASK, text)
    if _DOTTED_SIGN.search(text):
        text = _DOTTED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), text)
    return _AIRY.sub(lambda m: m[0].replace(" ", ""), text) if _AIRY_SIGN.search(text) else text


@lru_cache(maxsize=500_000)
def _code(word: str) -> int:
    """A word as a number above 0; 0 stands between passages."""
    if word == "\n":
        return 0
    return xxhash.xxh32_intdigest(plain_word(word)) % 0x7FFFFFFE + 1


def codes(text: str | None) -> np.ndarray:
    """The words of all passages of a text, each passage followed by 0."""
    if not text:
        return np.zeros(0, np.int32)
    bare = _HEADER.sub(rf"\1{_HEAD} ", _PREFIX.sub("", _PASSAGE.sub(r"\1\n", plain_text(text))))
    found = list(map(_code, _TOKEN.findall(bare)))
    found.append(0)
    out = np.array(found, np.int32)
    keep_ = out != 0
    keep_[1:] |= out[:-1] != 0  # one 0 after each passage
    return out[keep_]


def _bigrams(words: np.ndarray) -> np.ndarray:
    """Code pairs (word before, word) as one number; the edges of passages count as words."""
    w = words.astype(np.int64)
    return np.concatenate([[0], w[:-1]]) << 32 | w if len(w) else w


class Counts:
    """Sorted values with counts, looked up in bulk; what is missing counts 0."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts

    @classmethod
    def of(cls, items: np.ndarray) -> Counts:
        return cls(*np.unique(items, return_counts=True))

    def get(self, items: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(items), self.counts.dtype)
        at = np.minimum(np.searchsorted(self.values, items), len(self.values) - 1)
        return np.where(self.values[at] == items, self.counts[at], 0)


class Shared:
    """Counts over all documents that both classes fall back on: word pairs, contexts, and in how many contexts a word occurs."""

    def __init__(self, pairs: Counts, contexts: Counts, endings: Counts, types: int):
        self.pairs, self.contexts, self.endings, self.types = pairs, contexts, endings, max(1, types)

    def word(self, words: np.ndarray) -> np.ndarray:
        return (self.endings.get(words) + 0.5) / self.types

    def pair(self, bigrams: np.ndarray) -> np.ndarray:
        n = self.contexts.get(bigrams >> 32)
        seen = np.maximum(self.pairs.get(bigrams) - DISCOUNT, 0)
        return (seen + BACKOFF * self.word(bigrams & 0xFFFFFFFF)) / (n + BACKOFF)


class KneserNey:
    """Bigram probabilities of one class: discounted pairs, then the class' words by the contexts they end, then all documents."""

    def __init__(self, bigrams: np.ndarray, shared: Shared):
        self.pairs = Counts.of(bigrams)
        contexts, at = np.unique(self.pairs.values >> 32, return_inverse=True)
        self.context = Counts(contexts, np.bincount(at, self.pairs.counts) if len(contexts) else np.zeros(0))
        self.followers = Counts(contexts, np.bincount(at).astype(float) if len(contexts) else np.zeros(0))
        self.endings = Counts.of(self.pairs.values & 0xFFFFFFFF)
        self.shared = shared

    def lower(self, words: np.ndarray) -> np.ndarray:
        known = np.maximum(self.endings.get(words) - DISCOUNT, 0)
        rest = DISCOUNT * len(self.endings.values) + BACKOFF
        return (known + rest * self.shared.word(words)) / (len(self.pairs.values) + BACKOFF)

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        return (DISCOUNT * self.followers.get(contexts) + BACKOFF) / (self.context.get(contexts) + BACKOFF)

    def log_probability(self, bigrams: np.ndarray, common: np.ndarray) -> np.ndarray:
        before, after = bigrams >> 32, bigrams & 0xFFFFFFFF
        seen = np.maximum(self.pairs.get(bigrams) - DISCOUNT, 0) / (self.context.get(before) + BACKOFF)
        return np.log(seen + self.rest(before) * ((1 - COMMON) * self.lower(after) + COMMON * common))


class Model:
    """The log ratio of the two classes as lookups: of known pairs, else of words."""

    def __init__(self, pairs: Counts, words: Counts, other: float, threshold: float):
        self.pairs, self.words, self.other, self.threshold = pairs, words, other, threshold

    @classmethod
    def of(cls, toxic: KneserNey, ordinary: KneserNey, shared: Shared) -> Model:
        def ratio(pairs: np.ndarray, common: np.ndarray) -> np.ndarray:
            return np.clip(toxic.log_probability(pairs, common) - ordinary.log_probability(pairs, common), -MOST, MOST)

        known = np.union1d(toxic.pairs.values, ordinary.pairs.values)
        after = np.unique(known & 0xFFFFFFFF)
        # A pair that neither class knows: what its word says; that it is new speaks for neither.
        words = ratio(after | 0x7FFFFFFF << 32, shared.word(after))
        other = float(ratio(np.array([0x7FFFFFFF << 32 | 0x7FFFFFFF]), np.array([0.5 / shared.types]))[0])
        return cls(Counts(known, ratio(known, shared.pair(known))), Counts(after, words), other, 0.0)

    def ratios(self, bigrams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pairs.values, bigrams), max(0, len(self.pairs.values) - 1))
        known = self.pairs.values[at] == bigrams if len(self.pairs.values) else np.zeros(len(bigrams), bool)
        out = np.empty(len(bigrams))
        out[known] = self.pairs.counts[at[known]]
        new = bigrams[~known]
        after = new & 0xFFFFFFFF
        place = np.minimum(np.searchsorted(self.words.values, after), max(0, len(self.words.values) - 1))
        of_word = np.where(self.words.values[place] == after, self.words.counts[place], self.other) if len(self.words.values) else np.full(len(new), self.other)
        out[~known] = of_word
        return out

    def passages(self, words: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(score, end) of each passage; one shorter than ``least`` words counts as that long."""
        ends = np.flatnonzero(words == 0)
        if not len(ends):
            return np.zeros(0), ends
        total = np.add.reduceat(self.ratios(_bigrams(words)), np.r_[0, ends[:-1] + 1])
        length = np.diff(np.r_[-1, ends])
        return total / np.maximum(length, LEAST_WORDS if least is None else least), ends

    def to_bytes(self) -> bytes:
        arrays = [np.array([self.other, self.threshold])]
        for c in (self.pairs, self.words):
            arrays += [c.values.astype(np.int64), c.counts.astype(np.float64)]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        sizes, at, out = np.frombuffer(raw, np.int64, 5), 40, []
        for i, n in enumerate(sizes):
            out.append(np.frombuffer(raw, np.int64 if i % 2 else np.float64, n, at))
            at += 8 * int(n)
        return cls(Counts(out[1], out[2]), Counts(out[3], out[4]), float(out[0][0]), float(out[0][1]))


def _taken(words: np.ndarray, chosen: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words of the chosen passages."""
    length = np.diff(np.r_[-1, ends])
    return words[np.repeat(chosen, length)] if len(ends) else words[:0]


def _frequent(passages: list[np.ndarray], least: int) -> np.ndarray:
    """The pairs of all passages that occur in at least ``least`` documents."""
    each = [_bigrams(w) for w in passages]
    if not each:
        return np.zeros(0, np.int64)
    in_docs = Counts.of(np.concatenate([np.unique(b) for b in each]))
    every = np.concatenate(each)
    return every[in_docs.get(every) >= least]


def fit(toxic: list[np.ndarray], ordinary: list[np.ndarray], shared: Shared) -> Model:
    """Models of toxic and ordinary passages, from documents that hold some and none.

    At first every passage of a toxic document counts as toxic, but only pairs that several
    such documents share. Then only the passages that score high do, and those that score below 0 are ordinary.
    A passage that clean documents hold as often, such as a house rule, is never taken.
    """
    clean = np.concatenate([_bigrams(w) for w in ordinary]) if ordinary else np.zeros(0, np.int64)
    least = min(LEAST_DOCS, 1 + len(toxic) // PER_DOC)
    model = Model.of(KneserNey(_frequent(toxic, least), shared), KneserNey(clean, shared), shared)
    share = Model.of(KneserNey(_frequent(toxic, 1), shared), KneserNey(clean, shared), shared)
    for _ in range(TURNS):
        bad, good = [], [clean]
        for words in toxic:
            scores, ends = model.passages(words)
            if len(scores):
                chosen = (scores >= CHOSEN) & (scores >= 0.5 * scores.max()) & (share.passages(words, 1)[0] >= MORE_OFTEN)
                bad.append(_taken(words, chosen, ends))
                good.append(_bigrams(_taken(words, scores < 0, ends)))  # between the two a passage counts for neither
        model = Model.of(KneserNey(_frequent(bad, 1), shared), KneserNey(np.concatenate(good), shared), shared)
    return model


def worst(model: Model, documents: list[np.ndarray]) -> np.ndarray:
    """The highest passage score of each document; -MOST without a word."""
    out = np.full(len(documents), -MOST, float)
    full = [i for i, w in enumerate(documents) if len(w)]
    if full:
        words = np.concatenate([documents[i] for i in full])
        scores, ends = model.passages(words)
        first = np.searchsorted(ends, np.cumsum([0] + [len(documents[i]) for i in full[:-1]]))
        out[full] = np.maximum.reduceat(scores, first)
    return out


def threshold(toxic: list[np.ndarray], ordinary: list[np.ndarray], shared: Shared) -> float:
    """The score that tells the classes apart best on documents left out of the fit, with few false alarms.

    The fewer toxic documents there are, the less their say beside the usual threshold.
    """
    bad, good = [], []
    for part in range(PARTS):
        model = fit([w for i, w in enumerate(toxic) if i % PARTS != part], [w for i, w in enumerate(ordinary) if i % PARTS != part], shared)
        bad.extend(worst(model, toxic[part::PARTS]))
        good.extend(worst(model, ordinary[part::PARTS]))
    if not bad or not good:
        return 1.0
    values = np.r_[bad, good]
    wrong, right = np.sort(good), np.sort(bad)
    steps = np.unique(values[values > 0.1])
    alarms, hits = len(wrong) - np.searchsorted(wrong, steps), len(right) - np.searchsorted(right, steps)
    f1 = 2 * hits / np.maximum(1, len(right) + hits + alarms)
    usual = lambda found: (len(bad) * found + USUAL_DOCS * USUAL) / (len(bad) + USUAL_DOCS)
    if not len(steps):
        return usual(1.0)
    level = steps[f1 >= f1.max() - PLATEAU]  # what does as well; rather high in it, as toxic texts are rarer than in the sample
    return usual(max(LEAST_SCORE, float(0.4 * level.min() + 0.6 * level.max())))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [codes(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(words, pa.binary())], names=["doc_id", "source", "words"])


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w, np.int32) for w in column.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word pairs with counts, summed over some batches before they are sent."""
    held: list[np.ndarray] = []

    def sums() -> pa.RecordBatch:
        c = Counts.of(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(c.values), pa.array(c.counts)], names=["pair", "n"])

    for batch in batches:
        held += [_bigrams(w) for w in _words(batch.column(0))]
        if sum(map(len, held)) > 4_000_000:
            yield sums()
            held = []
    if held:
        yield sums()


def _trained(table: pa.Table) -> pa.Table:
    kind, a, n = (table.column(c).to_numpy() for c in ("kind", "a", "n"))

    def counts(k: int) -> Counts:
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(a[at], kind="stable")]
        return Counts(a[at], n[at])

    types = n[kind == 4]
    shared = Shared(counts(1), counts(2), counts(3), int(types[0]) if len(types) else 1)
    docs = table.filter(pa.array(kind == 0)).sort_by("a")
    words, label = _words(docs.column("words")), docs.column("n").to_numpy()
    toxic, ordinary = ([w for w, x in zip(words, label, strict=True) if x == side] for side in (1, 0))
    model = fit(toxic, ordinary, shared)
    model.threshold = threshold(toxic, ordinary, shared)
    raw = model.to_bytes()
    pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
    return pa.table({"part": pa.array(range(len(pieces)), pa.int32()), "model": pa.array(pieces, pa.binary())})


@lru_cache(maxsize=1)
def _model(path: str) -> Model:
    """The model that a worker scores with, read once."""
    return Model.from_bytes(b"".join(rows_at(path).sort_by("part").column("model").to_pylist()))


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, n): 1 where more reviewers found a document toxic than clean, 0 where some found it clean and none toxic.

    A reviewer's last verdict counts; unsure and null ones do not.
    """
    last = labels.groupBy("doc_id", "reviewer").agg(F.max(F.struct("reviewed_at", "verdict")).alias("v"))
    votes = last.groupBy("doc_id").agg(F.count_if(F.col("v.verdict").isin(*TOXIC)).alias("bad"), F.count_if(F.col("v.verdict") == "clean").alias("good"))
    side = F.when(F.col("bad") > F.col("good"), 1.0).when((F.col("good") > 0) & (F.col("bad") == 0), 0.0)
    return votes.select("doc_id", side.alias("n")).where("n is not null and doc_id is not null")


def train(coded: DataFrame, labels: DataFrame) -> str:
    """The path of a model fitted in one task on at most SAMPLE reviewed documents, chosen by hash; the lower order counts all documents.

    Of those counts the task gets the pairs, contexts and words of the sample. The model, of
    the sample's size, goes to the shared folder; the driver never has it.
    """
    reviewed = keep(verdicts(labels), "verdicts")
    number = {r.n: r.k for r in reviewed.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    most = lambda side, n: F.pmod(F.xxhash64("doc_id"), F.lit(max(1, number.get(n, 1)))) < SAMPLE[side]
    chosen = reviewed.where(((F.col("n") == 1) & most("toxic", 1.0)) | ((F.col("n") == 0) & most("ordinary", 0.0)))
    sample = keep(coded.join(chosen, "doc_id").select("doc_id", "n", "words"), "sample")
    before, after = F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF)
    pairs = keep(coded.select("words").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    own = keep(sample.select("words").mapInArrow(_counted, "pair long, n long").select("pair").distinct(), "own-pairs")
    nothing = F.lit(None).cast("binary").alias("words")
    one = lambda k, a, n: (F.lit(k).alias("kind"), a.alias("a"), n.cast("double").alias("n"), nothing)
    contexts = pairs.groupBy(before.alias("v")).agg(F.sum("n").alias("n")).join(own.select(before.alias("v")).distinct(), "v", "left_semi")
    endings = pairs.groupBy(after.alias("w")).agg(F.count(F.lit(1)).alias("n")).join(own.select(after.alias("w")).distinct(), "w", "left_semi")
    rows = sample.select(F.lit(0).alias("kind"), F.col("doc_id").cast("long").alias("a"), "n", "words")
    rows = rows.unionByName(pairs.join(own, "pair", "left_semi").select(*one(1, F.col("pair"), F.col("n"))))
    rows = rows.unionByName(contexts.select(*one(2, F.col("v"), F.col("n")))).unionByName(endings.select(*one(3, F.col("w"), F.col("n"))))
    rows = rows.unionByName(pairs.agg(F.count(F.lit(1)).alias("n")).select(*one(4, F.lit(0).cast("long"), F.col("n"))))
    return stored(rows.groupBy().applyInArrow(_trained, "part int, model binary"), "model")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document.

    ``documents``: (doc_id, text, source), doc_id unique; ``labels``: (doc_id, reviewer, verdict,
    reviewed_at). Null, empty and wordless texts score -MOST and are never flagged. Whole texts
    are scored, each by its worst passage. Without labels nothing is flagged.
    """
    coded = keep(documents.select("doc_id", "source", "text").mapInArrow(_coded, "doc_id long, source string, words binary"), "coded")
    path = train(coded, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            found = np.round(worst(model, _words(batch.column("words"))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(found), pa.array(found >= model.threshold)], names=["doc_id", "source", "score", "flagged"])

    return coded.mapInArrow(scored, "doc_id long, source string, score double, flagged boolean")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, spellings joined: documents, flagged ones and their rate."""
    per = p8_scores(spark, sf_dir).groupBy(F.coalesce(source_key(F.col("source")), F.lit("unknown")).alias("source"))
    return per.agg(F.count(F.lit(1)).alias("docs"), F.count_if("flagged").alias("flagged_docs"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))
