"""Phrase collocations: n-grams as rows, counted per language, scored by their weakest cut in Decimal.

One pass over the texts for each order explodes the n-grams of whole texts into rows (lang, phrase,
count), one for each distinct n-gram of a few megabytes of text, and a hash aggregation adds them up.
An n-gram that occurs `least` times has parts that do, so the pass of order n leaves out those of which
either part of n - 1 words is surely rarer: a bitmap of fixed size marks the hashes of the frequent
parts. It lets some rare ones through and holds back no frequent one, so counts are exact at any size.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.llm._shared import discard, stage

#: Bits of the bitmap (16 MB), and bytes of text that are looked at together.
BITS, UNIT = 1 << 27, 1 << 20
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, separators to line feeds, tabs to spaces.
FOLD = bytes.maketrans(bytes(range(65, 91)) + SEPARATORS + b"\t", bytes(range(97, 123)) + b"\n" * len(SEPARATORS) + b" ")
RUNS = re.compile(b"  +")
BREAK = re.compile(b"[ \n]+")
EMPTY = np.zeros(0, np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when needed."""

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


class Unit:
    """Words of some texts, one after the other: where they stand, their piece, the language of their text."""

    def __init__(self, texts: list[bytes], langs: list[int], owned: list[int], powers: Powers):
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        word = (self.bytes != 32) & (self.bytes != 10)
        turn = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.piece = np.cumsum(self.bytes == 10)[self.start]
        text = np.searchsorted(ends, self.start, "right")
        self.lang = np.asarray(langs, np.int64)[text]
        # Words after the owned part of a text belong to the next unit as beginnings.
        self.own = self.start - np.concatenate([[0], ends[:-1]])[text] < np.asarray(owned, np.int64)[text]
        powers.upto(len(self.bytes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers.up[: len(self.bytes)])])
        self.word = mixed((sums[self.end] - sums[self.start]) * powers.down[self.start])

    def hashes(self, n: int, seeds: np.ndarray) -> np.ndarray:
        """Hash of the n words from each word on, with its language's seed; without regard to pieces."""
        h = mixed(self.word + seeds[self.lang])
        for k in range(1, n):
            h = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.word[k:])
        return h

    def ngrams(self, n: int) -> np.ndarray:
        """Words that begin an owned n-gram within one piece."""
        if n > len(self.start):
            return EMPTY
        last = len(self.start) - n + 1
        return np.flatnonzero(self.own[:last] & (self.piece[:last] == self.piece[n - 1 :]))

    def counted(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct (phrase, language) among the n-grams at these words, and how often each occurs."""
        begin, sizes = self.start[at], self.end[at + n - 1] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = self.bytes[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)]
        phrases = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        langs = int(self.lang.max(initial=0)) + 1
        keys, counts = np.unique(phrases.indices.to_numpy().astype(np.int64) * langs + self.lang[at], return_counts=True)
        return phrases.dictionary.take(pa.array(keys // langs)), keys % langs, counts


def folded(text: bytes) -> bytes:
    """Lower-case A-Z, line feeds for separators, single spaces between words."""
    return RUNS.sub(b" ", text.translate(FOLD))


def spans(text: bytes, n: int, size: int = UNIT) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts (bytes, how many of them are its own): cut between words, each with n - 1 words more."""
    start = 0
    while len(text) - start > size:
        cut = BREAK.search(text, start + size)
        if not cut or cut.end() == len(text):
            break
        upto = cut.end()
        for _ in range(n - 1):
            more = BREAK.search(text, upto)
            upto = more.end() if more else len(text)
        yield text[start:upto], cut.end() - start
        start = cut.end()
    yield text[start:], len(text) - start


def units(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[Unit, list[str]]]:
    """The texts of (lang, text) batches in units of about UNIT bytes, with the languages that occur."""
    powers, texts, codes, owned, names, held = Powers(), [], [], [], {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part, own in spans(folded(text.as_py()), n):
                texts.append(part)
                codes.append(names.setdefault(lang, len(names)))
                owned.append(own)
                held += len(part)
                if held >= UNIT or len(texts) >= UNIT >> 4:
                    yield Unit(texts, codes, owned, powers), list(names)
                    texts, codes, owned, names, held = [], [], [], {}, 0
    if texts:
        yield Unit(texts, codes, owned, powers), list(names)


def lang_seeds(langs: list[str]) -> np.ndarray:
    import zlib

    return mixed(np.array([zlib.crc32(x.encode()) + 1 for x in langs], np.uint64))


def ngram_rows(rows: DataFrame, n: int, frequent=None) -> DataFrame:
    """(lang, phrase, f) of the n-grams of (lang, text) rows, several rows for a phrase. Order 1 adds (lang, null, number of words).

    frequent: a broadcast bitmap of the hashes of phrases of n - 1 words, without which a phrase cannot be frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8) if frequent else None
        for unit, langs in units(batches, n):
            at = unit.ngrams(n)
            if n == 1:
                words = np.bincount(unit.lang[at], minlength=len(langs))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(words, pa.int64())], ["lang", "phrase", "f"])
            elif len(at):
                h = unit.hashes(n - 1, lang_seeds(langs)) % np.uint64(BITS)
                marked = (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
                at = at[(marked[at] & marked[at + 1]).astype(bool)]
            if len(at):
                phrases, of, counts = unit.counted(at, n)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(of)), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, phrase string, f long")


@F.arrow_udf(LongType())
def bit_place(langs: pa.Array, phrases: pa.Array) -> pa.Array:
    """The bit of a phrase in its language, as ngram_rows looks it up."""
    texts, names = [p.encode() for p in phrases.to_pylist()], {}
    codes = [names.setdefault(x, len(names)) for x in langs.to_pylist()]
    if not texts:
        return pa.array([], pa.int64())
    unit, n = Unit(texts, codes, [len(t) + 1 for t in texts], Powers()), texts[0].count(b" ") + 1
    return pa.array((unit.hashes(n, lang_seeds(list(names))) % np.uint64(BITS))[unit.ngrams(n)].astype(np.int64), pa.int64())


def bitmap(phrases: DataFrame) -> bytes:
    """Marks of the phrases of (lang, phrase) rows, all of one order: BITS bits, whatever their number."""
    # The built-in functions count places from 1, and buckets of 32768 places too.
    place = phrases.select((bit_place("lang", "phrase") + 1).alias("p"))
    marks = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(BITS // 8)
    for row in marks.toLocalIterator():  # at most BITS / 32768 rows of 4096 bytes
        at = (row.bucket - 1) * 4096
        out[at : at + 4096] = row.bits
    return bytes(out)


def phrase_counts(docs: DataFrame, most_words: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to most_words words that occur `least` times; staged.

    The row of words 0 and phrase null holds a language's number of words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    levels, marks = [], None
    for n in range(1, most_words + 1):
        counted = ngram_rows(rows, n, marks).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        kept = counted.where((F.col("f") >= least) | F.col("phrase").isNull())
        words = F.when(F.col("phrase").isNull(), 0).otherwise(n)
        levels.append(stage(kept.select("lang", "phrase", words.alias("words"), "f"), f"phrases-{n}", arrow_rows=256))
        if marks is not None:
            marks.destroy()
        marks = spark.sparkContext.broadcast(bitmap(levels[-1].where("phrase is not null"))) if n < most_words else None
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    whole = stage(out, "phrases")
    discard(*levels)
    return whole


def collocations(docs: DataFrame, most_words: int = 4, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to most_words words of each language.

    A phrase of a occurrences, cut after its first k words, scores floor(2000000 * a / (l + r)) by the counts of its
    parts; the lowest-scoring cut counts, of equal ones the first. A phrase is dropped if a longer one that
    contains it occurs at least share percent as often; as the longer phrases between two contained ones are
    no rarer than the longest, extensions by one word suffice. Products are Decimal.
    Null texts count as empty; null languages as `und`; repeated rows and texts count each time; other columns,
    whatever their names, are not read; an empty table, and texts without a frequent phrase, give no rows. Of equal
    scores the more frequent phrase is first, then the lesser in byte order.
    """
    counts = phrase_counts(docs, most_words, least, text_col, lang_col)
    known = counts.where("words between 1 and %d" % (most_words - 1)).select("lang", "phrase", "f")
    found = counts.where("words >= 2")
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    big = lambda c: F.col(c).cast("decimal(28,0)")
    met = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr("(2000000 * cast(a as decimal(28,0))) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))"))
    scored = met.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "words", "cut.a", "cut.l", "cut.r", "cut.score")
    longer = found.where("words >= 3").select("lang", F.col("f").alias("longer"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * share)).drop("longer", "words")
    # The best of each hash bucket first, so that no task orders a whole language.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = held.withColumn("__bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
