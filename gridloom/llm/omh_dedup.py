"""Near-duplicates by Order MinHash with banded alignment.

Every distinct text gets SKETCHES samples. A sample takes, under its own hash, the MINIMA
smallest occurrence-labelled k-mers (five words; the i-th occurrence of a k-mer is an element of its
own) and keeps them in the order of the text, so that it collides for texts that share k-mers in the
same order: it is sensitive to edit similarity. Texts that collide in a sample are candidates of
the least text of that bucket; buckets of one sample and of two samples together are used. A
candidate pair is linked where a banded alignment of the words finds at most
(1 - similarity) * longer length edits. Linked texts and equal texts form classes.

Each member first meets its buckets' least members (leaders), the one with most common buckets
before the others, so most classes form without a look at the pairs of a bucket. A third phase
compares what is left: members of one bucket whose labels still differ. Texts within the allowed
edits share at least n - edits of their words, so (as in prefix filtering) they share one of their
edits + 1 rarest words; an equi-join on these rare words, instead of all pairs of the bucket, finds
every pair that may align. So each pair that collides in a sample is aligned or in one class by
other links, and a passage that many texts share costs no pairs, as its words are not rare.
With similarity 0.8 of five-word shingles a sample collides with probability about 0.5, so 20
samples miss a pair once in a million.
"""

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from gridloom.llm._shared import WORD, discard, stage

K, SKETCHES, MINIMA, SIMILARITY = 5, 20, 3, 0.8
CHUNK = 1 << 18
#: Rows in a batch of texts for Python.
BATCH = 500
#: Counters that order words from rare to frequent: a fixed size, whatever the corpus.
COUNTERS = 1 << 20
#: Counters in a row that a task hands on (at most 64 rows for each task), and such rows in a batch: 32 MB.
COUNTER_BLOCK, COUNTER_ROWS = 1 << 14, 64
#: Rows in half a cell of the third phase, about; rare words of at most CELL / 32 texts share cells.
CELL = 2048
#: Classes of at most FEW texts meet others pair by pair; larger ones in cells of two blocks of so many texts and bytes, about.
FEW, BLOCK, BLOCK_BYTES = 16, 256, 1 << 21
#: Characters of text whose words an alignment keeps for the next pair, about.
CACHE_CHARS = 1 << 22
#: Bits that an alignment keeps as whole masks of words: 64 MB.
MASK_BITS = 1 << 29


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmers(words: list[str], codes: dict[str, int], k: int = K) -> np.ndarray:
    """Hash of every occurrence-labelled k-mer in the order of the text; a shorter text is one k-mer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    get, ids = codes.get, []
    for w in words:
        c = get(w)
        if c is None:
            raw = w.encode()
            c = codes[w] = zlib.crc32(raw) | (zlib.crc32(raw, 0x2545F491) << 32)
        ids.append(c)
    ids = mix(np.array(ids, np.uint64))
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - k + 1 + j]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if not new.all():
        at = np.arange(len(h))
        occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
        label = np.empty(len(h), np.uint64)
        label[order] = occurrence.astype(np.uint64)
        h = mix(h + label * np.uint64(0xD6E8FEB86659FD93))
    return h


def order_minhash(h: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """One 64-bit value for each sample: its smallest k-mers in the order of the text."""
    out = np.empty(sketches, np.uint64)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    rows = max(1, CHUNK // max(1, len(h)))
    for first in range(0, sketches, rows):
        part = seeds[first : first + rows, None]
        v = (h[None, :] ^ (part >> np.uint64(7))) * part
        v ^= v >> np.uint64(32)
        if len(h) > minima:
            at = np.sort(np.argpartition(v, minima - 1, axis=1)[:, :minima], axis=1)
        else:
            at = np.tile(np.arange(len(h)), (len(part), 1))
        picked = h[at]
        value = np.zeros(len(part), np.uint64)
        for j in range(picked.shape[1]):
            value = mix(value * np.uint64(0xD1342543DE82EF95) + picked[:, j])
        out[first : first + rows] = value
    return out


def sketch_column(text: Column, k: int = K, sketches: int = SKETCHES, minima: int = MINIMA) -> Column:
    """array<long> of the samples; empty for null and texts without a word."""
    word = WORD

    @F.arrow_udf(ArrayType(LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, codes = re.compile(word).findall, {}
        with np.errstate(over="ignore"):
            for texts in batches:
                out = []
                for t in texts:
                    h = kmers(find(t.as_py() or ""), codes, k)
                    out.append(order_minhash(h, sketches, minima).view(np.int64) if len(h) else np.zeros(0, np.int64))
                    if len(codes) > 1 << 17:
                        codes.clear()
                yield pa.array(out, pa.list_(pa.int64()))

    return run(text)


class Places:
    """Where a word stands in a text, as bits of the band of `most` places around a position.

    The most frequent words have a mask of the whole text, as many words as MASK_BITS allow (all, below some
    20,000 words); the band of another word is made of its few places when it is asked for. So memory grows
    with the text, not with its square.
    """

    def __init__(self, a: list[int], most: int):
        self.most, self.places, self.masks = most, {}, {}
        if len(a) < 2048:
            for i, w in enumerate(a):
                self.masks[w] = self.masks.get(w, 0) | 1 << i
            return
        for i, w in enumerate(a):
            self.places.setdefault(w, []).append(i)
        dense = sorted(self.places, key=lambda w: -len(self.places[w]))[: max(1, MASK_BITS // max(1, len(a)))]
        self.masks = {w: self.bits(self.places[w], 0) for w in dense}

    @staticmethod
    def bits(places: list[int], low: int) -> int:
        if len(places) < 4:
            return sum(1 << (p - low) for p in places)
        out = bytearray((places[-1] - low) // 8 + 1)
        for p in places:
            out[(p - low) >> 3] |= 1 << ((p - low) & 7)
        return int.from_bytes(out, "little")

    def band(self, word: int, j: int) -> int:
        """Bit i is set where the text has the word at place j - most + i."""
        low = j - self.most
        mask = self.masks.get(word)
        if mask is not None:
            return mask << -low if low <= 0 else mask >> low
        places = self.places.get(word, ())
        if not places:
            return 0
        return self.bits(places[bisect_left(places, low) : bisect_right(places, j + self.most)], low)


def banded(a: list[int], b: list[int], most: int) -> bool:
    """Whether at most `most` edits turn a into b; len(b) <= len(a) <= len(b) + most, most < len(a). Exact.

    The dynamic-programming band of 2 most + 1 cells along the diagonal is kept as bits of its vertical
    differences and moved one column at a time (Hyyro 2003), on integers as wide as the band.
    """
    n, m, width = len(a), len(b), 2 * most + 1
    full = (1 << width) - 1
    equal_at = Places(a, most)
    up, down = full ^ ((1 << most) - 1), 0
    distance, lowest, bottom = most, 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    for j in range(m):
        equal = equal_at.band(b[j], j) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        plus, minus = down | (full ^ (diagonal | up)), diagonal & up
        if j < n - most:
            # Along the band's lower edge, until that meets the last row.
            distance += not diagonal & lowest
            if distance > most + m - (n - most):
                return False
        else:
            distance += bool(plus & bottom) - bool(minus & bottom)
            bottom >>= 1
        diagonal >>= 1
        up, down = minus | (full ^ (diagonal | plus)), diagonal & plus
    return distance <= most


def aligned(a: list[str], b: list[str], most: int, counts: tuple[Counter, Counter] | None = None) -> bool:
    """Whether at most `most` insertions, deletions and substitutions of words turn a into b; exact.
    counts: how often each word is in a and in b, where that is known.

    Words that only one text has bound the edits from below, which rejects most unlike pairs, and
    tell how wide a band to try before the full one.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return False
    if most >= n or a == b:
        return True
    left, right = counts or (Counter(a), Counter(b))
    least = n - (left & right).total()
    if least > most:
        return False
    codes: dict[str, int] = {}
    x, y = [codes.setdefault(w, len(codes)) for w in a], [codes.setdefault(w, len(codes)) for w in b]
    narrow = least + least // 4 + 8
    return (narrow < most and banded(x, y, narrow)) or banded(x, y, most)


class Parsed(dict):
    """text -> (words, how often each), kept for the next pairs: the joins leave the pairs of a text side by side."""

    def __init__(self, find):
        self.find, self.held = find, 0

    def __missing__(self, text: str) -> tuple[list[str], Counter]:
        self.held += len(text)
        if self.held > CACHE_CHARS:
            self.clear()
            self.held = len(text)
        words = self.find(text)
        self[text] = out = words, Counter(words)
        return out


def similar_column(left: Column, right: Column, similarity: float = SIMILARITY) -> Column:
    word = WORD

    @F.arrow_udf(BooleanType())
    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        known, out = Parsed(re.compile(word).findall), []
        for a, b in zip(lefts, rights, strict=True):
            (a, p), (b, q) = known[a.as_py() or ""], known[b.as_py() or ""]
            out.append(aligned(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9), (p, q)))
        return pa.array(out, pa.bool_())

    return run(left, right)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, rep_id (least id), n rows, sketch of every distinct text; staged. Null texts are left out."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), sketch_column(F.col(text_col)).alias("sketch"))
    return stage(rows.groupBy("k").agg(F.min("id").alias("rep_id"), F.count("*").alias("n"), F.first("sketch").alias("sketch")), "omh-sketches", BATCH)


def candidates(prints: DataFrame) -> DataFrame:
    """k, leader, votes: each text with the least text of every bucket it is in; staged."""
    s = F.col("sketch")
    single = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda j: F.xxhash64(j, F.get(s, j)))
    double = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 2), F.lit(2)), lambda j: F.xxhash64(j, F.get(s, j), F.get(s, j + 1)))
    buckets = prints.where(F.size("sketch") > 0).select("k", F.explode(F.concat(single, double)).alias("bucket"))
    # Partial aggregation leaves a row for each bucket and task, however many texts the bucket holds.
    leaders = buckets.groupBy("bucket").agg(F.min("k").alias("leader"), F.max("k").alias("last")).where("leader <> last").drop("last")
    leaders = stage(leaders, "omh-leaders")
    met = buckets.join(leaders, "bucket").where("k <> leader")
    out = stage(met.groupBy("k", "leader").agg(F.count("*").alias("votes")), "omh-candidates")
    discard(leaders)
    return out


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, more: list[str] = ()) -> DataFrame:
    """The (k, leader) pairs whose texts align, with `more` columns; staged. texts: k, text."""
    left = pairs.join(texts.withColumnRenamed("text", "a"), "k")
    both = left.join(texts.select(F.col("k").alias("leader"), F.col("text").alias("b")), "leader")
    return stage(both.where(similar_column(F.col("a"), F.col("b"), similarity)).select("k", "leader", *more), "omh-links", BATCH, spread=True)


def labelled_words(text: str, find=re.compile(WORD).findall) -> np.ndarray:
    """A 63-bit hash of each word of a text with the number of its earlier occurrences there."""
    words = find(text)
    seen: dict[str, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        seen[w] = at = seen.get(w, 0) + 1
        raw = w.encode()
        out[i] = (zlib.crc32(raw) | (zlib.crc32(raw, 0x2545F491) << 32)) + at * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        return mix(out) >> np.uint64(1)


def counter_of(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(COUNTERS)).astype(np.int64)


def packed(held: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counters that are not 0, a row for each block of COUNTER_BLOCK of them."""
    at = np.flatnonzero(held)
    for first in range(0, COUNTERS, COUNTER_BLOCK):
        part = at[np.searchsorted(at, first) : np.searchsorted(at, first + COUNTER_BLOCK)]
        if len(part):
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (part, held[part], low[part], high[part])]
            yield pa.RecordBatch.from_arrays([pa.array([first // COUNTER_BLOCK], pa.int64()), *lists], names=["block", "at", "n", "low", "high"])


def word_counters(texts: DataFrame, words_of: Callable[[str], np.ndarray]) -> np.ndarray:
    """How many words have each of the COUNTERS hash values, 0 where their texts have one label: at most that many numbers for the driver.

    Each task counts its texts and gives a row for each block of counters; a block's rows meet in one task,
    which adds them up as they come. Memory is three arrays of COUNTERS numbers, whatever the texts and tasks.
    """

    def empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(COUNTERS, np.int64), np.full(COUNTERS, 1 << 56), np.full(COUNTERS, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, high = empty()
        for batch in batches:
            for label, t in zip(batch.column(0), batch.column(1), strict=True):
                at, of = counter_of(words_of(t.as_py())), int.from_bytes(label.as_py()[:7])
                np.add.at(held, at, 1)
                low[at], high[at] = np.minimum(low[at], of), np.maximum(high[at], of)
        yield from packed(held, low, high)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, high = empty()
        for batch in batches:
            # The counters of one row differ, so plain indexing adds each once.
            for lists in zip(*(batch.column(c) for c in ("at", "n", "low", "high")), strict=True):
                at, n, least, most = (x.values.to_numpy() for x in lists)
                held[at] += n
                low[at], high[at] = np.minimum(low[at], least), np.maximum(high[at], most)
        yield from packed(np.where(low != high, held, 0), low, high)

    kind = "block long, at array<long>, n array<long>, low array<long>, high array<long>"
    blocks = stage(texts.select("label", "text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind), "omh-counters", COUNTER_ROWS)
    out = np.zeros(COUNTERS, np.int64)
    for batch in blocks.select("at", "n").toArrow().to_batches():
        out[batch.column("at").flatten().to_numpy()] = batch.column("n").flatten().to_numpy()
    discard(blocks)
    return out


def rarest(words: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """Places of the allowed edits + 1 rarest words: in the order of their counters, then hashes, one order for all texts."""
    return np.lexsort((words, often[counter_of(words)]))[: int((1 - similarity) * len(words) + 1e-9) + 1]


def rare_words(text: Column, often, shared, similarity: float) -> Column:
    """struct<n, rare>: the number of words and, of the rarest, those that are rare in a text of another label too, with their places."""
    place = StructType([StructField("word", LongType()), StructField("place", LongType())])

    @F.arrow_udf(StructType([StructField("n", LongType()), StructField("rare", ArrayType(place))]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, rows = [], []
            for t in texts:
                words = labelled_words(t.as_py())
                first = rarest(words, often.value, similarity)
                first = first[shared.value[counter_of(words[first])] > 0]
                sizes.append(len(words))
                rows.append([{"word": int(w), "place": int(p)} for w, p in zip(words[first], first, strict=True)])
            kind = pa.list_(pa.struct([("word", pa.int64()), ("place", pa.int64())]))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(rows, kind)], names=["n", "rare"])

    return run(text)


def cell_pairs(cell: pa.Table, similarity: float) -> pa.Table:
    """(k, other): a text, and the label of one that has a rare word in common with it, may align and shares a bucket.

    Of two labels the one of more texts is the other, so a text meets a class of copies once.
    """
    cell = cell.sort_by([("word", "ascending"), ("k", "ascending")])
    word, n, place, block, members = (cell[c].to_numpy() for c in ("word", "n", "place", "block", "members"))
    inner = cell["i"][0].as_py() == cell["j"][0].as_py()
    k, label = cell["k"].to_pylist(), cell["label"].to_pylist()
    codes: dict[bytes, int] = {}
    code = np.array([codes.setdefault(x, len(codes)) for x in label])
    buckets = [frozenset(b) for b in cell["buckets"].to_pylist()]
    found = set()
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    for low, high in zip(starts, [*starts[1:], len(word)], strict=True):
        for y in range(low + 1, high):
            most = ((1 - similarity) * np.maximum(n[low:y], n[y]) + 1e-9).astype(np.int64)
            may = (code[low:y] != code[y]) & (np.abs(n[low:y] - n[y]) <= most) & (np.abs(place[low:y] - place[y]) <= most)
            if not inner:
                may &= block[low:y] != block[y]
            for x in (np.flatnonzero(may) + low).tolist():
                pair = (k[x], label[y]) if (members[x], label[x]) < (members[y], label[y]) else (k[y], label[x])
                if pair not in found and not buckets[x].isdisjoint(buckets[y]):
                    found.add(pair)
    return pa.table([pa.array(c, pa.binary()) for c in ([a for a, _ in found], [b for _, b in found])], names=["k", "other"])


def shared_words(texts: list[list[str]]) -> np.ndarray:
    """Matrix of the number of words, with multiplicity, that two texts share."""
    codes: dict[tuple[str, int], int] = {}
    row, col = [], []
    for i, ws in enumerate(texts):
        seen: dict[str, int] = {}
        for w in ws:
            seen[w] = at = seen.get(w, 0) + 1
            col.append(codes.setdefault((w, at), len(codes)))
        row.append(np.full(len(ws), i))
    row, col = np.concatenate(row), np.array(col, np.int64)
    often = np.bincount(col, minlength=len(codes)) > 1
    row, col = row[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(texts), len(texts)), np.int64)
    for low in range(0, int(often.sum()), 4096):
        first, last = np.searchsorted(col, [low, low + 4096])
        part = np.zeros((len(texts), 4096), np.float32)
        part[row[first:last], col[first:last] - low] = 1
        out += np.rint(part @ part.T).astype(np.int64)
    return out


def class_links(cell: pa.Table, similarity: float) -> pa.Table:
    """(a, b) labels: that of a text which asks and that of the class, where the text aligns with a member of the cell."""
    find = re.compile(WORD).findall
    texts = [find(t) for t in cell["text"].to_pylist()]
    size, common = np.array([len(t) for t in texts]), shared_words(texts)
    asks, label, other = cell["asks"].to_numpy(zero_copy_only=False), cell["label"].to_pylist(), cell["other"][0].as_py()
    members, links = np.flatnonzero(~asks), set()
    for x in np.flatnonzero(asks).tolist():
        if label[x] in links:
            continue
        longer = np.maximum(size[members], size[x])
        most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        off = longer - common[members, x]
        for at in np.argsort(off, kind="stable").tolist():
            if off[at] <= most[at] and aligned(texts[x], texts[members[at]], int(most[at])):
                links.add(label[x])
                break
    return pa.table({"a": pa.array(list(links), pa.binary()), "b": pa.array([other] * len(links), pa.binary())})


def meeting_links(meets: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) labels of (k, other) rows where the text k aligns with a text of the label other; staged. met: k, label, members, text.

    Classes of at most FEW texts give pairs. A larger one and the texts that must meet it are dealt into blocks,
    and every block of one with every block of the other makes a cell of bounded size, which gives links only.
    """
    own = met.select("k", F.col("label").alias("la"))
    sizes = met.groupBy("label").agg(F.count("*").alias("members"), F.sum(F.octet_length("text")).alias("bytes"))
    asked = meets.join(own, "k").join(sizes.withColumnRenamed("label", "other"), "other")
    asked = stage(asked, "omh-asked")
    m = met.select(F.col("k").alias("leader"), F.col("label").alias("lb"))
    few = asked.where(F.col("members") <= FEW)
    pairs = stage(few.join(m, few["other"] == m["lb"]).select("k", "leader", "la", "lb"), "omh-unmet-pairs")
    close = verify(pairs, met.select("k", "text"), similarity, ["la", "lb"])
    many = asked.where(F.col("members") > FEW).join(met.select("k", "text"), "k")
    many = stage(many.select("k", "la", "other", "members", "bytes", "text"), "omh-many")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    plan = many.groupBy("other").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.max("members").alias("members"), F.max("bytes").alias("bytes"))
    plan = stage(plan.select("other", blocks(F.col("members"), F.col("bytes")).alias("rows"), blocks(F.col("n"), F.col("size")).alias("cols")), "omh-plan")
    deal = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = many.join(plan, "other").select("other", all_of("rows").alias("i"), deal("cols").alias("j"), F.lit(True).alias("asks"), F.col("la").alias("label"), "text")
    held = met.join(plan, met["label"] == plan["other"]).select("other", deal("rows").alias("i"), all_of("cols").alias("j"), F.lit(False).alias("asks"), "label", "text")
    found = asks.unionByName(held).groupBy("other", "i", "j").applyInArrow(lambda cell: class_links(cell, similarity), "a binary, b binary")
    links = close.select(F.col("la").alias("a"), F.col("lb").alias("b")).unionByName(stage(found, "omh-class-links", spread=True))
    links = stage(links.distinct(), "omh-unmet-links")
    discard(asked, pairs, close, many, plan)
    return links


def unmet_links(prints: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b) labels that a pair of texts links which share a sample and of which neither leads that bucket; staged.

    Where such texts of a bucket have one label, nothing is left to find. The others are joined on their
    rare words, in cells of a bounded number of rows, which tells what classes a text must meet.
    """
    named = prints.where(F.size("sketch") > 0).join(labels, "k", "left").select("k", "sketch", F.coalesce("label", "k").alias("label"))
    buckets = stage(named.select("k", "label", F.posexplode("sketch").alias("sample", "value")).select("k", "label", F.xxhash64("sample", "value").alias("bucket")), "omh-named")
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("k", "label")).alias("leader"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    leaders = stage(leaders.where("members > 2 and low <> high").select("bucket", F.col("leader.k").alias("leader")), "omh-open")
    # Leaders have met all others of their bucket; buckets whose others have one label are done.
    rest = stage(buckets.join(leaders, "bucket").where("k <> leader").select("k", "label", "bucket"), "omh-rest")
    open_ = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    # At most one bucket for each sample, so these lists are short.
    met = rest.join(open_, "bucket").groupBy("k", "label").agg(F.collect_set("bucket").alias("buckets"))
    met = stage(met.join(texts, "k"), "omh-unmet")
    share = prints.sparkSession.sparkContext.broadcast  # COUNTERS numbers, whatever the corpus
    often = share(word_counters(met, labelled_words))

    def own_rarest(text: str) -> np.ndarray:
        words = labelled_words(text)
        return words[rarest(words, often.value, similarity)]

    shared = share(word_counters(met, own_rarest))
    rare = met.select("k", "label", "buckets", rare_words(F.col("text"), often, shared, similarity).alias("r")).select("k", "label", "buckets", "r.n", "r.rare")
    sizes = stage(met.groupBy("label").agg(F.count("*").alias("members")), "omh-label-sizes")
    rare = rare.join(sizes, "label").select("k", "label", "members", "buckets", "n", F.explode("rare").alias("w"))
    rare = stage(rare.select("k", "label", "members", "buckets", "n", "w.word", "w.place"), "omh-rare", BATCH)
    words = rare.groupBy("word").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low <> high")
    small = F.col("rows") <= CELL // 32
    cells = max(1, -(-rare.count() // CELL))
    blocks = F.when(F.col("rows") <= 2 * CELL, 1).otherwise(F.ceil(F.col("rows") / CELL)).cast("int")
    words = stage(words.select("word", blocks.alias("blocks"), F.when(small, F.pmod(F.xxhash64("word"), F.lit(cells))).otherwise(-1).alias("cell"), F.when(~small, F.col("word")).alias("alone")), "omh-words")
    placed = rare.join(words, "word").withColumn("block", F.pmod(F.xxhash64("k", "word"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    meets = placed.groupBy("cell", "alone", "i", "j").applyInArrow(lambda cell: cell_pairs(cell, similarity), "k binary, other binary")
    meets = stage(meets.distinct(), "omh-meets", spread=True)
    links = meeting_links(meets, met, similarity)
    discard(buckets, leaders, rest, met, rare, sizes, words, meets)
    often.unpersist()
    shared.unpersist()
    return links


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (k, label) after further (a, b) links between labels; a graph of labels only. Staged."""
    met = components(links)
    joins = met.select(F.col("k").alias("from"), F.col("label").alias("to"))
    known = labels.join(joins, labels["label"] == joins["from"], "left").select("k", F.coalesce("to", "label").alias("label"))
    return stage(known.unionByName(met.where("k <> label").join(labels, "k", "left_anti")), "omh-labels")


def roots(links: DataFrame) -> DataFrame:
    """k, label of each k of (k, leader) links, where a k has one leader and that is less: the end of its chain.

    Pointer jumping over staged tables: a round halves the length of every chain and takes one join.
    """
    labels = stage(links.select("k", F.col("leader").alias("label")), "omh-roots")
    while True:
        up = labels.select(F.col("k").alias("at"), F.col("label").alias("further"))
        new = stage(labels.join(up, labels["label"] == up["at"], "left").select("k", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "omh-roots")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.drop("moved")
        if not moved:
            return labels


def components(links: DataFrame) -> DataFrame:
    """k, label of every end of (a, b) links: the least k that they reach. Staged label tables, round by round."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "omh-edges")
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("k"), "label"), "omh-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["k"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, labels["k"] == near["a"]).select("k", F.least("label", "near").alias("label"), F.col("label").alias("old")), "omh-lower")
        # Pointer jumping: take the label of one's label, so long chains shrink by half and more each round.
        jump = lower.select(F.col("k").alias("at"), F.col("label").alias("further"))
        new = stage(lower.join(jump, lower["label"] == jump["at"]).select("k", F.least("label", "further").alias("label"), "old"), "omh-labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels, lower)
        labels = new.drop("old")
        if not changed:
            discard(edges)
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """k, class_id, class_size, keep_k of every distinct text; staged.

    class_id: the least id in the class (null if it has none but null); keep_k: the text of
    that id, the one to keep.
    """
    prints = fingerprints(docs, id_col, text_col)
    pairs = candidates(prints)
    involved = pairs.select("k").union(pairs.select(F.col("leader").alias("k"))).distinct()
    chosen = stage(prints.join(involved, "k", "left_semi").select("k", "rep_id", "n"), "omh-involved")
    # Only one row of each text that has a candidate is moved.
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("k"))
    # The planner would broadcast a small `chosen`; a merge join costs the same share at every size.
    found = rows.join(chosen.hint("merge"), (rows["k"] == chosen["k"]) & rows["id"].eqNullSafe(chosen["rep_id"])).select(chosen["k"], "n", "text")
    found = stage(found, "omh-texts")
    # One row of each text: rows may repeat, with the same id, where a text has more than one row.
    again = stage(found.where("n > 1").groupBy("k").agg(F.first("text").alias("text")), "omh-texts-again")
    texts = found.where("n = 1").select("k", "text").unionByName(again)
    first = pairs.groupBy("k").agg(F.max(F.struct("votes", "leader")).alias("best")).select("k", F.col("best.leader").alias("leader"))
    links = verify(first, texts, similarity)
    labels = roots(links)
    # Second phase: other leaders, where the first has not joined the two texts already.
    own = labels.select(F.col("k").alias("a"), F.col("label").alias("la"))
    theirs = labels.select(F.col("k").alias("b"), F.col("label").alias("lb"))
    rest = pairs.join(first, ["k", "leader"], "left_anti")
    rest = rest.join(own, rest["k"] == own["a"], "left").join(theirs, rest["leader"] == theirs["b"], "left")
    rest = rest.select("k", "leader", F.coalesce("la", "k").alias("la"), F.coalesce("lb", "leader").alias("lb"))
    rest = stage(rest.where("la <> lb"), "omh-rest")
    more = verify(rest.select("k", "leader"), texts, similarity)
    if more.limit(1).count():
        labels = joined_labels(labels, rest.join(more, ["k", "leader"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    # Third phase: members of a bucket whose leaders have not joined them.
    last = unmet_links(prints, texts, labels, similarity)
    if last.limit(1).count():
        labels = joined_labels(labels, last)
    joined = prints.join(labels, "k", "left").select("k", "rep_id", "n", F.coalesce("label", "k").alias("label"))
    joined = stage(joined, "omh-joined")
    order = F.struct(F.col("rep_id").isNull(), "rep_id", "k")
    sums = stage(joined.groupBy("label").agg(F.min(order).alias("least"), F.sum("n").alias("class_size")), "omh-classes")
    out = joined.join(sums, "label").select("k", F.col("least.rep_id").alias("class_id"), "class_size", F.col("least.k").alias("keep_k"))
    out = stage(out, "omh-members")
    discard(prints, pairs, chosen, found, again, links, rest, more, last, joined, sums)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id, class_size: a row for each row of docs.

    class_id is the least id among the documents whose texts are equal or linked, directly or through
    others. A null text is a class by itself; texts without a word are in a class with equal
    texts only; null ids take part and stay null; repeated rows count each in class_size;
    other columns are not read; an empty table gives no rows.
    """
    members = classes(docs, id_col, text_col, similarity)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"))
    joined = rows.join(members, rows["k"] == members["k"], "left")
    return joined.select(F.col("id").alias(id_col), F.when(rows["k"].isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of every class: that with the least id; of repeated rows one. Null texts stay.

    Further columns are carried along (names that begin with two underscores are reserved).
    """
    members = classes(docs, id_col, text_col, similarity)
    kept = members.where("k = keep_k").select(F.col("k").alias("__k"), F.col("class_id").alias("__id"))
    # How many rows carry the id and text that stay; more than one only for repeated rows.
    light = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"))
    hits = light.join(kept, (light["k"] == kept["__k"]) & light["id"].eqNullSafe(kept["__id"])).groupBy("__k", "__id").agg(F.count("*").alias("__rows"))
    hits = stage(hits, "omh-hits")
    keyed = docs.withColumn("__key", text_key(F.col(text_col)))
    rows = keyed.join(hits, (keyed["__key"] == hits["__k"]) & keyed[id_col].eqNullSafe(hits["__id"]))
    cols = [keyed[c] for c in docs.columns]
    once = rows.where("__rows = 1").select(*cols)
    again = rows.where("__rows > 1").select(*cols, "__key").dropDuplicates(["__key"]).drop("__key")
    return once.unionByName(again).unionByName(docs.where(F.col(text_col).isNull()))
