"""Benchmark decontamination by template windows.

Texts become templates: letters in lower case, punctuation gone, and numbers (in digits or
words), units after numbers and names (capitalised words) replaced by typed placeholders whose
values are kept as slots. Windows of eight template tokens of every document are looked up in a
hash table of the benchmark's windows, and a document leaks an item if matched windows cover
enough of the item and the slots are consistent: one value of the item stands for one value
of the document, and two names for two. Windows in which a slot says something else than it
mostly does are left out, unless they match word for word, and each such place counts against the copy. Equal slots are a copy, others a
re-parameterised question.

A window is read in up to three ways: as its words are, with numbers and units as placeholders,
and with names as placeholders too. So case tells names only where that helps: copies in other
case match as words, questions with other names by their templates. A window needs LITERALS
literal tokens to be read with placeholders; as words any window counts.

Items of one template whose slots repeat alike are one class in the table, so a template that
many items share is matched once.

The table is built in blocks of whole items with a bounded number of windows, and every block
meets all documents (one pass over the corpus for each block, no shuffle of texts).
"""

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

WINDOW = 8
#: Share of an item's windows that must match, and literal tokens that a window with placeholders needs to count.
COVER, LITERALS = 0.6, 3
#: Most windows in a block: about 60 MB in each Python worker.
BLOCK_WINDOWS = 500_000

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+")
#: Unit words and symbols, as they may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl dl l ms s sec min h hr hrs day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent usd eur "
    "heure heures jour jours an ans mois semaine semaines stunde stunden tag tage jahr jahre hora horas dia dias año años".split()
)
#: Numbers in words.
NUMERALS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01w"
WORDS, VALUES, NAMES = range(3)
FOUND = ArrayType(StructType([StructField("item_id", StringType()), StructField("coverage", DoubleType()), StructField("reparameterised", BooleanType()), StructField("position", IntegerType())]))


class Template:
    """A text's words in lower case, and what stands for them where numbers and units, or names too, are placeholders.

    Plain lower-case words, most of a text, stand for themselves; only what begins otherwise is looked at.
    """

    def __init__(self, text: str):
        raws = TOKEN.findall(text)
        self.words, slots, names, unit = raws, [], [], -1
        for i in [i for i, r in enumerate(raws) if not "a" <= r < "{" or r in NUMERALS]:
            raw = raws[i]
            low = raws[i] = raw.lower()
            if i == unit:
                continue
            if raw[0].isdigit() or low in NUMERALS:
                slots.append((i, NUMBER))
                if i + 1 < len(raws) and raws[i + 1].lower() in UNITS:
                    unit = i + 1
                    slots.append((unit, UNIT))
            elif raw[0].isupper() and raw[1:].islower():
                names.append((i, NAME))
        self.slots = {VALUES: slots, NAMES: slots + names if names else []}

    def tokens(self, reading: int) -> list[str]:
        out = self.words.copy()
        for i, token in self.slots.get(NAMES if reading == NAMES and self.slots[NAMES] else VALUES, []) if reading else []:
            out[i] = token
        return out

    def windows(self, codes: "Codes", width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(reading, places, hashes) of the windows that have a placeholder of that reading."""
        n = len(self.words)
        if n < width:
            return
        ids = np.fromiter(map(codes.__getitem__, self.words), np.uint64, n)
        yield WORDS, np.arange(n - width + 1), hashed(ids, width)
        for reading in (VALUES, NAMES):
            slots = self.slots[reading]
            if slots:
                own, marked = ids.copy(), np.zeros(n + 1, np.int64)
                for i, token in slots:
                    own[i] = codes[token]
                    marked[i + 1] = 1 if reading == VALUES or token == NAME else 0
                upto = np.cumsum(marked)
                places = np.flatnonzero(upto[width:] > upto[:-width])
                yield reading, places, hashed(own, width)[places]


class Codes(dict):
    """word -> 64-bit code, made when first asked for."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        code = self[word] = zlib.crc32(raw) | (zlib.crc32(raw, 0x5BD1E995) << 32)
        return code


MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(256)], np.uint64)


def hashed(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of `width` codes."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += ids[j : len(ids) - width + 1 + j] * MULTIPLIERS[j]
        out ^= out >> np.uint64(31)
        return out * MULTIPLIERS[7]


def eligible(tokens: list[str], width: int) -> list[int]:
    """Windows with enough literal tokens."""
    plain = np.cumsum([0] + [t[0] != "\x01" for t in tokens])
    return np.flatnonzero(plain[width:] - plain[:-width] >= min(LITERALS, width)).tolist()


class Index:
    """Hash table of the windows of some items, by classes of items with one template."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW):
        self.width, self.classes, codes = width, [], Codes()
        numbers: dict[tuple, int] = {}
        entries: dict[tuple, tuple] = {}
        for item_id, text in items:
            made = Template(text)
            if not made.words:
                continue
            names = made.tokens(NAMES)
            first: dict[tuple[str, str], int] = {}
            pattern = tuple(first.setdefault((t, w), i) for i, (t, w) in enumerate(zip(names, made.words, strict=True)) if t[0] == "\x01")
            of = numbers.setdefault((tuple(names), pattern), len(self.classes))
            own = min(width, len(names))
            if of == len(self.classes):
                where = [i for i, t in enumerate(names) if t[0] == "\x01"]
                self.classes.append({"names": names, "where": where, "pattern": dict(zip(where, pattern, strict=True)), "windows": len(names) - own + 1, "typed": set(eligible(names, own)), "items": {}})
            entry = self.classes[of]
            values = tuple(made.words[i] for i in entry["where"])
            entry["items"].setdefault(values, []).append(item_id)
            may = {WORDS: None, VALUES: set(eligible(made.tokens(VALUES), own)), NAMES: entry["typed"]}
            entry.setdefault("plain", may[VALUES])
            for reading, places, hashes in made.windows(codes, own):
                tokens = made.tokens(reading)
                for q, h in zip(places.tolist(), hashes.tolist(), strict=True):
                    if may[reading] is None or q in may[reading]:
                        entries.setdefault((h, reading, of, q), tuple(tokens[q : q + own]))
        keys = sorted(entries)
        self.hashes = np.array([k[0] for k in keys], np.uint64)
        self.places = [(*k[1:], entries[k]) for k in keys]
        # One byte for each of 2^20 hash prefixes rules out almost all windows before the search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.widths = {min(width, len(c["names"])) for c in self.classes} | {width}

    def parts(self) -> dict:
        """Plain lists and arrays, so that executors need no class of this package to read them."""
        return dict(vars(self))

    @classmethod
    def of(cls, parts: dict) -> "Index":
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def find(self, text: str, codes: Codes, cover: float) -> list[tuple]:
        """(item id, share of its windows matched, slots differ, first token matched) of every class that text leaks.

        The item id is that of the class's items with the document's values, or else the least.
        """
        made, matched = Template(text), defaultdict(list)
        for width in self.widths:
            for reading, places, own in made.windows(codes, width):
                maybe = np.flatnonzero(self.seen[(own >> np.uint64(44)).astype(np.int64)])
                if not len(maybe):
                    continue
                low, high = np.searchsorted(self.hashes, own[maybe]), np.searchsorted(self.hashes, own[maybe], "right")
                hit = high > low
                if not hit.any():
                    continue
                tokens, at = made.tokens(reading), defaultdict(list)
                for p, k, end in zip(places[maybe[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    at[k, end].append(p)
                for (k, end), ps in at.items():
                    qs, window = defaultdict(list), tuple(tokens[ps[0] : ps[0] + width])
                    for kind, of, q, words in self.places[k:end]:
                        if kind == reading and words == window:
                            qs[of].append(q)
                    for of, q in qs.items():
                        matched[of].append((ps, q))
        out = []
        for of, groups in matched.items():
            entry, best = self.classes[of], None
            length = len(entry["names"])
            for run in self.placements(groups, length, made, entry, cover):
                found = self.judge(run, entry, made.words)
                if found and found[0] >= cover and (best is None or (-found[0], found[1], found[3]) < best[0]):
                    best = (-found[0], found[1], found[3]), found
                    if found[0] == 1 and not found[1]:
                        break
            if best:
                share, differ, item, position = best[1]
                out.append((item, share, differ, position))
        return sorted(out, key=lambda r: (r[3], r[0] is None, r[0] or ""))

    def judge(self, run: list[tuple[int, int]], entry: dict, words: list[str]) -> tuple | None:
        """(coverage, slots differ, item id, first token) of an item that stands at a run; none if no window holds.

        A slot's value is what most of its places in the document say, and of equally many what an item says. Windows with
        another value in a slot do not count, unless they read like an item's word for word. A name stands for one slot, that
        with more places; numbers and units may be equal by chance. Each place that says something else counts as a further window that is missing.
        """
        width = min(self.width, len(entry["names"]))
        slots, odd = entry["pattern"], 0
        if slots:
            votes: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
            for place, i in {(p + i - q, i) for p, q in run for i in range(q, q + width) if i in slots}:
                votes[slots[i]][words[place]] += 1
            value, taken = {}, set()
            best = {slot: max(found, key=lambda w: (found[w], w in self.owned(entry, slot), w)) for slot, found in votes.items()}
            for slot in sorted(best, key=lambda k: (-votes[k][best[k]], k)):
                if entry["names"][slot] != NAME or best[slot] not in taken:
                    value[slot] = best[slot]
                    taken.add(best[slot] if entry["names"][slot] == NAME else None)
            odd = sum(n for slot, found in votes.items() for word, n in found.items() if word != value.get(slot))
            run = [(p, q) for p, q in run if all(value.get(slots[i]) == words[p + i - q] for i in range(q, q + width) if i in slots) or self.literal(entry, words[p : p + width], q)]
            if not run:
                return None
        hit = {q for _, q in run}
        share = len(hit) / (entry["windows"] + odd)
        for may in (entry["typed"], entry["plain"]):
            # Windows made of slots cannot match other values; what can must be half of the item.
            if 2 * len(may) >= entry["windows"]:
                share = max(share, len(hit & may) / (len(may) + odd))
        values = {i: words[p + i - q] for p, q in run for i in range(q, q + width) if i in slots}
        item, differ = self.member(entry, tuple(sorted(values)), values)
        return share, differ, item, min(p for p, _ in run)

    @staticmethod
    def owned(entry: dict, slot: int) -> set[str]:
        """What the items of a class have in a slot."""
        known = entry.setdefault("owned", {})
        if slot not in known:
            n = entry["where"].index(slot)
            known[slot] = {own[n] for own in entry["items"]}
        return known[slot]

    @staticmethod
    def literal(entry: dict, window: list[str], q: int) -> bool:
        """Whether a window reads as it stands in an item of the class; slots aside it is known to be equal."""
        known = entry.setdefault("literal", {})
        inner = [n for n, i in enumerate(entry["where"]) if q <= i < q + len(window)]
        if q not in known:
            known[q] = {tuple(own[n] for n in inner) for own in entry["items"]}
        return tuple(window[entry["where"][n] - q] for n in inner) in known[q]

    @staticmethod
    def member(entry: dict, covered: tuple[int, ...], values: dict[int, str]) -> tuple[str | None, bool]:
        """The least item with these values at the covered slots, or the least of all; and whether it has others."""
        least = lambda ids: min(ids, key=lambda i: (i is None, i or ""))
        known = entry.setdefault("known", {})
        if covered not in known:
            if len(known) >= 16:
                known.clear()
            table = known[covered] = {}
            place = {i: n for n, i in enumerate(entry["where"])}
            for own, ids in entry["items"].items():
                table.setdefault(tuple(own[place[i]] for i in covered), []).extend(ids)
            entry.setdefault("least", least([i for ids in entry["items"].values() for i in ids]))
        same = known[covered].get(tuple(values[i] for i in covered))
        return (least(same), False) if same else (entry["least"], True)

    @classmethod
    def placements(cls, groups: list[tuple[list[int], list[int]]], length: int, made: Template, entry: dict, cover: float) -> Iterator[list[tuple[int, int]]]:
        """Matches (place in the document, in the item) that may be one occurrence of the item.

        Runs of matches near each other, the longest chain of each in the order of both texts, and diagonals: an
        item with equal windows matches each with all of them, which mixes places in a run; a copy is a diagonal,
        and a chain where words were put in or left out. What has too few of the item's windows to cover it, or reads like
        a diagonal before it, is left out, as it changes nothing.
        """
        codes = np.unique(np.concatenate([((np.asarray(ps, np.int64) << 32)[:, None] | np.asarray(qs, np.int64)[None]).ravel() for ps, qs in groups]))
        p, q = codes >> 32, codes & 0xFFFFFFFF

        def covers(windows: np.ndarray) -> bool:
            hit = set(np.unique(windows).tolist())
            shares = [len(hit & may) / len(may) for may in (entry["typed"], entry["plain"]) if 2 * len(may) >= entry["windows"]]
            return max([len(hit) / entry["windows"], *shares]) >= cover

        for low, high in cls.runs(p, q, length):
            if covers(q[low:high]):
                run = list(zip(p[low:high].tolist(), q[low:high].tolist(), strict=True))
                yield run
                if len(np.unique(p[low:high])) < len(run) or len(np.unique(q[low:high])) < len(run):
                    yield cls.chain(run)
        order = np.argsort(p - q, kind="stable")
        ends = np.flatnonzero(np.diff((p - q)[order])) + 1
        if not len(ends):
            return
        known = set()
        for own in sorted(np.split(order, ends), key=lambda d: d[0]):
            if covers(q[own]):
                at = int(p[own[0]] - q[own[0]])
                reads = q[own].tobytes(), tuple(made.words[at + i] if 0 <= at + i < len(made.words) else None for i in entry["where"])
                if reads not in known:
                    known.add(reads)
                    yield list(zip(p[own].tolist(), q[own].tolist(), strict=True))

    @staticmethod
    def chain(run: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """A longest part of a run in which both positions increase."""
        ends, last = [], []
        for p, q in sorted(run, key=lambda m: (m[0], -m[1])):
            at = bisect_left(ends, q)
            # Each match holds the one before it, so those that no chain needs any more are free.
            ends[at:at + 1], last[at:at + 1] = [q], [(p, q, last[at - 1] if at else None)]
        out, m = [], last[-1]
        while m:
            out.append(m[:2])
            m = m[2]
        return out[::-1]

    @staticmethod
    def runs(p: np.ndarray, q: np.ndarray, length: int, step: int = 4096) -> Iterator[tuple[int, int]]:
        """First and last (exclusive) of the runs of pairs in order: one ends at a gap of more than length, or after length places where the item begins again."""
        gaps, start = np.append(np.flatnonzero(np.diff(p) > length) + 1, len(p)), 0
        while start < len(p):
            end = int(gaps[np.searchsorted(gaps, start, "right")])
            at = max(start + 1, int(np.searchsorted(p, p[start] + length)))
            while at < end:
                again = np.flatnonzero(q[at : min(at + step, end)] <= q[start])
                if len(again):
                    end = at + int(again[0])
                at += step
            yield start, end
            start = end


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_windows: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of about block_windows windows (an item of more is a block by itself)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    words = items.agg(F.coalesce(F.sum(F.length("t") / 2 + 1), F.lit(0.0))).first()[0]
    n = max(1, -(-int(words) // block_windows))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def matches_column(docs: DataFrame, items: list[tuple[str | None, str]], text_col: str, cover: float):
    index = docs.sparkSession.sparkContext.broadcast(Index(items).parts())  # bounded by BLOCK_WINDOWS

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, codes = Index.of(index.value), Codes()
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("coverage", pa.float64()), ("reparameterised", pa.bool_()), ("position", pa.int32())]))
        names = ("item_id", "coverage", "reparameterised", "position")
        for texts in batches:
            if len(codes) > 1 << 20:
                codes.clear()
            yield pa.array([[dict(zip(names, m, strict=True)) for m in own.find(t.as_py() or "", codes, cover)] for t in texts], kind)

    return run(F.col(text_col))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", cover: float = COVER, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """id, item_id, coverage, reparameterised, position: a row for each item that a document leaks.

    Items of one template whose slots repeat alike give one row for each document: that of the item with
    the document's values, or else of the least id. Null and empty texts leak nothing; items
    without a token are leaked by nothing; items of fewer than eight tokens must match as a
    whole; null ids stay null; repeated rows are reported each; other columns are not read; empty
    tables give no rows. item_id has the benchmark's type.
    """
    out, kind = None, benchmark.schema[item_col].dataType
    for items in blocks(benchmark, item_col, "text", block_windows):
        part = docs.select(F.col(id_col), matches_column(docs, items, text_col, cover).alias("m")).where(F.size("m") > 0).select(id_col, F.inline("m"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without the rows that leak an item; columns and other rows as they are.

    Null and empty texts, repeated rows, odd items and empty tables: as leaks() says. A column `__leaks` is reserved.
    """
    for items in blocks(benchmark, "item_id", "text", block_windows):
        docs = docs.withColumn("__leaks", matches_column(docs, items, "text", cover)).where(F.size("__leaks") == 0).drop("__leaks")
    return docs
