"""A hidden Markov language model: Baum-Welch over the whole corpus, exact likelihoods by scaled forward recursion.

Texts are packed in blocks of a few megabytes: token numbers, and the distinct words they stand for. Words are
counted over all blocks by a hash aggregation, and each block gets the counts of its own words by a join, so no task
holds the vocabulary. A state emits a class: one of CLASSES hash buckets of the words that occur
twice or more in the training texts, the class of rarer words, or the end of the text; a class emits a word by
corpus counts. So the parameters have a fixed size, and a round of Baum-Welch is one pass over the blocks whose
expected counts, as whole numbers of 2^-12, are added up by Spark.

Long texts do not serialise a pass: the recursion over CHUNK tokens is a product of matrices, which all chunks of a
block compute side by side; chaining the products gives each chunk its exact entry and exit vectors.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import discard, stage

STATES, ROUNDS, CLASSES = 6, 4, 1 << 15
#: The classes of words that training texts have at most once, and of the end of a text.
RARE, END = CLASSES, CLASSES + 1
BLOCK_BYTES, CHUNK, SLICE = 1 << 23, 2048, 1 << 19
#: Expected counts are rounded to this for a block, so that their sums do not depend on an order.
UNIT = 1 << 12
#: Weight of the overall class distribution in each state's, in tokens, and of even transitions.
PRIOR, EVEN = 1000.0, 10.0
#: Bits of a word's number in its block, in the place of a word: block << WORD_BITS | number.
WORD_BITS = 28
#: Token numbers from here on are kept apart, in four bytes.
WIDE = (1 << 16) - 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as token numbers: block, docs, learn, sizes (tokens with the end), low and high (token numbers), words, trained (their number in texts to learn from), buckets; staged."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (~held_out(F.col(id_col))).alias("learn"), F.coalesce(text_col, F.lit("")).alias("text"))

    def packed(block: int, ids: pa.DataType, docs: list, learn: list, texts: list[np.ndarray], words: list[bytes]) -> pa.RecordBatch:
        sizes = [len(t) for t in texts]
        tokens = np.concatenate(texts)
        # Frequent words get low numbers, which take two bytes; 0 is the end of a text.
        order = np.argsort(-np.bincount(tokens, minlength=len(words) + 1)[1:], kind="stable")
        rank = np.zeros(len(words) + 1, np.uint32)
        rank[order + 1] = np.arange(1, len(words) + 1)
        tokens, words = rank[tokens], [words[n] for n in order]
        trained = np.bincount(tokens[np.repeat(np.asarray(learn, bool), sizes)], minlength=len(words) + 1)[1:]
        buckets = np.fromiter((zlib.crc32(w) % CLASSES for w in words), np.uint16, len(words))
        cells = [
            ([block], pa.int64()), ([docs], pa.list_(ids)), ([learn], pa.list_(pa.bool_())), ([sizes], pa.list_(pa.int32())), ([np.minimum(tokens, WIDE).astype(np.uint16).tobytes()], pa.binary()), ([tokens[tokens >= WIDE].tobytes()], pa.binary()),
            ([[w.decode() for w in words]], pa.list_(pa.string())), ([trained], pa.list_(pa.int32())), ([buckets.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["block", "docs", "learn", "sizes", "low", "high", "words", "trained", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        fresh = lambda: defaultdict(count(1).__next__)
        docs, learn, texts, numbers, held = [], [], [], fresh(), 0
        for batch in batches:
            for doc, own, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2).cast(pa.binary()), strict=True):
                raw = text.as_py()
                # bytes.split parts at exactly the six white-space characters, and bytes.lower changes A-Z only.
                found = raw.lower().split()
                texts.append(np.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)), np.uint32(0)))
                docs.append(doc)
                learn.append(own)
                held += len(raw) + 16
                if held >= BLOCK_BYTES:
                    yield packed(block, batch.schema.field(0).type, docs, learn, texts, list(numbers))
                    block += 1
                    docs, learn, texts, numbers, held = [], [], [], fresh(), 0
        if docs:
            yield packed(block, batch.schema.field(0).type, docs, learn, texts, list(numbers))

    schema = f"block long, docs array<{kind}>, learn array<boolean>, sizes array<int>, low binary, high binary, words array<string>, trained array<int>, buckets binary"
    return stage(rows.mapInArrow(run, schema), "hmm-blocks", arrow_rows=256, codec="zstd")


def counted(packed: DataFrame) -> tuple[DataFrame, dict]:
    """Blocks with the corpus counts of their words, staged, and the totals: tokens, types, texts, once, and the tokens of each class.

    A word meets its other blocks in one exchange, where a window adds up its number. A block gets back
    only the counts that differ from its own; the others are its own, so words of one block alone do not travel back.
    """
    words = packed.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w"))
    words = words.select(F.col("w.words").alias("word"), F.shiftleft("block", WORD_BITS).bitwiseOR(F.col("at").cast("long")).alias("loc"), F.col("w.trained").alias("n"))
    same = W.partitionBy("word")
    sums = words.select("loc", "n", F.sum("n").over(same).alias("c"), F.min(F.when(F.col("n") > 0, F.col("loc"))).over(same).alias("head"))
    back = sums.where("c <> n").select(F.shiftright("loc", WORD_BITS).alias("block"), F.struct(F.col("loc").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("at"), "c", F.coalesce(F.col("loc") == F.col("head"), F.lit(False)).alias("head")).alias("r"))
    lists = back.groupBy("block").agg(F.collect_list("r").alias("r")).select(F.col("block").alias("of"), F.col("r.at").alias("at"), F.col("r.c").alias("c"), F.col("r.head").alias("head"))
    ready = stage(packed.drop("words").join(lists, packed["block"] == lists["of"], "left").drop("of"), "hmm-ready", spread=True, codec="zstd")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(CLASSES + 3, np.int64)
        for batch in batches:
            for n in range(len(batch)):
                block = Block(batch, n)
                whole[: CLASSES + 2] += np.bincount(block.classes[np.repeat(block.learn, block.sizes)], minlength=CLASSES + 2)
                whole[-1] += block.firsts
        used = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(whole[used])], ["row", "n"])

    classes = np.zeros(CLASSES + 3, np.int64)
    for r in ready.mapInArrow(tally, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect():  # at most CLASSES + 3 rows
        classes[r.row] = r.n
    texts = int(classes[END])
    totals = {"tokens": int(classes[:-1].sum()), "types": int(classes[-1]) + (texts > 0), "texts": texts, "once": int(classes[RARE]), "classes": classes[:-1].astype(float)}
    return ready, totals


def cell(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray | None:
    """The list or binary in row n of a column as numpy; None if null."""
    value = batch.column(batch.schema.get_field_index(name))[n]
    if not value.is_valid:
        return None
    return value.values.to_numpy(zero_copy_only=False) if isinstance(value, pa.ListScalar) else value.as_buffer()


class Block:
    """A row of the packed table: class and corpus count of each token."""

    def __init__(self, batch: pa.RecordBatch, n: int):
        self.learn, self.sizes = cell(batch, "learn", n).astype(bool), cell(batch, "sizes", n).astype(np.int64)
        buckets, trained = np.frombuffer(cell(batch, "buckets", n), np.uint16), cell(batch, "trained", n).astype(np.int64)
        self.tokens = np.frombuffer(cell(batch, "low", n), np.uint16).astype(np.int64)
        self.tokens[self.tokens == WIDE] = np.frombuffer(cell(batch, "high", n), np.uint32)
        c, at = trained.copy(), cell(batch, "at", n)
        alone = trained > 0
        if at is not None:
            c[at] = cell(batch, "c", n)
            alone[at] = cell(batch, "head", n)
        #: Words that occur in training texts of this block and of no block before it.
        self.firsts = int(alone.sum())
        self.of_word, self.class_of = c, np.concatenate([[END], np.where(c > 1, buckets, RARE)])
        self.classes = self.class_of[self.tokens]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def counts(self, totals: dict) -> np.ndarray:
        return np.concatenate([[totals["texts"]], self.of_word])[self.tokens]

    def inside(self, totals: dict) -> np.ndarray:
        """log10 of the probability of each token in its class.

        Half of the class of rare words goes to those that occur once, half to all unknown ones as a single type.
        """
        c, once = self.of_word, totals["once"]
        rare = np.where(c == 1, np.log10(0.5 / max(1, once)), np.log10(0.5) if once else 0.0)
        within = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(totals["classes"][self.class_of[1:]], 1))
        return np.concatenate([[0.0], np.where(c > 1, within, rare)])[self.tokens]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.sizes) else values[:0]


class Chunks:
    """The texts of a block in chunks of CHUNK tokens, longest first, and how they follow each other."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        per = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), per)
        place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin, length = starts[text] + place * CHUNK, np.minimum(CHUNK, sizes[text] - place * CHUNK)
        order = np.argsort(-length, kind="stable")
        self.text, self.place, self.last = text[order], place[order], (place == per[text] - 1)[order]
        self.begin, self.length = begin[order], length[order]
        # Chunks by place, and for each the chunk before it in its text.
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.before = where[np.maximum(np.arange(len(order)) - 1, 0)][order]
        ranks = np.argsort(self.place, kind="stable")
        self.rounds = np.split(ranks, np.cumsum(np.bincount(self.place))[:-1]) if len(ranks) else []

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of chunks of about SLICE tokens: what is held in memory at a time."""
        part = np.cumsum(self.length) // SLICE
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
        yield from zip([0, *ends], ends, strict=False)

    def active(self, low: int, high: int, t: int) -> int:
        """How many of chunks low to high are longer than t: a prefix."""
        return int(np.searchsorted(-self.length[low:high], -t, "left"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


class Model:
    """start, steps (state to state) and emits (class by state). A state is entered before the first token.

    Inside, arrays are states by chunks, and are scaled to sum 1 every EVERY tokens, which is exact: the factors are kept.
    """

    EVERY = 8

    def __init__(self, start: np.ndarray, steps: np.ndarray, emits: np.ndarray):
        self.start, self.steps, self.emits = start, steps, emits
        self.by_state = np.ascontiguousarray(emits.T)

    def entries(self, classes: np.ndarray, chunks: Chunks, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """State distribution before each chunk, and (if backward) the likelihood of what follows it, up to a factor."""
        k, n = len(self.start), len(chunks.begin)
        into, out = np.tile(self.start[:, None], (1, n)), np.ones((k, n))
        # A text of one chunk needs no product.
        need = np.flatnonzero((chunks.place > 0) | ~chunks.last)
        if not len(need):
            return into, out
        products = np.zeros((n, k, k))
        most = max(1, SLICE // (8 * k * k))
        for low in range(0, len(need), most):
            own = need[low : low + most]
            m = np.zeros((k, k, len(own)))  # exit state, entry state, chunk
            m[np.arange(k), np.arange(k)] = 1.0
            for t in range(int(chunks.length[own[0]])):
                a = int(np.searchsorted(-chunks.length[own], -t, "left"))
                moved = (self.steps.T @ m[:, :, :a].reshape(k, k * a)).reshape(k, k, a) * self.by_state[:, classes[chunks.begin[own[:a]] + t]][:, None, :]
                m[:, :, :a] = moved / moved.sum((0, 1)) if t % self.EVERY == 0 else moved
            products[own] = m.transpose(2, 1, 0)
        for now in chunks.rounds[1:]:
            was = chunks.before[now]
            into[:, now] = unit_rows((into[:, was].T[:, None, :] @ products[was])[:, 0]).T
        if backward:
            for now in reversed(chunks.rounds[1:]):
                out[:, chunks.before[now]] = unit_rows((products[now] @ out[:, now].T[:, :, None])[:, :, 0]).T
        return into, out

    def forward(self, classes: np.ndarray, chunks: Chunks, into: np.ndarray, low: int, high: int, kept: list | None = None) -> np.ndarray:
        """log10 likelihood of each of the chunks low to high, from their entry vectors; kept gets (vectors before the token, their number, scale) of each step."""
        a, logs = into[:, low:high].copy(), np.zeros(high - low)
        for t in range(int(chunks.length[low])):
            n = chunks.active(low, high, t)
            own = classes[chunks.begin[low : low + n] + t]
            moved = (self.steps.T @ a[:, :n]) * self.by_state[:, own]
            scale = None
            if t % self.EVERY == self.EVERY - 1:
                scale = moved.sum(0)
                moved /= scale
                logs[:n] += np.log10(scale)
            if kept is not None:
                kept.append((a[:, :n].copy(), own, scale))
            a[:, :n] = moved
        into[:, low:high] = a
        return logs + np.log10(a.sum(0))

    def log_likelihood(self, classes: np.ndarray, chunks: Chunks, texts: int) -> np.ndarray:
        """log10 of the probability of each text's classes."""
        total, (into, _) = np.zeros(texts), self.entries(classes, chunks, False)
        for low, high in chunks.slices():
            np.add.at(total, chunks.text[low:high], self.forward(classes, chunks, into, low, high))
        return total

    def expected(self, classes: np.ndarray, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts: class by state, state to state, first states; and log10 of the likelihood."""
        k = len(self.start)
        emitted, steps, first, total = np.zeros((len(self.emits), k)), np.zeros((k, k)), np.zeros(k), 0.0
        into, out = self.entries(classes, chunks, True)
        for low, high in chunks.slices():
            entry, kept = into[:, low:high].copy(), []
            total += float(self.forward(classes, chunks, into, low, high, kept).sum())
            b, after, shares = out[:, low:high].copy(), into[:, low:high], []
            for t in reversed(range(len(kept))):
                a, own, scale = kept[t]
                n = a.shape[1]
                joint = after[:, :n] * b[:, :n]
                z = joint.sum(0)
                joint /= z
                shares.append(joint)
                later = self.by_state[:, own] * b[:, :n]
                b[:, :n] = self.steps @ later
                later /= z if scale is None else z * scale
                steps += a @ later.T
                if t % self.EVERY == 0:
                    b[:, :n] /= b[:, :n].sum(0)
                # Chunks that ended at this token keep their exit vectors until they are reached.
                after[:, :n] = a
            shares, at = np.concatenate(shares, axis=1), np.concatenate([own for _, own, _ in reversed(kept)])
            for s in range(k):
                emitted[:, s] += np.bincount(at, weights=shares[s], minlength=len(emitted))
            heads = chunks.place[low:high] == 0
            first += unit_rows((entry[:, heads] * b[:, heads]).T).sum(0)
        return emitted, steps * self.steps, first, total


def initial(classes: np.ndarray, states: int) -> Model:
    """States that stay, with noisy copies of the overall class distribution; always the same."""
    overall = overall_classes(classes)
    noise = np.random.default_rng(13).uniform(0.1, 1.9, (len(classes), states))
    emits = overall[:, None] * noise
    stay = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    return Model(np.full(states, 1 / states), unit_rows(stay), emits / emits.sum(0))


def overall_classes(classes: np.ndarray) -> np.ndarray:
    """Share of each class in the training tokens; none is 0, as any may meet a text: the class of rare words weighs 1 more, others 2^-10."""
    weights = classes + 2.0**-10
    weights[[RARE, END]] += 1.0
    return weights / weights.sum()


def improved(ready: DataFrame, totals: dict, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over all texts to learn from: the new model, and log10 of the likelihood under the old one."""
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((len(model.emits) + k + 2, k), np.int64)
        for batch in batches:
            for n in range(len(batch)):
                block = Block(batch, n)
                chunks = Chunks(block.starts[block.learn], block.sizes[block.learn])
                if not len(chunks.begin):
                    continue
                emitted, steps, first, logs = model.expected(block.classes, chunks)
                likelihood = np.zeros((1, k))
                likelihood[0, 0] = logs
                whole += np.rint(np.concatenate([emitted, steps, first[None], likelihood]) * UNIT).astype(np.int64)
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(whole[used, s]) for s in range(k)]], ["row", *[f"s{s}" for s in range(k)]])

    schema = ", ".join(["row long", *[f"s{s} long" for s in range(k)]])
    sums = ready.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(F.col(f"s{s}").cast("decimal(20,0)")).cast("double").alias(f"s{s}") for s in range(k)])
    got = sums.toArrow()  # a row for each class and state
    table = np.zeros((len(model.emits) + k + 2, k))
    table[got["row"].to_numpy()] = np.stack([got[f"s{s}"].to_numpy() for s in range(k)], 1) / UNIT
    emitted, steps, first = table[: len(model.emits)], table[len(model.emits) : -2], table[-2]
    emits = emitted + PRIOR * overall_classes(totals["classes"])[:, None]
    return Model(unit_rows(first + 1.0), unit_rows(steps + EVEN / k), emits / emits.sum(0)), float(table[-1, 0])


def train(ready: DataFrame, totals: dict, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """A model after some rounds, and the likelihoods on the way."""
    model, path = initial(totals["classes"], states), []
    for _ in range(rounds if totals["texts"] else 0):
        model, logs = improved(ready, totals, model)
        path.append(logs)
    return model, path


def scored(ready: DataFrame, totals: dict, model: Model, id_col: str) -> DataFrame:
    kind = dict(ready.dtypes)["docs"].removeprefix("array<").removesuffix(">")
    low = np.log10(totals["tokens"] + totals["types"] + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                block, ids = Block(batch, n), batch.column(batch.schema.get_field_index("docs"))[n].values
                states = model.log_likelihood(block.classes, Chunks(block.starts, block.sizes), len(block.sizes))
                counts = block.counts(totals)
                known = block.per_text((counts > 0).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(~block.learn), pa.array(block.sizes), pa.array(known), pa.array(np.full(len(known), totals["tokens"], np.int64)), pa.array(block.per_text(np.log10(counts + 1.0) - low)), pa.array(states + block.per_text(block.inside(totals)))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return ready.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities) of every row.

    Learns from the rows that are not held out. Null and empty texts are their end alone; a null id is kept, is not
    held out and so is learned from; repeated rows count and are scored each; other columns, whatever their names, are not read; an empty
    table gives no rows. Where nothing is to be learned from, all states are alike. Unknown words are one
    type, as in the base score. A text is in one row of a block: its tokens take two or six bytes each.
    """
    packed = blocks(docs, id_col, text_col)
    ready, totals = counted(packed)
    discard(packed)
    model, _ = train(ready, totals, states, rounds)
    return scored(ready, totals, model, id_col)
