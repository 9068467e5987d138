"""Vector compression: each part of a vector becomes the number of its nearest codebook entry.

Entries are sorted by norm. As | |x| - |e| | is a lower bound of the distance of x and e, a part needs only
the entries whose norm lies within the best distance so far of its own: an interval that binary search finds. All
of that annulus, both ends included, is evaluated exactly, in integers. The codebooks, at most `entries` vectors,
are all that the driver holds; assignments and sums run on Arrow batches.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest size of a scaled component: squared distances of a vector then fit 64 bits.
LIMIT = 1 << 24


def root(squares: np.ndarray) -> np.ndarray:
    """Floor of the square root of whole numbers below 2^62, exact."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


class Book:
    """Entries of one part, searched by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.entries = entries[self.order]
        self.norms = root(squares[self.order])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry number, squared distance) of the nearest entry to each row of x; of equal ones the least number."""
        far = lambda rows, at: ((rows - self.entries[at]) ** 2).sum(1)
        norms = root((x * x).sum(1))
        # The entries next above and below in norm give the first bound.
        above = np.searchsorted(self.norms, norms).clip(0, len(self.norms) - 1)
        best = np.minimum(far(x, above), far(x, (above - 1).clip(0)))
        # Norms are floors, so the interval is wider by one on either side.
        reach = root(best) + 2
        low = np.searchsorted(self.norms, norms - reach, "left")
        high = np.searchsorted(self.norms, norms + reach, "right")
        sizes = high - low
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        at = np.arange(sizes.sum()) + np.repeat(low - begin, sizes)
        owner = np.repeat(np.arange(len(x)), sizes)
        found = far(x[owner], at)
        least = np.minimum.reduceat(found, begin) if len(x) else best
        number = np.where(found == least[owner], self.order[at], len(self.order))
        return (np.minimum.reduceat(number, begin) if len(x) else norms), least


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<long> column as a matrix of that width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def assign(rows: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x parts) of a matrix of vectors, some rows at a time, so that the pairs of an annulus take at most 32 MB."""
    width = rows.shape[1] // len(books)
    step = max(1, (1 << 22) // (len(books[0]) * max(1, width)))
    codes, errors = np.zeros((len(rows), len(books)), np.int64), np.zeros((len(rows), len(books)), np.int64)
    for p, entries in enumerate(books):
        book = Book(entries)
        for low in range(0, len(rows), step):
            codes[low : low + step, p], errors[low : low + step, p] = book.nearest(rows[low : low + step, p * width : (p + 1) * width])
    return codes, errors


def quantized(vectors: DataFrame, parts: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label and whole-number components of the usable rows, padded with zeros to a common multiple of `parts`; staged."""
    vec = F.col(vec_col)
    fit = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(fit).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    rows = stage(rows, "codes-input")
    ends = rows.agg(F.max(F.size("v")).alias("longest"), F.min(F.size("v")).alias("shortest"), F.max(F.array_max(F.transform("v", F.abs))).alias("far")).first()
    if ends.far is not None and ends.far > LIMIT:
        raise ValueError(f"components beyond {LIMIT / SCALE} would overflow 64-bit errors")
    width = -(-(ends.longest or 0) // parts) * parts
    if ends.shortest is not None and ends.shortest < width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    return rows


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors with the least ids, ascending: the codebooks to begin with."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    all_ = np.array([r.v for r in least], np.int64)
    return np.split(all_, parts, axis=1) if len(least) else []


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floored mean of its parts, unused entries as they were."""
    parts, width = len(books), books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width), object) for b in books]
        count = np.zeros((parts, len(books[0])), np.int64)
        for batch in batches:
            own = matrix(batch.column(0), parts * width)
            codes, _ = assign(own, books)
            for p in range(parts):
                added = np.zeros((len(books[p]), width), np.int64)
                np.add.at(added, codes[:, p], own[:, p * width : (p + 1) * width])
                total[p] += added
                count[p] += np.bincount(codes[:, p], minlength=len(books[p]))
        used = [(p, e) for p in range(parts) for e in range(len(books[p])) if count[p, e]]
        cells = [[int(total[p][e][w]) for p, e in used] for w in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p, e]) for p, e in used], pa.int64()), *[pa.array(c, pa.int64()) for c in cells]], ["part", "entry", "n", *[f"s{w}" for w in range(width)]])

    schema = ", ".join(["part int", "entry int", "n long", *[f"s{w} long" for w in range(width)]])
    partial = rows.select("v").mapInArrow(sums, schema)
    whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{w}").cast("decimal(20,0)")).alias(f"s{w}") for w in range(width)])
    new = [b.copy() for b in books]
    for r in whole.collect():  # a row for each entry of each part
        new[r.part][r.entry] = [int(r[f"s{w}"]) // r.n for w in range(width)]
    return new


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of quantized rows after some rounds; none for an empty table."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts) of quantized rows."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(matrix(batch.column(2), width), books)
            text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(errors.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not books:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row.

    Rows whose vector is null, or has a null or a component that is not finite, are dropped. Shorter vectors, and
    lengths that `parts` does not divide, are padded with zeros; an empty vector is all zeros. Null ids come last
    and are coded like others; null labels are one group; repeated rows are each coded, and each count; ids that
    tie are taken in the order of their vectors; other columns are not read; an empty table gives no rows.
    Components of more than LIMIT / SCALE are an error, as 64 bits would not hold their distances.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part has 1 to 256 entries")
    rows = quantized(vectors, parts, id_col, vec_col, label_col)
    books = train(rows, parts, entries, rounds)
    coded = stage(encode(rows, books), "codes")
    discard(rows)
    # One row a label, as measured when staged: the planner broadcasts it only if small, and else splits a hot label.
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
