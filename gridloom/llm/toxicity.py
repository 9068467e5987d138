"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled. A logistic model over
the presence of hashed words is fitted with numpy to the class-prior-corrected risk
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]). The prior is the toxic
share of the labels. Fitting uses bounded samples (see fit); scoring covers every whole text.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Bounds of the fitting sample: rows, taken in the order of a hash of the id, and buckets of each, the least
#: under a hash (a long text is seen in part by the fit, never by a score). Documented parameters.
POSITIVES, UNLABELLED, ROW_BUCKETS = 4000, 8000, 1 << 14


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words of a text, in lower case: at most BUCKETS."""
    words = set(LETTERS.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int32, len(words)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


class Model:
    """score = sigmoid(bias + sum of the weights of the buckets present)."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def score(self, present: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, present)
        at[at == len(self.buckets)] = 0
        f = self.bias + (float(self.weights[at[self.buckets[at] == present]].sum()) if len(self.buckets) and len(present) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def select(rows: list[np.ndarray], positive: np.ndarray, most: int, least_z: float) -> np.ndarray:
    """Buckets whose presence differs most between positives and unlabelled texts (two-proportion z score)."""
    p = np.bincount(np.concatenate([r for r, y in zip(rows, positive, strict=True) if y] or [np.zeros(0, np.int32)]), minlength=BUCKETS)
    u = np.bincount(np.concatenate([r for r, y in zip(rows, positive, strict=True) if not y] or [np.zeros(0, np.int32)]), minlength=BUCKETS)
    np_, nu = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    pooled = (p + u + 1) / (np_ + nu + 2)
    z = np.abs(p / np_ - u / nu) / np.sqrt(pooled * (1 - pooled) * (1 / np_ + 1 / nu))
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[(z[best] >= least_z) & (p[best] + u[best] >= 3)]).astype(np.int32)


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, most: int = 4096, least_z: float = 4.0) -> Model:
    """Fit by Adam on the whole sample. Without positives or unlabelled rows the score is the prior."""
    prior = min(0.99, max(1e-4, prior))
    start = float(np.log(prior / (1 - prior)))
    buckets = select(rows, positive, most, least_z)
    if not positive.any() or positive.all() or not len(buckets):
        return Model(buckets[:0], np.zeros(0), start)
    kept = [np.searchsorted(buckets, r[np.isin(r, buckets, assume_unique=True)]) for r in rows]
    sizes = np.array([len(k) for k in kept])
    cols, owner = np.concatenate(kept), np.repeat(np.arange(len(kept)), sizes)
    n_p, n_u = positive.sum(), (~positive).sum()
    w, b = np.zeros(len(buckets)), start
    m, v = np.zeros(len(buckets) + 1), np.zeros(len(buckets) + 1)
    for step in range(1, steps + 1):
        f = b + np.bincount(owner, weights=w[cols], minlength=len(kept))
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        # d loss(+) / df = s - 1; d loss(-) / df = s, loss(-) = log(1 + exp f)
        negative = np.logaddexp(0, f)
        rest = negative[~positive].mean() - prior * negative[positive].mean()
        g_rest = np.where(positive, -prior * s / n_p, s / n_u)
        # Where the unlabelled part would fall below zero it has overfitted: step back along it.
        g = np.where(positive, prior * (s - 1) / n_p, 0) + g_rest if rest >= 0 else -g_rest
        grad = np.append(np.bincount(cols, weights=g[owner], minlength=len(buckets)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(buckets, w, float(b))


def feature_column(text: Column, most: int = ROW_BUCKETS) -> Column:
    def bounded(found: np.ndarray) -> np.ndarray:
        if len(found) <= most:
            return found
        scrambled = found.astype(np.uint32) * np.uint32(0x9E3779B1)
        return np.sort(found[np.argpartition(scrambled, most)[:most]])

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([bounded(features(t.as_py())).tobytes() for t in texts], pa.binary())

    return run(text)


def least_ids(ids: DataFrame, salt: int, n: int) -> DataFrame:
    """The n distinct ids that are first in the order of a hash.

    Only ids below a threshold are shuffled; where many rows repeat it is raised until n are found, or all are in.
    """
    order, part = F.xxhash64(F.col("id"), F.lit(salt)), 4 * n / max(1, ids.count())
    while True:
        below = ids.where(order <= int(part * 2**64) - 2**63) if part < 1 else ids
        below = below.distinct()
        if part >= 1 or below.count() >= n:
            return below.orderBy(order, "id").limit(n)
        part *= 8


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, folds: int = 5) -> Model:
    """Learn from rows that are not held out: at most `positives` toxic ones and `unlabelled` others.

    Both are the first in the order of a hash of the id, so the choice does not depend on order
    or partitions; of repeated rows of an id the text with the least hash counts. The driver gets
    only their word buckets: 12,000 arrays of at most ROW_BUCKETS numbers. The
    prior is counted over all labels that are not held out.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id"), folds))
    toxic = own.groupBy("id").agg(F.max("y").alias("y"))
    share = toxic.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    # One entry for each id, made before any text is read.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").where(~held_out(F.col("id"), folds))
    chosen = toxic.where("y = 1").select("id").orderBy(F.xxhash64(F.col("id"), F.lit(11)), "id").limit(positives).withColumn("positive", F.lit(True))
    others = least_ids(rows.select("id"), 13, unlabelled).withColumn("positive", F.lit(False))
    wanted = chosen.unionByName(others).groupBy("id").agg(F.collect_list("positive").alias("as"))
    found = rows.join(F.broadcast(wanted), "id")  # at most 12,000 ids
    # The buckets, not the texts, are shuffled; partial aggregation leaves one row for each id and task.
    found = found.select("id", "as", F.xxhash64("text").alias("h"), feature_column(F.col("text")).alias("f"))
    got = found.groupBy("id").agg(F.min(F.struct("h", "f", "as")).alias("one")).select("id", "one.f", "one.as").toArrow()
    order = got["id"].to_numpy(zero_copy_only=False).argsort(kind="stable")
    kept, marks = [], []
    for f, marked in zip(got["f"].take(order), got["as"].take(order), strict=True):
        for mark in marked.as_py():
            kept.append(np.frombuffer(f.as_py(), np.int32))
            marks.append(mark)
    return train(kept, np.array(marks, bool), share)


def score_column(text: Column, model: Model) -> Column:
    buckets, weights, bias = model.buckets, model.weights, model.bias

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(buckets, weights, bias)
        for texts in batches:
            yield pa.array([own.score(features(t.as_py())) for t in texts], pa.float64())

    return run(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted for every row.

    Null and empty texts get the score of a text without known words; null ids stay null and are
    not learned from; several labels of an id count as toxic if one is; repeated rows are
    scored each; other columns are not read. Without labels every score is the least prior.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the model predicts toxic; columns and other rows as they are.

    Null and empty texts score like a text without known words, so they stay unless most labels are toxic; null ids,
    repeated rows and several labels: as score() says; an empty table stays empty. A column `__toxic` is reserved.
    """
    model = fit(docs, labels)
    marked = docs.withColumn("__toxic", score_column(F.col("text"), model))
    return marked.where("__toxic < 0.5").drop("__toxic")
