"""Ordered operators: space-filling curves, ranks, patches, windows, runs, scans with ties."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.functions.vec import morton

#: Names of the curves and what they order by.
CURVES = {"z": "morton", "morton": "morton", "z-trans": "morton_zyx", "morton_zyx": "morton_zyx", "hilbert": "hilbert", "hilbert-trans": "hilbert_zyx", "vdb": "identity", "identity": "identity"}


def hilbert_numpy(coords: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the 3-D Hilbert curve, by the transposition method of Skilling (2004)."""
    x = coords.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for n in range(3):
            flip = (x[n] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[n]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if n:
                x[n] ^= swap
        q >>= 1
    for n in (1, 2):
        x[n] ^= x[n - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[2] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for n in range(3):
            out = (out << 1) | ((x[n] >> b) & 1)
    return out


def hilbert(i: Column, j: Column, k: Column, bits: int = 16, offset: int = 0) -> Column:
    """Hilbert code of cells; coordinates plus offset must lie in [0, 2^bits). Vectorised numpy."""

    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_numpy(np.stack([a, b, c], 1) + offset, bits))

    return run(i, j, k)


def curve_key(curve: str, pos: str = "pos", bits: int = 16, offset: int = 0) -> Column:
    """Sort key of the named curve over i, j, k; ValueError for other names."""
    if curve not in CURVES:
        raise ValueError(f"unknown curve {curve!r}; one of {', '.join(CURVES)}")
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    kind = CURVES[curve]
    if kind == "identity":
        return F.col(pos).cast("long")
    if kind.startswith("morton"):
        return morton(i, j, k, bits, offset) if kind == "morton" else morton(k, j, i, bits, offset)
    return hilbert(i, j, k, bits, offset) if kind == "hilbert" else hilbert(k, j, i, bits, offset)


def shuffled_curves(curves: tuple[str, ...], seed: int, enabled: bool = True) -> tuple[str, ...]:
    """A seeded permutation of the curves for a forward pass."""
    import random

    return tuple(random.Random(seed).sample(curves, len(curves))) if enabled else curves


def running(df: DataFrame, group: list[str], by: list, **sums: Column) -> DataFrame:
    """Add running sums (this row included) along an order within groups, however large a group is.

    Rows are dealt out by range of (group, order) once and kept; each part sums for itself and starts
    from the totals of the group's earlier parts, a table of a row for each group and part.
    """
    from gridloom.session import stage

    names = {n: f"__sum_{n}" for n in sums}
    ranged = df.withColumns({names[n]: c for n, c in sums.items()}).repartitionByRange(*group, *by).withColumn("__part", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    totals = ranged.groupBy(*group, "__part").agg(*[F.sum(c).alias(c) for c in names.values()])
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"__g{n}") for n, g in enumerate(group)], F.col("__part").alias("__at"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in names.values()])
    starts = stage(starts, "starts")
    inner = W.partitionBy(*group, "__part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumns({c: F.sum(c).over(inner) for c in names.values()})
    same = F.col("__part") == F.col("__at")
    for n, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{n}"))
    return local.join(starts, same).select(*df.columns, *[(F.col(c) + F.col(f"{c}_start")).alias(n) for n, c in names.items()])


def ranked(df: DataFrame, key: str, pos: str = "pos", batch: str = "batch_id", name: str = "rank") -> DataFrame:
    """Position of each row along its batch's order; ties in the order of pos."""
    return running(df, [batch], [key, pos], **{name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def global_rank(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Position of each row in one order over the whole table, without a task that sees all rows.

    Rows are dealt out by range once and kept (so both passes see the same parts); each part is numbered
    by itself and starts where the counts of the parts before it end. `by` should tell rows apart.
    """
    from gridloom.session import stage

    ranged = stage(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    inner = F.row_number().over(W.partitionBy("__part").orderBy(*by)) - 1
    # One row for each range part.
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, inner + F.col("__start")).drop("__part", "__start")


def global_positions(df: DataFrame, rank: str = "rank", batch: str = "batch_id") -> DataFrame:
    """Rank plus the rows of all earlier batches: offsets are a running count over batches."""
    counts = df.groupBy(batch).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(counts.select(batch, before.alias("offset")), batch).withColumn("position", F.col("offset") + F.col(rank))


def batch_of(pos: Column, offsets: list[int]) -> Column:
    """Batch number of a row's position, where offsets are the running ends of the batches."""
    return F.size(F.filter(F.array(*[F.lit(o) for o in offsets]), lambda o: o <= pos))


def offsets(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Running end of each batch, in order of batch: a row for each."""
    counts = df.groupBy(batch).agg(F.count("*").alias("n"))
    return counts.select(batch, F.sum("n").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, 0)).alias("offset"))


def patches(df: DataFrame, size: int, rank: str = "rank") -> DataFrame:
    """Fixed-size patches along the order; the last of a batch may be shorter, none crosses batches."""
    return df.withColumn("patch", F.floor(F.col(rank) / size).cast("long"))


def sliding_mean(df: DataFrame, value: str, patch: int, order: list[str], batch: str = "batch_id") -> DataFrame:
    """Mean over the rows within patch / 2 of each along the order."""
    frame = W.partitionBy(batch).orderBy(*order).rowsBetween(-(patch // 2), patch // 2)
    return df.withColumn("window_sum", F.sum(value).over(frame)).withColumn("window_n", F.count(value).over(frame))


def patch_attention(df: DataFrame, scale: float, q: str = "q", k: str = "k", v: str = "v", pos: str = "pos", batch: str = "batch_id") -> DataFrame:
    """softmax(q k' scale) v within each patch (bounded by the patch size), numpy on grouped batches."""

    def attend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        a, b, c = (np.stack(rows[n].to_numpy()).astype(np.float64) for n in (q, k, v))
        logits = a @ b.T * scale
        e = np.exp(logits - logits.max(1, keepdims=True))
        return pd.DataFrame({batch: rows[batch], "patch": rows["patch"], pos: rows[pos], "out": list(e / e.sum(1, keepdims=True) @ c)})

    kinds = dict(df.dtypes)
    return df.groupBy(batch, "patch").applyInPandas(attend, f"{batch} {kinds[batch]}, patch long, {pos} {kinds[pos]}, out array<double>")


def running_sum(df: DataFrame, value: str, order: list[str], group: list[str], name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def step_difference(df: DataFrame, value: str, order: list[str], group: list[str], name: str = "step") -> DataFrame:
    """Difference from the row before; the first row keeps its value."""
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(W.partitionBy(*group).orderBy(*order)), F.lit(0)))


def run_lengths(df: DataFrame, value: str, order: list[str], group: list[str]) -> DataFrame:
    """Run-length encoding: group, run, value, length, start (rows before the run)."""
    w = W.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.select(*group, *order, value, new.alias("new"), (F.row_number().over(w) - 1).alias("at"))
    numbered = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run", value).agg(F.count("*").alias("length"), F.min("at").alias("start"))


def expand_runs(runs: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Undo run_lengths: a row for each element, with its place."""
    return runs.select(*group, value, "start", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("n")).select(*group, value, (F.col("start") + F.col("n")).alias("at"))


def smallest_int(low: int, high: int) -> str:
    """The smallest of Spark's integer types that holds the range."""
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
        if -(1 << bits - 1) <= low and high < 1 << bits - 1:
            return name
    return "bigint"


def padded(df: DataFrame, array: str, group: str, fill: float = 0.0) -> DataFrame:
    """Arrays padded to the longest, and a mask that is true on the padding."""
    longest = df.agg(F.max(F.size(array)).alias("longest"))
    rows = df.join(F.broadcast(longest))  # one row
    more = F.col("longest") - F.size(array)
    return rows.select(group, F.concat(array, F.array_repeat(F.lit(fill), more)).alias(array), F.concat(F.array_repeat(F.lit(False), F.size(array)), F.array_repeat(F.lit(True), more)).alias("pad_mask"))


def best_first(value: str, score: str, order: str) -> Column:
    """Aggregate: value of the highest score, the first in order on ties (a strict > scan)."""
    return F.max_by(value, F.struct(F.col(score), -F.col(order)))


def best_last(value: str, score: str, order: str) -> Column:
    """Aggregate: value of the highest score, the last in order on ties (a >= scan)."""
    return F.max_by(value, F.struct(F.col(score), F.col(order)))
