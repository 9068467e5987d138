"""Sampling, batching, splits and synthetic points. All draws come from hashes or seeded columns, so reruns agree."""

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.order import global_rank, running


def unit_hash(*cols, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the columns and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def with_replacement(df: DataFrame, n: int, group: str, order: str, seed: int = 0) -> DataFrame:
    """n uniform draws from each group, with replacement: draw numbers joined to row numbers."""
    numbered = running(df, [group], [order], at=F.lit(1)).withColumn("at", F.col("at") - 1)
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.select(group, "draw", F.floor(unit_hash(group, "draw", seed=seed) * F.col("size")).cast("long").alias("at"))
    return draws.join(numbered, [group, "at"])


def weighted(df: DataFrame, n: int, group: str, key: str, weight: Column, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, probability by weight (Efraimidis and Spirakis: least -ln(u)/w)."""
    draw = F.try_divide(-F.ln(F.greatest(unit_hash(key, seed=seed), F.lit(1e-300))), weight)
    return df.withColumn("__draw", draw).withColumn("__at", F.row_number().over(W.partitionBy(group).orderBy(F.col("__draw").asc_nulls_last(), key))).where(F.col("__at") <= n).drop("__draw", "__at")


def importance_weights(df: DataFrame, scale: str, bias: float, group: str) -> DataFrame:
    """Weight scale^-bias; missing scales take the group's lower median."""
    middle = df.groupBy(group).agg(F.expr(f"percentile_disc(0.5) within group (order by {scale})").alias("__m"))
    return df.join(middle, group).withColumn("weight", F.pow(F.coalesce(F.col(scale), F.col("__m")), F.lit(-bias))).drop("__m")


def subsample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in a seeded pseudo-random order."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def epoch(df: DataFrame, key: str, seed: int, number: int) -> DataFrame:
    """The rows with their place in the shuffled order of an epoch."""
    return df.withColumn("order", F.xxhash64(key, F.lit(seed + number)))


def arithmetic_order(key: Column, seed: int, modulus: int = 2_147_483_647) -> Column:
    """A hash that any SQL engine can repeat."""
    return F.pmod(key * F.lit(1_103_515_245) + F.lit(12_345 + seed * 7_919), F.lit(modulus))


def split_every(df: DataFrame, n: int, order: str, exclude: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Every n-th row in order is validation; excluded keys are gone first."""
    rows = df if exclude is None else df.join(exclude, key or order, "left_anti")
    return global_rank(rows, [order], "__at").withColumn("split", F.when(F.col("__at") % n == 0, "val").otherwise("train")).drop("__at")


def ray_groups(df: DataFrame, per_image: int, order: str) -> DataFrame:
    """Group number of each ray when every image gives per_image of them; ValueError if they do not divide."""
    if per_image <= 0:
        raise ValueError("rays per image must be positive")
    return global_rank(df, [order], "__at").withColumn("image_slot", F.floor(F.col("__at") / per_image).cast("long")).drop("__at")


def collate(df: DataFrame, batch: str, order: str, *cols: str) -> DataFrame:
    """One row for each batch, with ordered lists."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("r"))
    return rows.select(batch, *[F.col(f"r.{c}").alias(c) for c in (order, *cols)])


# ---- synthetic points


def _u(n: int, seed: int) -> Column:
    return unit_hash("id", F.lit(n), seed=seed)


def _normal(n: int, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(1 - _u(n, seed))) * F.cos(2 * pi * _u(n + 100, seed))


def plane(spark: SparkSession, n: int, width: float = 1.0, depth: float = 1.0, noise: float = 0.01, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pid"), ((_u(1, seed) - 0.5) * width).alias("x"), ((_u(2, seed) - 0.5) * depth).alias("y"), (_normal(3, seed) * noise).alias("z"))


def sphere(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.01, seed: int = 42) -> DataFrame:
    h, a, r = 2 * _u(1, seed) - 1, 2 * pi * _u(2, seed), F.lit(radius) + _normal(3, seed) * noise
    flat = F.sqrt(1 - h * h)
    return spark.range(n).select(F.col("id").alias("pid"), (r * flat * F.cos(a)).alias("x"), (r * flat * F.sin(a)).alias("y"), (r * h).alias("z"))


def cylinder(spark: SparkSession, n: int, radius: float = 0.5, height: float = 1.0, noise: float = 0.01, seed: int = 42) -> DataFrame:
    a, r = 2 * pi * _u(1, seed), F.lit(radius) + _normal(3, seed) * noise
    return spark.range(n).select(F.col("id").alias("pid"), (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), ((_u(2, seed) - 0.5) * height).alias("z"))


def box(spark: SparkSession, n: int, size: tuple[float, float, float] = (1.0, 1.0, 1.0), noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Points on the six faces, each face by its area."""
    a, b, c = size
    areas = [b * c, b * c, a * c, a * c, a * b, a * b]
    edge, face = 0.0, F.lit(5)
    for n_face, area in reversed(list(enumerate(areas))):
        face = F.when(_u(1, seed) < sum(areas[: n_face + 1]) / sum(areas), n_face).otherwise(face)
    rows = spark.range(n).withColumn("face", face)
    axis, side = F.floor(F.col("face") / 2), F.col("face") % 2 - 0.5
    out = [F.when(axis == d, side).otherwise(_u(2 + d, seed) - 0.5) * size[d] + _normal(6 + d, seed) * noise for d in range(3)]
    return rows.select(F.col("id").alias("pid"), *[o.alias(x) for o, x in zip(out, "xyz", strict=True)])


def scene_batch(spark: SparkSession, kind: str, n: int, batch: int, seed: int = 42) -> DataFrame:
    """A batch of scenes; scene i has seed + 1000 i. Kinds: object, room, street."""
    out = None
    for i in range(batch):
        s = seed + 1000 * i
        if kind == "object":
            parts = [plane(spark, n // 2, 0.6, 0.6, seed=s), sphere(spark, n - n // 2, 0.15, seed=s + 1)]
        elif kind == "room":
            parts = [plane(spark, n // 2, 4.0, 4.0, seed=s), box(spark, n - n // 2, (4.0, 4.0, 2.75), seed=s + 1)]
        elif kind == "street":
            parts = [plane(spark, n // 2, 40.0, 10.0, seed=s), box(spark, n - n // 2, (8.0, 4.0, 6.0), seed=s + 1)]
        else:
            raise ValueError(f"unknown scene {kind!r}")
        at = 0
        for p in parts:
            rows = p.select(F.lit(i).cast("long").alias("batch_id"), (F.col("pid") + at).alias("pid"), "x", "y", "z")
            out = rows if out is None else out.unionByName(rows)
            at += n // 2
    return out
