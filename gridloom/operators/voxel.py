"""Sparse voxel grids as tables (batch_id, i, j, k, features...), unique on the key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES, CELL = ("x", "y", "z"), ("i", "j", "k")
KEY = ["batch_id", *CELL]
Sizes = float | tuple[float, float, float]


def _three(v) -> tuple:
    return v if isinstance(v, tuple) else (v, v, v)


def keys(points: DataFrame, size: Sizes, origin: Sizes = 0.0, mode: str = "floor") -> DataFrame:
    """Add i, j, k. mode floor: corner-aligned cells; rint: nearest centre, halves to even."""
    rounding = {"floor": F.floor, "rint": F.rint}[mode]
    return points.withColumns({c: rounding((F.col(a) - F.lit(float(o))) / F.lit(float(s))).cast("long") for c, a, s, o in zip(CELL, AXES, _three(size), _three(origin), strict=True)})


def grid_coordinates(points: DataFrame, size: float) -> DataFrame:
    """Add i, j, k counted from the least corner of all batches together."""
    corner = points.agg(*[F.min(a).alias(f"__{a}") for a in AXES])
    rows = points.join(F.broadcast(corner))  # one row
    return rows.withColumns({c: F.floor((F.col(a) - F.col(f"__{a}")) / F.lit(float(size))).cast("long") for c, a in zip(CELL, AXES, strict=True)}).drop(*[f"__{a}" for a in AXES])


def voxelize(points: DataFrame, size: Sizes, **how) -> DataFrame:
    return keys(points, size, **how).select(*KEY).distinct()


def local_position(points: DataFrame) -> DataFrame:
    """Position inside the unit cell and its key."""
    out = points.withColumns({c: F.floor(a).cast("long") for c, a in zip(CELL, AXES, strict=True)})
    return out.withColumns({f"local_{a}": F.col(a) - F.floor(a) for a in AXES})


def downsample(points: DataFrame, size: Sizes, *aggs: Column, **how) -> DataFrame:
    """One row for each occupied cell. Aggregates run partially before the one exchange."""
    return keys(points, size, **how).groupBy(*KEY).agg(F.count("*").alias("n"), *aggs)


def trace(points: DataFrame, size: Sizes, pid: str = "pid") -> DataFrame:
    """Mean position and least point id of each cell."""
    return downsample(points, size, *[F.avg(a).alias(a) for a in AXES], F.min(pid).alias("first_id"))


def first_point(points: DataFrame, size: Sizes, *carried: str, pid: str = "pid") -> DataFrame:
    """The point with the least id of each cell, with the carried columns."""
    return keys(points, size).groupBy(*KEY).agg(F.min(F.struct(pid, *carried)).alias("p")).select(*KEY, "p.*")


def grid_sample(points: DataFrame, size: float, label: str = "label", pid: str = "pid", sentinel: bool = True) -> DataFrame:
    """First point of each cell counted from the least corner of the batch.

    With the sentinel the corner itself, with label 0, comes before all points and so wins cell 0, 0, 0.
    """
    corner = points.groupBy("batch_id").agg(*[F.min(a).alias(f"o_{a}") for a in AXES])
    placed = points.join(corner, "batch_id").withColumns({c: F.floor((F.col(a) - F.col(f"o_{a}")) / F.lit(size)).cast("long") for c, a in zip(CELL, AXES, strict=True)})
    rows = placed.select(*KEY, F.col(pid).cast("long").alias("row"), *AXES, label)
    if sentinel:
        zero = [F.lit(0).cast("long").alias(c) for c in CELL]
        rows = rows.unionByName(corner.select("batch_id", *zero, F.lit(-1).cast("long").alias("row"), *[F.col(f"o_{a}").alias(a) for a in AXES], F.lit(0).cast(dict(points.dtypes)[label]).alias(label)))
    return rows.groupBy(*KEY).agg(F.min(F.struct("row", *AXES, label)).alias("p")).select(*KEY, "p.*")


def coarsen(voxels: DataFrame, factor: int = 2) -> DataFrame:
    """Cells of the grid `factor` times as wide; floors negative cells too."""
    return voxels.select("batch_id", *[F.floor(F.col(c) / factor).cast("long").alias(c) for c in CELL]).distinct()


def hierarchy(points: DataFrame, size: Sizes, depth: int = 4, factor: int = 2, **how) -> DataFrame:
    """Cells of all levels, 0 the finest, in one pass: the finest cells are made distinct first."""
    fine = voxelize(points, size, **how)
    levels = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    scale = F.pow(F.lit(float(factor)), F.col("level"))
    return levels.select("level", "batch_id", *[F.floor(F.col(c) / scale).cast("long").alias(c) for c in CELL]).distinct()


def refined(levels: DataFrame, finer: DataFrame) -> DataFrame:
    """Put a finer level before the others."""
    return finer.withColumn("level", F.lit(0)).unionByName(levels.withColumn("level", F.col("level") + 1))


def splat(points: DataFrame) -> DataFrame:
    """The eight cells nearest to each point, in voxel-centre coordinates, as a set."""
    corners = F.explode(F.array(*[F.struct(*[F.lit(n >> s & 1).cast("long").alias(f"d{c}") for s, c in enumerate(CELL)]) for n in range(8)])).alias("d")
    base = points.select("batch_id", *[F.floor(a).cast("long").alias(c) for c, a in zip(CELL, AXES, strict=True)]).distinct()
    return base.select("*", corners).select("batch_id", *[(F.col(c) + F.col(f"d.d{c}")).alias(c) for c in CELL]).distinct()


def status(target: DataFrame, coarse: DataFrame, finer: DataFrame | None) -> DataFrame:
    """0: the target cell is in neither grid, 1: in the coarse grid, 2: a finer cell lies in it (which overrides)."""
    rows = target.join(coarse.select(*KEY, F.lit(1).alias("in_coarse")), KEY, "left")
    rows = rows.join(coarsen(finer, 2).withColumn("in_fine", F.lit(1)), KEY, "left") if finer is not None else rows.withColumn("in_fine", F.lit(None))
    value = F.when(F.col("in_fine").isNotNull(), 2).when(F.col("in_coarse").isNotNull(), 1).otherwise(0)
    return rows.select(*KEY, value.cast("smallint").alias("status"))


def bounds(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("batch_id").agg(*[f(c).alias(f"{n}_{c}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))])


def pool(points: DataFrame, voxels: DataFrame, features: list[str], how: str = "max") -> DataFrame:
    """Aggregate point features (points carry i, j, k) on a given grid; empty cells get 0, points outside are ignored."""
    f = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    pooled = points.groupBy(*KEY).agg(*[f(c).alias(c) for c in features])
    return voxels.join(pooled, KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])


def pool_back(points: DataFrame, features: list[str]) -> DataFrame:
    """Each point with its cell's maxima. A join with the aggregated cells, so a full cell is no hot task."""
    pooled = points.groupBy(*KEY).agg(*[F.max(c).alias(f"pooled_{c}") for c in features])
    return points.join(pooled, KEY)


def max_pool(voxels: DataFrame, stride: int, features: list[str]) -> DataFrame:
    keyed = voxels.select("batch_id", *[F.floor(F.col(c) / stride).cast("long").alias(c) for c in CELL], *features)
    return keyed.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in features])


def unpool(coarse: DataFrame, fine: DataFrame, stride: int, features: list[str]) -> DataFrame:
    """Each fine cell with its parent's features, as up_<feature>."""
    parents = coarse.select("batch_id", *[F.col(c).alias(f"p{c}") for c in CELL], *[F.col(c).alias(f"up_{c}") for c in features])
    keyed = fine.withColumns({f"p{c}": F.floor(F.col(c) / stride).cast("long") for c in CELL})
    return keyed.join(parents, ["batch_id", *[f"p{c}" for c in CELL]]).drop(*[f"p{c}" for c in CELL])


def inject(target: DataFrame, source: DataFrame, features: list[str], default: float = 0.0) -> DataFrame:
    """Features of source on the cells of target; default where source has no such cell."""
    return target.select(*KEY).join(source.select(*KEY, *features), KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(default)).alias(c) for c in features])


def inject_over(filled: DataFrame, source: DataFrame, features: list[str]) -> DataFrame:
    """Like inject, but cells that source lacks keep what filled has: the last writer wins."""
    new = source.select(*KEY, *[F.col(c).alias(f"__{c}") for c in features])
    return filled.join(new, KEY, "left").select(*KEY, *[F.coalesce(f"__{c}", c).alias(c) for c in features])


def index_of(voxels: DataFrame) -> DataFrame:
    """Dense index of each cell within its batch, in the order of its key."""
    from gridloom.operators.order import running

    return running(voxels, ["batch_id"], list(CELL), index=F.lit(1)).withColumn("index", F.col("index") - 1)


def lookup(points: DataFrame, indexed: DataFrame) -> DataFrame:
    """Index of each point's cell, -1 where the grid lacks it."""
    return points.join(indexed.select(*KEY, "index"), KEY, "left").withColumn("index", F.coalesce("index", F.lit(-1)))


def sample_trilinear(points: DataFrame, voxels: DataFrame, feature: str, pid: str = "pid") -> DataFrame:
    """Weighted sum of the eight cells around each point (voxel-centre coordinates); missing cells add 0."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(n >> s & 1).cast("long").alias(f"d{c}") for s, c in enumerate(CELL)]) for n in range(8)]))
    rows = points.select("batch_id", pid, *AXES, corner.alias("d"))
    weight = F.lit(1.0)
    for c, a in zip(CELL, AXES, strict=True):
        t = F.col(a) - F.floor(a)
        weight = weight * F.when(F.col(f"d.d{c}") == 1, t).otherwise(1 - t)
    placed = rows.select("batch_id", pid, *[(F.floor(a).cast("long") + F.col(f"d.d{c}")).alias(c) for c, a in zip(CELL, AXES, strict=True)], weight.alias("w"))
    met = placed.join(voxels.select(*KEY, F.col(feature).cast("double").alias("f")), KEY, "left")
    return met.groupBy("batch_id", pid).agg(F.sum(F.col("w") * F.coalesce("f", F.lit(0.0))).alias(feature))


def sample_grid(voxels: DataFrame, resolution: int = 2) -> DataFrame:
    """resolution^3 sample offsets inside every cell, as positions in voxel coordinates."""
    steps = F.sequence(F.lit(0), F.lit(resolution - 1))
    rows = voxels.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).withColumn("c", F.explode(steps))
    at = lambda cell, n: (F.col(cell) + F.col(n) / F.lit(float(max(1, resolution - 1))))
    return rows.select(*KEY, "a", "b", "c", at("i", "a").alias("x"), at("j", "b").alias("y"), at("k", "c").alias("z"))


def stencil(voxels: DataFrame, feature: str, weights: dict[tuple[int, int, int], float]) -> DataFrame:
    """Scalar sparse convolution on the same cells: each cell sends its weighted value to its neighbours."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for (a, b, c), w in weights.items()])).alias("s")
    sent = voxels.select("batch_id", *CELL, F.col(feature).alias("v"), shifts)
    moved = sent.select("batch_id", *[(F.col(c) - F.col(f"s.{n}")).alias(c) for c, n in zip(CELL, "abc", strict=True)], (F.col("v") * F.col("s.w")).alias("v"))
    sums = moved.groupBy(*KEY).agg(F.sum("v").alias("out"))
    return voxels.select(*KEY).join(sums, KEY)


def fuse(samples: DataFrame, value: str, weight: str = "w", *others: str) -> DataFrame:
    """Weighted running average of each cell over frames, free of order; cells without weight are pruned."""
    cols = [value, *others]
    sums = samples.groupBy(*KEY).agg(F.sum(weight).alias("weight"), *[F.sum(F.col(weight) * F.col(c)).alias(c) for c in cols])
    return sums.where("weight > 0").select(*KEY, "weight", *[(F.col(c) / F.col("weight")).alias(c) for c in cols])


def resolutions(first: int, last: int, levels: int) -> list[int]:
    """A geometric ladder of grid resolutions, rounded."""
    step = (last / first) ** (1 / max(1, levels - 1))
    return [round(first * step**n) for n in range(levels)]


def occupancy(points: DataFrame, ladder: list[int]) -> DataFrame:
    """Distinct cells of points in [0, 1]^3 at each resolution of a ladder."""
    rows = points.withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in ladder])))
    return rows.select("resolution", *[F.floor(F.col(a) * F.col("resolution")).cast("long").alias(c) for c, a in zip(CELL, AXES, strict=True)]).distinct()


def surface_cases(voxels: DataFrame, value: str) -> DataFrame:
    """Marching-cubes case (bit n: corner n is below 0) of every cell all of whose eight corners exist, if the surface crosses it."""
    corner = F.explode(F.array(*[F.struct(F.lit(1 << n).alias("bit"), *[F.lit(n >> s & 1).cast("long").alias(f"d{c}") for s, c in enumerate(CELL)]) for n in range(8)])).alias("d")
    sent = voxels.select("batch_id", *CELL, F.col(value).alias("v"), corner)
    cells = sent.select("batch_id", *[(F.col(c) - F.col(f"d.d{c}")).alias(c) for c in CELL], F.when(F.col("v") < 0, F.col("d.bit")).otherwise(0).alias("bit"))
    cases = cells.groupBy(*KEY).agg(F.count("*").alias("corners"), F.sum("bit").alias("case"))
    return cases.where("corners = 8 and case not in (0, 255)").select(*KEY, "case")


def concat_features(a: DataFrame, b: DataFrame, left: str, right: str, name: str = "features") -> DataFrame:
    """Channel arrays of two grids on their common cells, one after the other."""
    return a.select(*KEY, left).join(b.select(*KEY, F.col(right).alias("__right")), KEY).select(*KEY, F.concat(left, "__right").alias(name))


def assert_unique(voxels: DataFrame) -> DataFrame:
    """The same rows; reading them fails if a cell occurs twice."""
    again = voxels.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if again.count():
        raise ValueError(f"cell occurs more than once: {again.first()}")
    return voxels


def point_encoder(points: DataFrame, grid: DataFrame, layers, depth: int = 2, feature: str = "feature") -> DataFrame:
    """Cell features from points: a dense layer, then `depth` rounds of cell maxima sent back and joined to
    the point's own channels through a further layer, then cell means; cells without points get zeros.

    layers: depth + 1 lists of (weights, bias) for vector.mlp; points carry i, j, k and the array
    `feature`; points outside the grid are ignored.
    """
    from gridloom.operators.vector import mlp

    rows = points.join(grid.select(*KEY), KEY, "left_semi").withColumn("h", mlp(F.col(feature), layers[0]))
    widths = [len(layer[-1][1]) for layer in layers]
    for n in range(1, depth + 1):
        pooled = rows.groupBy(*KEY).agg(*[F.max(F.col("h")[c]).alias(f"m{c}") for c in range(widths[n - 1])])
        both = rows.join(pooled, KEY).withColumn("h", F.concat("h", F.array(*[f"m{c}" for c in range(widths[n - 1])])))
        rows = both.withColumn("h", mlp(F.col("h"), layers[n])).drop(*[f"m{c}" for c in range(widths[n - 1])])
    means = rows.groupBy(*KEY).agg(F.array(*[F.avg(F.col("h")[c]) for c in range(widths[depth])]).alias(feature))
    zero = F.array(*[F.lit(0.0)] * widths[depth])
    return grid.select(*KEY).join(means, KEY, "left").withColumn(feature, F.coalesce(feature, zero))
