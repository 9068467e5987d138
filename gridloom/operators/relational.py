"""Keyed lookups, re-indexing, filters by group, and item assembly."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.order import global_rank


def representative(points: DataFrame, key: list[str], pid: str, *carried: str) -> DataFrame:
    """One point of each cell, the least id: what an inverse voxel lookup returns."""
    return points.groupBy(*key).agg(F.min(F.struct(pid, *carried)).alias("p")).select(*key, "p.*")


def remap(df: DataFrame, col: str, mapping: dict, strict: bool = True) -> DataFrame:
    """Class ids through a map (a bounded literal). strict: an unknown id is an error."""
    book = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    got = F.try_element_at(book, F.col(col))
    if strict:
        got = F.when(got.isNull(), F.raise_error(F.concat(F.lit("no class for id "), F.col(col).cast("string")))).otherwise(got)
    return df.withColumn(col, got)


def remap_join(df: DataFrame, mapping: DataFrame, col: str, to: str) -> DataFrame:
    """Class ids through a table of col -> to; rows without an entry are dropped."""
    return df.join(mapping.select(col, to), col)


def first_known(mapping: Column, *names: Column) -> Column:
    """The first of several names that a map has: exact scene, trimmed scene, base name."""
    return F.coalesce(*[F.try_element_at(mapping, n) for n in names])


def base_scene(name: Column) -> Column:
    """Scene name up to its first underscore."""
    return F.substring_index(name, "_", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def image_by_name(images: DataFrame, name: str, col: str = "path", order: str = "image_id") -> DataFrame:
    """The first image, in order, whose stem equals name without regard to case."""
    return images.where(F.lower(stem(F.col(col))) == name.lower()).orderBy(order).limit(1)


def zip_by_position(a: DataFrame, b: DataFrame, order: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows at equal places of two ordered tables, to the end of the shorter."""
    left = global_rank(a, [order], "at").select("at", F.struct(*a.columns).alias(names[0]))
    right = global_rank(b, [order], "at").select("at", F.struct(*b.columns).alias(names[1]))
    return left.join(right, "at")


def intersect_positions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct common keys with their places among the sorted keys of either side."""
    return global_rank(a.select(key).distinct(), [key], "at_a").join(global_rank(b.select(key).distinct(), [key], "at_b"), key)


def compact_mesh(vertices: DataFrame, faces: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices in kept (vid) with new dense ids, and the faces whose three vertices are all kept, re-indexed."""
    index = global_rank(kept.select("vid").distinct(), ["vid"], "new")
    own = vertices.join(index, "vid")
    corners = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    whole = corners.join(index, "vid").groupBy("fid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("corner", "new"))).alias("c")).where("n = 3")
    return own, whole.select("fid", *[F.col("c")[i]["new"].alias(f"v{i}") for i in range(3)])


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges of exactly one face."""
    ends = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    edges = faces.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in ends])).alias("e"))
    return edges.groupBy("e.a", "e.b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def unique_compute(df: DataFrame, key: str, compute) -> DataFrame:
    """Compute once for each distinct key and join the result to all rows. compute: DataFrame(key) -> DataFrame(key, ...)."""
    return df.join(compute(df.select(key).distinct()), key)


def at_least(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of groups that have at least n rows."""
    big = df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= n)
    return df.join(big, group, "left_semi")


def visible_union(*visible: DataFrame, key: str = "pid") -> DataFrame:
    """Points that any camera sees, with dense new indices."""
    out = visible[0].select(key)
    for v in visible[1:]:
        out = out.unionByName(v.select(key))
    return global_rank(out.distinct(), [key], "new")


def repair_cameras(cameras: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where an image's true size differs from its camera's, take it and put the principal point at its centre."""
    rows = cameras.join(sizes.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id", "left")
    off = F.col("w").isNotNull() & ((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")))
    take = lambda new, old: F.when(off, new).otherwise(F.col(old)).alias(old)
    same = [c for c in cameras.columns if c not in ("width", "height", "cx", "cy")]
    return rows.select(*same, take(F.col("w"), "width"), take(F.col("h"), "height"), take(F.col("w") / 2.0, "cx"), take(F.col("h") / 2.0, "cy"))


def scaled_intrinsics(cameras: DataFrame, factor: float) -> DataFrame:
    return cameras.withColumns({c: F.col(c) * F.lit(factor) for c in ("fx", "fy", "cx", "cy")})


def drag(points: DataFrame, selected: Column, rotation: list[list[float]], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rigid motion of the selected points about their own mean."""
    means = points.where(selected).agg(*[F.avg(a).alias(f"__{a}") for a in "xyz"])
    rows = points.join(F.broadcast(means))  # one row
    d = [F.col(a) - F.col(f"__{a}") for a in "xyz"]
    moved = {a: F.when(selected, F.col(f"__{a}") + sum((F.lit(float(rotation[n][m])) * d[m] for m in range(3)), F.lit(0.0)) + F.lit(float(shift[n]))).otherwise(F.col(a)) for n, a in enumerate("xyz")}
    return rows.withColumns(moved).drop("__x", "__y", "__z")


def normalized_colors(df: DataFrame, cols: list[str], eight_bit: bool) -> DataFrame:
    """Colours as floats in [0, 1]: bytes over 255; floats over 255 if any is above 1."""
    if eight_bit:
        scale = F.lit(255.0)
        rows = df
    else:
        top = df.agg(F.greatest(*[F.max(c) for c in cols]).alias("__top"))
        rows, scale = df.join(F.broadcast(top)), F.when(F.col("__top") > 1, 255.0).otherwise(1.0)  # one row
    return rows.withColumns({c: F.least(F.greatest(F.col(c) / scale, F.lit(0.0)), F.lit(1.0)) for c in cols}).select(*df.columns)


def level_lengths(ids: DataFrame) -> DataFrame:
    """Masks of each level from running maxima of ids over levels: a level without pixels has none. ids: level, id."""
    tops = ids.groupBy("level").agg(F.max(F.when(F.col("id") >= 0, F.col("id") + 1)).alias("top"))
    w = W.orderBy("level")
    run = tops.withColumn("run", F.coalesce(F.max("top").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return run.select("level", (F.col("run") - F.coalesce(F.lag("run").over(w), F.lit(0))).alias("length"))


class Snapshots:
    """Undo stack of frames: DataFrames are immutable, so a snapshot is a reference."""

    def __init__(self, df: DataFrame):
        self.df, self.stack = df, []

    def push(self, df: DataFrame) -> DataFrame:
        self.stack.append(self.df)
        self.df = df
        return df

    def undo(self) -> DataFrame:
        if self.stack:
            self.df = self.stack.pop()
        return self.df

    def crop(self, ids: DataFrame, key: str = "pid") -> DataFrame:
        return self.push(self.df.join(ids, key, "left_semi"))


def gather(rows: DataFrame, values: DataFrame, key: list[str], default: dict | None = None) -> DataFrame:
    """Values by id (and batch): a join in place of fancy indexing with offsets; misses get the defaults or are dropped."""
    if default is None:
        return rows.join(values, key)
    return rows.join(values, key, "left").fillna(default)


def crop_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    cond = F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        cond = cond & F.col(a).between(lo, hi)
    return points.where(cond)


def has_colors(mesh: DataFrame, cols: tuple[str, ...] = ("r", "g", "b")) -> bool:
    """Whether a mesh has colour columns with a value in them."""
    return all(c in mesh.columns for c in cols) and mesh.where(" and ".join(f"{c} is not null" for c in cols)).limit(1).count() == 1


def run_scenes(scenes: DataFrame, done: DataFrame | None, run, key: str = "scene") -> dict[str, str]:
    """Run each scene that is not done; name -> done, skipped or the error. One failure does not stop the others."""
    names = [r[0] for r in scenes.select(key).distinct().orderBy(key).collect()]
    past = {r[0] for r in done.select(key).distinct().collect()} if done is not None else set()
    out = {}
    for name in names:
        if name in past:
            out[name] = "skipped"
            continue
        try:
            run(name)
            out[name] = "done"
        except Exception as failed:
            out[name] = f"failed: {failed}"
    return out
