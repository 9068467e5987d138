"""Which splats make up a pixel: footprints of 3-D Gaussians, binned to tiles, blended from front to back."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import vec
from gridloom.operators.depth import FRAME, to_camera, usable

#: The least opacity of a splat at a pixel, the most it can have, the blur added to a footprint (square pixels).
FAINTEST, DENSEST, BLUR = 1 / 255, 0.999, 0.3


def footprints(splats: DataFrame, cameras: DataFrame, near: float = 0.01) -> DataFrame:
    """batch_id, frame, sid, u, v, depth, a, b, c, opacity of every splat in every camera of its scene: its centre and the inverse covariance (a, b; b, c) in the image.

    splats: batch_id, sid, x, y, z, sx, sy, sz (standard deviations), qw, qx, qy, qz, opacity; cameras: batch_id, frame, fx, fy, cx, cy, width, height, pose
    (camera to world). The projection is linearised at the centre. Splats nearer than `near`, fainter than FAINTEST or not finite leave none.
    """
    numbers = [F.col(c).cast("double") for c in ("x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "opacity")]
    rows = splats.where(F.coalesce(vec.finite(*numbers), F.lit(False)) & (F.col("opacity") >= FAINTEST)).join(usable(cameras), "batch_id")
    rows = rows.withColumns(dict(zip(("ex", "ey", "ez"), to_camera(F.col("x"), F.col("y"), F.col("z")), strict=True))).where(F.col("ez") > near)
    turn, m = vec.rotation(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")), F.col("pose")
    # Axes of the splat in the camera: the transposed rotation of the pose, times the splat's, times its deviations.
    axes = {f"m{r}{n}": (m[r] * turn[0][n] + m[4 + r] * turn[1][n] + m[8 + r] * turn[2][n]) * F.col(f"s{'xyz'[n]}") for r in range(3) for n in range(3)}
    rows = rows.withColumns(axes)
    z = F.col("ez")
    flat = {f"{name}{n}": F.col(f) / z * F.col(f"m{r}{n}") - F.col(f) * F.col(e) / (z * z) * F.col(f"m2{n}") for name, f, e, r in (("p", "fx", "ex", 0), ("q", "fy", "ey", 1)) for n in range(3)}
    rows = rows.withColumns(flat)
    dot = lambda x, y: F.col(f"{x}0") * F.col(f"{y}0") + F.col(f"{x}1") * F.col(f"{y}1") + F.col(f"{x}2") * F.col(f"{y}2")
    rows = rows.withColumns({"xx": dot("p", "p") + BLUR, "xy": dot("p", "q"), "yy": dot("q", "q") + BLUR})
    rows = rows.withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))  # 0.09 or more, by the blur
    u, v = F.col("fx") * F.col("ex") / z + F.col("cx"), F.col("fy") * F.col("ey") / z + F.col("cy")
    return rows.select(*FRAME, "sid", u.alias("u"), v.alias("v"), z.alias("depth"), (F.col("yy") / F.col("det")).alias("a"), (-F.col("xy") / F.col("det")).alias("b"), (F.col("xx") / F.col("det")).alias("c"), F.col("opacity").cast("double").alias("opacity"), "xx", "yy", "width", "height")


def pixel_alphas(prints: DataFrame, tile: int = 16) -> DataFrame:
    """batch_id, frame, ty, tx, row, col, sid, depth, alpha: every pixel at which a splat's opacity is FAINTEST or more.

    A footprint goes to the tiles it touches, one row for each, and that is what is exchanged; its pixels are made where
    the tile is. A pixel is sampled at its middle.
    """
    # alpha >= FAINTEST inside an ellipse, whose box this is.
    reach = 2 * F.log(F.col("opacity") / FAINTEST)
    box = lambda mid, spread, size: (F.greatest(F.lit(0), F.ceil(F.col(mid) - F.sqrt(reach * F.col(spread)) - 0.5)).cast("int"), F.least(F.col(size) - 1, F.floor(F.col(mid) + F.sqrt(reach * F.col(spread)) - 0.5)).cast("int"))
    (c0, c1), (r0, r1) = box("u", "xx", "width"), box("v", "yy", "height")
    rows = prints.select(*FRAME, "sid", "u", "v", "depth", "a", "b", "c", "opacity", c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1"))
    # Empty boxes end here, and not in a filter, which the optimizer would copy all the arithmetic into.
    steps = lambda lo, hi: F.when(F.col(lo) <= F.col(hi), F.sequence(F.floor(F.col(lo) / tile).cast("int"), F.floor(F.col(hi) / tile).cast("int")))
    rows = rows.withColumn("ty", F.explode(steps("r0", "r1"))).withColumn("tx", F.explode(steps("c0", "c1")))
    rows = rows.repartition(*FRAME, "ty", "tx")
    inside = lambda lo, hi, t: F.sequence(F.greatest(F.col(lo), F.col(t) * tile), F.least(F.col(hi), F.col(t) * tile + tile - 1))
    rows = rows.withColumn("row", F.explode(inside("r0", "r1", "ty"))).withColumn("col", F.explode(inside("c0", "c1", "tx")))
    dx, dy = F.col("col") + 0.5 - F.col("u"), F.col("row") + 0.5 - F.col("v")
    power = -0.5 * (F.col("a") * dx * dx + 2 * F.col("b") * dx * dy + F.col("c") * dy * dy)
    alpha = F.least(F.lit(DENSEST), F.col("opacity") * F.exp(power))
    return rows.select(*FRAME, "ty", "tx", "row", "col", "sid", "depth", alpha.alias("alpha")).where(F.col("alpha") >= FAINTEST)


def contributors(splats: DataFrame, cameras: DataFrame, tile: int = 16, cut: float = 1e-4, most: int | None = None) -> DataFrame:
    """batch_id, frame, row, col, place, sid, depth, alpha, weight: the splats that a pixel shows, from the front on.

    weight is the splat's opacity times what those before it let through. A splat counts while more than `cut` of the
    light passes it too; at equal depths the lesser id is in front. most: only the heaviest of each pixel. The pixels of a tile are blended where the
    tile's footprints are, without another exchange.
    """
    pixel = W.partitionBy(*FRAME, "ty", "tx", "row", "col").orderBy("depth", "sid")
    rows = pixel_alphas(footprints(splats, cameras), tile)
    passed = F.sum(F.log1p(-F.col("alpha"))).over(pixel.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"left": F.exp(passed), "place": F.row_number().over(pixel) - 1}).where(F.col("left") > cut)
    out = rows.withColumn("weight", F.col("alpha") * F.col("left") / (1 - F.col("alpha")))
    if most is not None:
        heavy = W.partitionBy(*FRAME, "ty", "tx", "row", "col").orderBy(F.desc("weight"), "place")
        out = out.withColumn("__nth", F.row_number().over(heavy)).where(F.col("__nth") <= most)
    return out.select(*FRAME, "row", "col", "place", "sid", "depth", "alpha", "weight")


def weighted_values(shown: DataFrame, splats: DataFrame, values: list[str]) -> DataFrame:
    """batch_id, frame, row, col, total weight and the blended values of a table of contributors: what the pixel shows, and how much of it is covered."""
    met = shown.join(splats.select("batch_id", "sid", *[F.col(v).cast("double").alias(f"__{v}") for v in values]), ["batch_id", "sid"])
    return met.groupBy(*FRAME, "row", "col").agg(F.sum("weight").alias("weight"), *[F.sum(F.col("weight") * F.col(f"__{v}")).alias(v) for v in values])
