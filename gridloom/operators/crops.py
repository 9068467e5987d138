"""Masks proposed on overlapping crops, put together for the whole image; greedy suppression of boxes by rounds of joins."""

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, stage


def crop_boxes(images: DataFrame, layers: int = 1, overlap: float = 512 / 1500) -> DataFrame:
    """image_id, crop, layer, x0, y0, x1, y1: the image itself (crop 0, layer 0), then in layer n a grid of 2^n by 2^n crops. images: image_id, width, height.

    Neighbours of layer n overlap by `overlap` of the shorter side, halved for each layer after the first. Crops are numbered by layer, column and row; ends are exclusive.
    """
    parts = [F.array(F.struct(F.lit(0).alias("crop"), F.lit(0).alias("layer"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1")))]
    first = 1
    for layer in range(1, layers + 1):
        side = 2**layer
        shared = F.floor(F.least("width", "height") * F.lit(overlap) * F.lit(2 / side))
        size = lambda whole: F.ceil((shared * (side - 1) + F.col(whole)) / side)  # noqa: E731, B023
        grid = []
        for x in range(side):
            for y in range(side):
                at = lambda n, whole: ((size(whole) - shared) * n).cast("int")  # noqa: E731, B023
                ends = [F.least(at(n, whole) + size(whole).cast("int"), F.col(whole).cast("int")) for n, whole in ((x, "width"), (y, "height"))]
                grid.append(F.struct(F.lit(first + x * side + y).alias("crop"), F.lit(layer).alias("layer"), at(x, "width").alias("x0"), at(y, "height").alias("y0"), ends[0].alias("x1"), ends[1].alias("y1")))
        parts.append(F.array(*grid))
        first += side * side
    return images.select("image_id", F.explode(F.concat(*parts)).alias("c")).select("image_id", "c.*")


def moved(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """Pixels (image_id, crop, mask_id, row, col) of crops in the image's coordinates; a crop that is not in the grid has none."""
    place = crops.select("image_id", "crop", "x0", "y0")
    at = pixels.join(place, ["image_id", "crop"])
    return at.select("image_id", "crop", "mask_id", (F.col("row") + F.col("y0")).alias("row"), (F.col("col") + F.col("x0")).alias("col"))


def away_from_inner_edges(boxes: DataFrame, crops: DataFrame, near: float) -> DataFrame:
    """Boxes (x0, y0, x1, y1 in the image) without those that come within `near` of an edge of their crop that is no edge of the image: another crop sees them whole."""
    whole = crops.where("layer = 0").select("image_id", F.col("x1").alias("width"), F.col("y1").alias("height"))
    edges = crops.select("image_id", "crop", *[F.col(c).alias(f"crop_{c}") for c in ("x0", "y0", "x1", "y1")]).join(whole, "image_id")
    cut: Column = F.lit(False)
    for side, border in (("x0", F.lit(0)), ("y0", F.lit(0)), ("x1", F.col("width")), ("y1", F.col("height"))):
        close = lambda a, b: F.abs(a - b) <= near
        cut = cut | (close(F.col(side), F.col(f"crop_{side}")) & ~close(F.col(side), border))
    return boxes.join(edges, ["image_id", "crop"]).where(~cut).select(*boxes.columns)


def overlapping(boxes: DataFrame, iou_more: float, tile: int = 64) -> DataFrame:
    """group, better, worse: pairs of boxes of a group whose intersection over union is above iou_more, the one of higher score (of equal ones the lesser id) first.

    boxes: group, box_id, x0, y0, x1, y1, score. A box goes to the tiles it touches; a pair is found in the tile that holds its intersection's first corner.
    """
    tiles = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.greatest(lo, hi) / tile))
    sent = boxes.withColumn("tx", F.explode(tiles("x0", "x1"))).withColumn("ty", F.explode(tiles("y0", "y1")))
    rank = F.struct((-F.col("score")).alias("s"), F.col("box_id").alias("i"))
    sides = [sent.select("group", "tx", "ty", rank.alias(f"{n}_rank"), F.col("box_id").alias(f"{n}_id"), *[F.col(c).cast("double").alias(f"{n}_{c}") for c in ("x0", "y0", "x1", "y1")]) for n in "ab"]
    met = sides[0].join(sides[1], ["group", "tx", "ty"]).where("a_rank < b_rank")
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    met = met.where((F.floor(left / tile) == F.col("tx")) & (F.floor(top / tile) == F.col("ty")))
    return met.where(_alike(iou_more)).select("group", F.col("a_id").alias("better"), F.col("b_id").alias("worse"))


def _alike(iou_more: float) -> Column:
    """Whether boxes a_x0 .. a_y1 and b_x0 .. b_y1 have an intersection over union above iou_more."""
    both = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0.0)) * F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0.0))
    area = lambda n: (F.col(f"{n}_x1") - F.col(f"{n}_x0")) * (F.col(f"{n}_y1") - F.col(f"{n}_y0"))
    union = area("a") + area("b") - both
    return (union > 0) & (both / union > iou_more)


def unequal(boxes: DataFrame, iou_most: float) -> DataFrame:
    """boxes without those that equal a better one of their group: these overlap whole, so that greedy suppression drops them whatever else it keeps.

    The better one is kept, or goes by a kept box that both overlap. Boxes without area overlap none.
    """
    if iou_most >= 1:
        return boxes
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("box_id").alias("i"), F.struct(*boxes.columns).alias("row")))
    return boxes.where(solid).groupBy("group", "x0", "y0", "x1", "y1").agg(best.alias("b")).select("b.row.*").unionByName(boxes.where(~F.coalesce(solid, F.lit(False))))


def settled(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """group, box_id of the boxes that greedy suppression keeps: those that no kept better one overlaps.

    In a round, boxes without an undecided better one are kept, and what they overlap is dropped; rounds are as many as the longest chain of
    overlaps, and none needs a group in one task.
    """
    pairs = stage(pairs, "box-pairs")
    open_ = stage(boxes.select("group", "box_id"), "box-open")
    kept: list[DataFrame] = []
    while open_.limit(1).count():
        live = pairs.join(open_.select("group", F.col("box_id").alias("better")), ["group", "better"], "left_semi").join(open_.select("group", F.col("box_id").alias("worse")), ["group", "worse"], "left_semi")
        live = stage(live, "box-live")
        now = stage(open_.join(live.select("group", F.col("worse").alias("box_id")), ["group", "box_id"], "left_anti"), "box-kept")
        dropped = live.join(now.select("group", F.col("box_id").alias("better")), ["group", "better"], "left_semi").select("group", F.col("worse").alias("box_id"))
        rest = stage(open_.join(now, ["group", "box_id"], "left_anti").join(dropped, ["group", "box_id"], "left_anti"), "box-open")
        discard(open_, pairs)
        open_, pairs = rest, live
        kept.append(now)
    out = boxes.select("group", "box_id").limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out


BUCKET = ["__lw", "__lh", "__bx", "__by"]

#: Open boxes that are settled by their pairs, which are then few.
FEW = 2_000


def _bucketed(boxes: DataFrame, t: float) -> DataFrame:
    """Solid boxes with their bucket: the power of 1/t that their width and height come to, and the place of their first corner in cells of that size."""
    step = log(1 / t) * (1 + 1e-6)
    level = lambda lo, hi: F.floor(F.log(F.col(hi) - F.col(lo)) / step)
    cell = lambda lo, of: F.floor(F.col(lo) / ((1 - t) * F.exp((F.col(of) + 1) * step)))
    return boxes.withColumns({"__lw": level("x0", "x1"), "__lh": level("y0", "y1")}).withColumns({"__bx": cell("x0", "__lw"), "__by": cell("y0", "__lh")})


def _around(boxes: DataFrame, t: float) -> DataFrame:
    """Bucketed boxes sent to all buckets whose boxes may have an intersection over union above t with them: widths differ by less than a factor of 1/t, first corners by at most 1 - t of the larger width."""
    step, more = log(1 / t) * (1 + 1e-6), 1 + 1e-6

    def along(lo: str, hi: str, level: str) -> Column:
        found = []
        for d in (-1, 0, 1):
            n = F.col(level) + d
            most, size = F.exp((n + 1) * step), F.col(hi) - F.col(lo)
            reach = (1 - t) * more * F.greatest(size, F.least(size / t * more, most))
            ends = [F.floor((F.col(lo) + way * reach) / ((1 - t) * most)) for way in (-1, 1)]
            found.append(F.transform(F.sequence(*ends), lambda b: F.struct(n.alias("n"), b.alias("b"))))  # noqa: B023
        return F.concat(*found)

    sent = boxes.withColumn("__x", F.explode(along("x0", "x1", "__lw"))).withColumn("__y", F.explode(along("y0", "y1", "__lh")))
    return sent.select(*[c for c in boxes.columns if c not in BUCKET], F.col("__x.n").alias("__lw"), F.col("__y.n").alias("__lh"), F.col("__x.b").alias("__bx"), F.col("__y.b").alias("__by"))


def greedy(boxes: DataFrame, iou_most: float, tile: int = 64) -> DataFrame:
    """group, box_id of the boxes that greedy suppression keeps, without the pairs of those that go.

    boxes: group, box_id, x0, y0, x1, y1, score. In a round the best open box of each bucket is kept if it is better than the best of all
    buckets whose boxes may be too much like it, and open boxes too much like a kept one go. Boxes that are kept are unlike each other, so that
    a box meets few of them, however many are alike.
    """
    if not 0 < iou_most < 1:
        rows = stage(boxes, "boxes")
        return settled(rows, overlapping(rows, iou_most, tile))
    solid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    corners = ["x0", "y0", "x1", "y1"]
    rows = stage(boxes.select("group", "box_id", *[F.col(c).cast("double").alias(c) for c in corners], "score"), "boxes")
    kept = [rows.where(~solid).select("group", "box_id")]
    rank = F.struct((-F.col("score")).alias("s"), F.col("box_id").alias("i"))
    open_ = stage(_bucketed(unequal(rows.where(solid), iou_most), iou_most).select("group", "box_id", *corners, rank.alias("rank"), *BUCKET), "box-open")
    key = ["group", *BUCKET]
    # A table that is sent to many buckets must not be broadcast for the size of its file.
    sent = lambda df: _around(df, iou_most).select(*[F.col(c).alias(f"b_{c}") for c in (*key, *corners, "rank")]).hint("merge")
    same = F.col("group").eqNullSafe(F.col("b_group"))
    for c in BUCKET:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    while open_.count() > FEW:
        leaders = stage(open_.groupBy(*key).agg(F.min(F.struct("rank", *corners)).alias("m")).select(*key, "m.*"), "box-leaders")
        now = stage(leaders.join(sent(leaders), same & (F.col("b_rank") < F.col("rank")), "left_anti"), "box-kept")
        named = open_.select("group", "box_id", "rank", *BUCKET, *[F.col(c).alias(f"a_{c}") for c in corners])
        left = named.join(sent(now), same & _alike(iou_most), "left_anti")
        rest = stage(left.select("group", "box_id", "rank", *BUCKET, *[F.col(f"a_{c}").alias(c) for c in corners]), "box-open")
        discard(open_, leaders)
        open_ = rest
        kept.append(now.select("group", F.col("rank.i").alias("box_id")))
    rest = open_.withColumn("score", -F.col("rank.s"))
    kept.append(settled(rest, overlapping(rest, iou_most, tile)))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def assemble(pixels: DataFrame, scores: DataFrame, images: DataFrame, layers: int = 1, overlap: float = 512 / 1500, near: float = 20.0, iou_most: float = 0.7) -> DataFrame:
    """image_id, crop, mask_id, x0, y0, x1, y1, area, score of the masks that stay when all crops' proposals are put together.

    pixels: image_id, crop, mask_id, row, col in the crop; scores: image_id, crop, mask_id, score. Masks that come `near` an inner edge of their crop go; then boxes are
    suppressed within each crop by score, and over crops, where those of smaller crops go first (of one size the larger score). Ids are unique in a crop.
    """
    crops = stage(crop_boxes(images, layers, overlap), "crops")
    key = ["image_id", "crop", "mask_id"]
    boxes = moved(pixels, crops).groupBy(*key).agg(F.min("col").alias("x0"), F.min("row").alias("y0"), F.max("col").alias("x1"), F.max("row").alias("y1"), F.count("*").alias("area")).join(scores, key)
    boxes = stage(away_from_inner_edges(boxes, crops, near), "crop-masks")

    def suppressed(rows: DataFrame, group: list[str], order: Column) -> DataFrame:
        named = stage(rows.select(*rows.columns, F.struct(*group).alias("group"), F.struct("crop", "mask_id").alias("box_id"), order.alias("__order")), "crop-ranked")
        left = greedy(named.drop("score").withColumnRenamed("__order", "score"), iou_most)
        return named.join(left, ["group", "box_id"], "left_semi").select(*rows.columns)

    within = suppressed(boxes, ["image_id", "crop"], F.col("score").cast("double"))
    size = crops.select("image_id", "crop", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("crop_area"))
    return suppressed(stage(within, "crop-within").join(size, ["image_id", "crop"]), ["image_id"], 1 / F.col("crop_area") + F.lit(0.0)).drop("crop_area")
