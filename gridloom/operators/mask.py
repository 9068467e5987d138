"""Masks as sparse rows (image_id, mask_id, row, col): overlap, suppression, morphology, maps."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import stage


def iou(inter: Column, union: Column, empty: float | None = 0.0) -> Column:
    """Overlap of counts; `empty` where the union is empty (None: null)."""
    value = F.try_divide(inter.cast("double"), union.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def overlap(pred: Column, truth: Column) -> tuple[Column, Column]:
    """Aggregates (intersection, union) of two boolean columns."""
    return F.count_if(pred & truth), F.count_if(pred | truth)


#: Masks, and words of their pixels, in a block at most (a mask of more words is a block by itself); masks of a block that meet the other block at a time.
BLOCK_MASKS, BLOCK_WORDS, SLICE_MASKS = 8192, 1 << 18, 128

#: Tasks that make or compare blocks at most: so many that each has about one block, or two blocks that meet, to some hundred thousand masks an image.
MOST_TASKS = 20_000


def met_masks(pixels: DataFrame, told: DataFrame, carried: list[str], reduce, schema: str) -> DataFrame:
    """What reduce(image, a, b, shared) yields for the masks of every image, block against block, as rows of `schema`.

    told: image_id, mask_id and the carried numbers, one row a mask. a and b are dicts of numpy columns (mask_id and the carried ones), shared the
    pixels that each mask of a shares with each of b; each two masks meet once, a the lesser id, and entries of others are 0. A block is words of
    8 by 8 pixels, and goes once to each block of its image, so pairs do not move; a task holds about two blocks and a slice of their pairs.
    """
    rows = pixels.select("image_id", "mask_id", "row", "col").dropna()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod("row", F.lit(8)) * 8 + F.pmod("col", F.lit(8))).cast("int"))
    kinds = dict(pixels.dtypes)
    tile = [F.shiftright(F.col(c).cast("long"), 3).cast("long" if kinds[c] == "bigint" else "int").alias(f"t{c}") for c in ("row", "col")]
    words = stage(rows.select("image_id", "mask_id", *tile, bit.alias("bit")).groupBy("image_id", "mask_id", "trow", "tcol").agg(F.bit_or("bit").alias("bits")), "mask-words")
    sizes = words.groupBy("image_id", "mask_id").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("image_id").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MASKS), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"))
    counts = stage(whole, "mask-blocks")
    total, pairs = counts.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in (F.col("blocks").cast("double"), F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)]).first()
    made = words.groupBy("image_id", "mask_id").agg(F.collect_list("trow").alias("trow"), F.collect_list("tcol").alias("tcol"), F.collect_list("bits").alias("bits"))
    made = made.join(told.select("image_id", "mask_id", *[F.col(c).cast("double").alias(c) for c in carried]), ["image_id", "mask_id"]).join(counts, "image_id")
    # A task makes about one block and writes it to a file of its own; parts are not joined to larger ones.
    made = made.withColumn("block", F.pmod(F.xxhash64("mask_id"), F.col("blocks")).cast("int")).repartition(int(max(1, min(total, MOST_TASKS))), "image_id", "block")
    lists = [F.collect_list(c).alias(c) for c in ("mask_id", *carried, "trow", "tcol", "bits")]
    blocks = stage(made.groupBy("image_id", "block", "blocks").agg(*lists).select("image_id", "block", "blocks", "mask_id", *carried, F.transform("bits", F.size).alias("sizes"), *[F.flatten(c).alias(c) for c in ("trow", "tcol", "bits")]), "mask-blocks")
    columns = ["mask_id", *carried, "sizes", "trow", "tcol", "bits"]
    n = int(max(1, min(pairs, MOST_TASKS)))

    def side(name: str, own: str, other: str, ends) -> DataFrame:
        return blocks.select("image_id", F.col("block").alias(own), F.explode(F.sequence(*ends)).alias(other), *[F.col(c).alias(f"{name}_{c}") for c in columns]).repartition(n, "image_id", "u", "v")

    left = side("a", "u", "v", (F.col("block"), F.col("blocks") - 1))
    right = side("b", "v", "u", (F.lit(0), F.col("block")))

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                at = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                sides = [{c: at[f"{x}_{c}"].values for c in columns} for x in "ab"]
                names, numbers, tiles, masks, bits = [], [], [], [], []
                for x in sides:
                    # In order of what is carried, so that rows of pairs hold runs of equal numbers and take less room.
                    own = np.array(x["mask_id"].to_pylist())
                    order = np.lexsort([own, *[x[c].to_numpy() for c in reversed(carried)]])
                    names.append(own[order])
                    numbers.append({"mask_id": names[-1], **{c: x[c].to_numpy()[order] for c in carried}})
                    tiles.append(np.stack([x["trow"].to_numpy(), x["tcol"].to_numpy()], 1))
                    masks.append(np.repeat(np.argsort(order), x["sizes"].to_numpy()))
                    bits.append(np.unpackbits(np.ascontiguousarray(x["bits"].to_numpy()).view(np.uint8), bitorder="little").reshape(-1, 64))
                known, which = np.unique(np.concatenate(tiles), axis=0, return_inverse=True)
                which = np.split(which.ravel(), [len(tiles[0])])
                orders = [np.argsort(w, kind="stable") for w in which]
                ends = [np.searchsorted(w[o], np.arange(len(known) + 1)) for w, o in zip(which, orders, strict=True)]
                both = np.flatnonzero((np.diff(ends[0]) > 0) & (np.diff(ends[1]) > 0))
                for low in range(0, len(names[0]), SLICE_MASKS):
                    high = min(low + SLICE_MASKS, len(names[0]))
                    shared = np.zeros((high - low, len(names[1])))
                    for t in both:
                        mine, other = (o[e[t] : e[t + 1]] for o, e in zip(orders, ends, strict=True))
                        mine = mine[(masks[0][mine] >= low) & (masks[0][mine] < high)]
                        if len(mine):
                            shared[np.ix_(masks[0][mine] - low, masks[1][other])] += bits[0][mine].astype(np.float32) @ bits[1][other].astype(np.float32).T
                    part = {c: v[low:high] for c, v in numbers[0].items()}
                    lesser = part["mask_id"][:, None] < names[1][None]
                    yield from reduce(at["image_id"], part, numbers[1], np.where(lesser, shared, 0))
                    if at["u"].as_py() != at["v"].as_py():
                        yield from reduce(at["image_id"], numbers[1], part, np.where(lesser, 0, shared).T)

    met = left.join(right.hint("merge"), ["image_id", "u", "v"])
    return met.mapInArrow(run, schema)


def mask_areas(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "mask_id", "row", "col").distinct().groupBy("image_id", "mask_id").agg(F.count("*").alias("area"))


def pair_overlaps(pixels: DataFrame) -> DataFrame:
    """Pixels shared by each pair of masks of an image, and both areas; block against block, see met_masks.

    Pairs that share no pixel have no row; a pixel is of one mask as often as it is repeated.
    """
    kinds = dict(pixels.dtypes)

    def reduce(image, a, b, shared):
        at, of = np.nonzero(shared)
        for low in range(0, len(at), 1 << 16):
            x, y = at[low : low + (1 << 16)], of[low : low + (1 << 16)]
            whole = [image_of(image, len(x)), *[pa.array(v) for v in (a["mask_id"][x], b["mask_id"][y], shared[x, y].astype(np.int64), a["area"][x].astype(np.int64), b["area"][y].astype(np.int64))]]
            yield pa.RecordBatch.from_arrays(whole, ["image_id", "a", "b", "shared", "area_a", "area_b"])

    met = met_masks(pixels, mask_areas(pixels), ["area"], reduce, f"image_id {kinds['image_id']}, a {kinds['mask_id']}, b {kinds['mask_id']}, shared long, area_a long, area_b long")
    return met.withColumn("iou", iou(F.col("shared"), F.col("area_a") + F.col("area_b") - F.col("shared")))


def image_of(image: pa.Scalar, n: int) -> pa.Array:
    return pa.repeat(image, n)


def suppress(pixels: DataFrame, scores: DataFrame, iou_most: float = 0.7, score_least: float = 0.1, inner: float = 0.2, keep_least: int = 3) -> DataFrame:
    """Mask suppression by rank of score, without greed: suppressed masks still suppress.

    A mask stays if its IoU with no better mask exceeds iou_most, its score is above score_least, and it
    does not lie inside a better mask, nor inside a worse one, by a measure above 1 - inner. A mask lies in
    another that it shares at least 0.85 of its own and less than half of the other's area with; the measure
    is 1 minus the product of both shares. The second test also counts a better mask that is next in
    rank. Where the score or one of these tests would keep no mask of an image, its keep_least best
    pass it. scores: image_id, mask_id, score.
    """
    by_score = W.partitionBy("image_id").orderBy(F.desc("score"), "mask_id")
    ranks = scores.withColumn("rank", F.row_number().over(by_score))
    kinds = dict(pixels.dtypes)

    def reduce(image, a, b, shared):
        """What the pairs of two blocks say of their masks, one row for each of these that has a pair."""
        with np.errstate(divide="ignore", invalid="ignore"):
            of_a, of_b = shared / a["area"][:, None], shared / b["area"][None]
            over = shared / (a["area"][:, None] + b["area"][None] - shared)
        first, measure = a["rank"][:, None] < b["rank"][None], 1 - of_a * of_b
        near = np.abs(a["rank"][:, None] - b["rank"][None]) == 1
        b_in, a_in = np.where((of_a < 0.5) & (of_b >= 0.85), measure, 0.0), np.where((of_b < 0.5) & (of_a >= 0.85), measure, 0.0)
        for own, axis, worse, inner in ((a, 1, ~first, a_in), (b, 0, first, b_in)):
            known = shared.any(axis)
            out = [np.where(worse, v, 0.0).max(axis, initial=0.0) for v in (over, inner)]
            out.append(np.where(worse & ~near, 0.0, inner).max(axis, initial=0.0))
            yield pa.RecordBatch.from_arrays([image_of(image, int(known.sum())), pa.array(own["mask_id"][known]), *[pa.array(v[known]) for v in out]], ["image_id", "mask_id", "iou_better", "in_better", "in_worse"])

    told = mask_areas(pixels).join(ranks.select("image_id", "mask_id", "rank"), ["image_id", "mask_id"])
    met = met_masks(pixels, told, ["area", "rank"], reduce, f"image_id {kinds['image_id']}, mask_id {kinds['mask_id']}, iou_better double, in_better double, in_worse double")
    worst = met.groupBy("image_id", "mask_id").agg(*[F.max(c).alias(c) for c in ("iou_better", "in_better", "in_worse")])
    rows = ranks.join(worst, ["image_id", "mask_id"], "left").fillna(0.0, ["iou_better", "in_better", "in_worse"])
    image, kept = W.partitionBy("image_id"), F.col("iou_better") <= iou_most
    for name, ok in (("__score", F.col("score") > score_least), ("__in_better", F.col("in_better") <= 1 - inner), ("__in_worse", F.col("in_worse") <= 1 - inner)):
        rows = rows.withColumn(name, ok)
        kept = kept & F.when(F.bool_or(name).over(image), F.col(name)).otherwise(F.col("rank") <= keep_least)
    return rows.withColumn("kept", kept).select("image_id", "mask_id", "score", "rank", "iou_better", "in_better", "in_worse", "kept")


def greedy_boxes(boxes: DataFrame, iou_most: float = 0.7, tile: int = 64) -> DataFrame:
    """Greedy suppression of boxes (image_id, box_id, x0, y0, x1, y1, score), image by image, in rounds of joins; see crops.greedy."""
    from gridloom.operators.crops import greedy

    rows = stage(boxes.select(F.col("image_id").alias("group"), "box_id", "x0", "y0", "x1", "y1", "score"), "boxes")
    kept = greedy(rows, iou_most, tile)
    return rows.join(kept, ["group", "box_id"], "left_semi").select(F.col("group").alias("image_id"), "box_id", "score")


def _thinning() -> list[list[bool]]:
    """For both phases, whether a pixel goes, by its eight neighbours (bit n: the n-th from the top on, clockwise) as a number."""
    out = []
    for phase in (0, 1):
        row = []
        for code in range(256):
            p = [code >> n & 1 for n in range(8)]  # top, top right, right, bottom right, bottom, bottom left, left, top left
            turns = sum(not p[n] and p[(n + 1) % 8] for n in range(8))
            top, right, bottom, left = p[0], p[2], p[4], p[6]
            ends = (top and right and bottom, right and bottom and left) if phase == 0 else (top and right and left, top and bottom and left)
            row.append(bool(2 <= sum(p) <= 6 and turns == 1 and not any(ends)))
        out.append(row)
    return out


def skeleton(pixels: DataFrame) -> DataFrame:
    """Pixels of each mask thinned to lines of one pixel: two phases in turn until neither changes anything. Repeated pixels count once.

    A pixel goes if it has two to six neighbours in one run, and, by phase, none to the lower right or the upper left
    whose loss would break a line. Each phase is one aggregation of what pixels send to their neighbours.
    """
    from gridloom.session import discard

    key = ["image_id", "mask_id", "row", "col"]
    steps = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    around = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(256).alias("bit")), *[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(1 << n).alias("bit")) for n, (a, b) in enumerate(steps)])).alias("d")
    now, still, phase = stage(pixels.select(*key).distinct(), "skeleton"), 0, 0
    tables = [F.array(*map(F.lit, t)) for t in _thinning()]
    while still < 2:
        sent = now.select(*key, around).select("image_id", "mask_id", (F.col("row") + F.col("d.a")).alias("row"), (F.col("col") + F.col("d.b")).alias("col"), F.col("d.bit").alias("bit"))
        seen = sent.groupBy(*key).agg(F.sum("bit").alias("code")).where("code >= 256")
        marked = stage(seen.select(*key, F.get(tables[phase], (F.col("code") - 256).cast("int")).alias("goes")), "skeleton")
        changed = marked.where("goes").limit(1).count()
        discard(now)
        now = marked.where("not goes").drop("goes") if not changed else stage(marked.where("not goes").drop("goes"), "skeleton")
        still, phase = (0 if changed else still + 1), 1 - phase
    return now


def area_filter(masks: DataFrame, image_area: int, most: float = 0.95) -> DataFrame:
    return masks.where((F.col("area") > 0) & (F.col("area") <= F.lit(most * image_area)))


def erode(pixels: DataFrame, least: int = 5) -> DataFrame:
    """Pixels of the image that have at least `least` of the 3 x 3 around them set (outside counts as unset); repeated pixels count once.

    Runs of 32 pixels of a row are bits of a word, with a bit for the pixel before and one for that after: a word, not a pixel, goes to the rows above and below.
    """
    place, run = F.pmod(F.col("col").cast("long"), F.lit(32)), F.shiftright(F.col("col").cast("long"), 5)
    one = F.lit(1).cast("long")
    part = lambda at, bit: F.struct(at.alias("run"), F.call_function("shiftleft", one, bit.cast("int")).alias("bit"))
    ends = F.when(place == 0, F.array(part(run, place + 1), part(run - 1, F.lit(33)))).when(place == 31, F.array(part(run, place + 1), part(run + 1, F.lit(0)))).otherwise(F.array(part(run, place + 1)))
    key = ["image_id", "mask_id", "row", "run"]
    words = pixels.select("image_id", "mask_id", "row", F.inline(ends)).groupBy(*key).agg(F.bit_or("bit").alias("bits"))
    sent = words.select("image_id", "mask_id", "row", "run", "bits", F.explode(F.array(*[F.lit(n) for n in (-1, 0, 1)])).alias("d")).select("image_id", "mask_id", (F.col("row") + F.col("d")).alias("row"), "run", "d", "bits")
    rows = sent.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("d") == n, F.col("bits"))), F.lit(0).cast("long")).alias(f"r{n + 1}") for n in (-1, 0, 1)])
    around = lambda n: sum((F.bit_count(F.expr(f"shiftright(r{r}, {n - 1}) & 7")) for r in range(1, 3)), F.bit_count(F.expr(f"shiftright(r0, {n - 1}) & 7")))
    kept = F.array_compact(F.array(*[F.when(around(n) >= least, F.lit(n - 1)) for n in range(1, 33)]))
    kind = dict(pixels.dtypes)["col"]
    return rows.select("image_id", "mask_id", "row", "run", F.explode(kept).alias("n")).select("image_id", "mask_id", "row", (F.col("run") * 32 + F.col("n")).cast(kind).alias("col"))


def components(pixels: DataFrame) -> DataFrame:
    """8-connected components: each pixel with the least (row, col) code it reaches. Staged label rounds."""
    code = F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")
    labels = stage(pixels.select("image_id", "mask_id", "row", "col", code.alias("label")).distinct(), "pixel-labels")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")
    key = ["image_id", "mask_id", "row", "col"]
    while True:
        sent = labels.select("image_id", "mask_id", "row", "col", "label", around)
        sent = sent.select("image_id", "mask_id", (F.col("row") + F.col("d.a")).alias("row"), (F.col("col") + F.col("d.b")).alias("col"), "label")
        low = sent.groupBy(*key).agg(F.min("label").alias("low"))
        lower = stage(labels.join(low, key).select(*key, F.least("label", "low").alias("label"), F.col("label").alias("old")), "pixel-lower")
        jump = lower.select("image_id", "mask_id", code.alias("label"), F.col("label").alias("further"))
        new = stage(lower.join(jump, ["image_id", "mask_id", "label"]).select(*key, F.col("further").alias("label"), "old"), "pixel-labels")
        if not new.where("label <> old").limit(1).count():
            return new.drop("old")
        labels = new.drop("old")


def drop_islands(pixels: DataFrame, least_area: int) -> DataFrame:
    """Pixels whose component has at least least_area pixels."""
    labelled = components(pixels)
    big = labelled.groupBy("image_id", "mask_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least_area)
    return labelled.join(big, ["image_id", "mask_id", "label"], "left_semi").drop("label")


def segmentation_map(pixels: DataFrame, order: str = "mask_order") -> DataFrame:
    """One id for each pixel and scale: the later mask wins; ids of later scales follow on those of earlier ones."""
    counts = pixels.groupBy("image_id", "scale").agg(F.max(order).alias("top"))
    before = F.sum(F.col("top") + 1).over(W.partitionBy("image_id").orderBy("scale").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("image_id", "scale", F.coalesce(before, F.lit(0)).alias("offset"))
    won = pixels.groupBy("image_id", "scale", "row", "col").agg(F.max(order).alias("id"))
    return won.join(offsets, ["image_id", "scale"]).select("image_id", "scale", "row", "col", (F.col("id") + F.col("offset")).alias("id"))


def pixel_stacks(pixels: DataFrame, rank: str = "mask_id") -> DataFrame:
    """The masks over each pixel in order of rank, and how many."""
    stacks = pixels.groupBy("image_id", "row", "col").agg(F.sort_array(F.collect_list(rank)).alias("mask_ids"))
    return stacks.withColumn("depth", F.size("mask_ids"))


def pad_stacks(stacks: DataFrame) -> DataFrame:
    """Stacks padded with -1 to the deepest of their image."""
    deepest = stacks.groupBy("image_id").agg(F.max("depth").alias("deepest"))
    rows = stacks.join(deepest, "image_id")
    return rows.withColumn("mask_ids", F.concat("mask_ids", F.array_repeat(F.lit(-1).cast("bigint"), (F.col("deepest") - F.col("depth")).cast("int"))))


def probability_cdf(pixels: DataFrame) -> DataFrame:
    """Per pixel, the running share of log probability over its masks in order of id.

    A mask's probability is its share of all covered mask pixels of the image.
    """
    counts = pixels.groupBy("image_id", "mask_id").agg(F.count("*").alias("n"))
    shares = counts.join(counts.groupBy("image_id").agg(F.sum("n").alias("all")), "image_id").withColumn("lp", F.coalesce(F.ln(F.try_divide(F.col("n").cast("double"), F.col("all").cast("double"))), F.lit(0.0)))
    rows = pixels.join(shares.select("image_id", "mask_id", "lp"), ["image_id", "mask_id"])
    w = W.partitionBy("image_id", "row", "col")
    run = F.sum("lp").over(w.orderBy("mask_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("image_id", "row", "col", "mask_id", F.coalesce(F.try_divide(run, F.sum("lp").over(w)), F.lit(1.0)).alias("cdf"))


def pick_by_cdf(cdf: Column, ids: Column, u: Column) -> Column:
    """The id whose place is the number of cdf values below u, kept within the list."""
    at = F.size(F.filter(cdf, lambda c: u > c))
    return F.get(ids, F.least(at, F.size(ids) - 1))


def pick_scale(cdf: Column, scales: Column, u: Column, v: Column) -> Column:
    """Scale for the mask that pick_by_cdf takes: between that of the mask before it (0 for the first) and its own, at v."""
    at = F.least(F.size(F.filter(cdf, lambda c: u > c)), F.size(scales) - 1)
    own, before = F.get(scales, at), F.when(at > 0, F.get(scales, at - 1)).otherwise(0.0)
    return before + (own - before) * v


def box_mean(pixels: DataFrame, value: str, half: int, group: list[str]) -> DataFrame:
    """Mean over the (2 half + 1)^2 box around each pixel, of the pixels that exist.

    Two passes of sums and counts, along rows and then along columns: each pixel is sent to
    2 half + 1 places instead of the square of that, and a missing pixel passes nothing on.
    """
    step = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("__d")
    sent = pixels.select(*group, "row", "col", F.col(value).alias("__v"), step).select(*group, "row", (F.col("col") + F.col("__d")).alias("col"), "__v")
    flat = sent.groupBy(*group, "row", "col").agg(F.sum("__v").alias("__v"), F.count("*").alias("__n"))
    sent = flat.select("*", step).select(*group, (F.col("row") + F.col("__d")).alias("row"), "col", "__v", "__n")
    sums = sent.groupBy(*group, "row", "col").agg((F.sum("__v") / F.sum("__n")).alias("box"))
    return pixels.join(sums, [*group, "row", "col"])


def relevancy_mask(pixels: DataFrame, value: str, group: list[str], threshold: float = 0.4, half: int = 14) -> DataFrame:
    """Blend with the box mean, stretch to [0, 1], keep the upper half stretched, and threshold."""
    blended = box_mean(pixels, value, half, group).withColumn("blend", 0.5 * (F.col("box") + F.col(value)))
    w = W.partitionBy(*group)
    low, high = F.min("blend").over(w), F.max("blend").over(w)
    out = blended.withColumn("unit", (F.col("blend") - low) / (high - low + F.lit(1e-9)))
    clipped = F.least(F.greatest(F.col("unit") * 2 - 1, F.lit(0.0)), F.lit(1.0))
    return out.withColumn("mask", clipped > threshold).drop("box")


def majority(pixels: DataFrame, mask: str, half: int, group: list[str]) -> DataFrame:
    """Majority of the box around each pixel."""
    return box_mean(pixels.withColumn("__v", F.col(mask).cast("double")), "__v", half, group).withColumn(mask, F.col("box") > 0.5).drop("__v", "box")


def polygon_mask(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside a polygon of (x, y) corners, even-odd rule."""
    rows, cols = np.mgrid[0:height, 0:width]
    inside = np.zeros((height, width), bool)
    for (xa, ya), (xb, yb) in zip(points, np.roll(points, -1, axis=0), strict=True):
        if ya != yb:
            hit = (rows >= min(ya, yb)) & (rows < max(ya, yb))
            inside ^= hit & (cols < xa + (rows - ya) * (xb - xa) / (yb - ya))
    return inside


def rasterize(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels inside each polygon (poly_id, xs, ys), even-odd rule, pixel centres; numpy, one polygon at a time."""

    def run(batches):
        for batch in batches:
            for poly_id, xs, ys in zip(batch["poly_id"], batch["xs"], batch["ys"], strict=True):
                r, c = np.nonzero(polygon_mask(np.column_stack([xs, ys]), height, width))
                yield pd.DataFrame({"poly_id": poly_id, "row": r.astype(np.int32), "col": c.astype(np.int32)})

    return polygons.mapInPandas(run, "poly_id long, row int, col int")


def resize_nearest(pixels: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of dense images: each target pixel reads floor(target * old / new)."""
    (h, w), (nh, nw) = size, to
    rows = pixels.sparkSession.range(nh * nw).select(F.floor(F.col("id") / nw).cast("int").alias("row"), (F.col("id") % nw).cast("int").alias("col"))
    at = rows.select("row", "col", F.floor(F.col("row") * h / nh).cast("int").alias("r"), F.floor(F.col("col") * w / nw).cast("int").alias("c"))
    source = pixels.select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), value)
    return source.join(at, ["r", "c"]).select("image_id", "row", "col", value)


def resize_bilinear(pixels: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Bilinear resize (pixel centres aligned): each target reads its four neighbours by a join and adds them by weight."""
    (h, w), (nh, nw) = size, to
    rows = pixels.sparkSession.range(nh * nw).select(F.floor(F.col("id") / nw).cast("int").alias("row"), (F.col("id") % nw).cast("int").alias("col"))
    y = F.greatest((F.col("row") + 0.5) * (h / nh) - 0.5, F.lit(0.0))
    x = F.greatest((F.col("col") + 0.5) * (w / nw) - 0.5, F.lit(0.0))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = rows.select("row", "col", y.alias("y"), x.alias("x"), near.alias("d"))
    side = lambda c, d: F.when(d == 1, F.col(c) - F.floor(c)).otherwise(1 - (F.col(c) - F.floor(c)))
    at = at.select("row", "col", F.least(F.floor("y") + F.col("d.a"), F.lit(h - 1)).cast("int").alias("r"), F.least(F.floor("x") + F.col("d.b"), F.lit(w - 1)).cast("int").alias("c"), (side("y", F.col("d.a")) * side("x", F.col("d.b"))).alias("w"))
    source = pixels.select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), value)
    return source.join(at, ["r", "c"]).groupBy("image_id", "row", "col").agg(F.sum(F.col(value) * F.col("w")).alias(value))
