"""Losses and evaluation metrics as aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vec import cosine, l2
from gridloom.operators.order import global_rank, running


def accuracy(pred: Column, truth: Column) -> Column:
    return F.avg((pred == truth).cast("double"))


def confusion(df: DataFrame, pred: str, truth: str, group: list[str]) -> DataFrame:
    """Per group: intersection, union, IoU (0 when empty) and accuracy of two boolean columns."""
    both, either = F.count_if(F.col(pred) & F.col(truth)), F.count_if(F.col(pred) | F.col(truth))
    out = df.groupBy(*group).agg(both.alias("inter"), either.alias("union"), F.count_if(F.col(pred) == F.col(truth)).alias("same"), F.count("*").alias("n"))
    return out.select(*group, "inter", "union", F.coalesce(F.try_divide("inter", "union"), F.lit(0.0)).alias("iou"), (F.col("same") / F.col("n")).alias("accuracy"))


def cross_entropy(df: DataFrame, logits: str, label: str, ignore: int | None = None) -> DataFrame:
    """Mean of log-sum-exp minus the label's logit over rows whose label is not ignored."""
    rows = df if ignore is None else df.where(F.col(label) != ignore)
    x = F.col(logits)
    top = F.array_max(x)
    lse = top + F.ln(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b))
    return rows.agg(F.avg(lse - F.get(x, F.col(label))).alias("cross_entropy"), F.count("*").alias("n"))


def lovasz(df: DataFrame, probs: str, label: str, tie: str, ignore: int | None = None) -> DataFrame:
    """Lovasz-softmax of each class present: errors in falling order against the steps of the Jaccard index.

    probs is an array; the mean over the classes is the loss. Sums along the order run in parts, so a class is no single task.
    """
    rows = df if ignore is None else df.where(F.col(label) != ignore)
    each = rows.select(tie, F.col(label).alias("truth"), F.posexplode(probs).alias("class", "p"))
    fg = (F.col("truth") == F.col("class")).cast("long")
    each = each.select(tie, "class", fg.alias("fg"), F.abs(fg - F.col("p")).alias("error"))
    totals = each.groupBy("class").agg(F.sum("fg").alias("total")).where("total > 0")
    run = running(each, ["class"], [F.desc("error"), F.col(tie)], hits=F.col("fg"), misses=1 - F.col("fg"))
    index = lambda hits, misses: 1 - (F.col("total") - hits) / (F.col("total") + misses)
    # The step of the Jaccard index is its value after this row less its value before it.
    step = index(F.col("hits"), F.col("misses")) - index(F.col("hits") - F.col("fg"), F.col("misses") - (1 - F.col("fg")))
    return run.join(F.broadcast(totals), "class").groupBy("class").agg(F.sum(F.col("error") * step).alias("loss"))  # a row for each class


def vector_losses(df: DataFrame, pred: str, truth: str, denominator: Column | None = None) -> DataFrame:
    """Cosine and L1 loss; divided by the rows, or by the number given (the sparse form)."""
    n = denominator if denominator is not None else F.count("*").cast("double")
    l1 = F.aggregate(F.zip_with(pred, truth, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(pred)
    return df.agg((F.sum(1 - cosine(F.col(pred), F.col(truth))) / n).alias("cosine_loss"), (F.sum(l1) / n).alias("l1_loss"))


def pairs(df: DataFrame, image: str = "image_id", pid: str = "pid", mask: str = "mask_id", *carried: str) -> DataFrame:
    """Upper-triangular pairs of the sampled pixels of each image, marked positive (same mask, no diagonal) or
    negative; unmasked pixels (-1) take no part. An image's sample is small by contract (256 pixels).
    """
    rows = df.where(F.col(mask) >= 0).select(image, pid, mask, *carried)
    a = rows.select(image, *[F.col(c).alias(f"a_{c}") for c in (pid, mask, *carried)])
    b = rows.select(image, *[F.col(c).alias(f"b_{c}") for c in (pid, mask, *carried)])
    met = a.join(b, image).where(F.col(f"a_{pid}") <= F.col(f"b_{pid}"))
    same = F.col(f"a_{mask}") == F.col(f"b_{mask}")
    return met.withColumn("positive", same & (F.col(f"a_{pid}") < F.col(f"b_{pid}"))).withColumn("negative", ~same)


def contrastive(df: DataFrame, feature: str, image: str = "image_id", pid: str = "pid", mask: str = "mask_id", margin: float = 1.0) -> DataFrame:
    """Distances of positives plus hinge of negatives, over the number of pairs with the diagonal."""
    met = pairs(df, image, pid, mask, feature)
    d = F.nanvl(l2(F.col(f"a_{feature}"), F.col(f"b_{feature}")), F.lit(0.0))
    return met.groupBy(image).agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("positive"), d).otherwise(0.0)).alias("pull"), F.sum(F.when(F.col("negative"), F.greatest(F.lit(margin) - d, F.lit(0.0))).otherwise(0.0)).alias("push"))


def deviations(a: DataFrame, b: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Mean absolute and relative difference of two runs, matched by position, to the shorter's end.

    The relative difference is 0 where either side is 0.
    """
    left = global_rank(a, [order], "at").select("at", *[F.col(f).alias(f"a_{f}") for f in fields])
    right = global_rank(b, [order], "at").select("at", *[F.col(f).alias(f"b_{f}") for f in fields])
    met = left.join(right, "at")
    out = []
    for f in fields:
        x, y = F.col(f"a_{f}"), F.col(f"b_{f}")
        off = F.abs(x - y)
        out += [F.avg(off).alias(f"{f}_absolute"), F.avg(F.when((x != 0) & (y != 0), off / F.greatest(F.abs(x), F.abs(y))).otherwise(0.0)).alias(f"{f}_relative")]
    return met.agg(F.count("*").alias("n"), *out)


def localization(scores: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per (frame, prompt), whether any pixel of the highest score lies in a box; all tied pixels count.

    scores: frame, prompt, row, col, score; boxes: frame, prompt, x0, y0, x1, y1.
    """
    top = scores.groupBy("frame", "prompt").agg(F.max("score").alias("score"))
    best = scores.join(top, ["frame", "prompt", "score"])
    inside = (F.col("col") >= F.col("x0")) & (F.col("col") <= F.col("x1")) & (F.col("row") >= F.col("y0")) & (F.col("row") <= F.col("y1"))
    hit = best.join(boxes, ["frame", "prompt"]).where(inside).select("frame", "prompt").distinct().withColumn("hit", F.lit(1))
    return top.join(hit, ["frame", "prompt"], "left").select("frame", "prompt", F.coalesce("hit", F.lit(0)).alias("hit"))


def summary(df: DataFrame, scene: str, value: str) -> DataFrame:
    """Mean of each scene, and overall (null scene) the unweighted mean of the scenes' means."""
    means = df.groupBy(scene).agg(F.avg(value).alias(value))
    return means.unionByName(means.agg(F.avg(value).alias(value)).withColumn(scene, F.lit(None).cast(dict(df.dtypes)[scene])))


def loss_image(pixels: DataFrame, loss: str, image: str = "image_id") -> DataFrame:
    """Summed loss of each pixel over the largest sum of its image."""
    sums = pixels.groupBy(image, "row", "col").agg(F.sum(loss).alias("sum"))
    tops = sums.groupBy(image).agg(F.max("sum").alias("top"))
    return sums.join(tops, image).select(image, "row", "col", F.coalesce(F.try_divide("sum", "top"), F.lit(0.0)).alias("loss"))


def instance_cosine(features: DataFrame, embeddings: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """1 - cosine of each instance's feature and the embedding of the same id."""
    met = features.join(embeddings.select(*key, F.col(vec).alias("__other")), key)
    return met.withColumn("distance", 1 - cosine(F.col(vec), F.col("__other"))).drop("__other")
