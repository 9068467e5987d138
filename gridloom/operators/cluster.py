"""Clusters: density clustering, coherence, filters, scale search."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.spatial import nearest, radius_join
from gridloom.session import stage


def label_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label: the least id that links (a, b) reach. Min-label rounds with pointer jumping over staged tables."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(nodes.select(F.col("id"), F.col("id").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old")), "labels")
        jump = lower.select(F.col("id").alias("at"), F.col("label").alias("further"))
        new = stage(lower.join(jump, lower["label"] == jump["at"]).select("id", F.col("further").alias("label"), "old"), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.drop("old")
        labels = new.drop("old")


def dbscan(points: DataFrame, eps: float, min_points: int, pid: str = "pid") -> DataFrame:
    """id, label: the least core id of the cluster, -1 for noise. A border point joins its least core neighbour's cluster."""
    near = stage(radius_join(points, points, eps, pid).select("a_id", "b_id"), "eps-pairs")
    core = stage(near.groupBy("a_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("a_id").alias("id")), "cores")
    links = near.join(core.withColumnRenamed("id", "a_id"), "a_id").join(core.withColumnRenamed("id", "b_id"), "b_id").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    labels = label_components(links, core)
    reach = near.join(labels, near["b_id"] == labels["id"]).groupBy("a_id").agg(F.min_by("label", F.struct(F.col("a_id") != F.col("b_id"), F.col("b_id"))).alias("label"))
    return points.select(F.col(pid).alias("id")).join(reach, F.col("id") == reach["a_id"], "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def fill_noise(points: DataFrame, labels: DataFrame, width: float, pid: str = "pid") -> DataFrame:
    """Give each noise point the label of the nearest labelled point."""
    # Labels may be long in the making: made once, and what the rounds read is a table.
    labels = stage(labels, "noise-labels")
    rows = stage(points.select(F.col(pid).alias("id"), "x", "y", "z").join(labels, "id"), "noise-rows")
    got = nearest(rows.where("label < 0"), rows.where("label >= 0"), width, "id", ["label"])
    return rows.where("label >= 0").select("id", "label").unionByName(got.select(F.col("a_id").alias("id"), "label"))


def coherence(members: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Size and mean membership of each cluster; noise (-1) apart."""
    return members.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), F.avg(prob).alias("coherence"))


def spread(members: DataFrame, label: str = "label") -> DataFrame:
    """Mean variance over the axes divided by the square of the largest extent; 0 where that is tiny."""
    axes = ("x", "y", "z")
    sums = members.groupBy(label).agg(F.count("*").alias("n"), *[F.var_samp(a).alias(f"v{a}") for a in axes], *[(F.max(a) - F.min(a)).alias(f"e{a}") for a in axes])
    extent = F.greatest("ex", "ey", "ez")
    value = F.when(extent > 1e-6, (F.col("vx") + F.col("vy") + F.col("vz")) / 3 / (extent * extent)).otherwise(0.0)
    return sums.select(label, "n", value.alias("spread"))


def select_clusters(members: DataFrame, least: int, most_spread: float, label: str = "label") -> DataFrame:
    return spread(members, label).where((F.col("n") >= least) & (F.col("spread") <= most_spread))


def trim_percentile(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows between two exact percentiles of a column."""
    ends = df.agg(F.percentile(col, low).alias("__lo"), F.percentile(col, high).alias("__hi"))
    return df.join(F.broadcast(ends)).where(F.col(col).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row


def scale_search(candidates: DataFrame, truth: DataFrame, sweeps: int = 10, gain: float = 1e-6) -> tuple[dict, float]:
    """Coordinate ascent of one scale for each point so that the union of masks best matches the truth.

    candidates: point, scale, pixel; truth: pixel. Each step is one aggregate over the staged table; the
    driver holds a scale for each clicked point.
    """
    rows = stage(candidates.join(truth.select("pixel", F.lit(True).alias("t")), "pixel", "left").select("point", "scale", "pixel", F.coalesce("t", F.lit(False)).alias("t")), "scale-candidates")
    total = truth.select("pixel").distinct().count()

    def score(fixed: dict, point) -> list:
        """(scale, IoU) of every scale of `point` with the others fixed."""
        kept = F.lit(False)
        for p, s in fixed.items():
            if p != point:
                kept = kept | ((F.col("point") == p) & (F.col("scale") == s))
        base = rows.where(kept).select("pixel", "t").distinct()
        own = rows.where(F.col("point") == point)
        b = base.agg(F.count("*").alias("n"), F.count_if("t").alias("hit")).first()
        new = own.join(base.select("pixel"), "pixel", "left_anti").groupBy("scale").agg(F.count("*").alias("n"), F.count_if("t").alias("hit"))
        all_scales = own.select("scale").distinct().join(new, "scale", "left").fillna(0)
        return [(r.scale, (b.hit + r.hit) / max(1, total + b.n + r.n - b.hit - r.hit)) for r in all_scales.orderBy("scale").collect()]

    points = [r.point for r in rows.select("point").distinct().orderBy("point").collect()]
    fixed: dict = {}
    best = 0.0
    for _ in range(sweeps):
        before = best
        for p in points:
            found = max(score(fixed, p), key=lambda x: x[1], default=None)
            if found and (p not in fixed or found[1] > best):
                fixed[p], best = found
        if best - before <= gain:
            break
    return fixed, best


def progressive_crop(points: DataFrame, click: int, scales: list[float], affinity, eps: float, min_points: int, pid: str = "pid") -> list[DataFrame]:
    """For each scale, the points alike to the click (affinity(df, scale)) in the same density cluster as it, united with the first crop."""
    out: list[DataFrame] = []
    first = None
    for s in scales:
        alike = affinity(points, s)
        labels = dbscan(alike, eps, min_points, pid)
        own = labels.where(F.col("id") == click).select(F.col("label").alias("own"))
        ids = labels.join(F.broadcast(own)).where("label = own").select("id")  # one row
        crop = stage(ids if first is None else ids.unionByName(first).distinct(), "crop")
        first = crop if first is None else first
        out.append(crop)
    return out


def fit_sample_label_all(vectors: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", most: int = 300_000, dims: int | None = None, seed: int = 0) -> DataFrame:
    """Cluster label and membership of all rows by centres fitted to at most `most` rows, after PCA if dims is given.

    Stands in for a projection and density clustering that Spark has no distributed form of.
    """
    from gridloom.operators.sample import subsample
    from gridloom.operators.vector import assign_codes, fit_codebook, pca

    rows, col = vectors, vec
    if dims:
        rows, col = pca(vectors, dims, vec), "projection"
    book = fit_codebook(subsample(rows, most, key, seed), k, col, seed)
    out = assign_codes(rows, book, col)
    return out.withColumnRenamed("code", "label").withColumn("prob", 1 / (1 + F.col("code_distance"))).drop("code_distance")
