"""Embeddings: top-k codes, codebooks, retrieval, projection."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.vec import dbl, dot, l2, relevancy


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once a row: a column that a lambda names is made again for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(v: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    powers = let(v, lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return let(powers, shares)


def topk_code(logits: Column, k: int, eps: float = 1e-10) -> Column:
    """The k largest softmax weights, renormalised, as map<index, weight>; ties go to the lower index."""
    pairs = F.transform(softmax(dbl(logits)), lambda p, n: F.struct((-p).alias("m"), n.alias("n")))

    def weighed(best: Column) -> Column:
        total = F.aggregate(best, F.lit(0.0), lambda s, b: s - b["m"])
        return F.map_from_arrays(F.transform(best, lambda b: b["n"]), let(total, lambda t: F.transform(best, lambda b: -b["m"] / (t + F.lit(eps)))))

    return let(F.slice(F.array_sort(pairs), 1, k), weighed)


def assign_codes(vectors: DataFrame, centers: list[tuple[int, list[float]]], vec: str = "embedding") -> DataFrame:
    """Nearest centre of each vector, the lower id on ties. The codebook is a bounded literal: no join."""
    book = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for n, c in centers])
    best = F.array_min(F.transform(book, lambda b: F.struct(l2(F.col(vec), b["c"]).alias("d"), b["n"].alias("n"))))
    return vectors.withColumn("code", best["n"]).withColumn("code_distance", best["d"])


def fit_codebook(vectors: DataFrame, k: int, vec: str = "embedding", seed: int = 0, steps: int = 20) -> list[tuple[int, list[float]]]:
    """k-means centres by MLlib, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="f").fit(vectors.select(array_to_vector(vec).alias("f")))
    return [(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())]


def residual_codes(vectors: DataFrame, levels: int, k: int, vec: str = "embedding", seed: int = 0) -> DataFrame:
    """Residual quantisation: each level codes what the earlier ones left; adds `codes` and `residual`."""
    out = vectors.withColumn("residual", dbl(F.col(vec))).withColumn("codes", F.array().cast("array<int>"))
    for level in range(levels):
        book = fit_codebook(out, k, "residual", seed + level)
        centers = F.array(*[F.array(*[F.lit(x) for x in c]) for _, c in book])
        out = assign_codes(out, book, "residual").withColumn("codes", F.concat("codes", F.array("code")))
        out = out.withColumn("residual", F.zip_with("residual", F.get(centers, F.col("code")), lambda a, b: a - b)).drop("code", "code_distance")
    return out


def decode(weights: DataFrame, codebook: DataFrame, key: list[str]) -> DataFrame:
    """Sum of weight * code vector for each key. weights: key, code, w; codebook: code, pos, value rows."""
    return weights.join(codebook, "code").groupBy(*key, "pos").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def packed(df: DataFrame, key: str, vec: str, rows: int = 4096) -> DataFrame:
    """ids, m: some rows' keys and their vectors as one matrix of doubles, made where the rows are. Null vectors are left out; all must have one length."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.slice(low, rows)
                sizes = set(part.column(1).value_lengths().to_pylist())
                if len(sizes) != 1:
                    raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])

    return df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).alias("v")).mapInArrow(run, f"ids array<{kind}>, m binary")


def against(items: DataFrame, queries: DataFrame, reduce, schema: str, key: str, query_key: str, vec: str = "embedding", query_vec: str | None = None) -> DataFrame:
    """What reduce(item ids, item matrix, query ids, query matrix) yields for every block of items with every block of queries, as rows of `schema`.

    The query set is a table like any other: the planner broadcasts its blocks if they are measured as
    small, and pairs them with the items' blocks where they are if not. The driver sees none of it. reduce should leave little: its rows are all that moves on.
    """
    left = packed(items, key, vec)
    right = packed(queries, query_key, query_vec or vec).select(F.col("ids").alias("query_ids"), F.col("m").alias("query_m"))

    def run(batches):
        for batch in batches:
            for n in range(len(batch)):
                ids, own, query_ids, other = (batch.column(c)[n] for c in range(4))
                a, b = (np.frombuffer(m.as_buffer(), np.float64).reshape(len(i), -1) for i, m in ((ids, own), (query_ids, other)))
                yield from reduce(ids.values, a, query_ids.values, b)

    return left.crossJoin(right).mapInArrow(run, schema)


def affinities(items: DataFrame, clicks: DataFrame, least: float = 0.9, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """key, click, affinity of every item and click whose product is `least` or more."""
    kind, click = dict(items.dtypes)[key], dict(clicks.dtypes)[key]

    def reduce(ids, a, query_ids, b):
        products = a @ b.T
        at, of = np.nonzero(products >= least)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), query_ids.take(pa.array(of)), pa.array(products[at, of])], [key, "click", "affinity"])

    return against(items, clicks, reduce, f"`{key}` {kind}, click {click}, affinity double", key, key, vec)


def strongest(items: DataFrame, queries: DataFrame, name: str, key: str = "vec_id", query_key: str | None = None, vec: str = "embedding", query_vec: str | None = None) -> DataFrame:
    """key, name: the greatest product of every item with any query; one row an item and block of queries is exchanged."""
    kind = dict(items.dtypes)[key]

    def reduce(ids, a, query_ids, b):
        yield pa.RecordBatch.from_arrays([ids, pa.array((a @ b.T).max(1))], [key, name])

    best = against(items, queries, reduce, f"`{key}` {kind}, `{name}` double", key, query_key or key, vec, query_vec)
    return best.groupBy(key).agg(F.max(name).alias(name))


def score_phrases(items: DataFrame, phrases: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, phrase_id, relevancy of every item (of unique keys) for every positive phrase against all negatives.

    phrases: phrase_id, positive, vec; a table of any size. Without a negative phrase there is no relevancy, and no row.
    """
    kind, phrase = dict(items.dtypes)[key], dict(phrases.dtypes)["phrase_id"]

    # What the negatives say goes to the items, as a further component, before they meet the positives: products do not move.
    negative = strongest(items, phrases.where("not positive"), "__neg", key, "phrase_id", vec, "vec")
    told = items.select(key, vec).join(negative, key).select(key, F.concat(dbl(F.col(vec)), F.array("__neg")).alias(vec))

    def reduce(ids, a, query_ids, b):
        m = len(b)
        step = max(1, (1 << 16) // m)
        for low in range(0, len(a), step):
            own = a[low : low + step]
            at = np.arange(low, low + len(own))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, m))), query_ids.take(pa.array(np.tile(np.arange(m), len(own)))), pa.array((own[:, :-1] @ b.T).ravel()), pa.array(np.repeat(own[:, -1], m))], [key, "phrase_id", "product", "__neg"])

    products = against(told, phrases.where("positive"), reduce, f"`{key}` {kind}, phrase_id {phrase}, product double, __neg double", key, "phrase_id", vec, "vec")
    return products.select(key, "phrase_id", relevancy(F.col("product"), F.col("__neg")).alias("relevancy"))


def nearest_codes(vectors: DataFrame, codes: DataFrame, key: str = "vec_id", vec: str = "embedding", code: str = "code") -> DataFrame:
    """key, code, code_distance: the nearest row of a table of codes (code, vec) to each vector, the lesser code on ties.

    Products find the candidates; those within rounding of the best are measured again by their differences.
    """
    kind, of = dict(vectors.dtypes)[key], dict(codes.dtypes)[code]

    def reduce(ids, a, query_ids, b):
        names = np.array(query_ids.to_pylist())
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
        close = squares <= squares.min(1, keepdims=True) + 1e-9 * (1 + (a * a).sum(1)[:, None])
        at, which = np.nonzero(close)
        exact = np.sqrt(((a[at] - b[which]) ** 2).sum(1))
        order = np.lexsort((names[which], exact, at))
        first = order[np.unique(at[order], return_index=True)[1]]
        yield pa.RecordBatch.from_arrays([ids, query_ids.take(pa.array(which[first])), pa.array(exact[first])], [key, "code", "code_distance"])

    best = against(vectors, codes, reduce, f"`{key}` {kind}, code {of}, code_distance double", key, code, vec, vec)
    return best.groupBy(key).agg(F.min(F.struct("code_distance", "code")).alias("m")).select(key, "m.code", "m.code_distance")


def affinity(items: DataFrame, click: list[float], least: float = 0.9, vec: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in click])
    return items.withColumn("affinity", dot(F.col(vec), q)).where(F.col("affinity") >= least)


def negative_evidence(positive: Column, negative: Column, mode: str, least: float = 0.9, weight: float = 1.0) -> Column:
    """Whether a pixel stays given its affinity to the click and its greatest one to negative clicks.

    dominate: the positive is above weight times the negative; subtract: what weight times the negative
    leaves reaches the threshold; veto: the negative is below weight. Any other mode ignores the negative.
    """
    if mode == "dominate":
        return (positive >= least) & (positive > negative * weight)
    if mode == "subtract":
        return positive - negative * weight >= least
    if mode == "veto":
        return (positive >= least) & (negative < weight)
    return positive >= least


def topk(df: DataFrame, group: list[str], score: str, k: int, tie: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pca(vectors: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """Projection on the first k principal axes, by MLlib; signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("__f", array_to_vector(vec))
    return PCA(k=k, inputCol="__f", outputCol="__p").fit(rows).transform(rows).withColumn("projection", vector_to_array("__p")).drop("__f", "__p")


def centered(df: DataFrame, cols: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    return df.join(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])  # one row


def min_max(df: DataFrame, cols: list[str], eps: float = 1e-8) -> DataFrame:
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.join(F.broadcast(ends))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + F.lit(eps)) for c in cols}).drop(*[f"__{n}_{c}" for c in cols for n in ("lo", "hi")])


def mlp(features: Column, layers: list[tuple[np.ndarray, np.ndarray]], unit_length: bool = False, eps: float = 1e-6) -> Column:
    """Dense layers with ReLU between them on an array column; numpy on Arrow batches, inference only."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        h = np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 1))
        for n, (w, b) in enumerate(layers):
            h = h @ w + b
            if n < len(layers) - 1:
                h = np.maximum(h, 0)
        if unit_length:
            h = h / (np.linalg.norm(h, axis=1, keepdims=True) + eps)
        return pd.Series(list(h))

    return run(features)


def ray_features(contributors: DataFrame, features: DataFrame, key: list[str], k: int | None = None) -> DataFrame:
    """Weighted sum of the features of a ray's contributors, of the k heaviest if given.

    contributors: key, rank, gid, weight; features: gid, pos, value rows.
    """
    rows = contributors if k is None else topk(contributors, key, "weight", k, "gid").drop("rank")
    return rows.join(features, "gid").groupBy(*key, "pos").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
