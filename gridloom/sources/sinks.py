"""Writers: partitioned tables, metrics, caches keyed by parameters, PLY and JSON exports."""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.vec import finite


def write_segments(splats: DataFrame, path: str, key: str = "cluster_id", **metadata: str) -> None:
    """One folder for each cluster, metadata as columns."""
    splats.withColumns({k: F.lit(v) for k, v in metadata.items()}).write.partitionBy(key).parquet(path)


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows none of whose numbers is null, NaN or infinite."""
    return df.where(F.coalesce(finite(*[F.col(c).cast("double") for c in cols]), F.lit(False)))


def append_groups(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def log_metrics(spark: SparkSession, path: str, rows: list[tuple[int, str, float]]) -> None:
    spark.createDataFrame(rows, "step long, name string, value double").coalesce(1).write.mode("append").parquet(path)


def export_samples(points: DataFrame, path: str | None, least: int, most: int, patch: int, order: str = "pos", sample: str = "sample") -> DataFrame:
    """Samples with least..most points, cut to a multiple of the patch size, as JSON if a path is given."""
    from pyspark.sql import Window as W

    sizes = points.groupBy(sample).agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    kept = points.join(sizes, sample).withColumn("rn", F.row_number().over(W.partitionBy(sample).orderBy(order)))
    kept = kept.where(F.col("rn") <= F.floor(F.col("n") / patch) * patch).drop("rn", "n")
    if path:
        kept.write.json(path)
    return kept


def ply_text(vertices: list[tuple], faces: list[tuple], colors: bool) -> str:
    props = ["property float x", "property float y", "property float z"] + [f"property uchar {c}" for c in ("red", "green", "blue") if colors]
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *props, f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    return "\n".join([*head, *(" ".join(map(str, v)) for v in vertices), *(f"3 {a} {b} {c}" for a, b, c in faces)]) + "\n"


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, as_ply: bool = False, colors: bool = False) -> None:
    """Mesh as two Parquet tables; as PLY text only for meshes that fit the driver, as the format is one file."""
    if not as_ply:
        vertices.write.parquet(f"{path}/vertices")
        faces.write.parquet(f"{path}/faces")
        return
    cols = ["x", "y", "z"] + (["r", "g", "b"] if colors else [])
    v = [tuple(r) for r in vertices.orderBy("vid").select(*cols).toLocalIterator()]
    f = [tuple(r) for r in faces.orderBy("fid").select("v0", "v1", "v2").toLocalIterator()]
    vertices.sparkSession.createDataFrame([(ply_text(v, f, colors),)], "value string").coalesce(1).write.text(path)


class ParameterCache:
    """A table kept with the parameters that made it; any other parameters remake it, all or nothing."""

    def __init__(self, spark: SparkSession, path: str, version: int = 1, **parameters):
        self.spark, self.path = spark, path
        self.key = hashlib.sha256(json.dumps({"version": version, **parameters}, sort_keys=True).encode()).hexdigest()

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, make) -> DataFrame:
        at = f"{self.path}/{self.key}"
        if not self._exists(f"{at}/_SUCCESS"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            make().write.parquet(at)
        return self.spark.read.parquet(at)


def artifact_path(base: str, step: int, name: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".csv", ".pt", ".ply")) -> str:
    """base/<step, 8 digits>/name; ValueError for other suffixes and for names that leave the folder."""
    import posixpath

    if posixpath.splitext(name)[1] not in suffixes:
        raise ValueError(f"suffix of {name!r} is not one of {', '.join(suffixes)}")
    out = posixpath.normpath(posixpath.join(base, f"{step:08d}", name))
    if not out.startswith(posixpath.normpath(base) + "/"):
        raise ValueError(f"{name!r} leaves {base!r}")
    return out


#: What a saved state must have, and its mark.
STATE_MAGIC, STATE_VERSION = "gridloom-state", 1


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    body = json.dumps({"magic": STATE_MAGIC, "version": STATE_VERSION, **state}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    state = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
    if state.pop("magic", None) != STATE_MAGIC or state.pop("version", None) != STATE_VERSION:
        raise ValueError("not a saved state of this version")
    missing = [k for k in required if k not in state]
    if missing:
        raise ValueError(f"state lacks {', '.join(missing)}")
    return state
