"""Operators that no registered query runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import vec
from gridloom.operators import cluster, order, relational, sample, voxel
from gridloom.sources import readers, sinks


def test_sample_json_and_grouped_store(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"num_points": 2, "xyz": [[0, 1, 2], [3, 4, 5]], "grid_coords": [[0, 0, 0], [1, 1, 1]], "color": [[1, 1, 1], [0, 0, 0]], "label": [7, 8]}]))
    rows = readers.sample_json(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r.x, r.z, r.label) for r in rows] == [(0, 2, 7), (3, 5, 8)]
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", 1, [3])], "model_type string, image_id int, ids array<int>")
    sinks.append_groups(df, str(tmp_path / "g"), "model_type")
    sinks.append_groups(df, str(tmp_path / "g"), "model_type")
    assert readers.grouped(spark, str(tmp_path / "g"), "a").count() == 2
    spark.createDataFrame([(0, 5), (1, 6)], "level int, id tinyint").write.partitionBy("level").parquet(str(tmp_path / "l"))
    got = readers.cached_level(spark, str(tmp_path / "l"), 1, ("id",))
    assert dict(got.dtypes)["id"] == "int" and [r.id for r in got.collect()] == [6]
    assert readers.split_sequences(df, {"train": [1], "valid": [2]}, "all", "image_id").count() == 2
    assert readers.split_sequences(df, {"train": [1], "valid": [2]}, "valid", "image_id").count() == 0


def test_mesh_sinks(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, v0 long, v1 long, v2 long")
    sinks.write_mesh(v, f, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/faces")).count() == 1
    sinks.write_mesh(v, f, str(tmp_path / "p"), as_ply=True)
    part = next(p for p in (tmp_path / "p").iterdir() if p.name.startswith("part"))
    got = readers.parse_ply(part.read_bytes())
    assert got["vertex"]["x"] == [0.0, 1.0, 0.0] and got["face"]["vertex_indices"] == [[0, 1, 2]]


def test_colours(spark):
    df = spark.createDataFrame([(0, 0.0, 128.0), (1, 255.0, 300.0)], "vid int, r double, g double")
    got = relational.normalized_colors(df, ["r", "g"], False).orderBy("vid").collect()
    assert [(r.r, r.g) for r in got] == [(0.0, 128 / 255), (1.0, 1.0)]
    half = relational.normalized_colors(df.select("vid", (F.col("r") / 255).alias("r"), F.lit(0.5).alias("g")), ["r", "g"], False)
    assert {r.g for r in half.collect()} == {0.5}
    assert relational.normalized_colors(df, ["r"], True).where("r = 1").count() == 1
    assert relational.has_colors(df, ("r", "g")) and not relational.has_colors(df, ("r", "b"))
    c = df.select(vec.palette(F.col("vid")).alias("c")).collect()
    assert all(0 <= x <= 1 for r in c for x in r.c) and c[0].c != c[1].c
    assert spark.range(1).select(vec.sh_to_rgb(vec.rgb_to_sh(F.lit(0.3)))).first()[0] == pytest.approx(0.3)


def test_grid_features_and_intrinsics(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, [1.0]), (0, 1, 0, 0, [2.0])], "batch_id long, i long, j long, k long, f array<double>")
    b = a.where("i = 0").withColumnRenamed("f", "g")
    assert [r.features for r in voxel.concat_features(a, b, "f", "g").collect()] == [[1.0, 1.0]]
    cams = spark.createDataFrame([(100.0, 110.0, 50.0, 60.0)], "fx double, fy double, cx double, cy double")
    assert tuple(relational.scaled_intrinsics(cams, 0.5).first()) == (50.0, 55.0, 25.0, 30.0)


def test_ray_groups_epochs_and_curve_shuffles(spark):
    df = spark.range(10)
    assert sorted(r.image_slot for r in sample.ray_groups(df, 5, "id").collect()) == [0] * 5 + [1] * 5
    with pytest.raises(ValueError):
        sample.ray_groups(df, 0, "id")
    one = [r.id for r in sample.epoch(df, "id", 1, 0).orderBy("order").collect()]
    two = [r.id for r in sample.epoch(df, "id", 1, 1).orderBy("order").collect()]
    assert sorted(one) == sorted(two) and one != two
    curves = ("z", "hilbert", "morton_zyx", "hilbert-trans")
    assert sorted(order.shuffled_curves(curves, 3)) == sorted(curves)
    assert order.shuffled_curves(curves, 3, enabled=False) == curves


def test_progressive_crop_stays_with_the_click(spark):
    rng = np.random.default_rng(0)
    rows = [(n, *map(float, rng.normal(c, 0.05, 3))) for n, c in enumerate([0] * 20 + [5] * 20)]
    p = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    crops = cluster.progressive_crop(p, 0, [0.1, 0.2], lambda df, s: df.where(F.col("x") < (10 if s > 0.1 else 1)), 1.0, 3)
    assert [sorted(r.id for r in c.collect()) for c in crops] == [list(range(20))] * 2


def test_running_sums_match_a_window(spark):
    from pyspark.sql import Window as W

    rng = np.random.default_rng(1)
    rows = [(int(g) if g < 3 else None, n, int(v)) for n, (g, v) in enumerate(zip(rng.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, n int, v int")
    want = df.withColumn("s", F.sum("v").over(W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    got = order.running(df, ["g"], ["n"], s=F.col("v"))
    assert sorted((r.n, r.s) for r in got.collect()) == sorted((r.n, r.s) for r in want.collect())
    ranks = order.global_rank(df, ["n"], "at")
    assert all(r.at == r.n for r in ranks.collect())


def test_fill_noise_and_labels(spark):
    p = spark.createDataFrame([(n, float(x), 0.0, 0.0) for n, x in enumerate([0, 0.1, 0.2, 5, 5.1, 5.2, 1.0])], "pid long, x double, y double, z double")
    labels = cluster.dbscan(p, 0.3, 2)
    assert {r.id: r.label for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    assert {r.id: r.label for r in cluster.fill_noise(p, labels, 0.5).collect()}[6] == 0


def test_position_code(spark):
    got = spark.range(1).select(vec.position_code([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [10.0, 10.0, 10.0], 20).alias("c")).first().c
    f = np.logspace(0, np.log2(5000), 3, base=2) * np.pi
    want = np.concatenate([[0.0, 0.0], *[np.concatenate([np.sin(x / 10 * f), np.cos(x / 10 * f)]) for x in (1, 2, 3)]])
    assert np.allclose(got, want, atol=1e-6)
