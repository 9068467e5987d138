"""Transforms, voxels, orders and spatial joins: invariants and exact small cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import vec, xform
from gridloom.operators import cluster, order, relational, sample, spatial, voxel

AFFINE = [xform.Affine(2.0, 1.0), xform.Affine(-0.5, 3.0), xform.Affine(4.0, 0.0)]


def points(spark, rows, batch=0):
    return spark.createDataFrame([(batch, n, *map(float, r)) for n, r in enumerate(rows)], "batch_id long, pid long, x double, y double, z double")


def test_affine_algebra(spark):
    for a in AFFINE:
        assert xform.chain(a, a.inverse()).at(1.7) == pytest.approx(1.7)
        for b in AFFINE:
            assert (a @ b).at(0.3) == pytest.approx(a.at(b.at(0.3)))
            assert isinstance(a @ b, xform.Affine)
            assert (a @ b).inverse().at((a @ b).at(5.0)) == pytest.approx(5.0)
    assert isinstance(xform.chain(xform.Identity(), xform.Identity()), xform.Identity)
    with pytest.raises(ValueError):
        xform.Affine(0.0, 1.0)
    df = points(spark, [(1, 2, 3)])
    assert (AFFINE[0] @ df).select("x", "y", "z").first() == (3.0, 5.0, 7.0)
    assert xform.Affine(-3.0, 1.0).pseudo_scale() == pytest.approx(3.0)


@pytest.mark.parametrize("factor", [2, 4])
def test_coarse_zero_lies_at_the_fine_midpoint(factor):
    assert xform.coarse_to_fine(factor).at(0) == (factor - 1) / 2
    twice = xform.coarse_to_fine(2) @ xform.coarse_to_fine(2)
    assert twice.at(1) == xform.coarse_to_fine(4).at(1)


def test_one_point_for_each_voxel(spark):
    rows = [(0.5, 0.5, 0.5), (1.5, 0.5, 0.5), (0.5, 1.5, 0.5), (0.5, 0.5, 1.5)]
    assert voxel.voxelize(points(spark, rows), 1.0).count() == 4


def test_many_points_for_each_voxel(spark):
    rows = [(0.1,) * 3, (0.2,) * 3, (0.3,) * 3, (1.1,) * 3, (1.2,) * 3]
    got = voxel.downsample(points(spark, rows), 1.0, F.max("x").alias("x")).orderBy("n").collect()
    assert [(r.n, r.x) for r in got] == [(2, 1.2), (3, 0.3)]


def test_negative_cells_are_floored_and_rint_goes_to_even(spark):
    p = points(spark, [(-0.5, -1.0, -1.5), (0.5, 1.5, 2.5)])
    assert voxel.keys(p, 1.0).orderBy("pid").select("i", "j", "k").collect() == [(-1, -1, -2), (0, 1, 2)]
    assert voxel.keys(p, 1.0, mode="rint").orderBy("pid").select("i", "j", "k").collect() == [(0, -1, -2), (0, 2, 2)]
    assert sorted(tuple(r) for r in voxel.coarsen(voxel.voxelize(p, 1.0)).select("i", "j", "k").collect()) == [(-1, -1, -1), (0, 0, 1)]


@pytest.mark.parametrize("kind", ["object", "room", "street"])
def test_hierarchy_invariants(spark, kind):
    p = sample.scene_batch(spark, kind, 2000, 2)
    levels = voxel.hierarchy(p, 0.05, 4, 2).groupBy("level", "batch_id").count().collect()
    count = {(r.level, r.batch_id): r["count"] for r in levels}
    assert {b for _, b in count} == {0, 1}
    for b in (0, 1):
        sizes = [count[lv, b] for lv in range(4)]
        assert sizes == sorted(sizes, reverse=True)
    again = sample.scene_batch(spark, kind, 2000, 2).orderBy("batch_id", "pid").collect()
    assert again == p.orderBy("batch_id", "pid").collect()
    assert again != sample.scene_batch(spark, kind, 2000, 2, seed=7).orderBy("batch_id", "pid").collect()


def test_status_values(spark):
    p = sample.scene_batch(spark, "object", 1000, 1)
    fine = voxel.voxelize(p, 0.05)
    coarse = voxel.coarsen(fine)
    assert {r.status for r in voxel.status(coarse, coarse, None).collect()} == {1}
    assert {r.status for r in voxel.status(coarse, coarse, fine).collect()} == {2}
    assert {r.status for r in voxel.status(coarse, coarse.limit(0), None).collect()} == {0}


def test_pooling_of_empty_and_outside(spark):
    grid = voxel.voxelize(points(spark, [(0.5, 0.5, 0.5), (1.5, 0.5, 0.5)]), 1.0)
    outside = voxel.keys(points(spark, [(9, 9, 9)]), 1.0).withColumn("f", F.lit(5.0))
    assert [r.f for r in voxel.pool(outside, grid, ["f"]).collect()] == [0.0, 0.0]
    assert voxel.pool(outside.limit(0), grid, ["f"], "mean").count() == 2


def test_trilinear_reproduces_a_linear_field(spark):
    cells = spark.createDataFrame([(0, i, j, k, float(2 * i - j + 3 * k)) for i in range(4) for j in range(4) for k in range(4)], "batch_id long, i long, j long, k long, f double")
    rng = np.random.default_rng(0)
    p = points(spark, rng.uniform(0, 3, (20, 3)).tolist())
    got = {r.pid: r.f for r in voxel.sample_trilinear(p, cells, "f").collect()}
    for r in p.collect():
        assert got[r.pid] == pytest.approx(2 * r.x - r.y + 3 * r.z)


def test_grid_sample_sentinel(spark):
    p = points(spark, [(0, 0, 0), (0.1, 0, 0), (5, 0, 0)]).withColumn("label", F.lit(7))
    got = {r.i: (r.row, r.label) for r in voxel.grid_sample(p, 1.0).collect()}
    assert got == {0: (-1, 0), 5: (2, 7)}
    plain = {r.i: (r.row, r.label) for r in voxel.grid_sample(p, 1.0, sentinel=False).collect()}
    assert plain == {0: (0, 7), 5: (2, 7)}


def test_hilbert_is_a_path():
    n = 8
    c = np.array([(i, j, k) for i in range(n) for j in range(n) for k in range(n)])
    code = order.hilbert_numpy(c, 3)
    assert sorted(code.tolist()) == list(range(n**3))
    path = c[np.argsort(code)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("name", ["z", "morton", "z-trans", "morton_zyx", "hilbert", "hilbert-trans", "vdb", "identity"])
def test_curve_aliases(spark, name):
    df = spark.createDataFrame([(0, 5, 1, 2, 3), (0, 6, 3, 2, 1)], "batch_id long, pos long, i long, j long, k long")
    out = order.ranked(df.withColumn("key", order.curve_key(name)), "key")
    assert sorted(r.rank for r in out.collect()) == [0, 1]


@pytest.mark.parametrize("name", ["invalid", "unknown", "random", "xyz", ""])
def test_unknown_curves(spark, name):
    with pytest.raises(ValueError):
        order.curve_key(name)


def test_patches_keep_the_remainder(spark):
    df = spark.createDataFrame([(b, n) for b, m in ((0, 5), (1, 3)) for n in range(m)], "batch_id long, pos long")
    got = order.patches(order.ranked(df, "pos"), 2).groupBy("batch_id", "patch").count().orderBy("batch_id", "patch").collect()
    assert [r["count"] for r in got] == [2, 2, 1, 2, 1]


def test_attention_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(0, n // 3, n, v[n].tolist()) for n in range(6)], "batch_id long, patch long, pos long, q array<double>")
    got = {r.pos: r.out for r in order.patch_attention(df.withColumn("k", F.col("q")).withColumn("v", F.col("q")), 0.5).collect()}
    for p in range(2):
        a = v[3 * p : 3 * p + 3]
        e = np.exp(a @ a.T * 0.5)
        want = e / e.sum(1, keepdims=True) @ a
        assert np.allclose([got[3 * p + n] for n in range(3)], want)


def test_runs_round_trip(spark):
    seq = list("aabbbacc")
    df = spark.createDataFrame([(0, n, s) for n, s in enumerate(seq)], "g long, n long, s string")
    runs = order.run_lengths(df, "s", ["n"], ["g"])
    assert [(r.s, r.length) for r in runs.orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1), ("c", 2)]
    assert [r.s for r in order.expand_runs(runs, "s", ["g"]).orderBy("at").collect()] == seq
    assert [order.smallest_int(*r) for r in ((0, 127), (0, 128), (-40000, 0), (0, 1 << 40))] == ["tinyint", "smallint", "int", "bigint"]


def brute(a, b):
    return {i: sorted((math.dist(p, q), j) for j, q in enumerate(b)) for i, p in enumerate(a)}


@pytest.mark.parametrize("width", [0.05, 0.3, 3.0])
def test_nearest_equals_brute_force(spark, width):
    r = random.Random(4)
    a = [tuple(r.uniform(-2, 2) for _ in "xyz") for _ in range(40)] + [(50.0, 50.0, 50.0)]
    b = [tuple(r.uniform(-2, 2) for _ in "xyz") for _ in range(80)]
    want = brute(a, b)
    got = spatial.nearest(points(spark, a), points(spark, b), width, k=3).orderBy("a_id", "rank").collect()
    assert [(g.a_id, g.b_id) for g in got] == [(i, want[i][n][1]) for i in range(len(a)) for n in range(3)]
    near = {x.pid: x.distance for x in spatial.nearest_within(points(spark, a), points(spark, b), 0.4).collect()}
    for i in want:
        d = want[i][0][0]
        assert near[i] == pytest.approx(d) if d < 0.4 else near[i] == float("inf")


def test_nearest_with_few_targets(spark):
    got = spatial.nearest(points(spark, [(0, 0, 0)]), points(spark, [(9, 9, 9)]), 0.001, k=4).collect()
    assert [(g.a_id, g.b_id) for g in got] == [(0, 0)]


def test_reproject_fills_bad_queries_with_the_mean(spark):
    src = points(spark, [(0, 0, 0), (1, 0, 0)]).withColumn("r", F.col("x") * 10)
    to = points(spark, [(0.1, 0, 0), (float("nan"), 0, 0), (0.9, 0, 0)])
    got = {x.pid: x.r for x in spatial.reproject(to, src, 1.0, ["r"]).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 10.0}


def test_dbscan_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(r.gauss(c, 0.1), r.gauss(0, 0.1), 0.0) for c in (0, 3) for _ in range(40)] + [(r.uniform(-9, 9), 5.0, 0.0) for _ in range(10)]
    near = [[j for j, q in enumerate(rows) if math.dist(p, q) < 0.15] for p in rows]
    core = {i for i, n in enumerate(near) if len(n) >= 4}
    label, seen = {}, set()
    for i in sorted(core):
        if i in seen:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                label[j] = i
                todo += [k for k in near[j] if k in core]
    got = {x.id: x.label for x in cluster.dbscan(points(spark, rows), 0.15, 4).collect()}
    for i in range(len(rows)):
        if i in core:
            assert got[i] == label[i]
        else:
            reach = {label[j] for j in near[i] if j in core}
            assert got[i] in reach if reach else got[i] == -1


def test_scale_search_improves_the_union(spark):
    cand = spark.createDataFrame([(p, s, x) for p in (0, 1) for s, n in ((0.1, 3), (0.2, 6)) for x in range(p * 10, p * 10 + n)], "point int, scale double, pixel int")
    truth = spark.createDataFrame([(x,) for x in [*range(6), *range(10, 13)]], "pixel int")
    scales, best = cluster.scale_search(cand, truth)
    assert scales == {0: 0.2, 1: 0.1} and best == pytest.approx(1.0)


def test_mesh_compaction(spark):
    v = spark.createDataFrame([(n, float(n)) for n in range(5)], "vid long, x double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4)], "fid long, v0 long, v1 long, v2 long")
    own, kept = relational.compact_mesh(v, f, v.where("vid >= 2"))
    assert own.count() == 3 and [tuple(r) for r in kept.collect()] == [(1, 0, 1, 2)]


def test_remap_raises_for_unknown_ids(spark):
    df = spark.createDataFrame([(1,), (2,)], "c int")
    assert [r.c for r in relational.remap(df, "c", {1: 10, 2: 20}).orderBy("c").collect()] == [10, 20]
    with pytest.raises(Exception, match="no class for id 2"):
        relational.remap(df, "c", {1: 10}).collect()


def test_quaternion_rotation(spark):
    h = math.sqrt(0.5)
    r = vec.rotation(F.lit(h), F.lit(0.0), F.lit(0.0), F.lit(h))
    got = spark.range(1).select(*[r[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]).first()
    assert np.allclose(np.array(got).reshape(3, 3), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


def test_samples(spark):
    p = points(spark, [(n, 0, 0) for n in range(100)])
    assert sample.with_replacement(p, 50, "batch_id", "pid").count() == 50
    w = sample.weighted(p, 30, "batch_id", "pid", F.col("x") + 1).collect()
    assert len({r.pid for r in w}) == 30 and sum(r.pid for r in w) / 30 > 50
    assert sample.subsample(p, 10, "pid", 1).collect() == sample.subsample(p.repartition(3), 10, "pid", 1).collect()


def test_undo(spark):
    p = points(spark, [(n, 0, 0) for n in range(4)])
    s = relational.Snapshots(p)
    assert s.crop(p.where("pid < 2").select("pid")).count() == 2
    assert s.undo().count() == 4


def test_point_encoder_empty_cells_and_outside_points(spark):
    rng = np.random.default_rng(3)
    layers = [[(rng.normal(size=(3, 4)), np.zeros(4))]] + [[(rng.normal(size=(8, 4)), np.zeros(4))] for _ in range(2)]
    p = voxel.keys(points(spark, [(0.5, 0.5, 0.5), (0.6, 0.5, 0.5), (9.5, 9.5, 9.5)]), 1.0).withColumn("feature", F.array("x", "y", "z"))
    grid = voxel.voxelize(points(spark, [(0.5, 0.5, 0.5), (5.5, 0.5, 0.5)]), 1.0)
    got = {r.i: r.feature for r in voxel.point_encoder(p, grid, layers).collect()}
    h = np.array([[0.5, 0.5, 0.5], [0.6, 0.5, 0.5]]) @ layers[0][0][0]
    for n in (1, 2):
        h = np.concatenate([h, np.repeat(h.max(0, keepdims=True), 2, 0)], 1) @ layers[n][0][0]
    assert np.allclose(got[0], h.mean(0)) and got[5] == [0.0] * 4


def test_quaternion_round_trip(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(10):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        rows.append((n, *(q if q[0] >= 0 else -q).tolist()))
    df = spark.createDataFrame(rows, "n long, w double, x double, y double, z double")
    r = vec.rotation(*[F.col(c) for c in "wxyz"])
    got = df.withColumn("m", F.array(*[F.array(*row) for row in r])).withColumn("q", vec.quaternion(F.col("m"))).orderBy("n").collect()
    for g, want in zip(got, rows, strict=True):
        assert np.allclose(g.q, want[1:], atol=1e-6)


def test_rigid_inverse(spark):
    m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ([0, -1, 0, 5], [1, 0, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1])])
    got = spark.range(1).select(vec.matmul(m, vec.rigid_inverse(m)).alias("p")).first().p
    assert np.allclose(got, np.eye(4))


def test_unique_cells(spark):
    g = voxel.voxelize(points(spark, [(0, 0, 0), (1, 1, 1)]), 1.0)
    assert voxel.assert_unique(g).count() == 2
    with pytest.raises(ValueError):
        voxel.assert_unique(g.unionByName(g))


def test_scene_runs_skip_and_report(spark):
    scenes = spark.createDataFrame([("a",), ("b",), ("c",)], "scene string")

    def run(name):
        if name == "c":
            raise RuntimeError("no")

    assert relational.run_scenes(scenes, scenes.where("scene = 'a'"), run) == {"a": "skipped", "b": "done", "c": "failed: no"}


def test_offsets_and_batches(spark):
    got = spark.range(9).select(order.batch_of(F.col("id"), [2, 5, 9]).alias("batch_id"))
    assert [r.batch_id for r in got.collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert [tuple(r) for r in order.offsets(got).orderBy("batch_id").collect()] == [(0, 2), (1, 5), (2, 9)]


def test_grid_coordinates_use_the_global_minimum(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0)], 0).unionByName(points(spark, [(9, 0, 0), (11, 2, 3)], 1))
    got = voxel.grid_coordinates(p, 1.0).orderBy("batch_id", "pid").select("i", "j", "k").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (1, 0, 0), (9, 0, 0), (11, 2, 3)]


def test_bounds_contain_points(spark):
    p = sample.scene_batch(spark, "object", 500, 1)
    b = voxel.bounds(voxel.voxelize(p, 0.05)).first()
    for r in p.collect():
        for a, c in zip("xyz", "ijk"):
            assert b[f"lo_{c}"] * 0.05 - 1e-9 <= r[a] <= (b[f"hi_{c}"] + 1) * 0.05 + 1e-9
