"""Depth images, fused grids, triangle meshes, and the stateful stream that builds a grid."""

import itertools
import math
from collections import Counter

import numpy as np

from gridloom.operators import depth, voxel
from gridloom.plans import surface_queries
from gridloom.streaming import fusion

GRID = "batch_id string, i long, j long, k long, v double"
SF = "/root/testdata/sf0.001"


def field(spark, f, n, batch="a"):
    side = range(-n, n + 1)
    return spark.createDataFrame([(batch, *c, float(f(*c))) for c in itertools.product(side, side, side)], GRID)


def edges_of(faces):
    return Counter(e for f in faces for e in ((f.v0, f.v1), (f.v1, f.v2), (f.v2, f.v0)))


def test_sphere_is_closed_and_turned_outwards(spark):
    r, at = 4.3, (0.2, -0.1, 0.35)
    grid = field(spark, lambda i, j, k: math.dist((i, j, k), at) - r, 6).unionByName(field(spark, lambda i, j, k: math.dist((i, j, k), (0, 0, 0)) - 3.1, 5, "b"))
    vertices, faces = depth.mesh(grid, "v")
    vs, fs = {x.vid: x for x in vertices.collect()}, faces.collect()
    assert sorted(vs) == list(range(len(vs))) and sorted(f.fid for f in fs) == list(range(len(fs)))
    edges = edges_of(fs)
    # Every edge is used once in either direction: no gaps, no flipped faces.
    assert all(n == 1 and edges[b, a] == 1 for (a, b), n in edges.items())
    for batch, centre, radius in (("a", at, r), ("b", (0, 0, 0), 3.1)):
        own = {i for i, x in vs.items() if x.batch_id == batch}
        tri = [f for f in fs if f.batch_id == batch]
        assert all({f.v0, f.v1, f.v2} <= own for f in tri)
        assert len(own) - len([e for e in edges if e[0] in own]) // 2 + len(tri) == 2  # Euler's number of a sphere
        # Linear interpolation along a lattice edge of length up to sqrt(3) is off by at most its square over 8 r.
        assert max(abs(math.dist((vs[i].x, vs[i].y, vs[i].z), centre) - radius) for i in own) < 3 / (8 * (radius - 1.8))
        p = {i: np.array((vs[i].x, vs[i].y, vs[i].z)) - centre for i in own}
        volume = sum(np.dot(p[f.v0], np.cross(p[f.v1], p[f.v2])) for f in tri) / 6
        assert 0.9 < volume / (4 / 3 * math.pi * radius**3) < 1.0
    normals = depth.vertex_normals(vertices, faces).collect()
    assert len(normals) == len(vs)
    for n in normals:
        centre = np.array(at if n.batch_id == "a" else (0, 0, 0))
        out = np.array((vs[n.vid].x, vs[n.vid].y, vs[n.vid].z)) - centre
        assert np.dot(out / np.linalg.norm(out), (n.nx, n.ny, n.nz)) > 0.9


def test_random_values_leave_no_gap(spark):
    rng = np.random.default_rng(1)
    n = 4
    grid = field(spark, lambda i, j, k: 1.0 if max(map(abs, (i, j, k))) == n else rng.integers(-2, 3), n)
    _, faces = depth.mesh(grid, "v")
    edges = edges_of(faces.collect())
    assert len(edges) > 1000 and all(count == edges[b, a] for (a, b), count in edges.items())


def test_holes_and_odd_values_of_a_grid(spark):
    assert depth.cut(spark.createDataFrame([], GRID), "v").count() == 0
    cube = [("a", *c, -1.0 if c == (0, 0, 0) else 1.0) for c in itertools.product((0, 1), repeat=3)]
    rows = spark.createDataFrame(cube, GRID)
    # One corner inside: a triangle in each of the six tetrahedra.
    assert depth.cut(rows, "v").count() == 18
    for gone in (None, float("nan")):
        assert depth.cut(spark.createDataFrame([*cube[:-1], (*cube[-1][:4], gone)], GRID), "v").count() == 0
    assert depth.cut(spark.createDataFrame(cube[:-1], GRID), "v").count() == 0
    # A value of 0 is outside.
    flat = spark.createDataFrame([("a", *c, 0.0 if c[0] else 1.0) for c in itertools.product((0, 1), repeat=3)], GRID)
    assert depth.cut(flat, "v").count() == 0


def brute_samples(pixels, cameras, size, truncation):
    """Loops over frames, cells and pixels, with numpy's inverse of the pose."""
    out = []
    for frame, f, cx, cy, pose in cameras:
        m = np.array(pose).reshape(4, 4)
        if not np.isfinite(m).all() or np.linalg.det(m[:3, :3]) < 1e-6:
            continue
        image = {(r, c): z for fr, r, c, z in pixels if fr == frame and z is not None and math.isfinite(z) and z > 0}
        met = set()
        for (r, c), z in image.items():
            for s in range(-math.ceil(truncation / (size / 2)), math.ceil(truncation / (size / 2)) + 1):
                w = z + s * size / 2
                if w > 0:
                    p = m @ [(c - cx) / f * w, (r - cy) / f * w, w, 1]
                    met.add(tuple(int(x) for x in np.floor(p[:3] / size)))
        for cell in met:
            p = np.linalg.inv(m) @ [*((np.array(cell) + 0.5) * size), 1]
            if p[2] <= 0:
                continue
            z = image.get((math.floor(f * p[1] / p[2] + cy + 0.5), math.floor(f * p[0] / p[2] + cx + 0.5)))
            if z is not None and z - p[2] >= -truncation:
                out.append((*cell, frame, min(1.0, (z - p[2]) / truncation)))
    return out


def a_scene():
    """A sphere seen from three sides, one camera without a usable pose, and pixels without a depth."""
    rng = np.random.default_rng(7)
    cameras, pixels = [], []
    for frame, angle in enumerate((0.0, 0.7, 2.1, 0.0)):
        c, s = math.cos(angle), math.sin(angle)
        eye = np.array((4 * s, 0.0, -4 * c))
        pose = np.array([[c, 0, -s, eye[0]], [0, 1, 0, eye[1]], [s, 0, c, eye[2]], [0, 0, 0, 1.0]])
        if frame == 3:
            pose[0, 0] = float("nan")
        cameras.append((frame, 24.0, 9.5, 9.5, [float(x) for x in pose.ravel()]))
        for r, col in itertools.product(range(20), range(20)):
            ray = np.array(((col - 9.5) / 24, (r - 9.5) / 24, 1.0))
            world = pose[:3, :3] @ ray if frame < 3 else ray
            a, b, g = world @ world, 2 * world @ eye, eye @ eye - 1.5**2
            z = (-b - math.sqrt(b * b - 4 * a * g)) / (2 * a) if b * b > 4 * a * g else [None, 0.0, float("nan"), -1.0][int(rng.integers(0, 4))]
            pixels.append((frame, r, col, None if z is None else float(z)))
    return pixels, cameras


def frames(spark, pixels, cameras):
    p = spark.createDataFrame([("s", *x, 1, 2) for x in pixels], "batch_id string, frame long, row int, col int, depth double, i int, tsdf int")
    return p, spark.createDataFrame([("s", n, f, f, cx, cy, m) for n, f, cx, cy, m in cameras], "batch_id string, frame long, fx double, fy double, cx double, cy double, pose array<double>")


def test_integration_equals_loops(spark):
    pixels, cameras = a_scene()
    got = depth.samples(*frames(spark, pixels, cameras), 0.2, 0.4).select("i", "j", "k", "frame", "tsdf").collect()
    want = {x[:4]: x[4] for x in brute_samples(pixels, cameras, 0.2, 0.4)}
    have = {tuple(r)[:4]: r.tsdf for r in got}
    # Rotations are rounded differently, so a ray that grazes a cell's face may fall on either side.
    assert len(got) == len(have) and len(have.keys() ^ want.keys()) <= 0.01 * len(want) and len(want) > 1000
    assert all(abs(have[c] - want[c]) < 1e-9 for c in have.keys() & want.keys())


def test_depth_images_to_a_mesh_of_the_object(spark):
    pixels, cameras = a_scene()
    grid = depth.integrate(*frames(spark, pixels, cameras), 0.2)
    assert grid.where("weight <= 0 or abs(tsdf) > 1").count() == 0
    vertices, faces = depth.mesh(grid, "tsdf")
    found = [math.dist(((v.x + 0.5) * 0.2, (v.y + 0.5) * 0.2, (v.z + 0.5) * 0.2), (0, 0, 0)) for v in vertices.collect()]
    assert len(found) > 200 and faces.count() > 400
    # The nearest pixel measures along the optical axis: good to a cell, most to a fifth of it.
    assert max(abs(x - 1.5) for x in found) < 0.3 and np.median([abs(x - 1.5) for x in found]) < 0.05


def test_no_frames(spark):
    pixels, cameras = frames(spark, *a_scene())
    assert depth.integrate(pixels.limit(0), cameras, 0.2).count() == 0
    assert depth.integrate(pixels, cameras.limit(0), 0.2).count() == 0


def test_stream_equals_batch_after_a_stop_and_late_frames(spark, tmp_path):
    pixels, cameras = surface_queries.depth_images(spark, SF)
    all_samples = depth.samples(pixels, cameras, 0.5, 1.0, ["shade"]).cache()
    schema = all_samples.schema
    late = lambda n: all_samples.where(f"frame % 7 in ({n})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = fusion.fuse_stream(stream, ["tsdf", "shade"], "w", str(tmp_path / "out"), str(tmp_path / "ck"), trigger={"availableNow": True}, name="fuse")
        q.awaitTermination()

    log = fusion.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    late("5, 2")
    late("6")
    run()
    first = fusion.fused(spark, str(tmp_path / "out"), ["tsdf", "shade"])
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in voxel.fuse(all_samples.where("frame % 7 in (2, 5, 6)"), "tsdf", "w", "shade").collect()}
    late("0, 1")
    late("3, 4")
    run()  # goes on from the checkpoint
    want = {tuple(r) for r in voxel.fuse(all_samples, "tsdf", "w", "shade").collect()}
    got = fusion.fused(spark, str(tmp_path / "out"), ["tsdf", "shade"])
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    # A batch holds what it changed, not the whole grid.
    sizes = {r.batch: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().collect()}
    assert len(sizes) >= 4 and min(sizes.values()) < len(want)
    import time

    for _ in range(50):
        if sum(r[3] == "ended" for r in log.rows) == 2:
            break
        time.sleep(0.2)
    spark.streams.removeListener(log)
    log.flush()
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sum(r.value for r in rows if r.name == "numInputRows") == all_samples.count()
    assert max(r.value for r in rows if r.name == "stateRowsTotal") == len({w[:4] for w in want} | {tuple(r) for r in all_samples.select(*voxel.KEY).distinct().collect()})
