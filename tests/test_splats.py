"""Contributors of pixels against loops over splats and pixels; table functions."""

import itertools
import math

import numpy as np
import pytest

from gridloom.functions import tables
from gridloom.operators import splats

SPLAT = "batch_id string, sid long, x double, y double, z double, sx double, sy double, sz double, qw double, qx double, qy double, qz double, opacity double, depth double, left int"
CAMERA = "batch_id string, frame long, fx double, fy double, cx double, cy double, width int, height int, pose array<double>"


def scene(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("a", i, *(float(v) for v in (*rng.uniform(-2, 2, 2), rng.uniform(-1, 6), *rng.lognormal(-2.2, 0.6, 3), *rng.normal(0, 1, 4), rng.uniform(0, 1.1))), 1.0, 2) for i in range(n)]
    rows += [("a", n, *rows[3][2:])]  # the same place and depth
    rows += [("a", n + 1, float("nan"), *rows[0][3:]), ("a", n + 2, None, *rows[0][3:]), ("b", n + 3, *rows[0][2:])]
    c, s = math.cos(0.3), math.sin(0.3)
    poses = [np.eye(4), np.array([[c, 0, s, 0.4], [0, 1, 0, -0.2], [-s, 0, c, -1.0], [0, 0, 0, 1]])]
    cameras = [("a", f, 30.0, 34.0, 20.3, 15.1, 41, 31, [float(v) for v in p.ravel()]) for f, p in enumerate(poses)]
    return rows, cameras


def brute(rows, cameras, cut=1e-4):
    out = {}
    for batch, frame, fx, fy, cx, cy, width, height, pose in cameras:
        m = np.array(pose).reshape(4, 4)
        turn, prints = m[:3, :3].T, []
        for b, sid, *v in rows:
            if b != batch or any(x is None or not math.isfinite(x) for x in v[:11]) or v[10] < 1 / 255:
                continue
            e = turn @ (np.array(v[:3]) - m[:3, 3])
            if e[2] <= 0.01:
                continue
            w, x, y, z = np.array(v[6:10]) / np.linalg.norm(v[6:10])
            r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
            sigma = r @ np.diag(np.square(v[3:6])) @ r.T
            j = np.array([[fx / e[2], 0, -fx * e[0] / e[2] ** 2], [0, fy / e[2], -fy * e[1] / e[2] ** 2]])
            flat = j @ turn @ sigma @ turn.T @ j.T + 0.3 * np.eye(2)
            prints.append((e[2], sid, np.array([fx * e[0] / e[2] + cx, fy * e[1] / e[2] + cy]), np.linalg.inv(flat), v[10]))
        prints.sort(key=lambda p: p[:2])
        for row, col in itertools.product(range(height), range(width)):
            left, shown = 1.0, []
            for depth, sid, mid, inverse, opacity in prints:
                d = np.array([col + 0.5, row + 0.5]) - mid
                alpha = min(0.999, opacity * math.exp(-0.5 * d @ inverse @ d))
                if alpha < 1 / 255:
                    continue
                if left * (1 - alpha) <= cut:
                    break
                shown.append((sid, alpha * left))
                left *= 1 - alpha
            if shown:
                out[frame, row, col] = shown
    return out


@pytest.mark.parametrize("n, tile", [(1000, 16), (60, 5)])
def test_contributors_equal_loops(spark, n, tile):
    rows, cameras = scene(n, n)
    s, c = spark.createDataFrame(rows, SPLAT).repartition(3), spark.createDataFrame(cameras, CAMERA)
    got = {}
    shown = splats.contributors(s, c, tile).cache()
    for r in shown.orderBy("frame", "row", "col", "place").collect():
        got.setdefault((r.frame, r.row, r.col), []).append((r.sid, r.weight))
    want = brute(rows, cameras)
    assert got.keys() == want.keys() and len(want) > 1000
    for pixel, pairs in want.items():
        assert [p[0] for p in pairs] == [g[0] for g in got[pixel]]
        assert np.allclose([p[1] for p in pairs], [g[1] for g in got[pixel]])
    best = {}
    for r in splats.contributors(s, c, tile, most=3).collect():
        best.setdefault((r.frame, r.row, r.col), set()).add(r.sid)
    assert all(len(best[p]) == min(3, len(v)) and min(w for i, w in v if i in best[p]) >= max([w for i, w in v if i not in best[p]], default=0) - 1e-12 for p, v in want.items())
    image = splats.weighted_values(shown, s, ["x"]).collect()
    place = {r[1]: r[2] for r in rows if r[0] == "a"}
    assert len(image) == len(want)
    for r in image[:200]:
        pairs = want[r.frame, r.row, r.col]
        assert math.isclose(r.weight, sum(w for _, w in pairs)) and math.isclose(r.x, sum(w * place[i] for i, w in pairs), abs_tol=1e-9)


def test_no_second_exchange_after_the_tiles(spark):
    rows, cameras = scene(20)
    plan = splats.contributors(spark.createDataFrame(rows, SPLAT), spark.createDataFrame(cameras, CAMERA), most=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "ty" in plan  # the join with the cameras, and the tiles
    assert not any("hashpartitioning(batch_id" in line and "row" in line.split("hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_blending_by_table_function(spark):
    rows, cameras = scene(300, 5)
    tables.register(spark)
    s, c = spark.createDataFrame(rows, SPLAT), spark.createDataFrame(cameras, CAMERA)
    alphas = splats.pixel_alphas(splats.footprints(s, c)).cache()
    alphas.select("sid", "alpha", "depth", "frame", "row", "col").createOrReplaceTempView("alphas")
    got = spark.sql("SELECT sid, place, weight FROM blend(TABLE(SELECT * FROM alphas) PARTITION BY (frame, row, col) ORDER BY (depth, sid))")
    want = splats.contributors(s, c)
    key = lambda df: sorted((r.sid, r.place, round(r.weight, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_rays_through_cells(spark):
    tables.register(spark)
    rng = np.random.default_rng(3)
    rays = [(i, *(float(v) for v in rng.uniform(-3, 3, 6))) for i in range(60)]
    rays += [(60, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (61, 0.5, 0.5, 0.5, 0.0, -1.0, 0.0), (62, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (63, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0), (64, None, 0.0, 0.0, 1.0, 0.0, 0.0), (65, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0)]
    spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double").createOrReplaceTempView("rays")
    found = {}
    for r in spark.sql("SELECT ray, w.* FROM rays, LATERAL walk_cells(ox, oy, oz, dx, dy, dz, 0.5D, 0.25D, 2.0D) w ORDER BY ray, enter, leave").collect():
        found.setdefault(r.ray, []).append(r)
    assert set(found) == set(range(63))
    for ray, *v in rays[:60]:
        o, d = np.array(v[:3]), np.array(v[3:])
        cells = found[ray]
        assert cells[0].enter == 0.25 and cells[-1].leave == 2.0 and all(a.leave == b.enter for a, b in zip(cells, cells[1:], strict=False))
        for c in cells:
            if c.leave - c.enter > 1e-9:
                assert tuple(np.floor((o + d * (c.enter + c.leave) / 2) / 0.5)) == (c.i, c.j, c.k)
        assert all(abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) == 1 for a, b in zip(cells, cells[1:], strict=False))
    assert [c.i for c in found[60]] == [0, 1, 2, 3] and [c.j for c in found[61]] == [0, -1, -2, -3]
