"""Boundary loops, filled gaps and smoothing of triangle meshes."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.operators import depth, meshes

GRID = "batch_id string, i long, j long, k long, v double"


def sphere(spark, n=6, r=4.3):
    side = range(-n, n + 1)
    grid = spark.createDataFrame([("a", i, j, k, math.dist((i, j, k), (0.2, -0.1, 0.35)) - r) for i, j, k in itertools.product(side, side, side)], GRID)
    vertices, faces = depth.mesh(grid, "v")
    return [tuple(x) for x in vertices.select("vid", "x", "y", "z").collect()], [tuple(x) for x in faces.select("fid", "v0", "v1", "v2").collect()]


def tables(spark, vertices, faces):
    return spark.createDataFrame(vertices, "vid long, x double, y double, z double").repartition(3), spark.createDataFrame(faces, "fid long, v0 long, v1 long, v2 long").repartition(3)


def half_edges(faces):
    return Counter(e for _, a, b, c in faces for e in ((a, b), (b, c), (c, a)))


def loops_of(faces):
    edges = half_edges(faces)
    after = {a: b for (a, b), n in edges.items() if n > edges[b, a]}
    out = []
    while after:
        start = min(after)
        loop, at = [], start
        while at in after:
            loop.append(at)
            at = after.pop(at)
        out.append(loop)
    return out


def punched(vertices, faces, seed, holes):
    """The mesh without the faces around some vertices that are far from each other."""
    r, place, gone = random.Random(seed), {v[0]: np.array(v[1:]) for v in vertices}, []
    for v in r.sample(sorted(place), len(place)):
        if len(gone) < holes and all(np.linalg.norm(place[v] - place[g]) > 3 for g in gone):
            gone.append(v)
    return [f for f in faces if not set(gone) & set(f[1:])]


def test_loops_and_caps_of_a_punched_sphere(spark):
    vertices, whole = sphere(spark)
    faces = punched(vertices, whole, 1, 6)
    want = loops_of(faces)
    assert len(want) >= 5 and len({len(w) for w in want}) > 1
    v, f = tables(spark, vertices, faces)
    got = {}
    for r in meshes.boundary_loops(f).collect():
        got.setdefault(r.loop, []).append(r)
    assert sorted(got) == list(range(len(want)))
    turned = []
    for loop in got.values():
        loop.sort(key=lambda r: r.place)
        assert [r.place for r in loop] == list(range(len(loop))) and all(r.size == len(loop) for r in loop)
        assert all(x.b == y.a for x, y in zip(loop, loop[1:] + loop[:1], strict=True))
        turned.append([r.a for r in loop])
    assert sorted(turned) == sorted(want)
    for harmonic in (False, True):
        more_v, more_f = meshes.fill_gaps(v, f, harmonic)
        all_faces, place = [tuple(x) for x in more_f.collect()], {x.vid: np.array((x.x, x.y, x.z)) for x in more_v.collect()}
        assert len({x[0] for x in all_faces}) == len(all_faces) == len(faces) + sum(map(len, want))
        assert len(place) == len(vertices) + len(want) and all(tuple(place[x[0]]) == x[1:] for x in vertices)
        edges = half_edges(all_faces)
        assert all(n == 1 and edges[b, a] == 1 for (a, b), n in edges.items())
        for cap in range(len(vertices), len(place)):
            rim = [set(x[1:]) - {cap} for x in all_faces if cap in x[1:]]
            ring = set.union(*rim)
            centre = np.mean([place[a] for a in ring], 0)
            if not harmonic:
                assert np.allclose(place[cap], centre)
                continue
            weights = Counter()
            for a, b in map(sorted, rim):
                cot = lambda at, p, q: np.dot(p - at, q - at) / np.linalg.norm(np.cross(p - at, q - at))
                weights[a] += cot(place[b], centre, place[a])
                weights[b] += cot(place[a], centre, place[b])
            assert np.allclose(place[cap], sum(w * place[a] for a, w in weights.items()) / sum(weights.values()))
    closed_v, closed_f = meshes.fill_gaps(*tables(spark, vertices, whole))
    assert closed_v.count() == len(vertices) and closed_f.count() == len(whole)


@pytest.mark.parametrize("size", [3, 4, 7, 64, 65])
def test_loop_of_any_length(spark, size):
    # A fan without its last face: one loop of all rim vertices and the hub.
    fan = [(n, 1000, n, n + 1) for n in range(size)]
    rows = meshes.boundary_loops(tables(spark, [(0, 0.0, 0.0, 0.0)], fan)[1]).collect()
    assert len(rows) == size + 2 and {r.loop for r in rows} == {0} and sorted(r.place for r in rows) == list(range(size + 2))


def test_loops_that_touch_and_odd_faces(spark):
    two = [(0, 1, 2, 3), (1, 3, 4, 5)]  # they share a vertex
    rows = meshes.boundary_loops(tables(spark, [(0, 0.0, 0.0, 0.0)], two)[1]).collect()
    assert len(rows) == 6 and sum(1 for r in rows) == 6 and all(x.size in (3, 6) for x in rows)
    again = [(0, 1, 2, 3), (1, 1, 2, 3), (2, 7, 7, 8)]  # a face twice, and one without area
    rows = meshes.boundary_loops(tables(spark, [(0, 0.0, 0.0, 0.0)], again)[1]).collect()
    assert Counter((r.a, r.b) for r in rows) == Counter({(1, 2): 2, (2, 3): 2, (3, 1): 2})
    v, f = tables(spark, [(i, float(i), 0.0, 0.0) for i in range(4)], [(0, 0, 1, 2)])
    flat_v, flat_f = meshes.fill_gaps(v, f)  # no angle has a cotangent: the mean stays
    cap = flat_v.where("vid = 4").first()
    assert (cap.x, cap.y, cap.z) == (1.0, 0.0, 0.0) and flat_f.count() == 4
    empty_v, empty_f = meshes.fill_gaps(v.limit(0), f.limit(0))
    assert empty_v.count() == 0 and empty_f.count() == 0


def test_smoothing_moves_free_vertices_to_their_neighbours(spark):
    vertices, faces = sphere(spark)
    v, f = tables(spark, vertices, faces)
    place = {x[0]: np.array(x[1:]) for x in vertices}
    links = {}
    for a, b in half_edges(faces):
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    fixed = {x[0] for x in vertices if x[3] > 0}
    for _ in range(2):
        place = {a: p if a in fixed else p + 0.5 * (np.mean([place[b] for b in links[a]], 0) - p) for a, p in place.items()}
    got = meshes.smooth(v, f, 2, 0.5, spark.createDataFrame([(x,) for x in fixed], "vid long")).collect()
    assert len(got) == len(place) and all(np.allclose((r.x, r.y, r.z), place[r.vid]) for r in got)
