"""Depth images to a truncated-distance grid, and the grid to triangles.

A pixel's ray is walked through its truncation band; the distinct cells it meets are projected back into
their frame, and the pixel that a cell's centre falls on gives its signed distance. Samples of all frames add up in any
order (voxel.fuse). The surface is cut from the grid by tetrahedra: six for each cell, the same on both
sides of every cell face, so neighbouring cells share their edges and vertices and the mesh has no gaps.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vec import finite
from gridloom.operators import order, voxel
from gridloom.operators.voxel import CELL, KEY
from gridloom.session import stage

FRAME = ["batch_id", "frame"]


def usable(cameras: DataFrame) -> DataFrame:
    """Cameras whose pose (16 numbers by row, camera to world) is finite with a determinant of 1e-6 or more."""
    m = lambda r, c: F.col("pose")[4 * r + c]
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    whole = F.forall("pose", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cameras.where(F.col("pose").isNotNull() & whole & (det >= 1e-6))


def valid_pixels(pixels: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pixels with a finite depth above 0, with whole-number places."""
    depth = F.col("depth").cast("double")
    kept = pixels.where(finite(depth) & (depth > 0))
    return kept.select(*FRAME, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), depth.alias("depth"), *(features or []))


def to_world(x: Column, y: Column, z: Column) -> list[Column]:
    m = F.col("pose")
    return [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3)]


def to_camera(x: Column, y: Column, z: Column) -> list[Column]:
    """The rigid inverse: the transposed rotation of what is left after the translation."""
    m = F.col("pose")
    d = [x - m[3], y - m[7], z - m[11]]
    return [m[r] * d[0] + m[4 + r] * d[1] + m[8 + r] * d[2] for r in range(3)]


def band(pixels: DataFrame, cameras: DataFrame, size: float, truncation: float) -> DataFrame:
    """Distinct cells (batch_id, frame, i, j, k) that rays meet within `truncation` of their depth, at samples half a cell of depth apart.

    pixels: batch_id, frame, row, col, depth along the optical axis; cameras: batch_id, frame, fx, fy, cx, cy, pose.
    """
    steps = int(-(-truncation // (size / 2)))
    along = F.explode(F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda s: F.col("depth") + s * F.lit(size / 2)))
    seen = valid_pixels(pixels).join(usable(cameras), FRAME).withColumn("z", along).where("z > 0")
    at = to_world((F.col("col") - F.col("cx")) / F.col("fx") * F.col("z"), (F.col("row") - F.col("cy")) / F.col("fy") * F.col("z"), F.col("z"))
    return seen.select(*FRAME, *[F.floor(a / F.lit(float(size))).cast("long").alias(c) for c, a in zip(CELL, at, strict=True)]).distinct()


def samples(pixels: DataFrame, cameras: DataFrame, size: float, truncation: float, features: list[str] | None = None) -> DataFrame:
    """Cells of every frame's band with tsdf (signed distance over the truncation, at most 1), w = 1 and the pixel's features.

    A cell is measured by the pixel its centre falls on. Cells whose centre falls on no valid pixel, or lies
    more than the truncation behind the surface, give no sample.
    """
    centre = to_camera(*[(F.col(c) + 0.5) * F.lit(float(size)) for c in CELL])
    cells = band(pixels, cameras, size, truncation).join(usable(cameras), FRAME)
    cells = cells.withColumns(dict(zip(("eye_x", "eye_y", "eye_z"), centre, strict=True))).where("eye_z > 0")
    on = lambda f, a, c: F.floor(F.col(f) * F.col(a) / F.col("eye_z") + F.col(c) + 0.5).cast("long")
    placed = cells.select(*FRAME, *CELL, "eye_z", on("fy", "eye_y", "cy").alias("row"), on("fx", "eye_x", "cx").alias("col"))
    met = placed.join(valid_pixels(pixels, features), [*FRAME, "row", "col"])
    ahead = F.col("depth") - F.col("eye_z")
    value = F.least(F.lit(1.0), ahead / F.lit(float(truncation)))
    return met.where(ahead >= -truncation).select(*KEY, "frame", value.alias("tsdf"), F.lit(1.0).alias("w"), *(features or []))


def integrate(pixels: DataFrame, cameras: DataFrame, size: float, truncation: float | None = None, features: list[str] | None = None) -> DataFrame:
    """The grid of all frames: batch_id, i, j, k, weight, tsdf and mean features. The truncation is two cells unless given."""
    return voxel.fuse(samples(pixels, cameras, size, truncation or 2 * size, features), "tsdf", "w", *(features or []))


#: Corner n of a cell is n's bits as offsets along i, j, k. The six tetrahedra follow the paths from corner 0 to corner 7
#: that add one axis after the other.
TETRAHEDRA = [(0, a, a | b, 7) for a, b, _ in permutations((1, 2, 4))]


def _triangles(corners: tuple[int, ...], inside: list[bool]) -> list[list[tuple[int, int]]]:
    """Triangles that part the inner corners of a tetrahedron from the outer ones; a vertex is an edge (p, q), p within q."""
    place = lambda n: (n & 1, n >> 1 & 1, n >> 2 & 1)
    ins, outs = [c for c, i in zip(corners, inside, strict=True) if i], [c for c, i in zip(corners, inside, strict=True) if not i]
    if not ins or not outs:
        return []
    edge = lambda a, b: (min(a, b), max(a, b))
    if len(ins) == 2:
        ring = [edge(ins[0], outs[0]), edge(ins[0], outs[1]), edge(ins[1], outs[1]), edge(ins[1], outs[0])]
        faces = [ring[:3], [ring[0], ring[2], ring[3]]]
    else:
        lone, others = (ins[0], outs) if len(ins) == 1 else (outs[0], ins)
        faces = [[edge(lone, o) for o in others]]
    # Corners run counter-clockwise as seen from outside, where values are not negative.
    mean = lambda ns: [sum(place(n)[x] for n in ns) / len(ns) for x in range(3)]
    outward = [o - i for o, i in zip(mean(outs), mean(ins), strict=True)]
    turned = []
    for face in faces:
        p = [mean(e) for e in face]
        u, v = ([b - a for a, b in zip(p[0], p[n], strict=True)] for n in (1, 2))
        normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        turned.append(face if sum(a * b for a, b in zip(normal, outward, strict=True)) > 0 else face[::-1])
    return turned


def case_table() -> list[list[list[int]]]:
    """Triangles for each tetrahedron and each set of its corners with negative values (bit n: its n-th corner): edges as 8 p + q."""
    return [[[8 * p + q for p, q in face] for face in _triangles(t, [bool(case >> n & 1) for n in range(4)])] for t in TETRAHEDRA for case in range(16)]


def cut(voxels: DataFrame, value: str) -> DataFrame:
    """Corners of all triangles of the surface value = 0: cell, part (number of the triangle in it), turn (0 to 2), its lattice edge and position.

    A cell is a cube between eight voxel centres, all of which the grid must have. The lattice edge is the voxel it begins at
    (vi, vj, vk) and a direction (bits as of corners); x, y, z are in voxel units, a voxel's centre being its index.
    Negative values are inside; a value of 0 is outside. Null and NaN values count as missing voxels.
    """
    kept = voxels.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(n >> s & 1).cast("long").alias(f"d{c}") for s, c in enumerate(CELL)]) for n in range(8)])).alias("d")
    sent = kept.select("batch_id", *CELL, F.col(value).cast("double").alias("v"), corner)
    own = sent.select("batch_id", *[(F.col(c) - F.col(f"d.d{c}")).alias(c) for c in CELL], F.col("d.n").alias("n"), "v")
    cells = own.groupBy(*KEY).agg(F.count("*").alias("corners"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.max(F.when(F.col("n") == n, F.col("v"))).alias(f"v{n}") for n in range(8)])
    crossed = cells.where("corners = 8 and lo < 0 and hi >= 0").select(*KEY, F.array(*[f"v{n}" for n in range(8)]).alias("v"))
    tets = F.array(*[F.struct(F.lit(n).alias("tet"), sum((F.when(F.col("v")[c] < 0, 1 << b).otherwise(0) for b, c in enumerate(t)), F.lit(0)).alias("case")) for n, t in enumerate(TETRAHEDRA)])
    table = F.array(*[F.array(*[F.array(*map(F.lit, face)) for face in faces]) if faces else F.array().cast("array<array<int>>") for faces in case_table()])
    parts = F.flatten(F.transform(tets, lambda t: F.element_at(table, (t["tet"] * 16 + t["case"] + 1).cast("int"))))
    faces = crossed.select(*KEY, "v", F.posexplode(parts).alias("part", "edges"))
    turns = faces.select(*KEY, "part", "v", F.posexplode("edges").alias("turn", "edge"))
    p, q = F.floor(F.col("edge") / 8).cast("int"), (F.col("edge") % 8).cast("int")
    t = F.col("v")[p] / (F.col("v")[p] - F.col("v")[q])
    bit = lambda n, s: F.shiftright(n, s).bitwiseAND(1)
    start = [F.col(c) + bit(p, s) for s, c in enumerate(CELL)]
    return turns.select(*KEY, "part", "turn", *[a.alias(f"v{c}") for a, c in zip(start, CELL, strict=True)], (q - p).alias("direction"), *[(a + t * bit(q - p, s)).alias(x) for s, (a, x) in enumerate(zip(start, "xyz", strict=True))])


def mesh(voxels: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface: batch_id, vid, x, y, z in voxel units, and batch_id, fid, v0, v1, v2. Numbers count through all batches.

    One vertex for each lattice edge that the surface crosses, shared by all its triangles, which turn counter-clockwise seen from outside.
    """
    corners = stage(cut(voxels, value), "mesh-corners")
    at = ["batch_id", "vi", "vj", "vk", "direction"]
    # The same two values give every triangle at a lattice edge the same position.
    vertices = stage(order.global_rank(corners.groupBy(*at).agg(*[F.min(a).alias(a) for a in "xyz"]), at, "vid"), "mesh-vertices")
    met = corners.join(vertices.select(*at, "vid"), at)
    faces = met.groupBy(*KEY, "part").agg(*[F.max(F.when(F.col("turn") == n, F.col("vid"))).alias(f"v{n}") for n in range(3)])
    faces = order.global_rank(faces, [*KEY, "part"], "fid")
    return vertices.select("batch_id", "vid", "x", "y", "z"), faces.select("batch_id", "fid", "v0", "v1", "v2")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """batch_id, vid, nx, ny, nz: the unit sum of the area-weighted normals of a vertex's triangles; null where they cancel out."""
    rows = faces
    for n in range(3):
        rows = rows.join(vertices.select(F.col("vid").alias(f"v{n}"), *[F.col(a).alias(f"{a}{n}") for a in "xyz"]), f"v{n}")
    u = {a: F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"}
    v = {a: F.col(f"{a}2") - F.col(f"{a}0") for a in "xyz"}
    rows = rows.select(F.col("batch_id"), F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(u[a] * v[b] - u[b] * v[a]).alias(f"n{c}") for a, b, c in (("y", "z", "x"), ("z", "x", "y"), ("x", "y", "z"))])
    sums = rows.groupBy("batch_id", "vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    length = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in "yz"), F.col("nx") * F.col("nx")))
    return sums.withColumn("length", length).select("batch_id", "vid", *[F.when(F.col("length") > 0, F.col(f"n{a}") / F.col("length")).alias(f"n{a}") for a in "xyz"])
