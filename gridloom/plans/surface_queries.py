"""Queries over depth images, fused grids, triangle meshes and density trees."""

from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import crops, density, depth, mask, meshes, order, splats, voxel
from gridloom.plans.inputs import DENSE, LINES, PIX, PROBES, cells, dense, pixels, probes
from gridloom.plans.registry import query
from gridloom.session import stage, table

K = "batch_id, i, j, k"
SIZE, TRUNCATION = 0.5, 1.0


def depth_images(spark, d):
    """The dense images as depth maps of cameras that stand side by side, every other one turned by a right angle; whole eighths, so sums are exact."""
    pixels = dense(spark, d).select(F.lit("scene").alias("batch_id"), F.col("image_id").alias("frame"), "row", "col", (4 + F.col("value") % 16 / 8).alias("depth"), (F.col("value") % 5).cast("double").alias("shade"))
    turned = F.col("frame") % 2 == 1
    sine, cosine = F.when(turned, 1.0).otherwise(0.0), F.when(turned, 0.0).otherwise(1.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(cosine, -sine, zero, F.col("frame") / 4, sine, cosine, zero, zero, zero, zero, one, zero, zero, zero, zero, one)
    cameras = pixels.select("batch_id", "frame").distinct().select("batch_id", "frame", F.lit(32.0).alias("fx"), F.lit(32.0).alias("fy"), F.lit(11.0).alias("cx"), F.lit(25.0).alias("cy"), pose.alias("pose"))
    return pixels, cameras


#: Every cell that some ray meets is measured by the pixel its centre falls on.
FUSED = f"""{DENSE}, px AS (SELECT image_id AS frame, row, col, 4 + (value % 16)/8::DOUBLE AS depth, (value % 5)::DOUBLE AS shade, image_id % 2 = 1 AS t FROM dense),
ray AS (SELECT frame, t, (col - 11)/32::DOUBLE*z AS x, (row - 25)/32::DOUBLE*z AS y, z FROM (SELECT *, depth + s*{SIZE / 2}::DOUBLE AS z FROM px, (SELECT unnest(range(-4, 5)) AS s)) WHERE z > 0),
hit AS (SELECT DISTINCT frame, t, floor((CASE WHEN t THEN -y ELSE x END + frame/4)/{SIZE}::DOUBLE)::BIGINT AS i, floor((CASE WHEN t THEN x ELSE y END)/{SIZE}::DOUBLE)::BIGINT AS j, floor(z/{SIZE}::DOUBLE)::BIGINT AS k FROM ray),
eye AS (SELECT *, (i + 0.5::DOUBLE)*{SIZE}::DOUBLE - frame/4 AS a, (j + 0.5::DOUBLE)*{SIZE}::DOUBLE AS b, (k + 0.5::DOUBLE)*{SIZE}::DOUBLE AS z FROM hit),
pick AS (SELECT *, floor(32::DOUBLE*(CASE WHEN t THEN b ELSE a END)/z + 11 + 0.5)::BIGINT AS col, floor(32::DOUBLE*(CASE WHEN t THEN -a ELSE b END)/z + 25 + 0.5)::BIGINT AS row FROM eye WHERE z > 0),
sm AS (SELECT i, j, k, least(1::DOUBLE, (px.depth - pick.z)/{TRUNCATION}::DOUBLE) AS tsdf, px.shade FROM pick JOIN px ON px.frame = pick.frame AND px.row = pick.row AND px.col = pick.col WHERE px.depth - pick.z >= {-TRUNCATION}::DOUBLE),
fused AS (SELECT 'scene' AS batch_id, i, j, k, count(*)::DOUBLE AS weight, sum(tsdf)/count(*) AS tsdf, sum(shade)/count(*) AS shade FROM sm GROUP BY ALL)"""


@query("A17_depth_integration", f"WITH {FUSED} SELECT * FROM fused")
def a17_depth(spark, d):
    return depth.integrate(*depth_images(spark, d), SIZE, TRUNCATION, ["shade"])


def triangle_sql(value: str) -> str:
    """Triangles of a grid `vox` (batch_id, i, j, k, value): corner rows as depth.cut gives them, from the case table as a relation."""
    rows = ", ".join(f"({n // 16}, {n % 16}, {f}, {t}, {e // 8}, {e % 8})" for n, faces in enumerate(depth.case_table()) for f, face in enumerate(faces) for t, e in enumerate(face))
    tets = ", ".join(f"({n}, {b}, {c})" for n, t in enumerate(depth.TETRAHEDRA) for b, c in enumerate(t))
    return f"""ct(tet, cas, f, turn, p, q) AS (VALUES {rows}), tt(tet, b, c) AS (VALUES {tets}),
co AS (SELECT batch_id, i - (n & 1) AS i, j - (n >> 1 & 1) AS j, k - (n >> 2 & 1) AS k, n, {value}::DOUBLE AS v FROM vox, (SELECT unnest(range(8))::INT AS n)),
cc AS (SELECT * FROM co QUALIFY count(*) OVER (PARTITION BY {K}) = 8),
cs AS (SELECT {K}, tet, sum(CASE WHEN v < 0 THEN 1 << b ELSE 0 END) AS cas FROM cc JOIN tt ON c = n GROUP BY ALL),
tr AS (SELECT cs.batch_id, cs.i, cs.j, cs.k, ct.tet*2 + f AS part, turn, p, q, a.v AS vp, b.v AS vq FROM cs JOIN ct ON ct.tet = cs.tet AND ct.cas = cs.cas JOIN cc a ON a.batch_id = cs.batch_id AND a.i = cs.i AND a.j = cs.j AND a.k = cs.k AND a.n = p JOIN cc b ON b.batch_id = cs.batch_id AND b.i = cs.i AND b.j = cs.j AND b.k = cs.k AND b.n = q),
corners AS (SELECT batch_id, i + (p & 1) AS vi, j + (p >> 1 & 1) AS vj, k + (p >> 2 & 1) AS vk, q - p AS direction, vp/(vp - vq) AS t FROM tr)"""


VERTICES = "SELECT batch_id, vi, vj, vk, direction, count(*) AS triangles, round(vi + min(t)*(direction & 1), 9) AS x, round(vj + min(t)*(direction >> 1 & 1), 9) AS y, round(vk + min(t)*(direction >> 2 & 1), 9) AS z FROM corners GROUP BY 1, 2, 3, 4, 5"


def shared(corners):
    return corners.groupBy("batch_id", "vi", "vj", "vk", "direction").agg(F.count("*").alias("triangles"), *[F.round(F.min(a), 9).alias(a) for a in "xyz"])


@query("C14_triangles", f"WITH {LINES}, vox AS (SELECT {K}, sum(CASE WHEN line_status='F' THEN 1 ELSE -1 END) AS v FROM lines GROUP BY ALL), {triangle_sql('v')} {VERTICES}")
def c14_triangles(spark, d):
    v = cells(spark, d).groupBy(*voxel.KEY).agg(F.sum(F.when(F.col("line_status") == "F", 1).otherwise(-1)).alias("v"))
    return shared(depth.cut(v, "v"))


@query("A17_C14_depth_mesh", f"WITH {FUSED}, vox AS (SELECT * FROM fused), {triangle_sql('tsdf')}, vs AS ({VERTICES}) SELECT count(*) AS vertices, (sum(triangles)//3)::BIGINT AS faces, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z FROM vs")
def depth_mesh(spark, d):
    grid = depth.integrate(*depth_images(spark, d), SIZE, TRUNCATION)
    vertices, faces = depth.mesh(grid, "tsdf")
    sums = vertices.agg(F.count("*").alias("vertices"), *[F.round(F.sum(F.round(a, 9)), 4).alias(a) for a in "xyz"])
    return sums.join(F.broadcast(faces.agg(F.count("*").alias("faces")))).select("vertices", "faces", "x", "y", "z")  # one row each


def customers(spark, d):
    """Customers as points with whole-number coordinates."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 37 % 400).cast("double").alias("x"), (F.col("c_nationkey") * 16).cast("double").alias("y"), F.round(F.col("c_acctbal") / 25).alias("z"))


CUSTOMERS = "cu AS (SELECT c_custkey AS pid, (c_custkey*37 % 400)::DOUBLE AS x, (c_nationkey*16)::DOUBLE AS y, round(c_acctbal/25::DOUBLE) AS z FROM customer)"


def far_sql(points: str) -> str:
    return f"SELECT a.pid AS a, b.pid AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM {points} a, {points} b"


@query("C7_core_distances", f"WITH {CUSTOMERS} SELECT a AS id, round(d, 9) AS core FROM ({far_sql('cu')}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 5")
def c7_cores(spark, d):
    return density.core_distances(customers(spark, d), 5, 32.0).select("id", F.round("core", 9).alias("core"))


@query(
    "C7_spanning_tree",
    f"""WITH RECURSIVE {PROBES}, pr AS MATERIALIZED ({far_sql('probes')}), co AS (SELECT a, d AS core FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 3),
e AS MATERIALIZED (SELECT pr.a, pr.b, greatest(d, x.core, y.core) AS w FROM pr JOIN co x ON x.a = pr.a JOIN co y ON y.a = pr.b WHERE pr.a <> pr.b),
grow(n, inside, w, lo, hi) AS (SELECT 1::BIGINT, [min(pid)], NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT FROM probes UNION ALL
  SELECT n + 1, list_append(inside, s.b), s.w, s.lo, s.hi FROM (SELECT n, inside, (SELECT min({{'w': e.w, 'lo': least(e.a, e.b)::BIGINT, 'hi': greatest(e.a, e.b)::BIGINT, 'b': e.b}}) FROM e WHERE list_contains(inside, e.a) AND NOT list_contains(inside, e.b)) AS s FROM grow) WHERE s IS NOT NULL)
SELECT lo AS a, hi AS b, round(w, 9) AS weight FROM grow WHERE w IS NOT NULL""",
)
def c7_tree(spark, d):
    points = probes(spark, d)
    tree = density.spanning_tree(points, stage(density.core_distances(points, 3, 400.0), "cores"), 400.0)
    return tree.select("a", "b", F.round("weight", 9).alias("weight"))


@query("C7_density_clusters")
def c7_clusters(spark, d):
    found = density.cluster(customers(spark, d), 4, 8, 32.0)
    return found.select("pid", "label", F.round("prob", 9).alias("prob"))


def line_mesh(spark, d):
    """The surface between line items of either status: open where the grid ends."""
    v = cells(spark, d).groupBy(*voxel.KEY).agg(F.sum(F.when(F.col("line_status") == "F", 1).otherwise(-1)).alias("v"))
    return depth.mesh(v, "v")


#: Faces of that mesh by numbered vertices, and its open edges with the edge that follows each.
LINE_MESH = f"""{LINES}, vox AS (SELECT {K}, sum(CASE WHEN line_status='F' THEN 1 ELSE -1 END) AS v FROM lines GROUP BY ALL), {triangle_sql('v').replace("AS direction, vp/(vp - vq) AS t FROM tr", "AS direction, vp/(vp - vq) AS t, i, j, k, part, turn FROM tr")},
vn AS (SELECT *, row_number() OVER (ORDER BY batch_id, vi, vj, vk, direction) - 1 AS vid FROM (SELECT batch_id, vi, vj, vk, direction, min(t) AS t FROM corners GROUP BY ALL)),
pos AS MATERIALIZED (SELECT vid, vi + t*(direction & 1) AS x, vj + t*(direction >> 1 & 1) AS y, vk + t*(direction >> 2 & 1) AS z FROM vn),
fa AS MATERIALIZED (SELECT max(CASE WHEN turn = 0 THEN vid END) AS v0, max(CASE WHEN turn = 1 THEN vid END) AS v1, max(CASE WHEN turn = 2 THEN vid END) AS v2 FROM corners c JOIN vn USING (batch_id, vi, vj, vk, direction) GROUP BY batch_id, c.i, c.j, c.k, c.part),
he AS (SELECT v0 AS a, v1 AS b FROM fa UNION ALL SELECT v1, v2 FROM fa UNION ALL SELECT v2, v0 FROM fa),
net AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, sum(CASE WHEN a < b THEN 1 ELSE -1 END) AS s FROM he WHERE a <> b GROUP BY ALL HAVING s <> 0),
oe AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b, copy) AS e, a, b FROM (SELECT CASE WHEN s > 0 THEN lo ELSE hi END AS a, CASE WHEN s > 0 THEN hi ELSE lo END AS b, unnest(range(1, abs(s)::BIGINT + 1)) AS copy FROM net)),
nx AS MATERIALIZED (SELECT x.e, y.e AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY e) AS turn FROM oe) x JOIN (SELECT *, row_number() OVER (PARTITION BY a ORDER BY e) AS turn FROM oe) y ON y.a = x.b AND y.turn = x.turn),
walk(first_e, cur, n) AS (SELECT e, e, 0 FROM nx UNION ALL SELECT first_e, nxt, n + 1 FROM walk JOIN nx ON nx.e = cur WHERE nxt <> first_e),
lp AS MATERIALIZED (SELECT first_e AS least_e, cur AS e, n AS place, count(*) OVER (PARTITION BY first_e) AS size FROM walk QUALIFY min(cur) OVER (PARTITION BY first_e) = first_e),
ld AS (SELECT dense_rank() OVER (ORDER BY least_e) - 1 AS loop, place, size, a, b FROM lp JOIN oe USING (e))"""


@query("C13_boundary_loops", f"WITH RECURSIVE {LINE_MESH} SELECT loop, place::BIGINT AS place, size, a, b FROM ld")
def c13_loops(spark, d):
    return meshes.boundary_loops(line_mesh(spark, d)[1])


COT = "((p.x-r.x)*(q.x-r.x)+(p.y-r.y)*(q.y-r.y)+(p.z-r.z)*(q.z-r.z))/nullif(sqrt(((p.y-r.y)*(q.z-r.z)-(p.z-r.z)*(q.y-r.y))**2+((p.z-r.z)*(q.x-r.x)-(p.x-r.x)*(q.z-r.z))**2+((p.x-r.x)*(q.y-r.y)-(p.y-r.y)*(q.x-r.x))**2), 0)"


@query(
    "C13_filled_gaps",
    f"""WITH RECURSIVE {LINE_MESH}, ce AS MATERIALIZED (SELECT loop, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ld JOIN pos ON vid = a WHERE size >= 3 GROUP BY 1),
co2 AS (SELECT p.loop, q.x, q.y, q.z, {COT} AS w FROM ld JOIN ce p ON p.loop = ld.loop JOIN pos q ON q.vid = ld.a JOIN pos r ON r.vid = ld.b UNION ALL SELECT p.loop, q.x, q.y, q.z, {COT} FROM ld JOIN ce p ON p.loop = ld.loop JOIN pos q ON q.vid = ld.b JOIN pos r ON r.vid = ld.a),
su AS (SELECT loop, count(*) FILTER (w IS NULL) AS odd, sum(w) AS w, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM co2 GROUP BY 1)
SELECT loop, {', '.join(f'round(CASE WHEN odd = 0 AND su.w > 1e-12::DOUBLE THEN su.{c}/su.w ELSE ce.{c} END, 5) AS {c}' for c in 'xyz')}, (SELECT count(*) FROM ld l WHERE l.loop = ce.loop) AS faces FROM ce JOIN su USING (loop)""",
)
def c13_filled(spark, d):
    vertices, faces = line_mesh(spark, d)
    more_v, more_f = meshes.fill_gaps(vertices, faces)
    first = vertices.agg(F.max("vid").alias("last"))
    caps = more_v.join(F.broadcast(first)).where("vid > last").withColumn("n", F.col("vid") - F.col("last") - 1)  # one row
    around = more_f.groupBy(F.col("v0").alias("vid")).agg(F.count("*").alias("faces"))
    # Loops of fewer than three edges have no cap, so caps count through the others.
    numbers = order.global_rank(meshes.boundary_loops(faces).where("size >= 3").select("loop").distinct(), ["loop"], "n")
    return caps.join(around, "vid").join(numbers, "n").select("loop", *[F.round(c, 5).alias(c) for c in "xyz"], "faces")


def part_splats(spark, d):
    """Parts as splats before two cameras."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    splats_ = p.select(F.lit("scene").alias("batch_id"), key.alias("sid"), (key * 37 % 400 / 100 - 2).alias("x"), (key * 53 % 300 / 100 - 1.5).alias("y"), (4 + F.col("p_size") / 16).alias("z"), *[(0.0625 + key % m / 32).alias(s) for s, m in (("sx", 3), ("sy", 4), ("sz", 5))], F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(q) for q in ("qx", "qy", "qz")], ((key % 9 + 1) / 10).alias("opacity"))
    pose = [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("frame") / 2, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("frame").cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    cameras = spark.range(2).select(F.lit("scene").alias("batch_id"), F.col("id").alias("frame")).select("*", F.lit(32.0).alias("fx"), F.lit(32.0).alias("fy"), F.lit(32.0).alias("cx"), F.lit(24.0).alias("cy"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.array(*pose).alias("pose"))
    return splats_, cameras


SHOWN = """sp AS (SELECT p_partkey AS sid, p_partkey*37 % 400/100::DOUBLE - 2 AS x, p_partkey*53 % 300/100::DOUBLE - 1.5 AS y, 4 + p_size/16::DOUBLE AS z, 0.0625 + p_partkey % 3/32::DOUBLE AS sx, 0.0625 + p_partkey % 4/32::DOUBLE AS sy, 0.0625 + p_partkey % 5/32::DOUBLE AS sz, (p_partkey % 9 + 1)/10::DOUBLE AS op FROM part),
ey AS (SELECT sid, frame, sx, sy, sz, op, x - frame/2::DOUBLE AS x, y, z - frame AS z FROM sp, (SELECT unnest([0, 1]) AS frame)),
fp AS (SELECT *, 32*x/z + 32 AS u, 32*y/z + 24 AS v, (32/z*sx)**2 + (32*x/(z*z)*sz)**2 + 0.3::DOUBLE AS xx, 32*x/(z*z)*sz*32*y/(z*z)*sz AS xy, (32/z*sy)**2 + (32*y/(z*z)*sz)**2 + 0.3::DOUBLE AS yy, 2*ln(op*255) AS reach FROM ey WHERE z > 0.01 AND op*255 >= 1),
al AS (SELECT frame, r AS row, c AS col, sid, z AS depth, least(0.999::DOUBLE, op*exp(-0.5::DOUBLE*(yy*(c+0.5-u)**2 - 2*xy*(c+0.5-u)*(r+0.5-v) + xx*(r+0.5-v)**2)/(xx*yy - xy*xy))) AS alpha FROM (SELECT *, unnest(range(greatest(0, ceil(u - sqrt(reach*xx) - 0.5))::BIGINT, least(63, floor(u + sqrt(reach*xx) - 0.5))::BIGINT + 1)) AS c FROM (SELECT *, unnest(range(greatest(0, ceil(v - sqrt(reach*yy) - 0.5))::BIGINT, least(47, floor(v + sqrt(reach*yy) - 0.5))::BIGINT + 1)) AS r FROM fp))),
bl AS (SELECT *, exp(sum(ln(1 - alpha)) OVER w) AS lft, row_number() OVER w - 1 AS place FROM al WHERE alpha*255 >= 1 WINDOW w AS (PARTITION BY frame, row, col ORDER BY depth, sid ROWS UNBOUNDED PRECEDING))"""


@query("N4_contributors", f"WITH {SHOWN} SELECT frame, row, col, place::INT AS place, sid, round(alpha*lft/(1 - alpha), 6) AS weight FROM bl WHERE lft > 0.0001")
def n4(spark, d):
    return splats.contributors(*part_splats(spark, d)).select("frame", "row", "col", "place", "sid", F.round("weight", 6).alias("weight"))


RAYS = "SELECT o_orderkey AS ray, (o_custkey % 13)/7::DOUBLE AS ox, (o_custkey % 17)/11::DOUBLE AS oy, (o_orderkey % 19)/13::DOUBLE AS oz, (o_orderkey % 7 - 3)/9::DOUBLE + 0.011 AS dx, (o_orderkey % 5 - 2)/17::DOUBLE + 0.013 AS dy, (o_custkey % 11 - 5)/23::DOUBLE + 0.017 AS dz FROM orders"


@query(
    "Z6_ray_cells",
    f"WITH r AS ({RAYS}), e AS (SELECT *, {', '.join(f'floor((o{a} + {t}*d{a})/0.3)::BIGINT AS {n}{a}' for n, t in (('f', '0.2'), ('l', '9.7')) for a in 'xyz')} FROM r) SELECT ray, 1 + abs(lx - fx) + abs(ly - fy) + abs(lz - fz) AS cells, fx, fy, fz, lx, ly, lz FROM e".replace("0.2*", "0.2::DOUBLE*").replace("9.7*", "9.7::DOUBLE*").replace("/0.3", "/0.3::DOUBLE"),
)
def z6(spark, d):
    tables.register(spark)
    o = table(spark, d, "orders")
    part = lambda c, m, s, n: ((F.col(c) % m - s) / n)
    rays = o.select(F.col("o_orderkey").alias("ray"), part("o_custkey", 13, 0, 7).alias("ox"), part("o_custkey", 17, 0, 11).alias("oy"), part("o_orderkey", 19, 0, 13).alias("oz"), (part("o_orderkey", 7, 3, 9) + 0.011).alias("dx"), (part("o_orderkey", 5, 2, 17) + 0.013).alias("dy"), (part("o_custkey", 11, 5, 23) + 0.017).alias("dz"))
    walk = tables.WalkCells(*[F.col(c).outer() for c in ("ox", "oy", "oz", "dx", "dy", "dz")], F.lit(0.3), F.lit(0.2), F.lit(9.7))
    met = rays.lateralJoin(walk)
    ends = [F.min_by(c, F.struct("enter", "leave")).alias(f"f{a}") for c, a in zip("ijk", "xyz", strict=True)] + [F.max_by(c, F.struct("leave", "enter")).alias(f"l{a}") for c, a in zip("ijk", "xyz", strict=True)]
    return met.groupBy("ray").agg(F.count("*").alias("cells"), *ends)


#: The pixel masks as seen on crops of images of 24 by 52 pixels: the image and two by two crops that share 7 pixels.
WIDTH, HEIGHT = 24, 52


def crop_sql() -> str:
    shared = int(512 / 1500 * min(WIDTH, HEIGHT))
    size = [-(-(shared + whole) // 2) for whole in (WIDTH, HEIGHT)]
    grid = [(0, 0, 0, WIDTH, HEIGHT)]
    grid += [(1 + 2 * x + y, (size[0] - shared) * x, (size[1] - shared) * y, min((size[0] - shared) * x + size[0], WIDTH), min((size[1] - shared) * y + size[1], HEIGHT)) for x in (0, 1) for y in (0, 1)]
    return ", ".join(map(str, grid))


def greedy_sql(name: str, source: str, group: str, order: str) -> str:
    """Boxes of a relation that greedy suppression at 0.7 keeps: in the order of rank, each against those kept before."""
    cut = "len(list_filter(list_transform(kept, lambda b: [greatest(least(b.x1,r.x1)-greatest(b.x0,r.x0),0)*greatest(least(b.y1,r.y1)-greatest(b.y0,r.y0),0), (b.x1-b.x0)*(b.y1-b.y0)+(r.x1-r.x0)*(r.y1-r.y0)]), lambda s: s[2]>s[1] AND s[1]/(s[2]-s[1])::DOUBLE > 0.7::DOUBLE))=0"
    one = "{'crop': r.crop, 'mask_id': r.mask_id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}"
    return f"""{name}_r AS MATERIALIZED (SELECT *, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {order} DESC, crop, mask_id) AS n FROM {source}),
{name}_s(grp, n, kept) AS (SELECT grp, n, [{one}] FROM {name}_r r WHERE n = 1 UNION ALL SELECT r.grp, r.n, CASE WHEN {cut} THEN list_append(kept, {one}) ELSE kept END FROM {name}_s s JOIN {name}_r r ON r.grp = s.grp AND r.n = s.n + 1),
{name} AS (SELECT r.* FROM {name}_r r JOIN (SELECT grp, unnest(arg_max(kept, n)) AS b FROM {name}_s GROUP BY 1) k ON k.grp = r.grp AND k.b.crop = r.crop AND k.b.mask_id = r.mask_id)"""


@query(
    "C4_crop_assembly",
    f"""WITH RECURSIVE {PIX}, cr(crop, cx0, cy0, cx1, cy1) AS (VALUES {crop_sql()}),
bx AS (SELECT image_id, crop, mask_id, min(col) AS x0, min(row) AS y0, max(col) AS x1, max(row) AS y1, count(*) AS area, count(*)/64::DOUBLE AS score, any_value(1/((cx1-cx0)*(cy1-cy0))) AS small FROM pix, cr WHERE col >= cx0 AND col < cx1 AND row >= cy0 AND row < cy1 GROUP BY 1, 2, 3),
st AS (SELECT bx.* FROM bx JOIN cr USING (crop) WHERE NOT ((abs(x0-cx0) <= 1 AND abs(x0) > 1) OR (abs(y0-cy0) <= 1 AND abs(y0) > 1) OR (abs(x1-cx1) <= 1 AND abs(x1-{WIDTH}) > 1) OR (abs(y1-cy1) <= 1 AND abs(y1-{HEIGHT}) > 1))),
{greedy_sql('own', 'st', 'image_id * 8 + crop', 'score')}, al AS (SELECT * EXCLUDE (grp, n) FROM own), {greedy_sql('fin', 'al', 'image_id', 'small')}
SELECT image_id, crop, mask_id, x0, y0, x1, y1, area, score FROM fin""",
)
def c4(spark, d):
    # A mask's pixels lie together, so that each task adds up most of a mask before its counts move.
    px = stage(pixels(spark, d).repartition("image_id", "mask_id").distinct(), "crop-pixels")
    images = stage(px.select("image_id").distinct().select("image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")), "crop-images")
    grid = stage(crops.crop_boxes(images, 1), "crop-grid")
    seen = px.join(grid, "image_id").where("col >= x0 and col < x1 and row >= y0 and row < y1").select("image_id", "crop", "mask_id", (F.col("row") - F.col("y0")).alias("row"), (F.col("col") - F.col("x0")).alias("col"))
    scores = seen.groupBy("image_id", "crop", "mask_id").agg((F.count("*") / 64).alias("score"))
    return crops.assemble(seen, scores, images, 1, near=1.0)


@query(
    "X19_skeleton",
    f"""WITH RECURSIVE {PIX}, nb(bit, a, b) AS (VALUES (1,-1,0),(2,-1,1),(4,0,1),(8,1,1),(16,1,0),(32,1,-1),(64,0,-1),(128,-1,-1)),
bits AS (SELECT unnest(range(256)) AS code), gone AS MATERIALIZED (SELECT phase, code FROM bits, (SELECT unnest([0, 1]) AS phase) WHERE bit_count(code::INT) BETWEEN 2 AND 6
  AND len(list_filter(range(8), lambda n: (code >> n) & 1 = 0 AND (code >> ((n + 1) % 8)) & 1 = 1)) = 1 AND CASE WHEN phase = 0 THEN (code & 21) <> 21 AND (code & 84) <> 84 ELSE (code & 69) <> 69 AND (code & 81) <> 81 END),
th(n, image_id, mask_id, row, col) AS (SELECT DISTINCT 0, image_id, mask_id % 4, row, col FROM pix UNION ALL
  SELECT n + 1, image_id, mask_id, row, col FROM (SELECT p.n, p.image_id, p.mask_id, p.row, p.col, sum(CASE WHEN q.n IS NULL THEN 0 ELSE bit END) AS code FROM th p CROSS JOIN nb LEFT JOIN th q ON q.image_id = p.image_id AND q.mask_id = p.mask_id AND q.row = p.row + a AND q.col = p.col + b GROUP BY 1, 2, 3, 4, 5) c WHERE n < 60 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.phase = c.n % 2 AND g.code = c.code))
SELECT image_id, mask_id, row, col FROM th WHERE n = 60""",
)
def x19(spark, d):
    return mask.skeleton(pixels(spark, d).withColumn("mask_id", F.col("mask_id") % 4))
