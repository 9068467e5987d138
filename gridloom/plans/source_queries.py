"""Queries over readers: the standard tables are written in a format to the shared folder and read back by its reader."""

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.session import shared_path, table
from gridloom.sources import readers, scene_binary


def write_text(df: DataFrame, value: Column, name: str, *by: str) -> str:
    """A line of text for each row, in a folder for each value of the `by` columns; the path."""
    path = shared_path(df.sparkSession, name)
    df.select(*by, value.alias("value")).write.partitionBy(*by).text(path)
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(content)
    out.close()


@query(
    "S2_S3_S6_S7_scans",
    """WITH f AS (SELECT n_nationkey AS n, n_regionkey AS r, row_number() OVER (ORDER BY n_regionkey, n_nationkey)-1 AS index FROM nation)
    SELECT printf('%02d', r) AS sequence, printf('%06d', n) AS frame, index::INT AS index, p AS pid, (n+p)::DOUBLE AS x, r::DOUBLE AS y, p/2 AS z, n/4 AS intensity,
        CASE WHEN n%2=0 THEN 10*((n+p)%3) ELSE 0 END AS semantic, CASE WHEN n%2=0 THEN n+1 ELSE 0 END AS instance FROM f, range(3) t(p)""",
)
def scans(spark, d):
    """A frame for each of the 25 nations in a sequence for each region, with equal frame names; every other one has labels."""
    path = shared_path(spark, "scans")
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").toLocalIterator():  # 25 rows at every size
        n, folder = r.n_nationkey, f"{path}/sequences/{r.n_regionkey:02d}"
        points = [v for p in range(3) for v in (n + p, r.n_regionkey, p / 2, n / 4)]
        write_bytes(spark, f"{folder}/velodyne/{n:06d}.bin", struct.pack("<12f", *points))
        if n % 2 == 0:
            write_bytes(spark, f"{folder}/labels/{n:06d}.label", struct.pack("<3I", *(((n + 1) << 16) | (n + p) % 3 for p in range(3))))
    rows = readers.lidar_sequence(spark, path, {0: 0, 1: 10, 2: 20})
    numbers = readers.frame_index(rows)
    kinds = {c: F.col(c).cast("double") for c in ("x", "y", "z", "intensity")} | {c: F.col(c).cast("long") for c in ("semantic", "instance")}
    return rows.join(numbers, ["sequence", "frame"]).withColumns(kinds).select("sequence", "frame", "index", "pid", "x", "y", "z", "intensity", "semantic", "instance")


@query("S5_calibration", "SELECT 'P' || s_suppkey AS key, 12 AS n, s_suppkey/4 AS second, 11*s_suppkey/4 AS corner, 1.0::DOUBLE AS last FROM supplier")
def calibrations(spark, d):
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: (j * F.col("s_suppkey") / 4).cast("string")), " ")
    path = write_text(table(spark, d, "supplier"), F.concat(F.lit("P"), F.col("s_suppkey"), F.lit(": "), numbers), "calibration")
    rows = readers.calibration(spark, path).withColumn("e", readers.extrinsics(F.col("m")))
    return rows.select("key", F.size("m").alias("n"), F.col("e")[0][1].alias("second"), F.col("e")[2][3].alias("corner"), F.col("e")[3][3].alias("last"))


@query(
    "S11_samples",
    """WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)-1 AS sample FROM supplier)
    SELECT n, sample::INT AS sample, p::INT AS pos, (k+p)::DOUBLE AS x, (n*p)::DOUBLE AS y, p/2 AS z, (k%7)::DOUBLE AS label FROM s, range(3) t(p)""",
)
def samples(spark, d):
    """A file for each nation, an array of a sample for each supplier, of three points each."""
    at = lambda make: F.transform(F.sequence(F.lit(0), F.lit(2)), make)
    xyz = at(lambda p: F.array((F.col("s_suppkey") + p).cast("double"), (F.col("s_nationkey") * p).cast("double"), p / 2))
    one = F.struct("s_suppkey", F.lit(3).alias("num_points"), xyz.alias("xyz"), xyz.alias("grid_coords"), xyz.alias("color"), at(lambda p: F.col("s_suppkey") % 7).alias("label"))
    files = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.sort_array(F.collect_list(one)).alias("s"))
    rows = readers.sample_json(spark, write_text(files, F.to_json("s"), "samples", "n"))
    return rows.select(F.regexp_extract("file", r"/n=(\d+)/", 1).cast("long").alias("n"), "sample", "pos", "x", "y", "z", "label")


@query(
    "S18_masks",
    """SELECT s_suppkey AS image_id, s_suppkey%3 AS category_id, r::INT AS row, c::INT AS col FROM supplier, range(30) t(r), range(40) u(c)
    WHERE (c>=s_suppkey%20 AND c<s_suppkey%20+9 AND r>=s_nationkey%15 AND r<s_nationkey%15+6) OR (c*30+r>=100 AND c*30+r<100+s_nationkey)""",
)
def masks(spark, d):
    """A file for each nation; every supplier is an image with a rectangle and a run in one category."""
    x, y, k = F.col("s_suppkey") % 20, F.col("s_nationkey") % 15, F.col("s_suppkey")
    image = F.format_string('{"id": %d, "height": 30, "width": 40}', k)
    box = F.format_string('{"image_id": %d, "category_id": %d, "segmentation": [[%d, %d, %d, %d, %d, %d, %d, %d]]}', k, k % 3, x, y, x + 9, y, x + 9, y + 6, x, y + 6)
    run = F.format_string('{"image_id": %d, "category_id": %d, "segmentation": {"size": [30, 40], "counts": [100, %d, %d]}}', k, k % 3, F.col("s_nationkey"), 1100 - F.col("s_nationkey"))
    files = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.collect_list(image).alias("images"), F.flatten(F.collect_list(F.array(box, run))).alias("annotations"))
    text = F.concat(F.lit('{"images": ['), F.array_join("images", ", "), F.lit('], "annotations": ['), F.array_join("annotations", ", "), F.lit("]}"))
    return readers.coco(spark, write_text(files, text, "masks", "n"))


@query("S20_camera_path", "SELECT n_nationkey::INT AS pos, (30+n_nationkey)::DOUBLE AS fov, round(480/2/tan(radians(30+n_nationkey)/2), 6) AS focal, (n_regionkey+15)::DOUBLE AS last FROM nation")
def cameras(spark, d):
    """One path over the 25 nations."""
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (F.col("n_regionkey") + j).cast("double"))
    one = F.struct("n_nationkey", matrix.alias("camera_to_world"), (F.col("n_nationkey") + 30).cast("double").alias("fov"), F.lit(4 / 3).alias("aspect"))
    path = table(spark, d, "nation").agg(F.sort_array(F.collect_list(one)).alias("camera_path"))
    text = F.to_json(F.struct(F.lit(480.0).alias("render_height"), F.lit(640.0).alias("render_width"), "camera_path"))
    rows = readers.camera_path(spark, write_text(path, text, "camera-path"))
    return rows.select("pos", "fov", F.round("focal", 6).alias("focal"), F.col("camera_to_world")[15].alias("last"))


@query(
    "S25_pose_files",
    """SELECT n_name AS file_path, (row_number() OVER (PARTITION BY r ORDER BY n_nationkey)-1)::INT AS pos, CASE r WHEN 0 THEN 'PINHOLE' WHEN 3 THEN 'OPENCV' ELSE 'SIMPLE_PINHOLE' END AS model,
        CASE r WHEN 0 THEN 500 WHEN 1 THEN 400 WHEN 4 THEN 300 ELSE 640 END::DOUBLE AS fx, CASE r WHEN 0 THEN 510 WHEN 1 THEN 400 WHEN 4 THEN 300 ELSE 640 END::DOUBLE AS fy,
        CASE r WHEN 2 THEN 100 ELSE 320 END::DOUBLE AS cx, 240::DOUBLE AS cy, n_nationkey::DOUBLE AS shift FROM (SELECT *, n_regionkey AS r FROM nation)""",
)
def pose_files(spark, d):
    """A file for each region, each with other intrinsics: both focal lengths, one name for both, none, distortion, equal ones."""
    r = F.col("n_regionkey")
    given = {"fl_x": {0: 500.0, 4: 300.0}, "fl_y": {0: 510.0, 4: 300.0}, "focal_length": {1: 400.0}, "cx": {2: 100.0}, "k1": {3: 0.01}}
    known = [F.coalesce(*[F.when(r == n, F.lit(v)) for n, v in at.items()], F.lit(None).cast("double")).alias(c) for c, at in given.items()]
    matrix = F.array(*[F.array(*[(F.col("n_nationkey") if (i, j) == (0, 3) else F.lit(float(i == j))).cast("double") for j in range(4)]) for i in range(4)])
    frame = F.struct("n_nationkey", F.col("n_name").alias("file_path"), matrix.alias("transform_matrix"))
    files = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    text = F.to_json(F.struct(F.lit(640.0).alias("w"), F.lit(480.0).alias("h"), *known, "frames"))
    rows = readers.transforms(spark, write_text(files, text, "poses", "n_regionkey"))
    return rows.select("file_path", "pos", "model", "fx", "fy", "cx", "cy", F.col("transform_matrix")[0][3].alias("shift"))


def binary_scene(spark, d, *names):
    """Suppliers as cameras, orders as images that see their line items, parts as points with the line items as tracks: those named, written and read as binary files."""
    path = shared_path(spark, "scene")
    li, kinds = table(spark, d, "lineitem"), sorted(scene_binary.MODELS)
    model, sizes = (F.element_at(F.array(*[F.lit(scene_binary.MODELS[k][n]) for k in kinds]), (F.col("s_suppkey") % len(kinds) + 1).cast("int")) for n in (0, 1))
    cameras = table(spark, d, "supplier").select(F.col("s_suppkey").alias("camera_id"), model.alias("model"), (F.col("s_nationkey") + 640).alias("width"), F.lit(480).alias("height"), F.transform(F.sequence(F.lit(1), sizes), lambda n: F.col("s_acctbal") + n).alias("params"))
    seen = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_partkey").alias("pid")))).alias("s"))
    seen = seen.select("l_orderkey", F.transform("s", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["pid"].alias("pid"))).alias("seen"))
    orders = table(spark, d, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    images = orders.select(F.col("o_orderkey").alias("image_id"), F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")], F.col("o_totalprice").alias("tx"), *[F.lit(0.0).alias(c) for c in ("ty", "tz")], (F.col("o_custkey") % 10).alias("camera_id"), F.concat("o_orderpriority", F.lit("/é "), F.col("o_orderkey").cast("string")).alias("name"), "seen")
    track = li.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("place")))).alias("track"))
    points = table(spark, d, "part").join(track, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.5).alias("z"), *[(F.col("p_partkey") % m).cast("int").alias(c) for c, m in zip("rgb", (256, 100, 7), strict=True)], (F.col("p_size") / 4).alias("error"), "track")
    tables = {"cameras": cameras, "images": images, "points": points}
    scene_binary.write_scene(path, part_bytes=1 << 20, **{n: tables[n] for n in names})
    return readers.load_scene(spark, path, "colmap_binary")


@query(
    "S13_K10_binary_images",
    f"""WITH m(n, model, params) AS (VALUES {", ".join(f"({n}, '{name}', {size})" for n, (name, size) in scene_binary.MODELS.items())}), c AS (SELECT s_suppkey, s_nationkey, s_acctbal, model, params FROM supplier JOIN m ON n = s_suppkey % {len(scene_binary.MODELS)})
    SELECT o_orderkey AS image_id, o_orderpriority || '/é ' || o_orderkey AS name, o_totalprice AS tx, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey) - 1 AS place, l_quantity AS x, l_extendedprice AS y, l_partkey AS pid, model, s_nationkey + 640 AS width, params AS n_params, s_acctbal + params AS last_param FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN c ON s_suppkey = o_custkey % 10""",
)
def binary_images(spark, d):
    scene = binary_scene(spark, d, "cameras", "images")
    cameras = scene["cameras"].select("camera_id", "model", "width", F.size("params").alias("n_params"), F.element_at("params", -1).alias("last_param"))
    return scene["images"].join(cameras, "camera_id").select("image_id", "name", "tx", F.posexplode("seen").alias("place", "s"), "model", "width", "n_params", "last_param").select("image_id", "name", "tx", "place", "s.x", "s.y", "s.pid", "model", "width", "n_params", "last_param")


@query("S13_K10_binary_points", "SELECT p_partkey AS pid, p_size::DOUBLE AS x, p_retailprice AS y, 0.5::DOUBLE AS z, p_partkey % 256 AS r, p_partkey % 100 AS g, p_partkey % 7 AS b, p_size/4 AS error, count(l_orderkey) AS length, coalesce(sum(l_orderkey), 0)::BIGINT AS images FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def binary_points(spark, d):
    points = binary_scene(spark, d, "points")["points"]
    return points.select("pid", "x", "y", "z", "r", "g", "b", "error", F.size("track").alias("length"), F.aggregate("track", F.lit(0).cast("long"), lambda t, x: t + x["image_id"]).alias("images"))
