"""Readers, writers, caches and streams on small files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import vec
from gridloom.operators import mask, voxel
from gridloom.sources import readers, sinks
from gridloom.streaming import fusion


def test_lidar_with_labels(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "000.bin").write_bytes(a.tobytes())
    (tmp_path / "000.label").write_bytes(np.array([1 | 5 << 16, 2, 0xFFFF << 16 | 3], np.uint32).tobytes())
    (tmp_path / "001.bin").write_bytes(a.tobytes())
    rows = readers.lidar_sequence(spark, str(tmp_path)).orderBy("frame", "pid").collect()
    assert [(r.semantic, r.instance) for r in rows] == [(1, 5), (2, 0), (3, 65535), (0, 0), (0, 0), (0, 0)]
    assert rows[1].x == 4.0
    packed = spark.range(1).select(vec.pack_label(F.lit(3).cast("long"), F.lit(65535))).first()[0]
    assert packed == 0xFFFF0003


def test_calibration(spark, tmp_path):
    (tmp_path / "c.txt").write_text("P0: 1 2 3 4 5 6 7 8 9 10 11 12\nTr: 0 1\n\n")
    rows = {r.key: r for r in readers.calibration(spark, str(tmp_path)).withColumn("e", readers.extrinsics(F.col("m"))).collect()}
    assert rows["P0"].e == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [0, 0, 0, 1]]


def test_rgbd_needs_all_three_files(spark, tmp_path):
    for kind, ext in (("color", "png"), ("depth", "png"), ("pose", "txt")):
        (tmp_path / f"frame-1.{kind}.{ext}").write_bytes(b"1 0\n0 1")
    (tmp_path / "frame-2.color.png").write_bytes(b"x")
    assert [(r.stem, r.pose) for r in readers.rgbd(spark, str(tmp_path)).collect()] == [("frame-1", [1, 0, 0, 1])]


def test_npy_dir(spark, tmp_path):
    (tmp_path / "s").mkdir()
    np.save(tmp_path / "s" / "coord.npy", np.ones((2, 3)))
    np.save(tmp_path / "s" / "other.npy", np.ones(2))
    rows = readers.npy_dir(spark, str(tmp_path), ("coord",)).collect()
    assert [(r.scene, r.asset, r.shape, sum(r.data)) for r in rows] == [("s", "coord", [2, 3], 6.0)]


def test_ply_ascii_and_binary(spark, tmp_path):
    (tmp_path / "a.ply").write_text(sinks.ply_text([(0.0, 1.0, 2.0), (3.0, 4.0, 5.0), (6.0, 7.0, 8.0)], [(0, 1, 2)], False))
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + struct.pack("<6f", *range(6)) + struct.pack("<B3i", 3, 0, 1, 1))
    rows = readers.ply(spark, str(tmp_path)).orderBy("file", "id").collect()
    assert [(r.file, r.x, r.z) for r in rows] == [("a", 0, 2), ("a", 3, 5), ("a", 6, 8), ("b", 0, 2), ("b", 3, 5)]
    assert sorted((r.file, r.v0, r.v1, r.v2) for r in readers.ply_faces(spark, str(tmp_path)).collect()) == [("a", 0, 1, 2), ("b", 0, 1, 1)]
    with pytest.raises(ValueError):
        readers.load_splats(spark, "x.obj")
    with pytest.raises(ValueError):
        readers.load_scene(spark, "x", "nothing")


def test_json_formats(spark, tmp_path):
    (tmp_path / "coco.json").write_text(json.dumps({"annotations": [{"image_id": 1, "category_id": 2, "segmentation": {"counts": [1, 2, 3], "size": [2, 3]}}]}))
    got = sorted((r.row, r.col) for r in readers.coco(spark, str(tmp_path / "coco.json"), 2, 3).collect())
    assert got == [(0, 1), (1, 0)]
    (tmp_path / "lm.json").write_text(json.dumps({"info": {"name": "f_1.jpg", "height": 4, "width": 4}, "objects": [{"category": "cup", "bbox": [0, 0, 2, 2], "segmentation": [[0, 0], [3, 0], [3, 3], [0, 3]]}]}))
    obj = readers.labelme(spark, str(tmp_path / "lm.json")).first()
    assert (obj.frame, obj.label, len(obj.polygon)) == ("f_1", "cup", 4)
    poly = spark.createDataFrame([(1, [p[0] for p in obj.polygon], [p[1] for p in obj.polygon])], "poly_id long, xs array<double>, ys array<double>")
    assert mask.rasterize(poly, 4, 4).count() == 9
    (tmp_path / "cam.json").write_text(json.dumps({"render_height": 100.0, "render_width": 50.0, "camera_path": [{"camera_to_world": [1.0] * 16, "fov": 90.0, "aspect": 1.0}]}))
    assert readers.camera_path(spark, str(tmp_path / "cam.json")).first().focal == pytest.approx(50.0)
    (tmp_path / "tf.json").write_text(json.dumps({"w": 10.0, "h": 20.0, "frames": [{"file_path": "a", "transform_matrix": [[1.0]]}]}))
    tf = readers.transforms(spark, str(tmp_path / "tf.json")).first()
    assert (tf.model, tf.fx, tf.cx) == ("SIMPLE_PINHOLE", 20.0, 5.0)
    (tmp_path / "clicks.json").write_text(json.dumps({"_scale": 4, "fern": [[1, 2]]}))
    assert readers.click_points(spark, str(tmp_path / "clicks.json"), "fern_right") == [(4, 8)]
    assert readers.click_points(spark, str(tmp_path / "clicks.json"), "fern_undistort") == [(4, 8)]
    with pytest.raises(ValueError):
        readers.click_points(spark, str(tmp_path / "clicks.json"), "rose")


def test_colmap_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 500 320 240\n")
    (tmp_path / "images.txt").write_text("# i\n7 1 0 0 0 1 2 3 1 a.jpg\n1.0 2.0 -1\n")
    (tmp_path / "points3D.txt").write_text("5 1 2 3 255 0 0 0.5 7 0\n")
    got = readers.load_scene(spark, str(tmp_path), "colmap")
    assert got["cameras"].first().params == [500, 500, 320, 240]
    assert [(r.image_id, r.name) for r in got["images"].collect()] == [(7, "a.jpg")]
    assert got["points"].first().error == 0.5


def test_scene_dirs(spark, tmp_path):
    for n in ("b_scene", "a_scene", "other"):
        (tmp_path / n).mkdir()
    assert readers.scene_dirs(spark, str(tmp_path), "_scene") == ["a_scene", "b_scene"]
    with pytest.raises(FileNotFoundError):
        readers.scene_dirs(spark, str(tmp_path), "_none")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, float("inf")), (2, None), (2, 4.0)], "cluster_id int, x double")
    assert sinks.finite_rows(df, ["x"]).count() == 2
    sinks.write_segments(sinks.finite_rows(df, ["x"]), str(tmp_path / "s"), method="m")
    assert spark.read.parquet(str(tmp_path / "s")).where("cluster_id = 2 and method = 'm'").count() == 1
    for step in (1, 2):
        sinks.log_metrics(spark, str(tmp_path / "m"), [(step, "loss", 0.5)])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.save_state(spark, str(tmp_path / "state"), {"a": 1})
    assert sinks.load_state(spark, str(tmp_path / "state"), ("a",)) == {"a": 1}
    with pytest.raises(ValueError):
        sinks.load_state(spark, str(tmp_path / "state"), ("b",))
    assert sinks.artifact_path("/out", 3, "a/x.png") == "/out/00000003/a/x.png"
    for bad in ("x.exe", "../../../x.png"):
        with pytest.raises(ValueError):
            sinks.artifact_path("/out", 3, bad)


def test_parameter_cache(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    at = str(tmp_path / "cache")
    assert sinks.ParameterCache(spark, at, a=1).get(lambda: make(3)).count() == 3
    assert sinks.ParameterCache(spark, at, a=1).get(lambda: make(4)).count() == 3
    assert sinks.ParameterCache(spark, at, a=2).get(lambda: make(5)).count() == 5
    assert sinks.ParameterCache(spark, at, a=1).get(lambda: make(6)).count() == 6
    assert made == [3, 5, 6]


def test_streamed_fusion_equals_batch(spark, tmp_path):
    rows = [(0, n % 3, 0, 0, float(n), 1.0 + n % 2) for n in range(30)]
    schema = "batch_id long, i long, j long, k long, value double, w double"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fusion.fuse_stream(stream, ["value"], "w", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, fusion.fused(spark, str(tmp_path / "out"), ["value"]).collect()))
    want = sorted(map(tuple, voxel.fuse(spark.createDataFrame(rows, schema), "value", "w").collect()))
    assert got == want


def test_mask_morphology(spark):
    px = spark.createDataFrame([(0, 0, r, c) for r in range(4) for c in range(4)] + [(0, 0, 20, 20)], "image_id long, mask_id long, row int, col int")
    assert mask.drop_islands(px, 5).count() == 16
    kept = {(r.row, r.col) for r in mask.erode(px).collect()}
    assert (1, 1) in kept and (20, 20) not in kept and (0, 0) not in kept


def test_greedy_boxes(spark):
    b = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (0, 2, 20.0, 20.0, 30.0, 30.0, 0.1)], "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.box_id for r in mask.greedy_boxes(b).collect()) == [0, 2]


def test_suppression_keeps_the_stated_rules(spark):
    square = lambda m, r0, r1, c0, c1: [(0, m, r, c) for r in range(r0, r1) for c in range(c0, c1)]
    px = square(1, 0, 20, 0, 20) + square(2, 0, 20, 0, 19) + square(3, 2, 5, 2, 5) + square(4, 40, 45, 40, 45)
    scores = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7), (0, 4, 0.6)], "image_id long, mask_id long, score double")
    df = spark.createDataFrame(px, "image_id long, mask_id long, row int, col int")
    got = {r.mask_id: r for r in mask.suppress(df, scores).collect()}
    assert {m for m, r in got.items() if r.kept} == {1, 4}  # 2 overlaps 1; 3 lies in 1
    assert got[3].in_better == pytest.approx(1 - 9 / 400) and got[3].in_worse == pytest.approx(1 - 9 / 380)  # 2 is next in rank
    low = mask.suppress(df.where("mask_id = 4"), scores.where("mask_id = 4"), score_least=0.95).first()
    assert low.kept  # the best of an image pass a score that none has


def test_scale_between_masks(spark):
    cdf, scales = F.array(*[F.lit(c) for c in (0.3, 0.7, 1.0)]), F.array(*[F.lit(c) for c in (1.0, 3.0, 7.0)])
    got = spark.createDataFrame([(0.1, 0.5), (0.5, 0.5), (0.99, 0.25), (1.5, 1.0)], "u double, v double").select(mask.pick_scale(cdf, scales, F.col("u"), F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [0.5, 2.0, 4.0, 7.0]


def test_frames_of_two_sequences_stay_apart(spark, tmp_path):
    for n, seq in enumerate(("00", "08")):
        for kind, name, data in (("velodyne", "000000.bin", np.arange(12, dtype=np.float32) + 100 * n), ("labels", "000000.label", np.array([n + 1] * 3, np.uint32))):
            folder = tmp_path / "sequences" / seq / kind
            folder.mkdir(parents=True)
            (folder / name).write_bytes(data.tobytes())
    rows = readers.lidar_sequence(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    assert {(r.sequence, r.semantic, r.x >= 100) for r in rows} == {("00", 1, False), ("08", 2, True)}
    assert [tuple(r) for r in readers.frame_index(readers.lidar(spark, str(tmp_path))).orderBy("index").collect()] == [("00", "000000", 0), ("08", "000000", 1)]
    kept = readers.split_sequences(readers.lidar(spark, str(tmp_path)), {"train": ["00"], "valid": ["08"]}, "valid")
    assert {r.sequence for r in kept.collect()} == {"08"}


def encode_counts(counts):
    """The compressed form, by its definition: differences to two runs before, five bits a character."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            low, x = x & 31, x >> 5
            more = not (x == 0 and not low & 16 or x == -1 and low & 16)
            out.append(chr((low | 32 * more) + 48))
            if not more:
                break
    return "".join(out)


def test_coco_polygons_and_compressed_runs(spark, tmp_path):
    counts = [3, 40, 2, 1, 60, 5, 9]
    assert readers.rle_counts(encode_counts(counts)) == counts
    h, w = 10, 12
    square = [2, 2, 6, 2, 6, 5, 2, 5]
    notes = [
        {"image_id": 1, "category_id": 1, "segmentation": [square, [8, 8, 10, 8, 10, 9, 8, 9]]},
        {"image_id": 1, "category_id": 2, "segmentation": {"counts": counts, "size": [h, w]}},
        {"image_id": 2, "category_id": 2, "segmentation": {"counts": encode_counts(counts), "size": [h, w]}},
    ]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"images": [{"id": 1, "height": h, "width": w}], "annotations": notes}))
    got = {}
    for r in readers.coco(spark, str(path), h, w).collect():
        got.setdefault((r.image_id, r.category_id), set()).add((r.row, r.col))
    assert got[1, 1] == {(r, c) for r in range(2, 5) for c in range(2, 6)} | {(8, 8), (8, 9)}
    assert got[1, 2] == got[2, 2] and len(got[1, 2]) == 40 + 1 + 5
    with pytest.raises(ValueError):
        readers.decode_rle([1, 2], 2, 2)


def test_polygons_of_a_mesh_become_fans():
    assert readers.triangles([4, 5, 6, 7]) == [(4, 5, 6), (4, 6, 7)] and readers.triangles([1, 2]) == []
