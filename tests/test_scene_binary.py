"""Binary reconstructions: round trips, splits by records, odd files, and the text reader's rows."""

import glob
import os
import struct

import pytest

from gridloom.sources import readers, scene_binary

CAMERAS = [(3, "PINHOLE", 640, 480, [1.0, 2.0, 3.0, 4.0]), (1, "SIMPLE_PINHOLE", 10, 20, [5.0, 6.0, 7.0]), (2, "FULL_OPENCV", 2**40, 1, [float(n) for n in range(12)])]
IMAGES = [(n, 1.0, 0.0, 0.5, -0.25, n / 8, 1e300, -1.0, n % 3 + 1, f"bild é {n}" * (1 + 500 * (n == 7)), [(float(k), -k / 4, -1 if k % 2 else 2**40 + k) for k in range(n % 5)]) for n in range(300, 0, -1)]
POINTS = [(2**33 + n, n / 2, -1.0, 0.0, n % 256, 255, 0, 0.125, [(k, n) for k in range(3000 if n == 11 else n % 4)]) for n in range(400)]


def tables(spark):
    return {t: spark.createDataFrame(rows, scene_binary.SCHEMAS[t]).repartition(5) for t, rows in (("cameras", CAMERAS), ("images", IMAGES), ("points", POINTS))}


def plain(df):
    return sorted(tuple([tuple(x) if isinstance(x, (tuple, list)) else x for x in v] if isinstance(v, list) else v for v in r) for r in df.collect())


def test_round_trip_in_many_parts(spark, tmp_path):
    made = tables(spark)
    scene_binary.write_scene(str(tmp_path), part_bytes=2000, **{k: v.withColumn("more", v[v.columns[0]]) for k, v in made.items()})
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/*")) == ["cameras.bin", "cameras.bin.idx", "images.bin", "images.bin.idx", "points3D.bin", "points3D.bin.idx"]
    first = scene_binary.read_scene(spark, f"file://{tmp_path}")
    for t, df in made.items():
        assert plain(first[t]) == plain(df)
    assert first["images"].rdd.getNumPartitions() > 5
    ids = [r.image_id for r in first["images"].collect()]
    assert ids == sorted(ids)
    for f in glob.glob(f"{tmp_path}/*.idx"):
        os.remove(f)
    for part_bytes in (1, 3000, 1 << 24):
        again = scene_binary.read_scene(spark, str(tmp_path), part_bytes)
        assert all(plain(again[t]) == plain(df) for t, df in made.items())
        assert (again["points"].rdd.getNumPartitions() == 400) == (part_bytes == 1)


def test_bytes_are_those_of_the_format(spark, tmp_path):
    made = tables(spark)
    scene_binary.write_scene(str(tmp_path), cameras=made["cameras"])
    want = struct.pack("<Q", 3)
    for camera, name, width, height, params in sorted(CAMERAS):
        want += struct.pack("<IiQQ", camera, scene_binary.MODEL_IDS[name], width, height) + struct.pack(f"<{len(params)}d", *params)
    assert (tmp_path / "cameras.bin").read_bytes() == want


def test_overwriting_and_failing_writes(spark, tmp_path):
    made = tables(spark)
    scene_binary.write_scene(str(tmp_path), points=made["points"])
    with pytest.raises(Exception, match="exists"):
        scene_binary.write_scene(str(tmp_path), points=made["points"])
    before = (tmp_path / "points3D.bin").read_bytes()
    bad = spark.createDataFrame([(1, "NONE", 1, 1, [1.0])], scene_binary.SCHEMAS["cameras"])
    with pytest.raises(Exception, match="model"):
        scene_binary.write_scene(str(tmp_path), cameras=bad)
    assert not glob.glob(f"{tmp_path}/_parts*") and not os.path.exists(tmp_path / "cameras.bin")
    scene_binary.write_scene(str(tmp_path), overwrite=True, points=made["points"].where("pid % 2 = 0"))
    assert len(before) > (tmp_path / "points3D.bin").stat().st_size
    assert scene_binary.read_scene(spark, str(tmp_path))["points"].count() == 200
    with pytest.raises(ValueError):
        scene_binary.write_scene(str(tmp_path), meshes=made["points"])


def test_empty_and_damaged_files(spark, tmp_path):
    made = tables(spark)
    scene_binary.write_scene(str(tmp_path), images=made["images"].limit(0), points=made["points"], cameras=made["cameras"])
    read = lambda: scene_binary.read_scene(spark, str(tmp_path))
    assert read()["images"].count() == 0
    os.remove(tmp_path / "points3D.bin.idx")
    whole = (tmp_path / "points3D.bin").read_bytes()
    for cut in (4, 30, len(whole) - 1):
        (tmp_path / "points3D.bin").write_bytes(whole[:cut])
        with pytest.raises(Exception, match="ends within|no count"):
            read()["points"].count()
    os.remove(tmp_path / "cameras.bin.idx")
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QIiQQ", 1, 1, 99, 1, 1))
    with pytest.raises(Exception, match="camera model 99"):
        read()["cameras"].count()


def test_equals_the_text_reader(spark, tmp_path):
    images = [i for i in IMAGES if " " not in i[9]] or [(*i[:9], f"i{i[0]}.png", i[10]) for i in IMAGES[:20]]
    cameras = [c for c in CAMERAS if c[2] < 1000]  # the text reader's sizes have 32 bits
    (tmp_path / "cameras.txt").write_text("# cameras\n" + "".join(f"{c} {m} {w} {h} {' '.join(map(repr, p))}\n" for c, m, w, h, p in cameras))
    (tmp_path / "images.txt").write_text("# images\n" + "".join(f"{' '.join(map(repr, i[:9]))} {i[9]}\n{' '.join(f'{x!r} {y!r} {p}' for x, y, p in i[10])}\n" for i in images))
    (tmp_path / "points3D.txt").write_text("# points\n" + "".join(f"{' '.join(map(repr, p[:8]))} {' '.join(f'{a} {b}' for a, b in p[8])}\n" for p in POINTS[:9]))
    text = readers.load_scene(spark, str(tmp_path), "colmap")
    scene_binary.write_scene(str(tmp_path / "bin"), cameras=spark.createDataFrame(cameras, scene_binary.SCHEMAS["cameras"]), images=spark.createDataFrame(images, scene_binary.SCHEMAS["images"]), points=spark.createDataFrame(POINTS[:9], scene_binary.SCHEMAS["points"]))
    binary = readers.load_scene(spark, str(tmp_path / "bin"), "colmap_binary")
    for t in ("cameras", "images", "points"):
        assert plain(text[t]) == plain(binary[t].select(*text[t].columns)), t
