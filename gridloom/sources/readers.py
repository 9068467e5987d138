"""Readers for point, image, mask and scene formats. All list and read through Spark's own file sources."""

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _sequence(path: Column) -> Column:
    """The folder above the one that holds the frames, as in sequences/08/velodyne/000000.bin; empty if there is none."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*/[^/]*$", 1)


def lidar(spark: SparkSession, path: str) -> DataFrame:
    """sequence, frame, pid, x, y, z, intensity of float32 records."""

    def parse(batches):
        for b in batches:
            for sequence, frame, content in zip(b["sequence"], b["frame"], b["content"], strict=True):
                a = np.frombuffer(content, np.float32).reshape(-1, 4)
                yield pd.DataFrame({"sequence": sequence, "frame": frame, "pid": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "intensity": a[:, 3]})

    files = _files(spark, path, "*.bin").select(_sequence(F.col("path")).alias("sequence"), _stem(F.col("path")).alias("frame"), "content")
    return files.mapInPandas(parse, "sequence string, frame string, pid long, x float, y float, z float, intensity float")


def packed_labels(spark: SparkSession, path: str) -> DataFrame:
    """sequence, frame, pid, semantic, instance of unsigned 32-bit labels."""
    from gridloom.functions.vec import unpack_label

    def parse(batches):
        for b in batches:
            for sequence, frame, content in zip(b["sequence"], b["frame"], b["content"], strict=True):
                a = np.frombuffer(content, np.uint32).astype(np.int64)
                yield pd.DataFrame({"sequence": sequence, "frame": frame, "pid": np.arange(len(a)), "v": a})

    files = _files(spark, path, "*.label").select(_sequence(F.col("path")).alias("sequence"), _stem(F.col("path")).alias("frame"), "content")
    rows = files.mapInPandas(parse, "sequence string, frame string, pid long, v long")
    semantic, instance = unpack_label(F.col("v"))
    return rows.select("sequence", "frame", "pid", semantic.alias("semantic"), instance.alias("instance"))


def lidar_sequence(spark: SparkSession, path: str, classes: dict[int, int] | None = None) -> DataFrame:
    """Points left-joined to their labels by sequence and frame stem; unlabelled frames get 0; classes maps semantic ids."""
    from gridloom.operators.relational import remap

    out = lidar(spark, path).join(packed_labels(spark, path), ["sequence", "frame", "pid"], "left").fillna(0, ["semantic", "instance"])
    return remap(out, "semantic", classes) if classes else out


def frame_index(frames: DataFrame) -> DataFrame:
    """(sequence, frame) rows, distinct, with their number `index` in the order of both: how a data set numbers its scans.

    A row for each file, so one task orders them.
    """
    from pyspark.sql import Window as W

    return frames.select("sequence", "frame").distinct().withColumn("index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("sequence", "frame")) - 1)


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """key, m (numbers) of lines `key: numbers`."""
    parts = F.split("value", ":", 2)
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    numbers = F.transform(F.filter(F.split(F.trim(parts[1]), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    return rows.select(F.trim(parts[0]).alias("key"), numbers.alias("m"))


def extrinsics(m: Column) -> Column:
    """12 numbers of a 3 x 4 matrix as a 4 x 4 array of arrays."""
    return F.array(*[F.slice(m, 4 * r + 1, 4) for r in range(3)], F.array(*[F.lit(float(v)) for v in (0, 0, 0, 1)]))


def rgbd(spark: SparkSession, path: str) -> DataFrame:
    """stem, color, depth (image bytes) and pose (16 numbers) of frame-*.{color.png,depth.png,pose.txt}; only whole frames."""
    files = _files(spark, path, "frame-*").select(F.regexp_extract("path", r"(frame-[^./]*)\.(?:color|depth|pose)\.", 1).alias("stem"), F.regexp_extract("path", r"\.(color|depth|pose)\.", 1).alias("kind"), "content").where("kind <> ''")
    one = files.groupBy("stem").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("color", "depth", "pose")])
    pose = F.transform(F.filter(F.split(F.decode("pose", "utf-8"), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    return one.where("color is not null and depth is not null and pose is not null").select("stem", "color", "depth", pose.alias("pose"))


def depth_metres(raw: Column) -> Column:
    return raw / F.lit(1000.0)


def npy_dir(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """scene, asset, data (float64 values, row-major), shape of the allowed <scene>/<asset>.npy files."""

    def parse(batches):
        import io

        for b in batches:
            out = []
            for scene, asset, content in zip(b["scene"], b["asset"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                out.append((scene, asset, a.astype(np.float64).ravel().tolist(), list(a.shape)))
            yield pd.DataFrame(out, columns=["scene", "asset", "data", "shape"])

    files = _files(spark, path, "*.npy").select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("scene"), _stem(F.col("path")).alias("asset"), "content")
    return files.where(F.col("asset").isin(*names)).mapInPandas(parse, "scene string, asset string, data array<double>, shape array<long>")


def label_source(*names: str) -> Column:
    """The first label column that is there, or -1."""
    return F.coalesce(*[F.col(n) for n in names], F.lit(-1))


def sample_json(spark: SparkSession, path: str) -> DataFrame:
    """Points of exported samples: file, sample (its number in the file), pos, x, y, z, grid, color, label."""
    schema = "num_points int, xyz array<array<double>>, grid_coords array<array<double>>, color array<array<double>>, label array<double>"
    # A file is one array of samples, read as a whole, so that the numbers do not depend on how files are dealt to tasks.
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    # A file may hold one sample without an array around it.
    text = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = whole.select("file", F.posexplode(F.from_json(text, f"array<struct<{schema.replace(' array', ':array').replace(' int', ':int')}>>")).alias("sample", "s")).select("file", "sample", "s.*")
    p = rows.select("file", "sample", F.posexplode(F.arrays_zip("xyz", "grid_coords", "color", "label")).alias("pos", "p"))
    return p.select("file", "sample", "pos", *[F.col("p.xyz")[n].alias(a) for n, a in enumerate("xyz")], F.col("p.grid_coords").alias("grid"), F.col("p.color").alias("color"), F.col("p.label").alias("label"))


#: PLY scalar types and their struct codes.
PLY_TYPES = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d"}


def parse_ply(content: bytes) -> dict[str, dict[str, list]]:
    """element -> property -> values of an ascii or binary PLY file; list properties give lists."""
    end = content.index(b"end_header")
    start = content.index(b"\n", end) + 1
    fmt, elements = "ascii", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[2:4] if w[1] == "list" else w[1]))
    out: dict[str, dict[str, list]] = {}
    if fmt == "ascii":
        words = iter(content[start:].split())
        for name, n, props in elements:
            cols: dict[str, list] = {p: [] for p, _ in props}
            for _ in range(n):
                for p, kind in props:
                    cast = float if "f" in (kind[1] if isinstance(kind, list) else kind) or kind == "double" else int
                    cols[p].append([cast(next(words)) for _ in range(int(next(words)))] if isinstance(kind, list) else cast(next(words)))
            out[name] = cols
        return out
    order = "<" if "little" in fmt else ">"
    at = start
    for name, n, props in elements:
        if not any(isinstance(k, list) for _, k in props):
            kind = np.dtype([(p, order + PLY_TYPES[k]) for p, k in props])
            rows = np.frombuffer(content, kind, n, at)
            at += kind.itemsize * n
            out[name] = {p: rows[p].tolist() for p, _ in props}
            continue
        cols = {p: [] for p, _ in props}
        for _ in range(n):
            for p, k in props:
                if isinstance(k, list):
                    (m,) = struct.unpack_from(order + PLY_TYPES[k[0]], content, at)
                    at += struct.calcsize(PLY_TYPES[k[0]])
                    cols[p].append(list(struct.unpack_from(f"{order}{m}{PLY_TYPES[k[1]]}", content, at)))
                    at += m * struct.calcsize(PLY_TYPES[k[1]])
                else:
                    cols[p].append(struct.unpack_from(order + PLY_TYPES[k], content, at)[0])
                    at += struct.calcsize(PLY_TYPES[k])
        out[name] = cols
    return out


def ply(spark: SparkSession, path: str, element: str = "vertex", columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """file, id and the named properties (double) of one element of PLY files."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                cols = parse_ply(content).get(element, {})
                n = len(next(iter(cols.values()), []))
                yield pd.DataFrame({"file": name, "id": np.arange(n)} | {c: np.asarray(cols.get(c, [np.nan] * n), float) for c in columns})

    kinds = ", ".join(f"{c} double" for c in columns)
    return _files(spark, path, "*.ply").select(_stem(F.col("path")).alias("file"), "content").mapInPandas(parse, f"file string, id long, {kinds}")


def triangles(face: list[int]) -> list[tuple[int, int, int]]:
    """A polygon as a fan around its first vertex."""
    return [(face[0], face[n], face[n + 1]) for n in range(1, len(face) - 1)]


def ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """file, fid (of the polygon), part, v0, v1, v2: triangles; polygons of more corners are fans of them."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                face = parse_ply(content).get("face", {})
                rows = next(iter(face.values()), [])
                tri = [(fid, part, *t) for fid, r in enumerate(rows) for part, t in enumerate(triangles(r))]
                yield pd.DataFrame(tri, columns=["fid", "part", "v0", "v1", "v2"], dtype=np.int64).assign(file=name)[["file", "fid", "part", "v0", "v1", "v2"]]

    return _files(spark, path, "*.ply").select(_stem(F.col("path")).alias("file"), "content").mapInPandas(parse, "file string, fid long, part int, v0 long, v1 long, v2 long")


def decode_rle(counts: list[int], height: int, width: int) -> np.ndarray:
    """Uncompressed run lengths, column-major, zeros first; they must fill the image."""
    if sum(counts) != height * width:
        raise ValueError(f"runs of {sum(counts)} pixels for an image of {height} x {width}")
    return np.repeat(np.arange(len(counts)) % 2, counts).astype(bool).reshape(width, height).T


def rle_counts(text: str) -> list[int]:
    """Run lengths of a compressed string: little-endian groups of five bits above code point 48, bit 5 set where
    more follow, signed; from the fourth run on each is the difference to the run two before."""
    out, at = [], 0
    while at < len(text):
        value = shift = 0
        while True:
            c = ord(text[at]) - 48
            at += 1
            value |= (c & 31) << shift
            shift += 5
            if not c & 32:
                break
        if c & 16:
            value -= 1 << shift
        out.append(value + out[-2] if len(out) > 2 else value)
    return out


def coco(spark: SparkSession, path: str, height: int = 0, width: int = 0) -> DataFrame:
    """image_id, category_id, row, col: the union of the masks of each image and category.

    Segmentations are polygons, run lengths or compressed run lengths. The size is that of the image's entry, or
    height and width where the file has none.
    """
    from gridloom.operators.mask import polygon_mask

    schema = "images array<struct<id:long, height:int, width:int>>, annotations array<struct<image_id:long, category_id:long, segmentation:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    # One map for each file: the sizes of its images travel with its annotations.
    sizes = F.map_from_entries(F.transform(F.coalesce("images", F.expr("array()").cast("array<struct<id:long,height:int,width:int>>")), lambda i: F.struct(i["id"], F.struct(i["height"], i["width"]))))
    each = rows.select(sizes.alias("sizes"), F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.segmentation", F.try_element_at("sizes", F.col("a.image_id")).alias("s"))
    each = each.select("image_id", "category_id", "segmentation", F.coalesce("s.height", F.lit(height)).alias("h"), F.coalesce("s.width", F.lit(width)).alias("w"))

    def pixels(batches):
        import json

        for b in batches:
            for image, category, said, h, w in zip(b["image_id"], b["category_id"], b["segmentation"], b["h"], b["w"], strict=True):
                what = json.loads(said)
                if isinstance(what, list):
                    found = np.zeros((h, w), bool)
                    for flat in what:
                        found |= polygon_mask(np.asarray(flat, float).reshape(-1, 2), h, w)
                else:
                    counts = what["counts"]
                    h, w = what.get("size", (h, w))
                    found = decode_rle(rle_counts(counts) if isinstance(counts, str) else counts, h, w)
                r, c = np.nonzero(found)
                yield pd.DataFrame({"image_id": image, "category_id": category, "row": r.astype(np.int32), "col": c.astype(np.int32)})

    return each.mapInPandas(pixels, "image_id long, category_id long, row int, col int").distinct()


def labelme(spark: SparkSession, path: str) -> DataFrame:
    """frame, label, bbox, polygon of every labelled object."""
    schema = "info struct<name:string,height:int,width:int>, objects array<struct<category:string, bbox:array<double>, segmentation:array<array<double>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(_stem(F.col("info.name")).alias("frame"), F.col("info.height").alias("height"), F.col("info.width").alias("width"), F.explode("objects").alias("o")).select("frame", "height", "width", F.col("o.category").alias("label"), F.col("o.bbox").alias("bbox"), F.col("o.segmentation").alias("polygon"))


def focal(fov: Column, height: Column) -> Column:
    """Focal length in pixels of a vertical field of view in degrees."""
    return height / 2 / F.tan(F.radians(fov) / 2)


def camera_path(spark: SparkSession, path: str) -> DataFrame:
    """pos, fov, focal, camera_to_world (16 numbers) of a camera path."""
    schema = "render_height double, render_width double, camera_path array<struct<camera_to_world:array<double>, fov:double, aspect:double>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = rows.select("render_height", "render_width", F.posexplode("camera_path").alias("pos", "c"))
    return each.select("pos", "render_height", "render_width", F.col("c.fov").alias("fov"), focal(F.col("c.fov"), F.col("render_height")).alias("focal"), F.col("c.camera_to_world").alias("camera_to_world"))


def transforms(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a pose file with intrinsics by fallback (fl_x, focal_length, longest side) and the camera model's name.

    The model is OPENCV where a distortion exceeds 1e-10, PINHOLE where fx and fy differ by more than 1e-6, else SIMPLE_PINHOLE.
    """
    frame = "struct<file_path:string, transform_matrix:array<array<double>>>"
    schema = f"w double, h double, fl_x double, fl_y double, focal_length double, cx double, cy double, k1 double, k2 double, p1 double, p2 double, frames array<{frame}>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    fx = F.coalesce("fl_x", "focal_length", F.greatest("w", "h"))
    rows = rows.withColumn("fx", fx).withColumn("fy", F.coalesce("fl_y", fx)).withColumn("cx", F.coalesce("cx", F.col("w") / 2)).withColumn("cy", F.coalesce("cy", F.col("h") / 2))
    bent = F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in ("k1", "k2", "p1", "p2")]) > 1e-10
    model = F.when(bent, "OPENCV").when(F.abs(F.col("fx") - F.col("fy")) > 1e-6, "PINHOLE").otherwise("SIMPLE_PINHOLE")
    return rows.select(model.alias("model"), "w", "h", "fx", "fy", "cx", "cy", F.posexplode("frames").alias("pos", "f")).select("pos", "model", "w", "h", "fx", "fy", "cx", "cy", "f.file_path", "f.transform_matrix")


def click_points(spark: SparkSession, path: str, scene: str, suffix: str = "_undistort") -> list[tuple[int, int]]:
    """Clicks of a scene, times _scale: by its exact name, the name without the suffix, or the part before the first underscore."""
    import json

    book = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
    for name in (scene, scene.replace(suffix, ""), scene.split("_", 1)[0]):
        if name in book:
            scale = book.get("_scale", 1)
            return [(int(p[0] * scale), int(p[1] * scale)) for p in book[name]]
    raise ValueError(f"no clicks for scene {scene!r}; there are {', '.join(k for k in book if not k.startswith('_'))}")


def colmap_text(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cameras, images and points of a text reconstruction."""
    lines = lambda name: spark.read.text(f"{path}/{name}.txt").where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    p = F.col("p")
    num = lambda n, kind="double": F.get(p, F.lit(n)).cast(kind)
    cameras = lines("cameras").select(num(0, "long").alias("camera_id"), F.get(p, F.lit(1)).alias("model"), num(2, "int").alias("width"), num(3, "int").alias("height"), F.transform(F.slice(p, 5, 100), lambda s: s.cast("double")).alias("params"))
    images = lines("images").where((F.size("p") == 10) & ~F.get(p, F.lit(9)).rlike(r"^-?[\d.eE+-]+$")).select(num(0, "long").alias("image_id"), *[num(n + 1).alias(c) for n, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))], num(8, "long").alias("camera_id"), F.get(p, F.lit(9)).alias("name"))
    points = lines("points3D").select(num(0, "long").alias("pid"), *[num(n + 1).alias(a) for n, a in enumerate("xyz")], *[num(n + 4, "int").alias(c) for n, c in enumerate("rgb")], num(7).alias("error"))
    return {"cameras": cameras, "images": images, "points": points}


def colmap_binary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cameras, images and points of a binary reconstruction, split by records."""
    from gridloom.sources.scene_binary import read_scene

    return read_scene(spark, path)


#: Scene readers by dataset type; splat readers by suffix. Add to them to support more formats.
SCENES = {"colmap": colmap_text, "colmap_binary": colmap_binary}
SPLATS = {".ply": lambda spark, path: ply(spark, path, "vertex", ("x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2")), ".parquet": lambda spark, path: spark.read.parquet(path)}


def load_splats(spark: SparkSession, path: str) -> DataFrame:
    suffix = re.search(r"(\.[^./]*)?$", path)[0]
    if suffix not in SPLATS:
        raise ValueError(f"unsupported splat format {suffix!r}; one of {', '.join(SPLATS)}")
    return SPLATS[suffix](spark, path)


def load_scene(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    if kind not in SCENES:
        raise ValueError(f"unsupported dataset type {kind!r}; one of {', '.join(SCENES)}")
    return SCENES[kind](spark, path)


def scene_dirs(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Sorted sub-folders whose name ends in suffix; an error if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory() and s.getPath().getName().endswith(suffix))
    if not names:
        raise FileNotFoundError(f"no folder ending in {suffix!r} below {root}")
    return names


def checksum(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def semantic_embeddings(df: DataFrame, instance: str = "instance", vec: str = "embedding") -> DataFrame:
    """Side-file rows keyed as the packed labels are, with unit vectors (a zero vector stays as it is)."""
    from gridloom.functions.vec import dbl, instance_key, norm

    n = norm(F.col(vec))
    return df.withColumn("key", instance_key(F.col(instance))).withColumn(vec, F.transform(dbl(F.col(vec)), lambda x: F.coalesce(F.try_divide(x, n), x)))


def split_sequences(frames: DataFrame, splits: dict[str, list[int]], split: str, col: str = "sequence") -> DataFrame:
    """Frames of a split's sequences; `all` takes those of every split."""
    wanted = [s for v in splits.values() for s in v] if split == "all" else splits[split]
    return frames.where(F.col(col).isin(wanted))


def cached_level(spark: SparkSession, path: str, level: int | None = None, widen: tuple[str, ...] = ()) -> DataFrame:
    """A cached table, one of its levels (a partition column, so only that is read), narrow integers widened."""
    out = spark.read.parquet(path)
    if level is not None:
        out = out.where(F.col("level") == level)
    return out.withColumns({c: F.col(c).cast("int") for c in widen}) if widen else out


def grouped(spark: SparkSession, path: str, model_type: str) -> DataFrame:
    """Ragged arrays of one group of an appended store (see sinks.append_groups)."""
    return spark.read.parquet(path).where(F.col("model_type") == model_type)
