"""Binary reconstructions (cameras.bin, images.bin, points3D.bin) as a Spark data source, to read and to write.

Records have no fixed size and no marks to find their starts by, so the file is split along an index of record offsets: a side file `<name>.idx`
that the writer leaves, or a pass over the record heads. A partition reads its own bytes only. Files are opened by
URI on the executors (pyarrow's file systems), so the folder must be one that driver and executors share.
"""

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of camera models and their numbers of parameters, by model id.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
MODEL_IDS = {name: n for n, (name, _) in MODELS.items()}
#: Bytes of records in a partition, about.
PART_BYTES = 16 << 20

CAMERA, IMAGE, POINT, COUNT = "<IiQQ", "<I7dI", "<Q3d3BdQ", "<Q"
SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("pid", "<i8")])
TRACK = np.dtype([("image_id", "<u4"), ("place", "<u4")])

FILES = {"cameras": "cameras.bin", "images": "images.bin", "points": "points3D.bin"}
SCHEMAS = {
    "cameras": "camera_id long, model string, width long, height long, params array<double>",
    "images": "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string, seen array<struct<x: double, y: double, pid: long>>",
    "points": "pid long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id: long, place: long>>",
}


class Unfinished(Exception):
    """The bytes at hand end within a record's head."""


def record_end(table: str, data: bytes, at: int) -> int:
    """Where the record that begins at `at` ends; may lie beyond the bytes at hand."""
    try:
        if table == "cameras":
            model = struct.unpack_from(CAMERA, data, at)[1]
            if model not in MODELS:
                raise ValueError(f"unknown camera model {model}")
            return at + struct.calcsize(CAMERA) + 8 * MODELS[model][1]
        if table == "images":
            name = data.index(b"\0", at + struct.calcsize(IMAGE)) + 1
            return name + struct.calcsize(COUNT) + SEEN.itemsize * struct.unpack_from(COUNT, data, name)[0]
        return at + struct.calcsize(POINT) + TRACK.itemsize * struct.unpack_from(POINT, data, at)[-1]
    except (struct.error, ValueError) as short:
        if "camera model" in str(short):
            raise
        raise Unfinished from None


def decode(table: str, data: bytes, records: int) -> Iterator[tuple]:
    at = 0
    for _ in range(records):
        end = record_end(table, data, at)
        if end > len(data):
            raise Unfinished
        if table == "cameras":
            camera, model, width, height = struct.unpack_from(CAMERA, data, at)
            yield camera, MODELS[model][0], width, height, np.frombuffer(data, "<f8", MODELS[model][1], at + struct.calcsize(CAMERA)).tolist()
        elif table == "images":
            image, *pose, camera = struct.unpack_from(IMAGE, data, at)
            name = data.index(b"\0", at + struct.calcsize(IMAGE))
            seen = np.frombuffer(data, SEEN, struct.unpack_from(COUNT, data, name + 1)[0], name + 1 + struct.calcsize(COUNT))
            yield image, *pose, camera, data[at + struct.calcsize(IMAGE) : name].decode(), [dict(zip(SEEN.names, s, strict=True)) for s in seen.tolist()]
        else:
            *point, length = struct.unpack_from(POINT, data, at)
            yield *point, [dict(zip(TRACK.names, s, strict=True)) for s in np.frombuffer(data, TRACK, length, at + struct.calcsize(POINT)).tolist()]
        at = end


def encode(table: str, row) -> bytes:
    """A record of a row with the columns of SCHEMAS; null lists are empty."""
    if table == "cameras":
        model = MODEL_IDS.get(row.model)
        if model is None or len(row.params or ()) != MODELS[model][1]:
            raise ValueError(f"camera {row.camera_id}: model {row.model!r} with {len(row.params or ())} parameters")
        return struct.pack(CAMERA, row.camera_id, model, row.width, row.height) + struct.pack(f"<{len(row.params)}d", *row.params)
    if table == "images":
        name = row.name.encode()
        if b"\0" in name:
            raise ValueError(f"image {row.image_id}: a name cannot hold a zero byte")
        seen = np.array([(s.x, s.y, s.pid) for s in row.seen or ()], SEEN)
        return struct.pack(IMAGE, row.image_id, row.qw, row.qx, row.qy, row.qz, row.tx, row.ty, row.tz, row.camera_id) + name + b"\0" + struct.pack(COUNT, len(seen)) + seen.tobytes()
    track = np.array([(t.image_id, t.place) for t in row.track or ()], TRACK)
    return struct.pack(POINT, row.pid, row.x, row.y, row.z, row.r, row.g, row.b, row.error, len(track)) + track.tobytes()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def spans(file: pa.NativeFile, table: str, part_bytes: int, window: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(first byte, last byte, records) of parts of about part_bytes, from a pass over the heads of records."""
    size = file.size()
    if size < struct.calcsize(COUNT):
        raise ValueError("the file has no count of records")
    left, start, at, records, out = struct.unpack(COUNT, file.read(struct.calcsize(COUNT)))[0], struct.calcsize(COUNT), struct.calcsize(COUNT), 0, []
    data, base, wanted = b"", at, window
    while left:
        try:
            if not base <= at < base + len(data):
                raise Unfinished
            end = base + record_end(table, data, at - base)
            wanted = window
        except Unfinished:
            if base == at and len(data) >= size - at:
                raise ValueError(f"the file ends within a record, {left} records before its end") from None
            wanted = 2 * wanted if base == at and data else wanted
            file.seek(at)
            data, base = file.read(wanted), at
            continue
        if end > size:
            raise ValueError(f"the file ends within a record, {left} records before its end")
        at, left, records = end, left - 1, records + 1
        if at - start >= part_bytes or not left:
            out.append((start, at, records))
            start, records = at, 0
    return out


@dataclass
class Span(InputPartition):
    uri: str
    start: int
    end: int
    records: int


class SceneReader(DataSourceReader):
    def __init__(self, table: str, folder: str, part_bytes: int, schema):
        self.table, self.uri, self.part_bytes, self.schema = table, f"{folder.rstrip('/')}/{FILES[table]}", part_bytes, schema

    def partitions(self) -> list[Span]:
        system, path = located(self.uri)
        if system.get_file_info(f"{path}.idx").type == fs.FileType.File:
            with system.open_input_stream(f"{path}.idx") as side:
                found = np.frombuffer(side.read(), "<i8").reshape(-1, 3).tolist()
        else:
            with system.open_input_file(path) as file:
                found = spans(file, self.table, self.part_bytes)
        return [Span(self.uri, *s) for s in found] or [Span(self.uri, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.records:
            return
        system, path = located(partition.uri)
        with system.open_input_file(path) as file:
            file.seek(partition.start)
            data = file.read(partition.end - partition.start)
        yield from decode(self.table, data, partition.records)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    uri: str
    records: int
    bytes: int
    spans: list


class SceneWriter(DataSourceWriter):
    """Every task writes its records to a part of its own; the commit puts count and parts, in the order of partitions, in one file, which then takes its name."""

    def __init__(self, table: str, folder: str, part_bytes: int, overwrite: bool):
        self.table, self.folder, self.part_bytes, self.overwrite = table, folder.rstrip("/"), part_bytes, overwrite
        self.uri, self.run = f"{self.folder}/{FILES[table]}", uuid.uuid4().hex
        system, path = located(self.uri)
        if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.uri} exists; write with mode overwrite")

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{self.folder}/_parts-{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        system, path = located(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        records = held = start = total = 0
        found = []
        with system.open_output_stream(path) as out:
            for row in iterator:
                record = encode(self.table, row)
                out.write(record)
                records, held, total = records + 1, held + 1, total + len(record)
                if total - start >= self.part_bytes:
                    found.append((start, total, held))
                    start, held = total, 0
            if held:
                found.append((start, total, held))
        return Part(task.partitionId(), uri, records, total, found)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        system, path = located(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        at, index = struct.calcsize(COUNT), []
        with system.open_output_stream(f"{path}.new") as out:
            out.write(struct.pack(COUNT, sum(p.records for p in parts)))
            for part in parts:
                own, where = located(part.uri)
                with own.open_input_stream(where) as source:
                    while block := source.read(1 << 20):
                        out.write(block)
                index += [(at + a, at + b, n) for a, b, n in part.spans]
                at += part.bytes
        # An index of another file must not stand beside this one, so it goes first and comes last.
        if system.get_file_info(f"{path}.idx").type != fs.FileType.NotFound:
            system.delete_file(f"{path}.idx")
        system.move(f"{path}.new", path)
        with system.open_output_stream(f"{path}.idx") as out:
            out.write(np.array(index, "<i8").reshape(-1, 3).tobytes())
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        system, path = located(f"{self.folder}/_parts-{self.run}")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


class SceneSource(DataSource):
    """format("scene_binary") with options path (the folder), table (cameras, images or points) and partBytes."""

    @classmethod
    def name(cls) -> str:
        return "scene_binary"

    def _options(self) -> tuple[str, str, int]:
        table = self.options.get("table", "")
        if table not in FILES:
            raise ValueError(f"option table is {table!r}; one of {', '.join(FILES)}")
        return table, self.options["path"], int(self.options.get("partBytes", PART_BYTES))

    def schema(self) -> str:
        return SCHEMAS[self._options()[0]]

    def reader(self, schema) -> SceneReader:
        return SceneReader(*self._options(), schema)

    def writer(self, schema, overwrite: bool) -> SceneWriter:
        return SceneWriter(*self._options(), overwrite)


def read_scene(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> dict[str, DataFrame]:
    """cameras, images (with what they see) and points (with their tracks) of a binary reconstruction."""
    spark.dataSource.register(SceneSource)
    return {t: spark.read.format("scene_binary").option("table", t).option("partBytes", part_bytes).load(path) for t in FILES}


def write_scene(path: str, part_bytes: int = PART_BYTES, overwrite: bool = False, **tables: DataFrame) -> None:
    """Write cameras, images, points (those given) as a binary reconstruction, in the order of their ids. Missing lists are empty; other columns are left out."""
    for name, df in tables.items():
        if name not in FILES:
            raise ValueError(f"no table {name!r} in a reconstruction; {', '.join(FILES)}")
        df.sparkSession.dataSource.register(SceneSource)
        fields = StructType.fromDDL(SCHEMAS[name])
        rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        key = rows.columns[0]
        rows = rows.repartitionByRange(key).sortWithinPartitions(key)
        rows.write.format("scene_binary").option("table", name).option("partBytes", part_bytes).mode("overwrite" if overwrite else "append").save(path)
