"""Map elements in the binary block format as a data source: a task decodes some blocks, and only the asked kind of element.

    spark.dataSource.register(PbfSource)
    spark.read.format("map_pbf").option("kind", "way").load("file:/extract.pbf")

Blocks are found by their headers alone. Files are opened through pyarrow's
file systems, so that a path may be local or carry a scheme they know.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: element kinds, field numbers of groups, features that a reader must know, size limits.
KINDS = ("node", "way", "relation")
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
SCHEMAS = {
    "node": "node bigint, lat double, lon double, tags map<string,string>",
    "way": "way bigint, refs array<bigint>, tags map<string,string>",
    "relation": "relation bigint, members array<struct<_type:string,_ref:bigint,_role:string>>, tags map<string,string>",
}
TAGS = pa.map_(pa.string(), pa.string())
MEMBERS = pa.list_(pa.struct([("_type", pa.string()), ("_ref", pa.int64()), ("_role", pa.string())]))
ARROW = {
    "node": pa.schema([("node", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", TAGS)]),
    "way": pa.schema([("way", pa.int64()), ("refs", pa.list_(pa.int64())), ("tags", TAGS)]),
    "relation": pa.schema([("relation", pa.int64()), ("members", MEMBERS), ("tags", TAGS)]),
}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field of a message: an integer, or the bytes of a longer one."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > end:
                raise ValueError("a field ends beyond its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't known")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """The varints of a packed field, all at once."""
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last) or last[-1] != len(raw) - 1:
        raise ValueError("a packed field ends within a number")
    first = np.concatenate(([0], last[:-1] + 1))
    shift = (np.arange(len(raw)) - np.repeat(first, last - first + 1)) * 7
    return np.add.reduceat((raw & 127).astype(np.uint64) << shift.astype(np.uint64), first)


def signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(signed(packed(data)))


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def to_long(value: int) -> int:
    """A plain 64-bit varint as a signed number."""
    return value - (1 << 64) if value >> 63 else value


def blob_content(blob: bytes) -> bytes:
    found = dict(fields(blob))
    for number, opened in ((1, bytes), (3, zlib.decompress), (4, lzma.decompress), (5, bz2.decompress), (7, _zstd)):
        if number in found:
            return opened(found[number])
    raise ValueError("the block is compressed in a way that isn't read here")


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def block_places(stream):
    """(type, offset, size) of each block's content; only headers are read."""
    at = 0
    while True:
        stream.seek(at)
        size = stream.read(4)
        if not size:
            return
        if len(size) < 4:
            raise ValueError("the file ends within a block")
        size = struct.unpack(">I", size)[0]
        if size > MOST_HEADER:
            raise ValueError("a block's header is too long: is this a file of map elements?")
        header = dict(fields(stream.read(size)))
        if header.get(3, 0) > MOST_BLOB:
            raise ValueError("a block is too long")
        yield header[1].decode(), at + 4 + size, header[3]
        at += 4 + size + header[3]


def check_features(header: bytes) -> None:
    unknown = {v.decode() for k, v in fields(header) if k == 4} - KNOWN_FEATURES
    if unknown:
        raise ValueError(f"the file needs features that aren't read here: {sorted(unknown)}")


def _checked(ids):
    if any(i < 0 for i in ids):
        raise ValueError("negative ids aren't supported")
    return ids


def elements(block: bytes, kind: str) -> dict[str, list]:
    """Columns of the elements of one kind in a block; groups of other kinds aren't decoded."""
    strings, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(value) if k == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat0 = to_long(value)
        elif number == 20:
            lon0 = to_long(value)
    degrees = lambda stored, start: (start + granularity * stored) * 1e-9
    pairs = lambda f: dict(zip((strings[i] for i in packed(f.get(2, b""))), (strings[i] for i in packed(f.get(3, b""))), strict=True))
    out: dict[str, list] = {c: [] for c in ARROW[kind].names}
    for number, value in (x for g in groups for x in fields(g)):
        if kind == "node" and number == 2:
            dense = dict(fields(value))
            ids = deltas(dense.get(1, b"")).tolist()
            out["node"] += _checked(ids)
            out["lat"] += degrees(deltas(dense.get(8, b"")), lat0).tolist()
            out["lon"] += degrees(deltas(dense.get(9, b"")), lon0).tolist()
            out["tags"] += _dense_tags(packed(dense.get(10, b"")).tolist(), strings, len(ids))
        elif kind == "node" and number == 1:
            f = dict(fields(value))
            out["node"] += _checked([unzigzag(f[1])])
            out["lat"].append(float(degrees(unzigzag(f[8]), lat0)))
            out["lon"].append(float(degrees(unzigzag(f[9]), lon0)))
            out["tags"].append(pairs(f))
        elif kind == "way" and number == 3:
            f = dict(fields(value))
            out["way"] += _checked([to_long(f[1])])
            out["refs"].append(deltas(f.get(8, b"")).tolist())
            out["tags"].append(pairs(f))
        elif kind == "relation" and number == 4:
            f = dict(fields(value))
            out["relation"] += _checked([to_long(f[1])])
            members = zip(packed(f.get(10, b"")).tolist(), deltas(f.get(9, b"")).tolist(), packed(f.get(8, b"")).tolist(), strict=True)
            out["members"].append([{"_type": KINDS[t], "_ref": m, "_role": strings[r]} for t, m, r in members])
            out["tags"].append(pairs(f))
    return out


def _dense_tags(codes: list[int], strings: list[str], n: int) -> list[dict]:
    """Key and value numbers of all nodes of a group, those of a node ended by 0; nothing at all where no node has tags."""
    if not codes:
        return [{}] * n
    out, own, at = [], {}, 0
    while at < len(codes):
        if codes[at] == 0:
            out.append(own)
            own, at = {}, at + 1
        else:
            own[strings[codes[at]]] = strings[codes[at + 1]]
            at += 2
    if len(out) != n:
        raise ValueError("the tags of a group don't fit its nodes")
    return out


def opened(path: str):
    system, place = (fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path))
    return system.open_input_file(place)


class Blocks(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str, blocks: int):
        self.path, self.kind, self.blocks = path, kind, blocks

    def partitions(self):
        data = []
        with opened(self.path) as stream:
            for kind, at, size in block_places(stream):
                if kind == "OSMHeader":
                    stream.seek(at)
                    check_features(blob_content(stream.read(size)))
                elif kind == "OSMData":
                    data.append((at, size))
        # A source without partitions isn't allowed: an empty file has one without blocks.
        return [Blocks(data[k : k + self.blocks]) for k in range(0, max(len(data), 1), self.blocks)]

    def read(self, partition):
        schema = ARROW[self.kind]
        with opened(self.path) as stream:
            for at, size in partition.places:
                stream.seek(at)
                columns = elements(blob_content(stream.read(size)), self.kind)
                tags = [list(t.items()) for t in columns.pop("tags")]
                if tags:
                    arrays = [pa.array(columns[f.name] if f.name != "tags" else tags, f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class PbfSource(DataSource):
    """Options: path, kind (node, way or relation), blocks (how many a task decodes, 16 unless given)."""

    @classmethod
    def name(cls):
        return "map_pbf"

    def _kind(self) -> str:
        kind = self.options.get("kind", "node")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of element: {kind!r}")
        return kind

    def schema(self):
        return SCHEMAS[self._kind()]

    def reader(self, schema):
        return PbfReader(self.options["path"], self._kind(), int(self.options.get("blocks", "16")))


def read_elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The elements of one kind, with the columns that the XML source gives; negative ids are refused."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("map_pbf").option("kind", kind).load(path)
