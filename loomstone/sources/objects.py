"""Objects and packs: a binary envelope of typed objects, and files that hold many, read and written through Spark.

Object: MAGIC, type, version, two reserved bytes, length of the body (64 bits, little-endian), body. The id is the
SHA-256 of the whole. Pack: PACK, count, then for each object its coding (raw, zstd, or zstd with an earlier object of the pack as
dictionary), type, base, lengths and bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD, MAGIC = struct.Struct("<4sBBHQ"), b"LOOM"
PACK, COUNT, ENTRY = b"LPAK", struct.Struct("<I"), struct.Struct("<BBiQQ")
TYPES = {"blob": 1, "tree": 2, "commit": 3, "release": 4, "authority": 5}
RAW, ZSTD, DELTA = 0, 1, 2
#: Below this many bytes an object is kept as it is; a difference must save so many.
SMALL, GAIN = 256, 32


def object_bytes(kind: str, body: bytes) -> bytes:
    return HEAD.pack(MAGIC, TYPES[kind], 1, 0, len(body)) + body


def object_id(kind: str, body: bytes) -> str:
    return hashlib.sha256(object_bytes(kind, body)).hexdigest()


def parse_object(data: bytes) -> tuple[str, bytes]:
    magic, kind, version, _, size = HEAD.unpack_from(data)
    names = {v: k for k, v in TYPES.items()}
    if magic != MAGIC or version != 1 or kind not in names or len(data) != HEAD.size + size:
        raise ValueError("not an object")
    return names[kind], data[HEAD.size :]


def encode_pack(objects: list[tuple[str, bytes]], level: int = 3) -> bytes:
    """A pack of (type, body), in order; each may be a difference to the last one of its type."""
    import zstandard

    out, last = [PACK, COUNT.pack(len(objects))], {}
    plain = zstandard.ZstdCompressor(level)
    for k, (kind, body) in enumerate(objects):
        coding, base, data = RAW, -1, body
        if len(body) >= SMALL:
            packed = plain.compress(body)
            if len(packed) < len(body):
                coding, data = ZSTD, packed
            if kind in last and last[kind][1]:
                delta = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(last[kind][1], zstandard.DICT_TYPE_RAWCONTENT)).compress(body)
                if len(delta) + GAIN < len(data) and len(delta) < len(body):
                    coding, base, data = DELTA, last[kind][0], delta
        last[kind] = (k, body)
        out += [ENTRY.pack(coding, TYPES[kind], base, len(body), len(data)), data]
    return b"".join(out)


def decode_pack(data: bytes, most_objects: int = 1_000_000, most_bytes: int = 1 << 30) -> list[tuple[str, bytes]]:
    """The (type, body) of a pack; raises for one that is broken or beyond the limits, before anything large is made."""
    import zstandard

    if data[:4] != PACK:
        raise ValueError("not a pack")
    (count,) = COUNT.unpack_from(data, 4)
    if count > most_objects:
        raise ValueError("too many objects")
    names, at, total = {v: k for k, v in TYPES.items()}, 4 + COUNT.size, 0
    out: list[tuple[str, bytes]] = []
    for k in range(count):
        if at + ENTRY.size > len(data):
            raise ValueError("broken off")
        coding, kind, base, size, held = ENTRY.unpack_from(data, at)
        at += ENTRY.size
        total += size
        if total > most_bytes or at + held > len(data) or kind not in names:
            raise ValueError("broken, or beyond the limits")
        part = data[at : at + held]
        at += held
        if coding == DELTA:
            if not 0 <= base < k:
                raise ValueError("a difference to a later object")
            part = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(out[base][1], zstandard.DICT_TYPE_RAWCONTENT)).decompress(part, max_output_size=size)
        elif coding == ZSTD:
            part = zstandard.ZstdDecompressor().decompress(part, max_output_size=size)
        if len(part) != size:
            raise ValueError("a length that doesn't hold")
        out.append((names[kind], part))
    if at != len(data):
        raise ValueError("bytes after the last object")
    return out


def pack_objects(objects: DataFrame, per_pack: int = 4096) -> DataFrame:
    """(pack, data): packs of objects (id, type, body), dealt by their ids; a pack is one task's, in order of id."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"pack": [int(rows["pack"].iloc[0])], "data": [encode_pack([*zip(rows["type"], map(bytes, rows["body"]))])]})

    packs = max(1, -(-objects.count() // per_pack))
    dealt = objects.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("long"))
    return dealt.groupBy("pack").applyInPandas(encode, "pack long, data binary")


def unpack_objects(packs: DataFrame) -> DataFrame:
    """(pack, id, type, body) of packs (pack, data)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["pack"], batch["data"]):
                rows = [(name, object_id(k, b), k, b) for k, b in decode_pack(bytes(data))]
                yield pd.DataFrame(rows, columns=["pack", "id", "type", "body"])

    return packs.select("pack", "data").mapInPandas(decode, "pack long, id string, type string, body binary")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, type, body) of all pack files below a path, by Spark's own file reader: any file system, one task for a file at most."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name, object_id(k, b), k, b) for k, b in decode_pack(bytes(data))], columns=["path", "id", "type", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, id string, type string, body binary")


class PackReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for kind, body in decode_pack(f.read()):
                yield partition.value, object_id(kind, body), kind, body


class PackSource(DataSource):
    """spark.read.format("loompack").option("paths", "a,b").load(): packs on a file system that all executors mount; else use read_packs."""

    @classmethod
    def name(cls) -> str:
        return "loompack"

    def schema(self) -> str:
        return "path string, id string, type string, body binary"

    def reader(self, schema: object) -> PackReader:
        return PackReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])
