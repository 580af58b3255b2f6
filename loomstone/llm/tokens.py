"""Token files: flat little-endian unsigned ids with 64-bit document offsets, to be memory-mapped.

A dataset is a folder. Each segment file holds whole documents in ascending order of doc_id:

    ids       uint16 or uint32 (the narrowest that fits the vocabulary), the end id after each document
    padding   zeros to a multiple of 8
    offsets   uint64[n_docs + 1], where each document starts among the ids of this segment
    doc_ids   int64[n_docs]
    nulls     uint8[n_docs], 1 where the doc_id is null
    footer    FOOTER: version, id width, tokens, documents, tokens of this part before this segment
    MAGIC

Folders are named part=P/seg=S/tokens=T, so that the prefix sums over parts need no file to be opened. Spark's text
writer puts the bytes down, with MAGIC as its line end: whatever file system Spark writes to will do, and
its commit protocol discards what a lost task left.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\nTOKSEG1\n"
FOOTER = struct.Struct("<IIQQQ")
#: Tokens after which a segment ends, at the next document's end.
SEGMENT_TOKENS = 4_000_000
#: Chunks that a worker remembers the ids of, twice: those met of late and those before them. About 160 bytes each.
REMEMBERED = 600_000
#: The same for the starts of texts.
STARTS = 50_000
_encoders: dict[str, Encoder] = {}


class Remembered(dict):
    """The bytes of the ids of chunks, found by `make` where missing. When there are `most`, they become the ones
    before; of those, chunks that come again are taken over, the others forgotten next time."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.before.get(chunk)
        if out is None:
            out = self.make(chunk)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if len(chunk) < 64:
            self[chunk] = out
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library, as encode(text, add_special_tokens=False) gives them.

    A blank before a character that is no white space always starts a new piece in byte-level
    pre-tokenization, so text is cut there and each distinct chunk goes to the library once.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.width = self.whole.model, 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # The byte-level alphabet: bytes that print stand for themselves, the others for code points from 256 on.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.odd = re.compile("|".join([r"[\x1c-\x1f\x85]", *map(re.escape, self.special)])).search
        self.doubled = re.compile(r" (?:\s|$)").search
        self.starts = Remembered(self.chunk, STARTS)
        self.spaced = Remembered(lambda word: self.chunk(f" {word}"), REMEMBERED)
        # Only the byte-level scheme with this pre-tokenization can be cut so.
        probe = "It's 12  odd\n étés, we'll\tsee..."
        self.cut = self.by_chunk(probe) == self.packed(self.whole.encode(probe, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def chunk(self, text: str) -> bytes:
        tokens = self.model.tokenize
        return self.packed([x.id for piece in self.pieces(text) for x in tokens(piece.encode().decode("latin-1").translate(self.alphabet))])

    def by_chunk(self, text: str) -> bytes:
        if self.doubled(text):
            return b"".join([self.spaced[x[1:]] if x[0] == " " else self.starts[x] for x in re.split(r"(?= \S)", text) if x])
        first, *rest = text.split(" ")
        return (self.starts[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers."""
        if not self.cut or self.odd(text):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        return self.by_chunk(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def segment(ids: np.ndarray, offsets: list[int], docs: list[int | None], before: int) -> bytes:
    """The bytes of a segment without MAGIC, which the writer adds."""
    raw = ids.tobytes()
    null = np.fromiter((d is None for d in docs), np.uint8, len(docs))
    return b"".join([raw, b"\0" * (-len(raw) % 8), np.asarray(offsets, "<u8").tobytes(), np.asarray([d or 0 for d in docs], "<i8").tobytes(), null.tobytes(), FOOTER.pack(1, ids.itemsize, len(ids), len(docs), before)])


def open_segment(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int | None], int]:
    """(ids, offsets, doc_ids, tokens of this part before it) of a segment's bytes or of np.memmap(path, np.uint8)."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes | memoryview) else data
    if bytes(data[-len(MAGIC) :]) != MAGIC:
        raise ValueError("not a whole token segment")
    end = len(data) - len(MAGIC) - FOOTER.size
    version, width, tokens, docs, before = FOOTER.unpack(bytes(data[end : end + FOOTER.size]))
    if version != 1:
        raise ValueError(f"segment version {version}")
    at = -(-tokens * width // 8) * 8
    ids = data[: tokens * width].view(f"<u{width}")
    offsets = data[at : at + 8 * (docs + 1)].view("<u8")
    names = data[at + 8 * (docs + 1) : at + 16 * docs + 8].view("<i8")
    null = data[at + 16 * docs + 8 : end]
    return ids, offsets, [None if x else int(d) for d, x in zip(names, null)], before


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes doc_id and text of docs into a token dataset at path.

    Null texts are empty; every document gets end_id at its end. Null doc_ids come first; rows with one doc_id
    come by text. No rows: no files. The text is dealt once, by ranges of doc_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seg, before, end = 0, 0, encode.packed([end_id])
        pieces: list[bytes] = []
        offsets, names = [0], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), encode.kind)
            row = [[part], [seg], [len(ids)], [segment(ids, offsets, names, before)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "seg", "tokens", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.ids(text.as_py() or "") + end
                pieces.append(ids)
                names.append(doc)
                offsets.append(offsets[-1] + len(ids) // encode.width)
                if offsets[-1] >= SEGMENT_TOKENS:
                    yield flush()
                    seg, before, pieces, offsets, names = seg + 1, before + offsets[-1], [], [0], []
        if names:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(write, "part int, seg int, tokens long, data binary")
    rows.select("part", "seg", "tokens", F.col("data").cast("string").alias("value")).write.partitionBy("part", "seg", "tokens").option("lineSep", MAGIC.decode()).text(path)


def bases(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the tokens of all parts before. One row for each task of the writer, by names of folders alone."""
    files = spark.read.format("binaryFile").load(path).select(F.col("part").cast("int").alias("part"), F.col("tokens").cast("long").alias("tokens"))
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in sums]]).tolist()
    return spark.createDataFrame([(p, b) for (p, _), b in zip(sums, starts)], "part int, base long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a dataset, from its files.

    A file is read by one task, and no ids are dealt. start counts the ids of all documents before; ids_crc32
    is of the ids as little-endian unsigned 32-bit integers. A dataset without files has no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not any(x.isDirectory() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)):
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, offsets, names, before = open_segment(memoryview(content.as_buffer()))
                wide, at = ids.astype("<u4"), offsets.astype(np.int64)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + before + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select(F.col("part").cast("int").alias("part"), "content")
    return files.join(F.broadcast(bases(spark, path)), "part").select("base", "content").mapInArrow(read, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document of a dataset, without the end ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ids, offsets, names, _ = open_segment(memoryview(content.as_buffer()))
                for k, name in enumerate(names):
                    own = ids[int(offsets[k]) : int(offsets[k + 1]) - 1].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "doc_id long, ids array<long>")
