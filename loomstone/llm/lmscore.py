"""LM scoring by cross-entropy difference.

Two bigram models of words, one of a target corpus and one of the documents themselves (the background), share one vocabulary, order and
smoothing. A document's score is the mean over its words of the target's loss less the background's: the lower, the
more it is like the target. The background leaves the document's own counts out.

With additive smoothing a loss is a term of the bigram less a term of its first word, so each distinct n-gram of a document
can be scored where all its occurrences meet. n-grams travel once, as binary arrays dealt by their hash, and partial sums
travel back; no model is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_hashes

#: Added to the count of each word of the vocabulary after each word.
KAPPA = 0.01
#: Words of documents that are packed together.
PACK_WORDS = 1_000_000
START = np.uint64(0x51AB1E5EED)
DOCUMENTS, TARGET, HEADER = 0, 1, 2


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigrams, the first with START, and of their first words; kinds are told apart by the lowest bit."""
    before = np.concatenate([[START], ids[:-1]]).astype(np.uint64)
    two = mix(before * np.uint64(0x9E3779B97F4A7C15) + ids) | np.uint64(1)
    return two, mix(before) & ~np.uint64(1)


def vocabulary_size(*texts: DataFrame) -> int:
    """Different words of all texts, as the models read them; at least one."""
    every = texts[0]
    for t in texts[1:]:
        every = every.unionAll(t)
    words = every.select(F.explode(F.split("text", r"[ \t-\r]+")).alias("word")).where("word <> ''").distinct()
    upper = "".join(map(chr, range(65, 91)))
    return max(1, words.select(F.translate("word", upper, upper.lower()).alias("word")).distinct().count())


def pack(source: DataFrame, side: int, buckets: int) -> DataFrame:
    """(bucket, pack, side, keys, places, rows, counts): the distinct n-grams of packs of documents by bucket.

    keys: the bucket's different n-grams in the pack; places: how many documents have each; rows, counts: those documents' numbers
    in the pack and how often. Of each pack one row of side HEADER holds the doc_ids (keys), where they are null (places) and the words (counts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, todo, n, start = batch.column(0).to_pylist(), [], 0, 0
            for k, t in enumerate(batch.column(1)):
                ids = word_hashes(t.as_py())
                todo.append(ids)
                n += len(ids)
                if n >= PACK_WORDS or k == len(names) - 1 or len(todo) >= 60_000:
                    # A rerun of a lost task names its packs alike.
                    yield from packed((task << 32) + nth, names[start : k + 1], todo)
                    start, todo, n, nth = k + 1, [], 0, nth + 1

    def packed(name: int, names: list[int | None], todo: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = []
        if side == DOCUMENTS:
            null = np.fromiter((x is None for x in names), np.uint8, len(names))
            out.append((name % buckets, name, HEADER, np.array([x or 0 for x in names], np.int64).tobytes(), null.tobytes(), b"", np.array([len(x) for x in todo], np.int64).tobytes()))
        if sum(map(len, todo)):
            keys = np.concatenate([k for ids in todo if len(ids) for k in grams(ids)])
            rows = np.repeat(np.arange(len(todo), dtype=np.uint16), [2 * len(ids) for ids in todo])
            bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
            order = np.lexsort((rows, keys, bucket))
            keys, rows, bucket = keys[order], rows[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
            counts = np.diff([*starts, len(keys)]).astype(np.uint32)
            keys, rows, bucket = keys[starts], rows[starts], bucket[starts]
            bounds = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[b], bounds[b + 1])
                k, c = keys[part], counts[part]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                places = np.diff([*first, len(k)]).astype(np.uint16)
                # Within a bucket 48 bits tell n-grams apart.
                short = k[first].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                out.append((int(b), name, side, short, places.tobytes(), rows[part].tobytes(), (c.astype(np.uint8) if c.max() < 256 else c).tobytes()))
        types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), types)], names=["bucket", "pack", "side", "keys", "places", "rows", "counts"])

    return source.mapInArrow(run, "bucket int, pack long, side int, keys binary, places binary, rows binary, counts binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, count) of each entry of a packed row."""
    short = np.frombuffer(row["keys"], np.uint8).reshape(-1, 6)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :6] = short
    places, rows = np.frombuffer(row["places"], np.uint16), np.frombuffer(row["rows"], np.uint16)
    counts = np.frombuffer(row["counts"], np.uint8 if len(row["counts"]) == len(rows) else np.uint32)
    return np.repeat(keys.reshape(-1).view(np.uint64), places), rows, counts


def score(docs: DataFrame, target: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """(doc_id, n_tokens, score) for every row of docs; target has a column text.

    score: mean over the words of (loss under the target's model - loss under the background's), natural logarithms. Texts without
    words, and null ones, have score 0. Repeated rows are documents of their own. Without target texts the target's model is uniform.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mass = kappa * vocabulary_size(source.select("text"), wanted.select("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(t: pa.Table) -> pa.Table:
        packs, kinds, rows_out, values = [], [], [], []
        keys, rows, counts, at, sides = [], [], [], [], []
        for k, row in enumerate(t.select(["pack", "side", "keys", "places", "rows", "counts"]).to_pylist()):
            if row["side"] == HEADER:
                packs.append(row["pack"])
                kinds.append(HEADER)
                rows_out.append(row["keys"] + row["places"])
                values.append(row["counts"])
                continue
            e = unpacked(row)
            keys.append(e[0])
            rows.append(e[1])
            counts.append(e[2].astype(np.float64))
            at.append((row["pack"], row["side"]))
        if keys:
            sizes = [len(x) for x in keys]
            which = np.unique(np.concatenate(keys), return_inverse=True)
            target_side = np.repeat([s == TARGET for _, s in at], sizes)
            c = np.concatenate(counts)
            in_target = np.bincount(which[1], c * target_side, len(which[0]))
            in_docs = np.bincount(which[1], c * ~target_side, len(which[0]))
            is_bigram = (which[0] & np.uint64(1)).astype(bool)
            added = np.where(is_bigram, kappa, mass)
            sign = np.where(is_bigram, 1.0, -1.0)
            first = np.log(in_target + added)
            end = 0
            for (name, side), n, r in zip(at, sizes, rows):
                own, end = slice(end, end + n), end + n
                if side == TARGET:
                    continue
                w = which[1][own]
                gain = c[own] * sign[w] * (np.log(in_docs[w] - c[own] + added[w]) - first[w])
                total = np.bincount(r, gain)
                some = np.unique(r)
                packs.append(name)
                kinds.append(DOCUMENTS)
                rows_out.append(some.tobytes())
                values.append(total[some].astype(np.float32).tobytes())
        return pa.table({"pack": pa.array(packs, pa.int64()), "kind": pa.array(kinds, pa.int32()), "rows": pa.array(rows_out, pa.binary()), "sums": pa.array(values, pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        parts = t.select(["kind", "rows", "sums"]).to_pylist()
        head = next(x for x in parts if x["kind"] == HEADER)
        n = np.frombuffer(head["sums"], np.int64)
        names, null = np.frombuffer(head["rows"][: 8 * len(n)], np.int64), np.frombuffer(head["rows"][8 * len(n) :], np.uint8)
        total = np.zeros(len(n))
        for x in sorted((x for x in parts if x["kind"] == DOCUMENTS), key=lambda x: x["sums"]):
            total[np.frombuffer(x["rows"], np.uint16)] += np.frombuffer(x["sums"], np.float32)
        return pa.table({"doc_id": pa.array(names, pa.int64(), mask=null.astype(bool)), "n_tokens": pa.array(n, pa.int64()), "score": pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), pa.float64())})

    blocks = pack(source, DOCUMENTS, buckets).unionAll(pack(wanted, TARGET, buckets))
    sums = blocks.groupBy("bucket").applyInArrow(meet, "pack long, kind int, rows binary, sums binary")
    return sums.groupBy("pack").applyInArrow(gather, "doc_id long, n_tokens long, score double")
