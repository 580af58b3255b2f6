"""Benchmark decontamination by latent semantic retrieval.

Passages become TF-IDF vectors over the benchmark's words. A distributed randomised SVD of the passages gives a latent space; windows of
every document, at several lengths, are compared with the benchmark's items of about that length by cosine there. What
comes near is checked on words: the longest common subsequence of the item and the passage, and whether the item's end, its
answer, is there too, so that a paraphrase is found and a chance likeness is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Latent dimensions, and the columns sketched beyond them.
RANK, OVERSAMPLE = 64, 16
#: Words of a passage when frequencies are counted and the space is fitted.
PASSAGE = 32
#: Lengths of windows, continued by half as much again up to the longest item; an item belongs to the least that holds it.
SCALES = (8, 12, 18, 27, 40, 60, 90, 135, 200, 300)
#: Cosine that makes a candidate, and the part of the item's weight (sum of squared IDF) that the words of a window, whichever they are, must have.
NEAR, MASS = 0.6, 0.4
#: The part of the weight of an item's different words that a region must share with it before the longest common subsequence is sought.
SHARED = 0.4
#: Coverage of an item that convicts: this, and more the shorter the item is (SHORT / words); less by EASED if its answer is there.
COVERED, SHORT, EASED, ANSWER = 0.52, 2.0, 0.08, 0.75
#: Words at the end of an item that count as its answer.
ANSWER_WORDS = 5
#: Words of texts that are compared together, and of regions whose words are looked up at once.
TOGETHER, LOOKED_UP = 20_000, 1_000_000
#: Items of the benchmark that one pass over the documents takes.
ITEMS = 4096
#: ASCII characters that aren't letters or digits part words.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PARTS).split() if isinstance(text, str) else []


class Vocabulary(dict):
    """Numbers of words; what it lacks has the number after all of them."""

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, found, repeat(len(self))), np.int32, len(found))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits: one step for each element of b."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Index:
    """A block of items in the latent space."""

    ids: list[int]
    items: list[list[int]]
    vocabulary: Vocabulary
    idf: np.ndarray
    basis: np.ndarray

    def prepare(self) -> None:
        self.rows = np.vstack([self.idf[:, None] * self.basis, np.zeros((1, self.basis.shape[1]))]).astype(np.float32)
        self.by_scale, scales = {}, [*SCALES]
        while scales[-1] < max(map(len, self.items)):
            scales.append(scales[-1] * 3 // 2)
        for k, item in enumerate(self.items):
            scale = next(s for s in scales if len(item) <= s)
            self.by_scale.setdefault(scale, []).append(k)
        self.square = np.append(self.idf**2, 0.0)
        self.scale_of = {k: scale for scale, ks in self.by_scale.items() for k in ks}
        self.different = [np.unique(item) for item in self.items]
        self.weights = np.array([self.square[own].sum() for own in self.different])
        # (item, word) of all items as one sorted array of numbers.
        self.has = np.sort(np.concatenate([own.astype(np.int64) + k * len(self.square) for k, own in enumerate(self.different)]))
        self.vectors, self.masses = {}, {}
        for scale, ks in self.by_scale.items():
            v = np.stack([self.rows[self.items[k]].sum(0) for k in ks])
            self.vectors[scale] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            self.masses[scale] = np.array([self.square[self.items[k]].sum() for k in ks])

    def near(self, ids: np.ndarray, bounds: np.ndarray, cut: float = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of items, starts of windows and cosines: the windows of word ids that come near an item of their scale. No window leaves its text; bounds are the texts' starts.

        A window with too little of the vocabulary's weight for any item of its scale is passed over before its vector is made.
        """
        mass = np.zeros(len(ids) + 1)
        np.cumsum(self.square[ids], out=mass[1:])
        sums, out = None, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        stops = np.append(bounds[1:], len(ids))
        for scale, ks in self.by_scale.items():
            step = max(2, scale // 3)
            # Steps of each text from its start to its end: the last windows hold the end alone.
            counts = -(-(stops - bounds) // step)
            starts = np.repeat(bounds, counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            ends = np.minimum(starts + scale, np.repeat(stops, counts))
            own = mass[ends] - mass[starts]
            some = np.flatnonzero(own >= MASS * self.masses[scale].min())
            if not len(some):
                continue
            if sums is None:
                # Running sums of the vectors of known words; upto: how many of them come before each place.
                known = ids != len(self.idf)
                upto = np.concatenate([[0], np.cumsum(known)])
                sums = np.zeros((upto[-1] + 1, self.rows.shape[1]), np.float32)
                np.cumsum(self.rows[ids[known]], axis=0, out=sums[1:], dtype=np.float32)
            starts, ends, own = starts[some], ends[some], own[some]
            v = sums[upto[ends]] - sums[upto[starts]]
            cos = (v @ self.vectors[scale].T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)[:, None]
            r, c = np.nonzero((cos >= cut) & (own[:, None] >= MASS * self.masses[scale]))
            out.append((np.array(ks)[c], starts[r], cos[r, c].astype(float)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def sharing(self, ids: np.ndarray, bounds: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """If the regions around windows share enough of the weight of the items' different words, for each window and item."""
        stops = np.append(bounds[1:], len(ids))
        own = np.searchsorted(bounds, starts, "right") - 1
        scale = np.array([self.scale_of[k] for k in items.tolist()], np.int64)
        a = np.maximum(starts - scale // 2, bounds[own])
        n = np.minimum(starts + scale + scale // 2, stops[own]) - a
        out, at = np.zeros(len(items), bool), 0
        upto = np.cumsum(n)
        while at < len(items):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKED_UP, "right")))
            part = slice(at, end)
            pair = np.repeat(np.arange(end - at), n[part])
            place = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(a[part], n[part])
            word = ids[place].astype(np.int64)
            key = items[part][pair] * len(self.square) + word
            found = self.has[np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)] == key
            once = np.unique(pair[found] * len(self.square) + word[found])
            shared = np.bincount(once // len(self.square), self.square[once % len(self.square)], end - at)
            out[part] = shared >= SHARED * self.weights[items[part]]
            at = end
        return out

    def check(self, ids: np.ndarray, item: int, starts: list[int]) -> tuple[float, float]:
        """(coverage, answer) of an item in the regions around windows: the longest common subsequence by the item's length, and by that of its end."""
        own, scale = self.items[item], self.scale_of[item]
        tail, best = own[-ANSWER_WORDS:], (0.0, 0.0)
        regions: list[list[int]] = []
        margin = scale // 2
        for s in sorted(starts):
            a, b = max(0, s - margin), s + scale + margin
            if regions and a <= regions[-1][1] and b - regions[-1][0] <= 4 * (scale + margin):
                regions[-1][1] = b
            else:
                regions.append([a, b])
        for a, b in regions:
            there = ids[a:b]
            there = there.tolist()
            cover = common_subsequence(own, there) / len(own)
            if cover > best[0]:
                best = cover, common_subsequence(tail, there) / len(tail)
        return best

    def convicts(self, item: int, cover: float, answer: float) -> bool:
        bar = COVERED + SHORT / len(self.items[item])
        return cover >= min(bar, 1.0) or (cover >= bar - EASED and answer >= ANSWER)

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text (item_id, cosine, coverage, answer) of the items that it has."""
        if not hasattr(self, "rows"):
            self.prepare()
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        pieces, places, at = [], [], 0
        for k, text in enumerate(texts):
            found = words(text)
            if found:
                ids = self.vocabulary.numbers(found)
                pieces.append(ids)
                places.append((at, k, ids))
                at += len(ids)
            if places and (at >= TOGETHER or k == len(texts) - 1):
                bounds = np.array([p[0] for p in places])
                windows: dict[tuple[int, int], dict[int, float]] = {}
                together = np.concatenate(pieces)
                found = self.near(together, bounds)
                some = self.sharing(together, bounds, found[0], found[1])
                for item, start, cos in zip(*(x[some].tolist() for x in found)):
                    own = int(np.searchsorted(bounds, start, "right")) - 1
                    windows.setdefault((own, item), {})[start - places[own][0]] = cos
                for (own, item), starts in sorted(windows.items()):
                    # Words outside the vocabulary are like none of an item's.
                    cover, answer = self.check(places[own][2], item, [*starts])
                    if self.convicts(item, cover, answer):
                        out[places[own][1]].append((self.ids[item], max(starts.values()), cover, answer))
                pieces, places, at = [], [], 0
        return [sorted(x) for x in out]


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that tasks sent as (block, values as float64 bytes); blocks of BLOCK values are added where they meet."""

    def add(t: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in t["values"])
        return pd.DataFrame({"block": [t["block"].iloc[0]], "values": [total.tobytes()]})

    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for r in parts.groupBy("block").applyInPandas(add, "block int, values binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["values"], np.float64)
    return out[:size]


BLOCK = 16_384


def blocks(x: np.ndarray) -> pd.DataFrame:
    x = np.concatenate([x.ravel().astype(np.float64), np.zeros(-x.size % BLOCK)])
    return pd.DataFrame({"block": np.arange(len(x) // BLOCK, dtype=np.int32), "values": [x[k : k + BLOCK].tobytes() for k in range(0, len(x), BLOCK)]})


def build(docs: DataFrame, items: list[tuple[int, str]]) -> Index | None:
    """The latent space and the items in it. Items without words can't be found and are left out."""
    kept = [(i, w) for i, t in items if (w := words(t))]
    if not kept:
        return None
    vocabulary = Vocabulary({w: k for k, w in enumerate(sorted({w for _, ws in kept for w in ws}))})
    size = len(vocabulary)

    def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(passage, word) of the words of the vocabulary and the number of passages, for about TOGETHER words at a time."""
        ids, at, base = [], [], 0
        for k, text in enumerate(texts):
            own = vocabulary.numbers(words(text))
            ids.append(own)
            at.append(np.arange(len(own)) // PASSAGE + base)
            base += -(-len(own) // PASSAGE)
            if base and (base * PASSAGE >= TOGETHER or k == len(texts) - 1):
                w = np.concatenate(ids)
                known = w != size
                yield np.concatenate(at)[known], w[known], base
                ids, at, base = [], [], 0

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size + 1)
        for batch in batches:
            for p, w, n in passages(batch["text"].tolist()):
                df[:size] += np.bincount(np.unique(p * size + w) % size, minlength=size)
                df[size] += n
        yield blocks(df)

    df = summed(docs.select("text").mapInPandas(frequencies, "block int, values binary"), size + 1)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1

    width = min(RANK + OVERSAMPLE, size)
    omega = np.random.default_rng(7).standard_normal((size, width), np.float32)

    def add_weighted(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> None:
        """Adds A^T (A omega) of passages to y: rows of A are TF-IDF vectors of unit length."""
        both = np.sort(p * size + w)
        firsts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        pairs, tf = both[firsts], np.diff([*firsts, len(both)])
        p, w = pairs // size, pairs % size
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        x = (tf * idf[w]).astype(np.float32)
        norm = np.sqrt(np.add.reduceat(x * x, starts))
        counts = np.diff([*starts, len(p)])
        x = x / np.repeat(np.maximum(norm, 1e-9), counts)
        terms = omega[w]
        terms *= x[:, None]
        z = np.add.reduceat(terms, starts)
        order = np.argsort(w, kind="stable")
        sorted_w = w[order]
        firsts = np.flatnonzero(np.concatenate([[True], sorted_w[1:] != sorted_w[:-1]]))
        terms = z[np.repeat(np.arange(len(starts)), counts)[order]]
        terms *= x[order, None]
        y[sorted_w[firsts]] += np.add.reduceat(terms, firsts)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.zeros((size, width))
        for batch in batches:
            for p, w, _ in passages(batch["text"].tolist()):
                if len(p):
                    add_weighted(y, p, w)
        yield blocks(y)

    y = summed(docs.select("text").mapInPandas(sketch, "block int, values binary"), size * width).reshape(size, width)
    own = [(np.full(len(ws), k), np.array([vocabulary[w] for w in ws])) for k, (_, ws) in enumerate(kept)]
    # The items are passages too.
    add_weighted(y, np.concatenate([p for p, _ in own]), np.concatenate([w for _, w in own]))
    basis = np.linalg.svd(y, full_matrices=False)[0][:, :RANK]
    return Index([i for i, _ in kept], [[vocabulary[w] for w in ws] for _, ws in kept], vocabulary, idf, basis)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, ITEMS at a time: the driver holds one block, whatever the benchmark's size."""
    block = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) >= ITEMS:
            yield block
            block = []
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, cosine double, coverage double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, coverage, answer): the items of the benchmark that documents contain.

    Documents without a match have no row, nor have null or empty texts; an empty table or benchmark gives no rows. Repeated rows give
    repeated matches. coverage and answer are parts of the item's and its end's words found in order.
    """
    out = None
    for items in item_blocks(benchmark):
        index = build(docs, items)
        if index is None:
            continue

        def search(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, *m) for doc, found in zip(batch["doc_id"], index.matches(batch["text"].tolist())) for m in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "coverage", "answer"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = docs.select("doc_id", "text").mapInPandas(search, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item of the benchmark, with all columns."""
    import pyarrow as pa

    schema, out = docs.schema, docs
    for items in item_blocks(benchmark):
        index = build(docs, items)
        if index is None:
            continue

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            at = schema.fieldNames().index("text")
            for batch in batches:
                yield batch.filter(pa.array([not found for found in index.matches(batch.column(at).to_pylist())], pa.bool_()))

        out = out.mapInArrow(keep, schema)
    return out
