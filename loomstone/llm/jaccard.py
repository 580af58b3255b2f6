"""N-gram Jaccard join: exact similarity classes of shingle sets, by signature trees.

1. Each text becomes a sorted array of 64-bit hashes of its shingles. Texts with equal sets are one from here on, named by
   a hash of the set.
2. Candidates, without loss: the hash space is cut into more segments than two linked sets can differ in elements, so
   linked sets agree in a whole segment. Sets are told apart by classes of size; a set meets its own class and
   the next. A key is a class, a segment and the sum of its elements: unlike single shingles, it isn't shared by texts that
   have a passage in common. Keys travel in blocks of binary arrays; the sets of a key are a run.
3. A signature tree over the sets of overlapping runs (nodes hold OR- and AND-combined token bitmaps and the range of sizes) is
   traversed against itself, pruning node pairs by their largest possible overlap; the components of what is possible are groups.
4. Within a group the same traversal is followed by exact verification; only sets in groups are read again in full. Groups too large
   for a task are joined within blocks first; only what then isn't in the group's largest component meets all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, mix, unused, word_hashes

#: Sets that one task compares with each other; larger groups are cut into blocks.
BLOCK = 1024
#: Sets that runs which overlap may bring to one place; runs that would bring more go to places of their own.
PLACE = 4096
#: Sets of a place that are sifted by signatures in one task; all sets of a longer run are one group, for the exact comparison to part.
RUN = 50_000
LEAF = 32
#: Keys after which a pack ends, at the next text's end: it bounds what a worker holds, however many and long the texts of a batch are.
PACK = 1 << 19
#: Bits of the filter of candidate documents, at most: it bounds what is sent to all executors (16 MB).
FILTER_BITS = 1 << 27


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of the shingles of `width` words; all words as one shingle if there are fewer; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


class Scheme:
    """Classes of size and their segments, for similarity num / den at least."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.lows = num, den, [1]

    def size_class(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def segments(self, c: int) -> tuple[int, int]:
        """(segments, empty ones that need no key) for pairs whose smaller set is of class c."""
        while len(self.lows) < c + 2:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        top = self.lows[c + 1] - 1
        differ = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        slack = 1 + differ // 10 if differ else 0
        return differ + 1 + slack, slack

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """Keys of a sorted array of hashes. Two sets whose similarity reaches the scheme's have a key in common."""
        if not len(sets):
            return np.zeros(0, np.uint64)
        own, mixed, out = self.size_class(len(sets)), mix(sets), []
        for c in (own, own - 1) if own else (own,):
            m, slack = self.segments(c)
            # Monotonous in the hash, so a segment is a run of the sorted array.
            seg = ((sets >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            tag = np.uint64((c + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            out.append(mix(np.add.reduceat(mixed, starts) + mix(seg[starts] + tag)))
            if m - len(starts) > slack:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), seg[starts])
                out.append(mix(mix(empty + tag) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return np.concatenate(out)


def linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def dealt(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, keys, sets, counts, docs, sizes): the texts as packs, each by buckets of its keys, from one reading.

    A row with keys holds those of a bucket, five bytes each, in order of the sets (64-bit hashes) that have them, with each set's number
    of keys; equal sets of a pack are one. A row without holds the doc_ids of the pack, the sets and sizes of their texts.
    """

    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def pack(names: list[int | None], every: list[int], sizes: list[int], which: list[int], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(int(every[0] % buckets), b"", np.array(every, np.int64).tobytes(), b"", names, sizes)]
        if arrays:
            keys, at = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, at, bucket, which = keys[order], at[order], bucket[order], np.array(which, np.int64)
            bounds = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[b], bounds[b + 1])
                own, counts = np.unique(at[part], return_counts=True)
                # Within a bucket 40 bits tell keys apart but for a few, which cost a look at a signature.
                short = np.ascontiguousarray(keys[part].view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
                rows.append((int(b), short, which[own].tobytes(), counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes(), None, None))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), types)], names=["bucket", "keys", "sets", "counts", "docs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(num, den)
        for batch in batches:
            names, every, sizes, which, arrays, seen, held = [], [], [], [], [], set(), 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(t.as_py(), width)
                own = set_hash(s)
                names.append(doc)
                every.append(own)
                sizes.append(len(s))
                if len(s) and doc is not None and own not in seen:
                    seen.add(own)
                    which.append(own)
                    arrays.append(scheme.keys(s))
                    held += len(arrays[-1])
                if held >= PACK:
                    yield from pack(names, every, sizes, which, arrays)
                    names, every, sizes, which, arrays, seen, held = [], [], [], [], [], set(), 0
            if names:
                yield from pack(names, every, sizes, which, arrays)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket int, keys binary, sets binary, counts binary, docs array<long>, sizes array<long>")


def set_hash(s: np.ndarray) -> int:
    """64 bits that stand for a set of hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s)).view(np.int64))


def met(packs: DataFrame) -> DataFrame:
    """(run, id, doc_id, n): with run, the sets (id) that have a key in common, as runs of two or more; without, each document's set and its size."""

    def meet(t: pa.Table) -> pa.Table:
        keys, which, names, sets, sizes = [], [], [], [], []
        for short, own, counts, docs, n in zip(t.column("keys"), t.column("sets"), t.column("counts"), t.column("docs"), t.column("sizes")):
            own = np.frombuffer(own.as_buffer(), np.int64)
            if docs.is_valid:
                names.append(docs.values)
                sets.append(own)
                sizes.append(n.values)
                continue
            short = np.frombuffer(short.as_buffer(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :5] = short
            counts = np.frombuffer(counts.as_buffer(), np.uint8 if len(counts.as_buffer()) == len(own) else np.uint32)
            keys.append(wide.reshape(-1).view(np.uint64))
            which.append(np.repeat(own, counts))
        runs, ids = in_common(np.concatenate(keys), np.concatenate(which)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = pa.nulls(len(runs), pa.int64())
        links = pa.table({"run": pa.array(runs), "id": pa.array(ids), "doc_id": none, "n": none})
        if not sets:
            return links
        own = pa.array(np.concatenate(sets))
        return pa.concat_tables([links, pa.table({"run": pa.nulls(len(own), pa.int64()), "id": own, "doc_id": pa.concat_arrays(names), "n": pa.concat_arrays(sizes)})])

    return packs.groupBy("bucket").applyInArrow(meet, "run long, id long, doc_id long, n long")


def in_common(keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, set) of the sets that share a key; runs of the same sets are one, whatever their keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.concatenate([s[1:] == s[:-1], [False]])
    keep = order[same | np.concatenate([[False], same[:-1]])]
    keys, which = keys[keep], which[keep]
    order = np.lexsort((which, keys))
    keys, which = keys[order], which[order]
    if not len(keys):
        return np.zeros(0, np.int64), which
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])])
    keys, which = keys[first], which[first]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff([*starts, len(keys)])
    name = np.add.reduceat(mix(which.view(np.uint64) + np.uint64(1)), starts) ^ sizes.astype(np.uint64)
    alone = np.zeros(len(starts), bool)
    alone[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat((sizes > 1) & alone, sizes)
    return np.repeat(name, sizes)[keep].view(np.int64), which[keep]


class Filter:
    """A bitmap of hashed ids, sixteen bits for each, within a fixed bound."""

    def __init__(self, ids: DataFrame) -> None:
        count = ids.count()
        self.bits = min(FILTER_BITS, 1 << max(12, int(np.ceil(np.log2(16 * max(count, 1))))))
        words = ids.select(self.place(F.col(ids.columns[0])).alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toPandas()
        flags = np.zeros(self.bits // 32, np.uint32)
        flags[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
        self.words = ids.sparkSession.sparkContext.broadcast(flags)

    def place(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.bits))

    @staticmethod
    def hits(words: np.ndarray, places: pa.Array) -> np.ndarray:
        at = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, signs: bool) -> DataFrame:
    """(id, n, data): of each wanted set (id, doc_id: a document that has it) the hashes, or their signature.

    Texts aren't dealt: a filter of a bounded size drops nearly all others where they are read.
    """
    keep = Filter(wanted.select("doc_id"))
    shared, hits = keep.words, Filter.hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            some = batch.filter(pa.array(hits(words, batch.column(2))))
            for k in range(0, some.num_rows, 512):
                part = some.slice(k, 512)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                data = [(signature(s, bits_for(len(s))) if signs else s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "id", "n", "data"])

    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.withColumn("_at", keep.place(F.col("doc_id"))).mapInArrow(run, "doc_id long, id long, n long, data binary")
    return wanted.join(found.dropDuplicates(["id", "doc_id"]), ["id", "doc_id"]).select("id", "n", "data")


class Tree:
    """A signature tree: documents in leaves of LEAF, four nodes to a parent; levels[0] are the leaves."""

    def __init__(self, n: np.ndarray, signs: np.ndarray) -> None:
        self.order = np.lexsort((signs[:, 0], n))
        self.n, self.signs = n[self.order], signs[self.order]
        starts = np.arange(0, len(n), LEAF)
        any_of, all_of = np.bitwise_or.reduceat(self.signs, starts), np.bitwise_and.reduceat(self.signs, starts)
        low, high = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
        self.levels = [(any_of, all_of, low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), 4)
            any_of, all_of = np.bitwise_or.reduceat(any_of, starts), np.bitwise_and.reduceat(all_of, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((any_of, all_of, low, high))


def bits_for(most: int) -> int:
    """Bits of a bitmap of sets of so many elements."""
    return max(256, min(1 << 16, 1 << int(np.ceil(np.log2(4 * max(most, 1))))))


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of a set: a bit for each element, by its low bits."""
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def narrowed(sign: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap folded to fewer bits: that of the same set."""
    return np.bitwise_or.reduce(sign.reshape(-1, bits // 64), axis=0)


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets of left and right (None: left itself), enough of them for the same components as all links have."""
    bits = bits_for(max((len(s) for s in [*left, *(right or [])]), default=1))
    tree = lambda sets: Tree(np.array([len(s) for s in sets]), np.stack([signature(s, bits) for s in sets]))
    other = left if right is None else right

    def verified(i: int, j: int) -> bool:
        return linked(len(np.intersect1d(left[i], other[j], assume_unique=True)), len(left[i]), len(other[j]), num, den)

    return traverse(tree(left), None if right is None else tree(right), num, den, verified)


def stars(ids: list[int], links: list[tuple[int, int]]) -> pa.Table:
    """(u, v): each linked id with the least one that its links lead to."""
    union = Union(len(ids))
    for a, b in links:
        union.join(a, b)
    least: dict[int, int] = {}
    seen = {k for pair in links for k in pair}
    for k in seen:
        root = union.find(k)
        least[root] = min(least.get(root, ids[k]), ids[k])
    rows = [(ids[k], least[union.find(k)]) for k in seen if ids[k] != least[union.find(k)]]
    return pa.table({"u": pa.array([u for u, _ in rows], pa.int64()), "v": pa.array([v for _, v in rows], pa.int64())})


def traverse(a: Tree, right: Tree | None, num: int, den: int, verified: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of the trees (None: the first with itself) that pass the bounds, and `verified` if given; pairs that earlier ones join already are passed over."""
    b = a if right is None else right
    union, shift, links = Union(len(a.n) + (0 if right is None else len(b.n))), 0 if right is None else len(a.n), []

    def possible(x: tuple, i: int, y: tuple, j: int) -> bool:
        """If a pair below the nodes can be linked: its overlap is at most the smaller size, less what AND and OR rule out."""
        most = min(x[3][i], y[3][j])
        if den * most < num * max(x[2][i], y[2][j]):
            return False
        lost_x = int(np.bitwise_count(x[1][i] & ~y[0][j]).sum())
        lost_y = int(np.bitwise_count(y[1][j] & ~x[0][i]).sum())
        overlap = min(x[3][i] - lost_x, y[3][j] - lost_y)
        # The union has at least each side's least size and what the other side lacks.
        return den * overlap >= num * max(x[2][i] + lost_y, y[2][j] + lost_x)

    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        x, y = a.levels[la], b.levels[lb]
        if not possible(x, i, y, j):
            continue
        if la or lb:
            if la >= lb:
                kids = range(4 * i, min(4 * i + 4, len(a.levels[la - 1][2])))
                pairs = [(la - 1, k, lb, j) for k in kids]
            else:
                kids = range(4 * j, min(4 * j + 4, len(b.levels[lb - 1][2])))
                pairs = [(la, i, lb - 1, k) for k in kids]
            # Of a tree with itself, each pair of subtrees once: the first's documents don't all come after the second's.
            todo += pairs if right is not None else [p for p in pairs if p[1] * 4 ** p[0] <= p[3] * 4 ** p[2] + 4 ** p[2] - 1]
            continue
        rows, cols = range(i * LEAF, min(i * LEAF + LEAF, len(a.n))), range(j * LEAF, min(j * LEAF + LEAF, len(b.n)))
        # Pairs that are joined already need no look at their bitmaps.
        parts = np.fromiter(map(union.find, rows), np.int64, len(rows))
        others = np.fromiter((union.find(x + shift) for x in cols), np.int64, len(cols))
        apart = parts[:, None] != others[None, :]
        if not apart.any():
            continue
        p, q = a.signs[rows.start : rows.stop], b.signs[cols.start : cols.stop]
        n, m = a.n[rows.start : rows.stop][:, None], b.n[cols.start : cols.stop][None, :]
        lost_p = np.bitwise_count(p[:, None, :] & ~q[None]).sum(2, dtype=np.int64)
        lost_q = np.bitwise_count(q[None] & ~p[:, None, :]).sum(2, dtype=np.int64)
        overlap = np.minimum(n - lost_p, m - lost_q)
        ok = apart & (den * overlap >= num * (n + m - overlap))
        if right is None and i == j:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        for r, c in zip(*np.nonzero(ok)):
            u, v = rows.start + int(r), cols.start + int(c)
            if union.find(u) == union.find(v + shift):
                continue
            pair = int(a.order[u]), int(b.order[v])
            if verified is None or verified(*pair):
                union.join(u, v + shift)
                links.append(pair)
    return links


def places(runs: DataFrame) -> DataFrame:
    """(place, id): where the signatures of sets meet, so that those of a run do, each set as seldom as may be.

    The runs of near copies are many and overlap: each run goes to the least set that any of its members has as
    least of a run. A place with more than PLACE sets is left to its runs, one by one.
    """
    led = runs.join(runs.groupBy("run").agg(F.min("id").alias("least")), "run")
    leaders = led.groupBy("id").agg(F.min("least").alias("leader"))
    at = runs.join(leaders, "id").groupBy("run").agg(F.min("leader").alias("place"))
    each = materialize(runs.join(at, "run"))
    sizes = each.select("place", "id").distinct().groupBy("place").agg(F.count("*").alias("sets"))
    own = F.when(F.col("sets") > PLACE, F.xxhash64("run", F.lit(1))).otherwise(F.col("place"))
    out = materialize(each.join(sizes, "place").withColumn("place", own).select("place", "id").distinct())
    discard(each)
    return out


def sifted(runs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links whose components hold every linked pair of a run: what the signatures (id, n, data) of its sets leave possible."""

    def sift(t: pa.Table) -> pa.Table:
        ids, n = t.column("id").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        # Sets that meet are of neighbouring classes of size: their bitmaps are nearly as wide, and folded to the narrowest.
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("data")]
        bits = 64 * min(map(len, own))
        return stars(ids, traverse(Tree(n, np.stack([narrowed(x, bits) for x in own])), None, num, den))

    at = places(runs)
    sizes = at.groupBy("place").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    sized = at.join(sizes, "place")
    small = sized.where(F.col("size") <= RUN).select("place", "id").join(signs, "id")
    links = small.groupBy("place").applyInArrow(sift, "u long, v long")
    out = materialize(links.unionAll(sized.where((F.col("size") > RUN) & (F.col("id") != F.col("least"))).select(F.col("least").alias("u"), F.col("id").alias("v"))).distinct())
    discard(at)
    return out


def resolve(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root): the sets of members (id, root, hashes) that are linked within their groups, with the least set they lead to. A table in the shared folder."""

    def arrays(t: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        return t.column("id").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]

    def within(t: pa.Table) -> pa.Table:
        ids, sets = arrays(t)
        return stars(ids, tree_join(sets, None, num, den))

    def across(t: pa.Table) -> pa.Table:
        """Rows of side 0 against rows of side 1."""
        side = np.array(t.column("side").to_pylist())
        ids, sets = arrays(t)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = tree_join([sets[k] for k in p], [sets[k] for k in q], num, den) if len(p) and len(q) else []
        found = [(ids[p[a]], ids[q[b]]) for a, b in found if ids[p[a]] != ids[q[b]]]
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    sizes = materialize(members.groupBy("root").agg(F.count("*").alias("size")))
    sized = members.join(sizes, "root")
    # A group in one task: its components are known there.
    links = materialize(sized.where(F.col("size") <= BLOCK).groupBy("root").applyInArrow(within, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root")))
    if sizes.where(F.col("size") > BLOCK).isEmpty():
        discard(sizes)
        return links
    # Groups beyond a task: blocks join within, each with a few sets of the whole group among its own, which join the blocks.
    large = sized.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = materialize(large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    hubs = large.where(F.pmod(F.xxhash64("id", F.lit(5)), F.col("size")) < 8)
    in_all = hubs.withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").drop("own")
    inner = materialize(large.unionByName(in_all).select("root", "block", "id", "hashes").groupBy("root", "block").applyInArrow(within, "u long, v long"))
    found = components(inner)
    parts = materialize(large.select("root", "id").join(found.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id")))
    # Two sets of the largest component are joined already; every other set meets all blocks, in chunks of as many as a block has.
    largest = parts.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", "n").alias("largest"), (F.sum("n") - F.max("n")).alias("others"))
    apart = parts.join(largest, "root").where("part <> largest").select("id", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("others") / BLOCK)).cast("int").alias("chunk"))
    outside = materialize(large.join(apart, "id").select("root", "blocks", "chunk", "id", "hashes"))
    each = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "chunk", "block", "id", "hashes", F.lit(0).alias("side"))
    chunks = outside.select("root", "chunk").distinct()
    inside = large.join(chunks, "root").select("root", "chunk", "block", "id", "hashes", F.lit(1).alias("side"))
    outer = each.unionAll(inside).groupBy("root", "chunk", "block").applyInArrow(across, "u long, v long")
    whole = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(outer))
    out = materialize(links.unionAll(whole))
    discard(sizes, links, large, inner, found, parts, outside, whole)
    return out


def classes_of_sets(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(narrow, classes): (doc_id, id, n) of every row, and (id, class) of every set with shingles and a doc_id. Tables in the shared folder."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = materialize(met(dealt(docs, width, num, den, buckets)))
    narrow = both.where("run IS NULL").select("doc_id", "id", "n")
    runs = materialize(both.where("run IS NOT NULL").select("run", "id").distinct())
    holders = narrow.where("n > 0 AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(runs.select("id").distinct().join(holders, "id"))
    signs = materialize(sets_of(docs, wanted, width, signs=True))
    links = sifted(runs, signs, num, den)
    discard(runs, signs)
    groups = components(links)
    members = wanted.join(groups.select(F.col("node").alias("id"), "root"), "id")
    found = sets_of(docs, members.select("id", "doc_id"), width, signs=False)
    full = materialize(found.join(groups.select(F.col("node").alias("id"), "root"), "id").select("id", "root", F.col("data").alias("hashes")))
    discard(wanted, links, groups)
    roots = resolve(full, num, den)
    discard(full)
    joined = holders.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = materialize(joined.select("id", F.coalesce("root", "id").alias("class")))
    discard(roots)
    narrow.scratch = both.scratch
    return narrow, classes


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are what ASCII white space parts, A-Z lower-cased. Two documents link if den * common >= num * union of their sets of
    different shingles of `width` words; a text with fewer words is one shingle; one without words, or null, has none and links with nothing.
    component_id: the smallest doc_id reachable. Rows that repeat a doc_id are documents of their own, linked by their texts. Null
    doc_ids link with nothing, their component is null. Sets and shingles are told apart by 64-bit hashes.
    """
    narrow, classes = classes_of_sets(docs, width, num, den)
    linked_rows = narrow.where("n > 0 AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    least = linked_rows.join(classes, "id").groupBy("class").agg(F.min("doc_id").alias("component"))
    named = materialize(classes.join(least, "class").select("id", "component"))
    joined = narrow.join(named, "id", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (ties: the least hash of the set), all columns kept.

    Rows with a null doc_id, and rows without words, link with nothing and stay. Of rows that repeat a doc_id and its set one stays; rows
    of one doc_id with other texts are documents of their own. Only texts of doc_ids with a row to be removed, and a few
    that a bounded filter takes for such, are dealt.
    """
    narrow, classes = classes_of_sets(docs, width, num, den)
    rows = narrow.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "id").agg(F.count("*").alias("times"))
    classed = materialize(rows.join(classes, "id"))
    chosen = classed.groupBy("class").agg(F.min(F.struct("doc_id", "id")).alias("m")).select("m.doc_id", "m.id").withColumn("chosen", F.lit(True))
    judged = materialize(classed.join(chosen, ["doc_id", "id"], "left").select("doc_id", "id", "times", F.coalesce("chosen", F.lit(False)).alias("chosen")))
    discard(narrow, classes, classed)
    affected = judged.where("NOT chosen OR times > 1").select("doc_id").distinct()
    keep = Filter(affected)
    shared, hits, schema = keep.words, Filter.hits, docs.schema
    names = schema.fieldNames()
    extra, mark = unused("_set", names), unused("_place", names)

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = hits(shared.value, batch.column(batch.num_columns - 1))
            yield batch.filter(pa.array(~bad)).select(names)

    at = names.index("text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(hits(shared.value, batch.column(batch.num_columns - 1)))).select(names)
            for k in range(0, some.num_rows, 512):
                part = some.slice(k, 512)
                sets = [shingles(None if t is None else str(t), width) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], names=[*names, extra])

    from pyspark.sql import types as T

    placed = docs.withColumn(mark, F.coalesce(keep.place(F.col("doc_id").cast("long")), F.lit(0)))
    free = placed.mapInArrow(pass_by, schema)
    # A null doc_id has no place of its own; its rows stay, whichever branch they take.
    looked = placed.mapInArrow(look, T.StructType([*schema.fields, T.StructField(extra, T.LongType())]))
    stay = looked.where(F.col("doc_id").isNull() | F.col(extra).isNull()).select(names)
    ids = judged.where("chosen").select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"))
    named = looked.where(F.col("doc_id").isNotNull() & F.col(extra).isNotNull()).dropDuplicates(["doc_id", extra])
    one = named.join(ids, (F.col("doc_id").cast("long") == F.col("_d")) & (F.col(extra) == F.col("_i")), "left_semi").select(names)
    return free.unionAll(stay).unionAll(one)
