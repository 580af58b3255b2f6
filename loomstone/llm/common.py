"""What the corpus operators share: tables, scratch tables in the shared folder, running totals, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local session gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomstone/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder: lineage is cut and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that materialize() returned, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "scratch", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, taken: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words that a worker remembers the hashes of, about 140 bytes each; forgotten when there are more.
WORDS = 200_000
_words: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: what ASCII white space parts, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > WORDS:
        _words.clear()
    get, one, ids = _words.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = one(w)
            if len(w) < 40:
                _words[w] = h
        ids.append(h)
    return np.array(ids, np.uint64)


def with_running_total(df: DataFrame, key: list[str], order: list[str], value: str, total: str) -> DataFrame:
    """Adds `total`: the sum of `value` over the rows of the same key that come before, by `order`.

    Rows are dealt by ranges of (key, order), so a key with most of the rows spans many tasks. Each task
    streams its sorted range; what precedes the range comes from one sum per task and key. The result is a
    materialized table. `value` must not be null. Rows equal in key and order may come in any order.
    """
    by = [*key, *order]
    fields = [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_at", T.LongType())]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, last, carried = TaskContext.get().partitionId(), None, 0
        for rows in batches:
            if rows.empty:
                continue
            v = rows[value].to_numpy(np.int64)
            at = np.cumsum(v) - v
            if key:
                names = list(map(tuple, rows[key].astype(object).where(rows[key].notna(), None).to_numpy()))
                new = np.fromiter((a != b for a, b in zip(names, [last, *names[:-1]])), bool, len(names))
                starts = np.flatnonzero(new)
                if len(starts) == 0 or starts[0]:
                    starts = np.concatenate([[0], starts])
                base = np.repeat(at[starts], np.diff([*starts, len(at)]))
                at = at - base
                if not new[0]:
                    at[: starts[1] if len(starts) > 1 else None] += carried
                last = names[-1]
            else:
                at = at + carried
            carried = int(at[-1] + v[-1])
            yield rows.assign(_pid=np.int32(pid), _at=at)

    local = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(stream, T.StructType(fields)))
    sums = local.groupBy("_pid", *key).agg(F.sum(value).alias("_sum"))
    # At most one row for each task, and one more for each key: a window of one key sees no more rows than there are tasks.
    from pyspark.sql import Window

    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_pid", *key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    sums = sums.withColumnsRenamed({k: f"_k_{k}" for k in key}).withColumnRenamed("_pid", "_p")
    same = F.col("_pid") == F.col("_p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(sums, same).withColumn(total, F.col("_at") + F.col("_base")).drop("_pid", "_at", "_p", "_base", *[f"_k_{k}" for k in key])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node reachable. A table in the shared folder.

    Alternates large-star and small-star steps over edges in the shared folder. Only minima are gathered by
    node, so a hub with many edges needs no list of its neighbours. Raises if `rounds` don't suffice.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        # Dealt once by u for both the minima and the edges that they replace.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small_least.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small)
        seen = nxt.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v", F.lit(7)) % 1000003), F.lit(0))).first()
        discard(now)
        now = nxt
        if tuple(seen) == mark:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            out = materialize(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
            discard(now)
            return out
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
