"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

The terms of a text are its words, weighted by how often they occur. Each of SAMPLES hash families draws, for every term, two
Gamma(2, 1) variates r, c and a uniform b from the term alone; a term of weight w has t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. A text's sample is the (term, t) of least a: two texts have it in common with a
probability of the sum of the lesser weights over the sum of the greater ones, the generalised Jaccard similarity.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLES = 32


def bounds_of(docs: DataFrame, parts: int) -> list[int]:
    """Values of doc_id that cut the rows into about as many parts of one size."""
    at = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", at, 20_000)).first()[0] if at else None
    return sorted(set(found or []))


def next_to(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(dealt, firsts). dealt: (bucket, nth, doc_id, text, next_text), where next is the following row by descending doc_id (null last),
    and the last row's next is the first. Rows of one doc_id come by text.

    Buckets are ranges of doc_id, so rows meet their neighbours in one exchange of the texts; only the first row of
    each bucket, one for a bucket, is brought to the bucket before.
    """
    bounds = bounds_of(docs, parts)
    # Descending: bucket 0 has the greatest ids; nulls come last.
    above = F.size(F.filter(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), lambda x: x > F.col("doc_id"))) if bounds else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(above))
    first_ids = rows.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    firsts = rows.withColumnRenamed("bucket", "_b").join(F.broadcast(first_ids), F.col("_b").eqNullSafe(F.col("bucket")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("bucket").agg(F.min("text").alias("first_text"))
    # One row for each bucket: a bucket's follower is the next that has rows, the last one's the first.
    order = Window.orderBy("bucket")
    firsts = materialize(firsts.withColumn("follows", F.lag("bucket").over(order)).withColumn("last", F.max("bucket").over(Window.orderBy(F.lit(1)))))
    firsts = firsts.select(F.coalesce("follows", "last").alias("bucket"), F.col("first_text"), F.col("bucket").alias("of_bucket"))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc(), "text")
    dealt = rows.withColumn("nth", F.row_number().over(w)).withColumn("lead_text", F.lead("text").over(w))
    dealt = dealt.join(firsts, "bucket", "left").select("bucket", "nth", "doc_id", "text", F.coalesce("lead_text", "first_text").alias("next_text"))
    return dealt, firsts


def edited(text: Column, following: Column) -> Column:
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def samples(terms: DataFrame, key: list[str], count: int) -> DataFrame:
    """(key, s0 ...): the samples of (key, term, weight), each the low 32 bits of a hash of the chosen (term, t)."""
    terms = terms.withColumn("ln_w", F.log(F.col("weight").cast("double")))
    low = F.lit((1 << 26) - 1)
    # A uniform variate of 26 bits of a hash, never 0 or 1.
    uniform = lambda bits: (bits.bitwiseAND(low) + F.lit(0.5)) / F.lit(float(1 << 26))
    drawn = []
    for k in range(count):
        z, y = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
        # The sum of two exponential variates is Gamma(2, 1).
        r = -F.log(uniform(z) * uniform(F.shiftrightunsigned(z, 26)))
        ln_c = F.log(-F.log(uniform(y) * uniform(F.shiftrightunsigned(y, 26))))
        b = (F.shiftleft(F.shiftrightunsigned(z, 52), 12) + F.shiftrightunsigned(y, 52)) / F.lit(float(1 << 24))
        t = F.floor(F.col("ln_w") / r + b)
        ln_a = ln_c - r * (t - b) - r
        # The least a in the high bits, which sort as a does; the choice in the low ones.
        high = F.shiftleft(F.floor((ln_a + F.lit(200.0)) * F.lit(float(1 << 22))).cast("long"), 32)
        choice = F.xxhash64(z, t.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
        drawn.append(F.min(high.bitwiseOR(choice)).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"s{k}"))
    return terms.groupBy(*key).agg(*drawn)


def words(text: Column) -> Column:
    return F.split(text, r"[ \t\n\r]+")


def signatures(texts: DataFrame, key: list[str], count: int = SAMPLES) -> DataFrame:
    """(key, signature): array of samples of `text` for each key; rows of `texts` must be dealt by a part of the key for
    this to need no exchange. A text without words has no row."""
    each = texts.select(*key, F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    terms = each.select(*key, F.xxhash64("word").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("weight"))
    return samples(terms, key, count).select(*key, F.array(*[f"s{k}" for k in range(count)]).alias("signature"))


def shown(signature: Column) -> Column:
    """A signature as text, eight hexadecimal digits a sample; empty for a text without words."""
    return F.coalesce(F.concat_ws("", F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0")))), F.lit(""))


def likeness(a: Column, b: Column, count: int = SAMPLES) -> Column:
    """The part of the samples that agree; texts without words are alike, and unlike all others."""
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    agreeing = F.aggregate(both, F.lit(0), lambda s, x: s + x) / F.lit(float(count))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(agreeing)


def fingerprints(docs: DataFrame, count: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document by descending
    doc_id. Null texts are empty. A table of one row is its own next. Repeated rows follow one another.
    """
    spark = docs.sparkSession
    dealt, firsts = next_to(docs, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["bucket", "nth"]
    change = edited(F.col("text"), F.col("next_text"))
    meta = dealt.select(*key, "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(change.cast("binary"), 256).alias("edited_sha256"))
    both = dealt.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), change.alias("text")))).alias("x")).select(*key, "x.side", "x.text")
    signed = signatures(both, [*key, "side"], count)
    sides = signed.groupBy(*key).agg(F.collect_list(F.struct("side", "signature")).alias("x"))
    one = lambda k: F.filter("x", lambda y: y["side"] == k)[0]["signature"]
    table = materialize(meta.join(sides, key, "left").select(*key, "doc_id", "n_chars", "edited_sha256", one(0).alias("own"), one(1).alias("changed")))
    heads = table.where("nth = 1").select(F.col("bucket").alias("of_bucket"), F.col("own").alias("head"), F.lit(True).alias("has_head"))
    heads = firsts.select("bucket", "of_bucket").join(heads, "of_bucket").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy("nth")
    led = table.withColumn("following", F.lead(F.struct("own")).over(w)).join(heads, "bucket", "left")
    after = F.when(F.col("following").isNotNull(), F.col("following.own")).otherwise(F.col("head"))
    return led.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed"), count).alias("near_edited"), likeness(F.col("own"), after, count).alias("near_next"))
