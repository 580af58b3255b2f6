"""Mixing sources to target weights.

Temperature mixing: the weight of a source is its share of the tokens to the power of an exponent from 0 (all
sources alike) to 1 (as they come), normalised. The exponent is bisected until the mixture has a
wanted entropy, or until no source repeats more often than a limit. Weights become budgets of tokens, and each
source fills its budget by epochs, each a permutation of its documents, dealt in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unused, with_running_total

#: Rounds of bisection: each narrows the exponent to a half.
HALVINGS = 24
SEED = 20_26


def token_count(text):
    """Words of a text by white space; null or blank: none."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r]", " "))
    return F.when(words == "", F.lit(0)).otherwise(F.regexp_count(words, F.lit(" +")) + 1).cast("long")


def shares(counted: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) by source. A null source is a source of its own. Every document counts a token more, its end."""
    sums = materialize(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    whole = sums.agg(F.sum("tokens")).first()[0] or 1
    return sums.withColumn("share", F.col("tokens") / F.lit(whole))


def fit_exponent(table: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The largest exponent whose mixture has the target entropy (as a part of log(sources)) at least, or the smallest
    under which the most repeated source is seen at most max_repeats times for once of the least repeated.

    Every step asks for one row over all sources, however many there are; none is sent to the driver.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // 3):
        # Eight exponents a job: three halvings at once.
        grid = [low + (high - low) * k / 8 for k in range(9)]
        ask = []
        for k, a in enumerate(grid):
            power = F.pow(F.col("share"), F.lit(a))
            if max_repeats is None:
                # H = log(sum w) - sum(w log w) / sum(w), of weights w = share ** a.
                ask.append((F.log(F.sum(power)) - F.sum(power * F.log(power)) / F.sum(power)).alias(f"v{k}"))
            else:
                ask.append((F.max(power / F.col("share")) / F.min(power / F.col("share"))).alias(f"v{k}"))
        row = table.agg(F.count("*").alias("n"), *ask).first()
        if not row["n"]:
            return 1.0
        import math

        fits = [row[f"v{k}"] <= max_repeats + 1e-12 if max_repeats is not None else row[f"v{k}"] >= target_entropy * math.log(row["n"]) - 1e-12 for k in range(9)]
        if max_repeats is not None:
            # More even as the exponent falls: the repeats grow. Fits from some exponent on.
            k = fits.index(True) if True in fits else 8
            low, high = (grid[max(k - 1, 0)], grid[k])
        else:
            k = max((i for i, ok in enumerate(fits) if ok), default=0)
            low, high = grid[k], grid[min(k + 1, 8)]
        if low == high:
            break
    return high if max_repeats is not None else low


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, tokens: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(budgets, placed). budgets: for each source its weight, repeats, budget in tokens. placed: a row for each document and epoch
    that fits its source's budget: row_key, doc_id, source, epoch, tokens, at (tokens of its source before it).

    The source that repeats least is seen once, so no document is left out; the others repeat as the weights demand.
    """
    count = F.col(tokens) if tokens else token_count(F.col("text")) + 1
    narrow = materialize(docs.select("doc_id", "source", count.alias("tokens"), row_key(docs).alias("row_key")))
    table = materialize(shares(narrow))
    exponent = fit_exponent(table, target_entropy, max_repeats)
    power = F.pow(F.col("share"), F.lit(exponent))
    power_sum, least = table.agg(F.coalesce(F.sum(power), F.lit(1.0)), F.coalesce(F.min(power / F.col("share")), F.lit(1.0))).first()
    repeats = F.greatest(F.lit(1.0), power / F.col("share") / F.lit(least))
    budgets = table.select("source", "tokens", "docs", "share", F.lit(exponent).alias("exponent"), (power / F.lit(power_sum)).alias("weight"), repeats.alias("repeats"))
    budgets = materialize(budgets.withColumn("budget", F.round(F.col("repeats") * F.col("tokens")).cast("long")))
    b = budgets.select(F.col("source").alias("_source"), "repeats", "budget")
    epochs = narrow.join(b, F.col("source").eqNullSafe(F.col("_source"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("repeats") - 1e-9).cast("int") - 1)))
    epochs = epochs.withColumn("place", F.xxhash64("row_key", "epoch", F.lit(SEED))).drop("_source", "repeats")
    every = with_running_total(epochs, ["source"], ["epoch", "place", "row_key", "doc_id"], "tokens", "at")
    # A source ends with the last place that starts within its budget; rows that repeat each other share a place, and stay together.
    ends = every.where("at < budget").groupBy("source").agg(F.max(F.struct("epoch", "place")).alias("_last")).withColumnRenamed("source", "_source")
    placed = every.join(ends, F.col("source").eqNullSafe(F.col("_source"))).where(F.struct("epoch", "place") <= F.col("_last")).drop("_source", "_last")
    discard(narrow)
    return budgets, placed


def row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, block_tokens: int = 65_536) -> DataFrame:
    """(doc_id, source, epoch, tokens, block, mix_at): where each document comes in the mixture.

    block counts the source's blocks of block_tokens. Reading blocks by mix_at interleaves the sources so that any
    stretch has nearly their weights: the b-th of n blocks stands at (b + u) / n, with u from a hash. A document lies in the
    block where it starts. Repeated rows are mixed as rows of their own; an empty table gives no rows.
    """
    budgets, placed = plan(docs, target_entropy, max_repeats)
    blocks = F.floor(F.col("at") / F.lit(block_tokens)).cast("long")
    spread = (F.pmod(F.xxhash64("source", "block", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    count = F.greatest(F.lit(1.0), F.ceil(F.col("budget") / F.lit(block_tokens)))
    return placed.withColumn("block", blocks).withColumn("mix_at", (F.col("block") + spread) / count).select("doc_id", "source", "epoch", "tokens", "block", "mix_at")


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0) -> DataFrame:
    """docs with each row as often as the mixture has it, all columns kept, whatever their names. Text isn't dealt: a source's last, partial
    epoch is a range of its permutation, so each row is decided by its source's last place. Null sources are one source, null texts
    have a token, their end; repeated rows are mixed alike; an empty table gives no rows."""
    budgets, placed = plan(docs, target_entropy, max_repeats)
    key, source, epoch, place, copy = (unused(x, docs.columns) for x in ("_row_key", "_source", "_last_epoch", "_last_place", "_copy"))
    ends = placed.groupBy("source").agg(F.max(F.struct("epoch", "place")).alias("m"))
    ends = materialize(ends.select(F.col("source").alias(source), F.col("m.epoch").alias(epoch), F.col("m.place").alias(place)))
    discard(budgets)
    out = docs.withColumn(key, row_key(docs)).join(ends, F.col("source").eqNullSafe(F.col(source)))
    within = F.xxhash64(key, epoch, F.lit(SEED)) <= F.col(place)
    copies = F.col(epoch) + F.when(within, 1).otherwise(0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).select(*docs.columns)
