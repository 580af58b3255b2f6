"""Sharding by balanced label propagation.

Documents of equal text are linked. Every linked document starts in the shard of its place among all; then,
round by round until nothing moves, the members of a group move to the shard where most of the group is, as far as that
shard's quota of rows allows: shards swap rows, in pairs and longer cycles, and fill what is free. Groups that are still cut
then are laid whole into what the others leave free. At last the unlinked documents, which cost no cut edge anywhere, fill
each shard up to its quota. Law `rows`: shards differ by one row at most.

A group is held as counts by shard, at most as many cells as there are shards, so a group with a third of all rows is
as cheap to move as any other; its documents take their shards by their place in the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, with_running_total


def start_cells(groups: DataFrame, shards: int) -> DataFrame:
    """(gkey, shard, n): the members of each group in each shard, when the place among all rows modulo shards decides."""
    each = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Places p in [start, start + n) with p % shards = shard.
    below = lambda end: F.floor((end + F.lit(shards - 1) - F.col("shard")) / F.lit(shards))
    n = (below(F.col("start") + F.col("n")) - below(F.col("start"))).cast("long")
    return each.select("gkey", "shard", n.alias("n")).where("n > 0")


def flows(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """Rows that move from shard to shard, of those that want to, so that none gets more than its room and what leaves it.

    Cycles first, the shortest before others, since they need no room; what then remains has none, and fills the room from its ends backwards.
    """
    shards = len(room)
    left, room, out = [list(x) for x in wanted], list(room), [[0] * shards for _ in range(shards)]

    def push(path: list[int], rows: int) -> None:
        for a, b in zip(path, path[1:]):
            left[a][b] -= rows
            out[a][b] += rows

    def cycle() -> list[int] | None:
        found = None
        for start in range(shards):
            before, todo = {}, [start]
            for at in todo:
                for b in range(shards):
                    if left[at][b] and b not in before:
                        before[b] = at
                        todo.append(b)
            if start in before:
                path = [start, before[start]]
                while path[-1] != start:
                    path.append(before[path[-1]])
                if found is None or len(path) < len(found):
                    found = path[::-1]
        return found

    while path := cycle():
        push(path, min(left[a][b] for a, b in zip(path, path[1:])))
    done: list[int] = []
    while len(done) < shards:
        # A shard whose own rows have been dealt with: what leaves it counts as room.
        t = next(s for s in range(shards) if s not in done and all(b in done or not left[s][b] for b in range(shards)))
        for s in range(shards):
            rows = min(left[s][t], room[t])
            push([s, t], rows)
            room[t] -= rows
            room[s] += rows
        done.append(t)
    return out


def held_rows(cells: DataFrame, shards: int) -> list[int]:
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return [held.get(s, 0) for s in range(shards)]


def propagate(groups: DataFrame, quotas: list[int]) -> DataFrame:
    """(gkey, shard, n) after label propagation under quotas of rows by shard, until nothing moves: each move raises the sum of n * n."""
    shards = len(quotas)
    cells = materialize(start_cells(groups, shards))
    while True:
        best = cells.groupBy("gkey").agg(F.max(F.struct("n", F.pmod(F.xxhash64("gkey", "shard"), F.lit(1 << 20)).alias("tie"), "shard")).alias("b"))
        wish = cells.join(best.select("gkey", F.col("b.shard").alias("target"), F.col("b.n").alias("most")), "gkey")
        movers = materialize(wish.where("shard <> target").withColumn("loss", F.col("n") - F.col("most")))
        wanted = [[0] * shards for _ in range(shards)]
        for r in movers.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():  # a row for each pair of shards
            wanted[r["shard"]][r["target"]] = r["n"]
        allowed = flows(wanted, [q - h for q, h in zip(quotas, held_rows(cells, shards))])
        if not any(map(sum, allowed)):
            discard(movers)
            break
        limit = F.element_at(F.array(*[F.lit(x).cast("long") for row in allowed for x in row]), F.col("shard") * shards + F.col("target") + 1)
        ranked = with_running_total(movers, ["shard", "target"], ["loss", "gkey"], "n", "before")
        ranked = materialize(ranked.withColumn("moved", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), limit - F.col("before")))).where("moved > 0").select("gkey", "shard", "target", "moved"))
        changes = cells.select("gkey", "shard", "n").unionAll(ranked.select("gkey", "shard", (-F.col("moved")).alias("n"))).unionAll(ranked.select("gkey", F.col("target").alias("shard"), F.col("moved").alias("n")))
        after = materialize(changes.groupBy("gkey", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        discard(cells, movers, ranked)
        cells = after
    return settle(cells, quotas)


def settle(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """cells with the groups that are cut laid anew, where that leaves fewer edges cut.

    In a line, the largest first, they fill what uncut groups leave free, so that only a group at the border of two
    shards is cut; those few go whole to a shard that has room for them, if one has.
    """
    shards = len(quotas)
    sizes = cells.groupBy("gkey").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum(F.col("n") * F.col("n")).alias("kept"))
    cut = materialize(sizes.where("parts > 1").select("gkey", "n", "kept", (-F.col("n")).alias("order")))
    kept_before = cut.agg(F.sum("kept")).first()[0]
    if not kept_before:
        return cells
    whole = materialize(cells.join(cut.select("gkey"), "gkey", "left_anti"))
    free = [q - h for q, h in zip(quotas, held_rows(whole, shards))]
    line, ends = with_running_total(cut, [], ["order", "gkey"], "n", "before"), [sum(free[: s + 1]) for s in range(shards)]
    pieces = []
    for s in range(shards):
        n = F.least(F.col("before") + F.col("n"), F.lit(ends[s])) - F.greatest(F.col("before"), F.lit(ends[s] - free[s]))
        pieces.append(F.struct(F.lit(s).alias("shard"), n.cast("long").alias("n")))
    laid = materialize(line.select("gkey", F.explode(F.array(*pieces)).alias("p")).select("gkey", "p.shard", "p.n").where("n > 0"))
    # At most one group for each border between shards.
    border = laid.groupBy("gkey").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").select("gkey", "n").collect()
    keys = [r["gkey"] for r in border]
    others = laid.where(~F.col("gkey").isin(keys))
    room, rows = [f - h for f, h in zip(free, held_rows(others, shards))], []
    for r in sorted(border, key=lambda r: (-r["n"], r["gkey"])):
        # The tightest shard that holds it; without one the roomiest shards, in turn.
        fits = [s for s in range(shards) if room[s] >= r["n"]]
        left = r["n"]
        for s in [min(fits, key=lambda s: room[s])] if fits else sorted(range(shards), key=lambda s: -room[s]):
            n = min(left, room[s])
            if n > 0:
                rows.append((r["gkey"], s, n))
                room[s] -= n
                left -= n
    placed = materialize(others.unionByName(cells.sparkSession.createDataFrame(rows, "gkey string, shard int, n long")))
    if (placed.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) <= kept_before:
        discard(cut, whole, laid, placed)
        return cells
    out = materialize(whole.unionByName(placed))
    discard(cells, cut, whole, laid, placed)
    return out


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. Null and empty texts are one group of equal texts. Repeated
    rows and null doc_ids are rows of their own, told apart by nothing but their place. An empty table gives no rows.
    Shards hold floor(N / shards) or one row more. Texts are read once and never dealt.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("gkey"), F.lit(1).cast("long").alias("one")))
    placed = materialize(with_running_total(narrow, [], ["gkey", "doc_id"], "one", "place"))
    discard(narrow)
    total = placed.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(placed.groupBy("gkey").agg(F.count("*").alias("n"), F.min("place").alias("start")).where("n > 1"))
    cells = propagate(groups, quotas)
    free = [q - h for q, h in zip(quotas, held_rows(cells, shards))]

    # A group's members take its shards in turn: the first cell's n members, then the next cell's. At most one step a shard.
    upto = F.sum("n").over(Window.partitionBy("gkey").orderBy("shard"))
    steps = cells.withColumn("upto", upto).groupBy("gkey").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("steps"))
    linked = groups.join(steps, "gkey").select("gkey", "start", "steps")
    joined = materialize(placed.join(linked, "gkey", "left"))
    rank = F.col("place") - F.col("start")
    taken = joined.where("steps IS NOT NULL").withColumn("shard", F.filter("steps", lambda x: x["upto"] > rank)[0]["shard"])
    single = with_running_total(joined.where("steps IS NULL").drop("steps", "start"), [], ["doc_id", "gkey"], "one", "nth")
    marks, at = [], 0
    for s in range(shards):
        at += free[s]
        marks.append(F.when(F.col("nth") < at, F.lit(s)))
    single = single.withColumn("shard", F.coalesce(*marks))
    keep = ["doc_id", "size", "text_crc32", "shard", "one", "gkey"]
    every = materialize(taken.select(keep).unionAll(single.select(keep)))
    discard(placed, groups, cells, joined)
    out = with_running_total(every, ["shard"], ["doc_id", "gkey"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
