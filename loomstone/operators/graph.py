"""Queries over graphs of commits and objects: edges are (src, dst), or (commit_id, ordinal, parent_id) for commits.

Searches run in blocks: the edges are cut into blocks of bounded size, each block is searched to its end in one task, and what
leads to other blocks is handed over in rounds. Blocks follow `parts` (the repository of a node, say) where they are given, so a graph whose
parts hang together little needs few rounds. All state lies in the shared folder; a round's plan doesn't grow with the rounds before it.
"""

from __future__ import annotations

import re
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges that one task searches.
BLOCK_EDGES = 1_000_000
#: Tips whose ancestors merge_bases() marks in one sweep, a bit each on every commit.
SWEPT_TIPS = 512


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='loomstone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/loomstone/{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that a loop's plan stays short and survives lost executors."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _dropped(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that _written() returned."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def blocks(edges: DataFrame, parts: DataFrame | None, block_edges: int) -> DataFrame:
    """edges (src, dst) with `block`: all edges of a node are in one block, and those of a part (parts: id, part) in as few as their number allows.

    With `place` in parts (long; a commit's time, say) blocks are ranges of part and place, in a table of the shared folder. Where edges lead to earlier
    places, a search then passes each block of its part once; cut by hash, a long chain comes back to each block at every other step.
    """
    if parts is not None and "place" in parts.columns:
        at = parts.select(F.col("id").alias("src"), F.col("part").cast("long").alias("part"), F.col("place").cast("long").alias("place")).dropDuplicates(["src"])
        named = _written(edges.join(at, "src", "left"))
        n = max(1, -(-named.count() // block_edges))
        ranged = named.repartitionByRange(n, "part", "place", "src") if n > 1 else named
        cut = _written(ranged.select(*edges.columns, F.spark_partition_id().cast("long").alias("block") if n > 1 else F.lit(0).cast("long").alias("block")))
        _dropped(named)
        return cut
    if parts is None:
        named = edges.withColumn("part", F.lit(0).cast("long"))
    else:
        named = edges.join(parts.select(F.col("id").alias("src"), F.col("part").cast("long").alias("part")).dropDuplicates(["src"]), "src", "left")
    sizes = named.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block_edges)).cast("long").alias("cuts")).withColumnRenamed("part", "_part")
    cut = named.join(sizes, F.col("part").eqNullSafe(F.col("_part")))
    return cut.select(*edges.columns, F.xxhash64("part", F.pmod(F.xxhash64("src"), F.col("cuts"))).alias("block"))


def _cut(edges: DataFrame, parts: DataFrame | None, block_edges: int) -> DataFrame:
    """blocks() as a table of the shared folder."""
    found = blocks(edges, parts, block_edges)
    return found if hasattr(found, "scratch") else _written(found)


def closure(edges: DataFrame, roots: DataFrame, parts: DataFrame | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(root, id, depth): everything reachable from each root (root) over edges (src, dst), the root itself too, in a table of the shared folder.

    depth: steps of the path that led there first; the only one where nodes have one edge at most. Cycles end where they close.
    """
    kind = edges.schema["src"].dataType
    cut = _cut(edges.select("src", F.col("dst").cast(kind).alias("dst")).where("dst IS NOT NULL").distinct(), parts, block_edges)
    home = cut.select(F.col("src").alias("id"), F.col("block").alias("home")).distinct()
    found = T.StructType([T.StructField("root", kind), T.StructField("id", kind), T.StructField("depth", T.LongType()), T.StructField("open", T.BooleanType())])

    def search(at: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if at.empty:
            return pd.DataFrame({"root": at["id"], "id": at["id"], "depth": 0, "open": False}).iloc[:0]
        after: dict = {}
        for a, b in zip(own["src"].tolist(), own["dst"].tolist()):
            after.setdefault(a, []).append(b)
        out, starts = [], {}
        for root, x, depth in zip(at["root"].tolist(), at["id"].tolist(), at["depth"].tolist()):
            starts.setdefault(root, []).append((x, depth))
        for root, here in starts.items():
            seen, todo = {x for x, _ in here}, deque(sorted(here, key=lambda p: p[1]))
            while todo:
                x, depth = todo.popleft()
                for b in after.get(x, ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append((b, depth + 1))
                        out.append((root, b, depth + 1, b not in after))
        return pd.DataFrame(out, columns=["root", "id", "depth", "open"])

    path = _folder(edges.sparkSession)
    seen = edges.sparkSession.read.schema(T.StructType(found.fields[:3])).parquet
    first = roots.select(F.col("root").cast(kind).alias("root")).distinct().select("root", F.col("root").alias("id"), F.lit(0).cast("long").alias("depth"))
    first.write.parquet(path)
    frontier = None
    while True:
        at = (seen(path) if frontier is None else frontier.where("open")).select("root", "id", "depth").join(home, "id")
        step = at.groupBy("home").cogroup(cut.groupBy("block")).applyInPandas(search, found)
        # A node that its own block has searched needs no other task to do so.
        step = step.groupBy("root", "id").agg(F.min("depth").alias("depth"), F.min("open").alias("open"))
        new = _written(step.join(seen(path).select("root", "id"), ["root", "id"], "left_anti"))
        if frontier is not None:
            _dropped(frontier)
        frontier = new
        if new.isEmpty():
            break
        new.select("root", "id", "depth").write.mode("append").parquet(path)
        if new.where("open").join(home, "id", "left_semi").isEmpty():
            break
    _dropped(frontier, cut)
    out = seen(path)
    out.scratch = path
    return out


def commit_edges(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("commit_id").alias("src"), F.col("parent_id").alias("dst"))


def ancestors(parents: DataFrame, tips: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(root, id): each tip's ancestors and itself."""
    return closure(commit_edges(parents), tips, parts).select("root", "id")


def reached(edges: DataFrame, roots: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id): what any of the roots (root) reaches, themselves too: one search for all."""
    return _reached(edges, [roots], parts)[0]


def _reached(edges: DataFrame, all_roots: list[DataFrame], parts: DataFrame | None) -> list[DataFrame]:
    """reached() for each of several sets of roots; the edges are cut once."""
    kind = edges.schema["src"].dataType
    cut = _cut(edges.select("src", F.col("dst").cast(kind).alias("dst")).where("dst IS NOT NULL").distinct(), parts, BLOCK_EDGES)
    out = [_reached_in(cut, roots) for roots in all_roots]
    _dropped(cut)
    return out


def _reached_in(cut: DataFrame, roots: DataFrame) -> DataFrame:
    kind = cut.schema["src"].dataType
    home = cut.select(F.col("src").alias("id"), F.col("block").alias("home")).distinct()
    found = T.StructType([T.StructField("id", kind), T.StructField("open", T.BooleanType())])

    def search(at: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in zip(own["src"].tolist(), own["dst"].tolist()) if len(at) else ():
            after.setdefault(a, []).append(b)
        seen, todo, out = set(at["id"].tolist()), at["id"].tolist(), []
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
                    out.append((b, b not in after))
        return pd.DataFrame(out, columns=["id", "open"]) if out else pd.DataFrame({"id": at["id"].iloc[:0], "open": pd.Series([], dtype=bool)})

    path = _folder(cut.sparkSession)
    seen = cut.sparkSession.read.schema(T.StructType(found.fields[:1])).parquet
    roots.select(F.col("root").cast(kind).alias("id")).distinct().write.parquet(path)
    frontier = None
    while True:
        at = (seen(path) if frontier is None else frontier.where("open")).select("id").join(home, "id")
        # Blocks that nothing leads to rest.
        here = cut.join(at.select(F.col("home").alias("block")).distinct(), "block", "left_semi")
        step = at.groupBy("home").cogroup(here.groupBy("block")).applyInPandas(search, found)
        new = _written(step.groupBy("id").agg(F.min("open").alias("open")).join(seen(path), "id", "left_anti"))
        if frontier is not None:
            _dropped(frontier)
        frontier = new
        if new.isEmpty():
            break
        new.select("id").write.mode("append").parquet(path)
        if new.where("open").join(home, "id", "left_semi").isEmpty():
            break
    _dropped(frontier)
    out = seen(path)
    out.scratch = path
    return out


def have_want(parents: DataFrame, have: DataFrame, want: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id): what want reaches and have doesn't."""
    return difference(commit_edges(parents), have, want, parts)


def difference(edges: DataFrame, have: DataFrame, want: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id): what the roots `want` reach over edges and the roots `have` don't: what a fetch, a push or a mirror's pass must carry."""
    wanted, held = _reached(edges, [want, have], parts)
    return wanted.join(held, "id", "left_anti")


def unreachable(ids: DataFrame, parents: DataFrame, refs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id): stored commits that no reference reaches."""
    return unreferenced(ids, commit_edges(parents), refs.select(F.col("target").alias("root")), parts)


def unreferenced(ids: DataFrame, edges: DataFrame, roots: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id ...): the objects (id ...) that no root reaches over edges of any type."""
    return ids.join(reached(edges, roots, parts), "id", "left_anti")


#: What each type of object links to: link, and the type that it must have there.
LINKS = {
    ("commit", "tree"): "tree", ("commit", "authority"): "authority", ("commit", "parent"): "commit",
    ("release", "tree"): "tree", ("release", "predecessor"): "commit", ("release", "authority"): "authority", ("release", "parent_release"): "release",
    ("authority", "previous"): "authority", ("tree", "tree_entry"): "tree", ("tree", "blob_entry"): "blob",
}


def readable_edges(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): links (src, link, dst) of objects (id, type, readable) that a typed walk follows: those that the object's type has; an unreadable object leads nowhere."""
    kinds = F.array(*[F.concat(F.lit(f"{t}:"), F.lit(link)) for t, link in LINKS])
    good = objects.where("readable").select(F.col("id").alias("src"), "type")
    return links.join(good, "src").where(F.array_contains(kinds, F.concat_ws(":", "type", "link"))).select("src", "dst")


def mistyped(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(src, link, dst, problem): links to what isn't stored (`missing`), can't be read (`unreadable`) or has another type (`type`)."""
    wanted = F.create_map(*[x for (t, link), to in LINKS.items() for x in (F.lit(f"{t}:{link}"), F.lit(to))])
    named = links.join(objects.select(F.col("id").alias("src"), F.col("type").alias("_from")), "src")
    there = objects.select(F.col("id").alias("dst"), F.col("type").alias("_to"), "readable")
    both = named.join(there, "dst", "left")
    need = wanted[F.concat_ws(":", "_from", "link")]
    problem = F.when(F.col("_to").isNull(), "missing").when(~F.col("readable"), "unreadable").when(~F.col("_to").eqNullSafe(need), "type")
    return both.select("src", "link", "dst", problem.alias("problem")).where("problem IS NOT NULL")


def walk_budget(found: DataFrame, budget: int) -> DataFrame:
    """(objects, refused): the size of a walk, and whether it goes beyond its budget."""
    return found.agg(F.count("*").alias("objects")).withColumn("refused", F.col("objects") > budget)


def reaches(parents: DataFrame, pairs: DataFrame, commits: DataFrame | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(start, goal, reaches): if `goal` is an ancestor of `start`, or it; for each different pair (start, goal).

    commits (id, part): pairs are searched where the part's edges are, and a search stops at its goal. What a block can't
    decide goes on, pair by pair, in the blocks that its open nodes lead to. With `place` in commits, and no edge that leads to a later place, a search
    goes no further back than its goal; parents and pairs that are the wrong way round need none.
    """
    edges = commit_edges(parents).distinct()
    kind = edges.schema["src"].dataType
    asked = _written(pairs.select(F.col("start").cast(kind).alias("start"), F.col("goal").cast(kind).alias("goal")).where("start IS NOT NULL AND goal IS NOT NULL").distinct())
    direct = asked.where("start = goal").unionAll(asked.where("start <> goal").join(edges.select(F.col("src").alias("start"), F.col("dst").alias("goal")), ["start", "goal"], "left_semi"))
    direct = _written(direct)
    todo = asked.join(direct, ["start", "goal"], "left_anti")
    first, last = F.lit(-(1 << 62)), F.lit(1 << 62)
    if commits is not None and "place" in commits.columns:
        place = _written(commits.select(F.col("id").cast(kind).alias("id"), F.col("place").cast("long").alias("place")).dropDuplicates(["id"]))
        of = lambda x, name: place.select(F.col("id").alias(x), F.col("place").alias(name))
        edges = edges.join(of("dst", "at"), "dst", "left").select("src", "dst", F.coalesce("at", last).alias("at"))
        ordered = edges.join(of("src", "own"), "src", "left").where("own IS NULL OR at > own").isEmpty()
        todo = todo.join(of("start", "_start"), "start", "left").join(of("goal", "_goal"), "goal", "left")
        if ordered:
            todo = todo.where("_start IS NULL OR _goal IS NULL OR _start >= _goal")
        todo = todo.select("start", "goal", (F.coalesce("_goal", first) if ordered else first).alias("least"))
    else:
        edges, todo = edges.withColumn("at", last), todo.withColumn("least", first)
    cut = _cut(edges, commits, block_edges)
    home = cut.select(F.col("src").alias("id"), F.col("block").alias("home")).distinct()
    names = ["start", "goal", "id"]
    state = T.StructType([T.StructField(n, kind) for n in names] + [T.StructField("least", T.LongType()), T.StructField("hit", T.BooleanType())])

    def search(at: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b, place in zip(own["src"].tolist(), own["dst"].tolist(), own["at"].tolist()) if len(at) else ():
            after.setdefault(a, []).append((b, place))
        starts: dict = {}
        for start, goal, x, least in zip(*(at[n].tolist() for n in (*names, "least"))):
            starts.setdefault((start, goal, least), []).append(x)
        out = []
        for (start, goal, least), here in starts.items():
            # Newest first: a goal is mostly a few steps away.
            seen, todo, leave = set(here), deque(here), []
            while todo:
                x = todo.popleft()
                if x == goal:
                    out.append((start, goal, x, least, True))
                    leave = []
                    break
                for b, place in after.get(x, ()):
                    if place >= least and b not in seen:
                        seen.add(b)
                        todo.append(b)
                        if b not in after:
                            leave.append(b)
            out += [(start, goal, b, least, False) for b in leave]
        return pd.DataFrame(out, columns=[*names, "least", "hit"]) if out else pd.DataFrame({n: at["id"].iloc[:0] for n in names} | {"least": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})

    frontier = _written(todo.select("start", "goal", F.col("start").alias("id"), F.col("least").cast("long").alias("least"), F.lit(False).alias("hit")))
    rounds = [frontier]
    while True:
        done = _union(rounds).where("hit").select("start", "goal")
        at = frontier.where("NOT hit").join(home, "id").join(done, ["start", "goal"], "left_anti")
        here = cut.join(at.select(F.col("home").alias("block")).distinct(), "block", "left_semi")
        step = at.groupBy("home").cogroup(here.groupBy("block")).applyInPandas(search, state).distinct()
        new = _written(step.join(_union(rounds).select(*names, "hit"), [*names, "hit"], "left_anti").select(*names, "least", "hit"))
        rounds.append(new)
        frontier = new
        if len(rounds) > 8:
            rounds = [_written(_union(rounds))]
        if new.where("NOT hit").join(home, "id", "left_semi").isEmpty():
            break
    hits = _written(_union(rounds).where("hit").select("start", "goal").unionAll(direct).distinct().withColumn("hit", F.lit(True)))
    out = asked.join(hits, ["start", "goal"], "left").select("start", "goal", F.coalesce("hit", F.lit(False)).alias("reaches"))
    _dropped(cut)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionAll(df)
    return out


def chain(links: DataFrame, starts: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(root, id, depth): from each start along links (src, dst), at most one from a node, to the end, or to where a cycle closes; roots: (root)."""
    return closure(links, starts, parts)


def first_parent_log(parents: DataFrame, tips: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(root, id, depth): each tip's (root) line of first parents, newest first."""
    return chain(commit_edges(parents.where("ordinal = 0")), tips, parts)


def log_since(line: DataFrame, contained: DataFrame) -> DataFrame:
    """First-parent logs (root, id, depth), each up to its first commit that `contained` (id) has."""
    cut = line.join(contained.select("id").distinct(), "id", "left_semi").groupBy("root").agg(F.min("depth").alias("cut"))
    return line.join(cut, "root", "left").where("cut IS NULL OR depth < cut").select("root", "id", "depth")


def merge_bases(parents: DataFrame, pairs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(a, b, base): the first common commit in the order of a depth-first walk from b that takes the last parent first: not a lowest common ancestor.

    The walk depends on its own order, so a part's commits and the pairs in it meet in one task, which holds its edges once: what each tip of its pairs
    reaches is found for many tips in one sweep. Where edges or pairs go between parts, all is one part. Null without a common commit.
    """
    kind = parents.schema["commit_id"].dataType
    asked = pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).distinct()
    up = parents.where("parent_id IS NOT NULL").select(F.col("commit_id").alias("id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("parent_id").cast(kind).alias("up")).dropDuplicates(["id", "ordinal"])
    if parts is not None:
        of = parts.select(F.col("id").cast(kind).alias("id"), F.col("part").cast("long").alias("part")).dropDuplicates(["id"])
        ends = lambda df, x, y: df.join(of.withColumnRenamed("id", x), x, "left").join(of.select(F.col("id").alias(y), F.col("part").alias("_part")), y, "left")
        up, asked = _written(ends(up, "id", "up")), _written(ends(asked, "a", "b"))
        if up.unionByName(asked, allowMissingColumns=True).where("NOT (part <=> _part)").isEmpty():
            up, asked = up.drop("_part"), asked.drop("_part")
        else:
            parts, up, asked = None, up.drop("part", "_part"), asked.drop("part", "_part")
    if parts is None:
        up, asked = (df.withColumn("part", F.lit(0).cast("long")) for df in (up, asked))

    def walk(at: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "ordinal"])
        number: dict = {}
        for x in (own["id"], own["up"], at["a"], at["b"]):
            for y in x.tolist():
                number.setdefault(y, len(number))
        above: list = [()] * len(number)
        for x, y in zip(own["id"].tolist(), own["up"].tolist()):
            above[number[x]] = (*above[number[x]], number[y])
        # Children before their parents; what is left lies on or behind a cycle and is swept until nothing changes.
        children = [0] * len(number)
        for ys in above:
            for y in ys:
                children[y] += 1
        order = [x for x, n in enumerate(children) if not n]
        for x in order:
            for y in above[x]:
                children[y] -= 1
                if not children[y]:
                    order.append(y)
        ring = [x for x, n in enumerate(children) if n]
        by_tip: dict = {}
        for a, b in zip(at["a"].tolist(), at["b"].tolist()):
            by_tip.setdefault(a, []).append(b)
        tips, out = list(by_tip), []
        for lot in (tips[k : k + SWEPT_TIPS] for k in range(0, len(tips), SWEPT_TIPS)):
            of_tips = [0] * len(number)
            for bit, a in enumerate(lot):
                of_tips[number[a]] |= 1 << bit
            for x in order:
                if mask := of_tips[x]:
                    for y in above[x]:
                        of_tips[y] |= mask
            changed = bool(ring)
            while changed:
                changed = False
                for x in ring:
                    for y in above[x]:
                        if of_tips[x] & ~of_tips[y]:
                            of_tips[y] |= of_tips[x]
                            changed = True
            for bit, a in enumerate(lot):
                for b in by_tip[a]:
                    seen, todo, base = set(), [number[b]], None
                    while todo:
                        x = todo.pop()
                        if of_tips[x] >> bit & 1:
                            base = x
                            break
                        if x not in seen:
                            seen.add(x)
                            todo.extend(above[x])
                    out.append((a, b, base))
        names = list(number)
        return pd.DataFrame({"a": pd.Series([x[0] for x in out], dtype=object), "b": pd.Series([x[1] for x in out], dtype=object), "base": pd.Series([None if x[2] is None else names[x[2]] for x in out], dtype=object)})

    return asked.groupBy("part").cogroup(up.groupBy("part")).applyInPandas(walk, T.StructType([T.StructField(n, kind) for n in ("a", "b", "base")]))


def release_chain(releases: DataFrame) -> DataFrame:
    """(repo, id, depth): back from each repository's newest release (ties: the last by id) along parent_release."""
    newest = releases.groupBy("repo").agg(F.max(F.struct("ts", "id")).alias("m")).select("repo", F.col("m.id").alias("root"))
    line = chain(releases.select(F.col("id").alias("src"), F.col("parent_release").alias("dst")), newest, releases.select("id", F.col("repo").alias("part")))
    return newest.join(line, "root").select("repo", "id", "depth")


def hops(parents: DataFrame, tips: DataFrame, path: list[tuple[str, int]]) -> DataFrame:
    """(root, id): revisions like `~N` (N first parents) and `^N` (the N-th parent) from each tip; what doesn't exist is left out."""
    at = tips.select("root", F.col("root").alias("id"))
    for kind, n in path:
        for ordinal in [0] * n if kind == "~" else ([n - 1] if n else []):
            step = parents.where(F.col("ordinal") == ordinal).select(F.col("commit_id").alias("id"), "parent_id")
            at = at.join(step, "id").select("root", F.col("parent_id").alias("id"))
    return at


def topo_depth(parents: DataFrame, commits: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(id, depth): the longest line to a commit without parents, so ordering by (depth, id) puts parents first. Raises for a cycle.

    commits: (id), and `part` where there is one. A block is done in one task, from what it knows of depths in other blocks; rounds go on until nothing changes.
    """
    kind = parents.schema["commit_id"].dataType
    parts = commits.select("id", "part") if "part" in commits.columns else None
    cut = _cut(commit_edges(parents).distinct(), parts, block_edges)
    inner = cut.select(F.col("src").alias("id"), "block").distinct()
    known = _written(commits.select("id").distinct().join(inner, "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth")))
    schema = T.StructType([T.StructField("id", kind), T.StructField("depth", T.LongType())])

    def relax(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}
        for a, b in zip(own["src"].tolist(), own["dst"].tolist()):
            up.setdefault(a, []).append(b)
        depth = dict(zip(outer["id"].tolist(), outer["depth"].tolist()))
        found: dict = {}
        for start in up:
            todo, path = [start], set()
            while todo:
                x = todo[-1]
                if x in found:
                    todo.pop()
                    continue
                wait = [y for y in up[x] if y in up and y not in found]
                if wait:
                    if x in path:
                        raise ValueError("the commits form a cycle")
                    path.add(x)
                    todo += wait
                else:
                    path.discard(todo.pop())
                    found[x] = 1 + max((found[y] if y in up else depth.get(y, 0)) for y in up[x])
        return pd.DataFrame({"id": list(found), "depth": list(found.values())})

    crossing = cut.join(inner.select(F.col("id").alias("dst"), F.col("block").alias("there")), "dst", "left").where("there IS NULL OR there <> block").select("block", F.col("dst").alias("id")).distinct()
    crossing = _written(crossing)
    now, rounds, most = None, 0, inner.count() + 1
    while True:
        outer = crossing.join(known if now is None else known.unionAll(now), "id")
        new = _written(cut.groupBy("block").cogroup(outer.groupBy("block")).applyInPandas(relax, schema))
        changed = True if now is None else not new.join(now.withColumnRenamed("depth", "old"), "id").where("depth <> old").isEmpty()
        alone = now is None and crossing.join(inner, "id", "left_semi").isEmpty()
        if now is not None:
            _dropped(now)
        now, rounds = new, rounds + 1
        if not changed or alone:
            break
        if rounds > most:
            raise ValueError("the commits form a cycle")
    _dropped(cut, crossing)
    return known.unionAll(now)


def resolve_prefix(ids: DataFrame, prefix: str, shortest: int = 4, shown: int = 5) -> DataFrame:
    """(id, ambiguous): ids that start with a prefix of at least four hexadecimal digits; the first five when there are several."""
    if len(prefix) < shortest:
        return ids.select("id", F.lit(False).alias("ambiguous")).limit(0)
    found = ids.where(F.col("id").startswith(prefix.lower())).select("id").orderBy("id").limit(shown)
    return found.withColumn("ambiguous", F.count("*").over(Window.partitionBy(F.lit(1))) > 1)
