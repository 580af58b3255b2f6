"""Snapshot algebra: differences of trees, three-way classes, status and plans, as outer joins on path.

A snapshot is a DataFrame (path, hash, exec). All comparisons are null-safe: an absent file isn't an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _written


def entry() -> Column:
    return F.struct("hash", "exec")


def side(snapshot: DataFrame, name: str) -> DataFrame:
    return snapshot.select("path", entry().alias(name))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): A added, M changed in hash or exec, D deleted."""
    both = side(old, "l").join(side(new, "r"), "path", "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.select("path", F.when(F.col("l").isNull(), "A").when(F.col("r").isNull(), "D").otherwise("M").alias("change"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, no_auto: bool = False) -> DataFrame:
    """(path, class) over all paths. With no_auto, what only they changed is a conflict."""
    hashes = lambda df, name: df.select("path", F.col("hash").alias(name))
    all_ = hashes(base, "b").join(hashes(ours, "o"), "path", "full_outer").join(hashes(theirs, "t"), "path", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    theirs_only = F.when(t.isNull(), "theirs-deleted").otherwise("theirs-only") if not no_auto else F.lit("conflict")
    kind = (
        F.when(o.eqNullSafe(t), F.when(o.isNull(), "deleted-both").otherwise("agree"))
        .when(b.eqNullSafe(o), theirs_only)
        .when(b.eqNullSafe(t), F.when(o.isNull(), "ours-deleted").otherwise("ours-only"))
        .when(o.isNull() | t.isNull(), "modify-delete")
        .otherwise("both-changed")
    )
    return all_.select("path", kind.alias("class"))


def merge_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("paths"))


def staged_changes(head: DataFrame, index: DataFrame) -> DataFrame:
    """(path, change): New, Changed or Forgotten in the index against HEAD."""
    diff = tree_diff(head, index)
    return diff.select("path", F.when(F.col("change") == "A", "New").when(F.col("change") == "D", "Forgotten").otherwise("Changed").alias("change"))


def status(head: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, groups): the groups of a path. index has `conflicted`, worktree `kind` (file, symlink, other)."""
    i = index.select("path", F.struct("hash", "exec").alias("i"), "conflicted")
    w = worktree.select("path", F.struct("hash", "exec").alias("w"), "kind")
    all_ = side(head, "h").join(i, "path", "full_outer").join(w, "path", "full_outer")
    h, i_, w_ = F.col("h"), F.col("i"), F.col("w")
    marks = [
        (F.coalesce("conflicted", F.lit(False)), "conflicted"),
        (h.isNull() & i_.isNotNull(), "new"),
        (h.isNotNull() & i_.isNotNull() & ~h.eqNullSafe(i_), "staged"),
        (h.isNotNull() & i_.isNull(), "forgotten"),
        (i_.isNotNull() & (F.col("kind") == "file") & ~i_.eqNullSafe(w_), "modified"),
        (i_.isNotNull() & F.col("kind").isNull(), "deleted"),
        (i_.isNotNull() & F.col("kind").isNotNull() & (F.col("kind") != "file"), "replaced"),
        (i_.isNull() & h.isNull() & (F.col("kind") == "file"), "untracked"),
        (i_.isNull() & h.isNull() & (F.col("kind") == "symlink"), "symlinks"),
    ]
    groups = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in marks]), lambda x: x.isNotNull())
    return all_.select("path", groups.alias("groups")).where(F.size("groups") > 0)


def checkout_plan(head: DataFrame, target: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, action): write, remove, carry or refuse. The plan as a whole is refused if any row is (`plan_refused`)."""
    all_ = side(head, "h").join(side(target, "t"), "path", "full_outer").join(side(worktree, "w"), "path", "full_outer")
    h, t, w = F.col("h"), F.col("t"), F.col("w")
    action = (
        F.when(h.eqNullSafe(t), F.when(~w.eqNullSafe(h), "carry"))
        .when(w.eqNullSafe(t), None)
        .when(~w.eqNullSafe(h), "refuse")
        .when(t.isNull(), "remove")
        .otherwise("write")
    )
    return all_.select("path", action.alias("action")).where("action IS NOT NULL")


def plan_refused(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.max(F.col("action") == "refuse"), F.lit(False)).alias("refused"))


def scoped_commit(head: DataFrame, worktree: DataFrame, in_scope: Column) -> DataFrame:
    """The snapshot of a commit of a scope: in it the worktree, deletions too, elsewhere HEAD."""
    return worktree.where(in_scope).select("path", "hash", "exec").unionAll(head.where(~in_scope).select("path", "hash", "exec"))


def uncommitted(head: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, why): work that isn't committed: `staged` where the index differs from HEAD, else what the worktree has in place of HEAD's file."""
    h, i, w = side(head, "h"), side(index, "i"), worktree.select("path", F.struct("hash", "exec").alias("w"), "kind")
    all_ = h.join(i, "path", "full_outer").join(w, "path", "left")
    why = F.when(~F.col("h").eqNullSafe(F.col("i")), "staged").otherwise(changed(F.col("h")))
    return all_.select("path", why.alias("why")).where("why IS NOT NULL")


def changed(held: Column) -> Column:
    """What a working file (w, kind) is that isn't the one held: null if it is."""
    return F.when(F.col("kind").isNull(), "missing").when(F.col("kind") == "symlink", "a link").when(F.col("kind") != "file", "not a file").when(~F.col("w").eqNullSafe(held), "modified")


def would_lose(head: DataFrame, worktree: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, why): what writing paths (path, hash, exec), or removing them (hash null), would destroy: a link or folder there, or a file that is
    neither HEAD's nor the one to be written. A missing file loses nothing."""
    w = worktree.select("path", F.struct("hash", "exec").alias("w"), "kind")
    all_ = paths.select("path", F.when(F.col("hash").isNotNull(), entry()).alias("t")).join(side(head, "h"), "path", "left").join(w, "path")
    why = F.when(F.col("kind") == "symlink", "a link").when(F.col("kind") != "file", "not a file")
    why = why.when(F.col("h").isNull() & ~F.coalesce(F.col("w").eqNullSafe(F.col("t")), F.lit(False)), "untracked").when(~F.col("w").eqNullSafe(F.col("h")) & ~F.col("w").eqNullSafe(F.col("t")), "modified")
    return all_.select("path", why.alias("why")).where("why IS NOT NULL")


def staged_only(head: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, hash): versions that only the index holds: neither HEAD nor a working file has them."""
    w = worktree.where("kind = 'file'").select("path", F.struct("hash", "exec").alias("w"))
    all_ = side(index, "i").join(side(head, "h"), "path", "left").join(w, "path", "left")
    return all_.where(~F.col("i").eqNullSafe(F.col("h")) & ~F.col("i").eqNullSafe(F.col("w"))).select("path", F.col("i.hash").alias("hash"))


def scope_misses(scope: DataFrame, tracked: DataFrame) -> DataFrame:
    """(scope): scopes at which nothing is tracked: an error, not an empty scope. A tracked path counts for itself and for every folder above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = tracked.select(F.explode(above).alias("scope")).distinct()
    return scope.select("scope").distinct().where("scope NOT IN ('', '.')").join(held, "scope", "left_anti")


def status_json(groups: DataFrame, branch: str) -> DataFrame:
    """(report): one JSON document: schema_version, branch, clean, and the sorted paths of each group. Paths of a group meet in one row, as the report has them."""
    each = groups.select(F.explode("groups").alias("grp"), "path").groupBy("grp").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    one = each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "paths")))).alias("groups"))
    return one.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(branch).alias("branch"), (F.size("groups") == 0).alias("clean"), "groups")).alias("report"))


#: Longest path of a tree, in bytes; its entries are bounded too.
LONGEST_PATH, MOST_ENTRIES = 4096, 1 << 20


def tree_edges(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(dir, name, kind, id, exec) of every tree of a snapshot, deepest first: each tree's id is the hash of its sorted entries.

    depth: components of the longest path, counted if not given; one aggregation a level.
    """
    level = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit("blob").alias("kind"), F.col("hash").alias("id"), "exec")
    deepest = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    level = _written(level.withColumn("depth", deepest))
    if depth is None:
        depth = (level.agg(F.max("depth")).first()[0] or 0) + 1
    out, up = level.drop("depth"), None
    # All entries of a folder meet only when those below are done: folders by depth, deepest first.
    for at in range(depth - 1, 0, -1):
        here = level.where(F.col("depth") == at).drop("depth")
        trees = (here if up is None else here.unionAll(up)).groupBy("dir").agg(tree_id().alias("id"))
        up = _written(trees.select(F.regexp_extract("dir", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("dir", "([^/]*)$", 1).alias("name"), F.lit("tree").alias("kind"), "id", F.lit(False).alias("exec")))
        out = out.unionAll(up)
    return out


def tree_id() -> Column:
    """An aggregate: the hash of a folder's entries by name."""
    row = F.concat_ws(":", "name", "kind", "id", F.col("exec").cast("string"))
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ";"), 256)


def flatten_tree(edges: DataFrame, root: str = "", longest: int = LONGEST_PATH, most: int | None = MOST_ENTRIES) -> DataFrame:
    """(path, hash, exec) of the files below a folder; the control folder at the root is skipped. Levels are read until none is left;
    raises beyond `most` entries (none: as many as there are, since edges have each entry at its own path), or for a path of more than `longest` bytes, which a tree that contains itself comes to."""
    edges = _written(edges)
    own = edges.where((F.col("dir") != root) | (F.col("name") != ".control"))
    folders, total = [edges.sparkSession.createDataFrame([(root,)], "dir string")], 0
    inner = lambda path: F.expr(f"substring({path}, {len(root) + 2})") if root else F.col(path)
    # Only folders are kept level by level; files are read once, at the end.
    while True:
        below = own.select("dir", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "name").alias("path"), "kind").join(folders[-1], "dir").select(inner("path").alias("path"), F.col("path").alias("dir"), (F.col("kind") == "tree").alias("tree"))
        seen = below.agg(F.count("*"), F.coalesce(F.max(F.octet_length("path")), F.lit(0)), F.coalesce(F.max("tree"), F.lit(False))).first()
        total += seen[0]
        if (most is not None and total > most) or seen[1] > longest:
            raise ValueError("the tree goes beyond its bounds")
        if not seen[2]:
            break
        folders.append(_written(below.where("tree").select("dir")))
    all_ = folders[0]
    for level in folders[1:]:
        all_ = all_.unionAll(level)
    files = own.where("kind = 'blob'").join(all_, "dir")
    return files.select(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "name").alias("path"), F.col("id").alias("hash"), "exec").withColumn("path", inner("path"))


def write_once(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed append: the objects whose ids aren't stored yet, once each."""
    return objects.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def compare_and_set(updates: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo, name, expected, new, current, accepted, ...): an update holds iff its expected value is the current one of its repository's reference; absent equals absent."""
    now = refs.select("repo", "name", F.col("target").alias("current"))
    joined = updates.join(now, ["repo", "name"], "left")
    return joined.withColumn("accepted", F.col("expected").eqNullSafe(F.col("current")))


def recovery(recorded: DataFrame, refs: DataFrame) -> DataFrame:
    """(txn, repo, name, action, value): how an interrupted transaction (txn, repo, name, expected, new) is undone: `restore` what it had written,
    nothing where it hadn't, and `foreign`, only reported, where another has moved the reference since."""
    now = refs.select("repo", "name", F.col("target").alias("current"))
    all_ = recorded.join(now, ["repo", "name"], "left")
    action = F.when(F.col("current").eqNullSafe(F.col("expected")), "untouched").when(F.col("current").eqNullSafe(F.col("new")), "restore").otherwise("foreign")
    return all_.select("txn", "repo", "name", action.alias("action"), F.when(action == "foreign", F.col("current")).otherwise(F.col("expected")).alias("value"))


def all_or_nothing(checked: DataFrame, txn: str = "txn") -> DataFrame:
    """Checked updates with a transaction: committed iff every one of its updates is accepted."""
    verdict = checked.groupBy(txn).agg(F.min(F.col("accepted")).alias("committed"), F.count("*").alias("updates"))
    return verdict
