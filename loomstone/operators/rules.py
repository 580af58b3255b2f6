"""Rules of history, admission and reading, as views of typed violations.

Inputs are relational: commits (id, repo, author, cited, modifies, sig_valid), commit_parents, members (repo, member, role), roles
Reader 1 < Contributor 2 < Maintainer 3 < Owner 4, and authority versions that grow along a repository's chain.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import protected

READER, CONTRIBUTOR, MAINTAINER, OWNER = 1, 2, 3, 4
#: Which refusal of a transaction counts first.
PRECEDENCE = ["shape", "stale", "no-current", "unproved", "signer", "incomplete", "unforced", "protected", "history", "boundary", "fork"]


def effective_authority(commits: DataFrame) -> DataFrame:
    """(id, effective): the authority version that holds after a commit: the one it installs, else the one it cites."""
    return commits.select("id", F.when(F.col("modifies") == 1, F.col("cited") + 1).otherwise(F.col("cited")).alias("effective"))


def rule_h(commits: DataFrame, parents: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rule): violations of the rules of history.

    signature: not valid · signer: not a member, or below Contributor (Owner to change the authority) · monotone: cites an older
    version than a parent's effective one · root: a root that doesn't cite the first version.
    """
    role = commits.join(members.withColumnRenamed("member", "author"), ["repo", "author"], "left")
    need = F.when(F.col("modifies") == 1, OWNER).otherwise(CONTRIBUTOR)
    effective = effective_authority(commits).withColumnRenamed("id", "parent_id")
    held = parents.join(effective, "parent_id").groupBy("commit_id").agg(F.max("effective").alias("held"))
    monotone = commits.join(held, commits["id"] == held["commit_id"]).where(F.col("cited") < F.col("held"))
    roots = commits.join(parents.select(F.col("commit_id").alias("id")), "id", "left_anti")
    views = [
        commits.where("NOT sig_valid").select("id", F.lit("signature").alias("rule")),
        role.where(F.coalesce(F.col("role"), F.lit(0)) < need).select("id", F.lit("signer").alias("rule")),
        monotone.select("id", F.lit("monotone").alias("rule")),
        roots.where("cited <> 1").select("id", F.lit("root").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, views)


def history_report(commits: DataFrame, parents: DataFrame, violations: DataFrame) -> DataFrame:
    """(repo, commits, roots, merges, invalid): counts by repository, each object once."""
    child = parents.groupBy("commit_id").agg(F.max("ordinal").alias("last"))
    bad = violations.select("id").distinct().withColumn("bad", F.lit(1))
    all_ = commits.join(child, commits["id"] == child["commit_id"], "left").join(bad, "id", "left")
    return all_.groupBy("repo").agg(F.count("*").alias("commits"), F.sum(F.col("last").isNull().cast("long")).alias("roots"), F.sum((F.col("last") > 0).cast("long")).alias("merges"), F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("invalid"))


def first_refusal(checks: list[tuple[str, Column]]) -> Column:
    """The first kind, in the order of precedence, whose condition holds; null if none does."""
    order = {k: n for n, k in enumerate(PRECEDENCE)}
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in sorted(checks, key=lambda x: order[x[0]])])


def admit(updates: DataFrame, refs: DataFrame, repos: DataFrame, members: DataFrame, reach: DataFrame, exposed: DataFrame, protected_patterns: list[str]) -> DataFrame:
    """(txn, verdict): the first refusal of each transaction in the order of PRECEDENCE, or `admitted`.

    updates: (txn, repo, signer, name, expected, new, force); refs: (repo, name, target) before them, with `txn` where each transaction finds its own. Inputs about what lies behind:
      repos    (repo, has_current, proved): if there is a current authority, and if its chain ends at the repository's genesis
      reach    (start, goal, reaches): of each pair of a value that a reference has afterwards and one that an update gives up
      exposed  (txn, missing, violations, boundaries, boundary_ok, forks, fork_ok): what the transaction would publish for the first time
    Shape: a reference twice, a name that isn't a branch or release, a deletion that doesn't name what it holds. `unforced`: a rewrite
    without force. `protected`: below a maintainer, on a protected branch, or with a forced rewrite. A rewrite is an update to what doesn't
    descend from what was there, or a deletion of what no reference reaches after the whole transaction.
    """
    own = [k for k in ("txn", "repo", "name") if k in refs.columns]
    u = updates.join(refs.select(*own, F.col("target").alias("current")), own, "left")
    times = updates.groupBy("txn", "name").agg(F.count("*").alias("times"))
    role = members.select("repo", F.col("member").alias("signer"), "role")
    u = u.join(times, ["txn", "name"]).join(role, ["repo", "signer"], "left").join(repos, "repo", "left").join(exposed, "txn", "left")
    yes = reach.where("reaches").select(F.col("start").alias("new"), F.col("goal").alias("expected"), F.lit(True).alias("forward"))
    u = u.join(yes, ["new", "expected"], "left")
    after = standing_after(updates, refs)
    held = after.join(reach.where("reaches"), ["start", "goal"]).select("txn", F.col("goal").alias("expected"), F.lit(True).alias("held")).distinct()
    u = u.join(held, ["txn", "expected"], "left")
    published = F.col("name").startswith("refs/branches/") | F.col("name").startswith("refs/releases/")
    branch = F.regexp_replace("name", "^refs/branches/", "")
    old, new = F.col("expected"), F.col("new")
    rewrite = old.isNotNull() & F.when(new.isNotNull(), (old != new) & F.col("forward").isNull()).otherwise(F.col("held").isNull())
    below = F.coalesce(F.col("role"), F.lit(0)) < MAINTAINER
    kind = first_refusal([
        ("shape", (F.col("times") > 1) | (new.isNull() & old.isNull()) | ~published),
        ("stale", ~old.eqNullSafe(F.col("current"))),
        ("no-current", ~F.coalesce("has_current", F.lit(False))),
        ("unproved", ~F.coalesce("proved", F.lit(False))),
        ("signer", F.coalesce(F.col("role"), F.lit(0)) < CONTRIBUTOR),
        ("incomplete", F.coalesce("missing", F.lit(0)) > 0),
        ("unforced", rewrite & ~F.col("force")),
        ("protected", below & ((F.col("name").startswith("refs/branches/") & protected(branch, protected_patterns)) | (rewrite & F.col("force")))),
        ("history", F.coalesce("violations", F.lit(0)) > 0),
        ("boundary", (F.coalesce("boundaries", F.lit(0)) > 1) | ((F.coalesce("boundaries", F.lit(0)) == 1) & ~F.coalesce("boundary_ok", F.lit(False)))),
        ("fork", (F.coalesce("forks", F.lit(0)) > 1) | ((F.coalesce("forks", F.lit(0)) == 1) & ~F.coalesce("fork_ok", F.lit(False)))),
    ])
    order = F.create_map(*[x for n, k in enumerate(PRECEDENCE) for x in (F.lit(k), F.lit(n))])
    judged = u.withColumn("kind", kind)
    first = judged.groupBy("txn").agg(F.min_by("kind", order[F.col("kind")]).alias("kind"))
    return first.select("txn", F.coalesce("kind", F.lit("admitted")).alias("verdict"))


def standing_after(updates: DataFrame, refs: DataFrame) -> DataFrame:
    """(txn, start, goal): of each transaction that deletes, the values that references have after it, with each value that it gives up."""
    own = [k for k in ("txn", "repo") if k in refs.columns]
    gone = updates.where("new IS NULL AND expected IS NOT NULL").select("txn", "repo", F.col("expected").alias("goal")).distinct()
    left = gone.join(refs, own).join(updates.select("txn", "name").distinct(), ["txn", "name"], "left_anti").select("txn", F.col("target").alias("start"), "goal")
    sets = gone.join(updates.where("new IS NOT NULL").select("txn", F.col("new").alias("start")), "txn").select("txn", "start", "goal")
    return left.unionAll(sets)


def asked_of_reach(updates: DataFrame, refs: DataFrame) -> DataFrame:
    """(start, goal): the pairs whose ancestry admit() needs: an update's new value and the old one, and for a deletion every value that stands after it."""
    moves = updates.where("new IS NOT NULL AND expected IS NOT NULL").select(F.col("new").alias("start"), F.col("expected").alias("goal"))
    return moves.unionAll(standing_after(updates, refs).select("start", "goal")).distinct()


def admitted_counts(verdicts: DataFrame, exposed: DataFrame) -> DataFrame:
    """(commits, foreign_commits, releases): what admitted transactions publish, from exposed objects (txn, type, foreign)."""
    good = exposed.join(verdicts.where("verdict = 'admitted'").select("txn"), "txn", "left_semi")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return good.agg(count((F.col("type") == "commit") & ~F.col("foreign")).alias("commits"), count((F.col("type") == "commit") & F.col("foreign")).alias("foreign_commits"), count(F.col("type") == "release").alias("releases"))


def readers(repos: DataFrame, members: DataFrame, principals: DataFrame) -> DataFrame:
    """(repo, principal, may_read): public repositories for everybody, private ones for members, those without a proved current authority for nobody.

    principals: (repo, principal), the questions asked.
    """
    m = members.select("repo", F.col("member").alias("principal"), "role")
    asked = principals.join(repos, "repo").join(m, ["repo", "principal"], "left")
    may = F.col("proved") & (F.col("public_read") | (F.coalesce(F.col("role"), F.lit(0)) >= READER))
    return asked.select("repo", "principal", may.alias("may_read"))


def conflicting_lineage(authorities: DataFrame, ancestry: DataFrame, current: DataFrame) -> DataFrame:
    """(id): authorities neither on the chain to their repository's current one nor after it. ancestry: as authority.lineage() gives it, or pairs (root, id)."""
    if "low" in ancestry.columns:
        return _off_chain(authorities, ancestry, current)
    on_chain = current.join(ancestry, current["current"] == ancestry["root"]).select(ancestry["id"])
    after = ancestry.join(current.select(F.col("current").alias("id")), "id", "left_semi").select(F.col("root").alias("id"))
    return authorities.select("id").join(on_chain.unionAll(after).distinct(), "id", "left_anti")


def _off_chain(authorities: DataFrame, line: DataFrame, current: DataFrame) -> DataFrame:
    """conflicting_lineage() over the places of a lineage: one pass over each tree, however many of its authorities are current."""

    def near(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("low")
        low, high, now = (t[c].to_numpy() for c in ("low", "high", "now"))
        before = np.cumsum(now) - now
        ahead = before[np.searchsorted(low, high, "right") - 1] + now[np.searchsorted(low, high, "right") - 1] > before
        behind = np.maximum.accumulate(np.where(now > 0, high, -1)) >= low
        return pd.DataFrame({"id": t["id"][ahead | behind]})

    marked = line.select("id", "genesis", "low", "high").join(current.select(F.col("current").alias("id"), F.lit(1).cast("long").alias("now")).distinct(), "id", "left").fillna(0, ["now"])
    kept = marked.groupBy("genesis").applyInPandas(near, T.StructType([line.schema["id"]]))
    return authorities.select("id").join(kept, "id", "left_anti")


def _unless_after(rows: DataFrame, line: DataFrame, later: str, earlier: str, steps: int | None = None) -> DataFrame:
    """The rows whose authority `later` is neither the authority `earlier` nor after it; with steps, not so many after it. line: as authority.lineage() gives it."""
    named = rows
    for x, own in (("l", later), ("e", earlier)):
        named = named.join(line.select(F.col("id").alias(own), *(F.col(n).alias(f"_{n}_{x}") for n in ("genesis", "depth", "low", "high"))), own, "left")
    holds = (F.col("_genesis_l") == F.col("_genesis_e")) & F.col("_low_l").between(F.col("_low_e"), F.col("_high_e"))
    if steps is not None:
        holds = holds & (F.col("_depth_l") == F.col("_depth_e") + steps)
    return named.where(~F.coalesce(holds, F.lit(False))).select(*rows.columns)


def history_problems(commits: DataFrame, parents: DataFrame, members: DataFrame, line: DataFrame, pinned: DataFrame, releases: DataFrame) -> DataFrame:
    """(object, integrity, rule): every violation in a repository's history; integrity: damage, which stops a collection, not only a broken rule.

    commits: (id, repo, author, authority, installs, readable, sig_valid); releases: (id, repo, declarer, authority, predecessor); members: (id, member, role) by
    authority; line: as authority.lineage() gives it; pinned: (repo, genesis). Rules: `unreadable` (damage) · `signature` · `genesis`: the
    cited chain doesn't end at the pinned genesis · `signer`: not a member of the cited authority, or below Contributor (Owner to install another) ·
    `successor`: installs what isn't the cited authority's direct successor · `monotone`: the cited authority is neither a parent's effective one nor after it ·
    `root`: a root must cite the genesis · `release-signer`: below Maintainer · `release-authority`: neither the predecessor's effective one nor after it.
    """
    effective = commits.select(F.col("id").alias("parent_id"), F.coalesce("installs", "authority").alias("effective"))
    good = commits.where("readable")
    role = members.select(F.col("id").alias("authority"), F.col("member").alias("author"), "role")
    named = lambda df, key, rule, damage=False: df.select(F.col(key).cast("string").alias("object"), F.lit(damage).alias("integrity"), F.lit(rule).alias("rule"))
    need = F.when(F.col("installs").isNotNull(), OWNER).otherwise(CONTRIBUTOR)
    cited = good.join(parents.select(F.col("commit_id").alias("id"), "parent_id"), "id").join(effective, "parent_id")
    roots = good.join(parents.select(F.col("commit_id").alias("id")).distinct(), "id", "left_anti")
    declared = releases.join(members.select(F.col("id").alias("authority"), F.col("member").alias("declarer"), "role"), ["authority", "declarer"], "left")
    held = releases.join(effective.withColumnRenamed("parent_id", "predecessor"), "predecessor")
    views = [
        named(commits.where("NOT readable"), "id", "unreadable", True),
        named(good.where("NOT sig_valid"), "id", "signature"),
        named(_unless_after(good.join(pinned, "repo"), line, "authority", "genesis"), "id", "genesis"),
        named(good.join(role, ["authority", "author"], "left").where(F.coalesce(F.col("role"), F.lit(0)) < need), "id", "signer"),
        named(_unless_after(good.where("installs IS NOT NULL"), line, "installs", "authority", 1), "id", "successor"),
        named(_unless_after(cited.select("id", "authority", "effective"), line, "authority", "effective").select("id").distinct(), "id", "monotone"),
        named(roots.join(pinned, "repo").where("authority <> genesis"), "id", "root"),
        named(declared.where(F.coalesce(F.col("role"), F.lit(0)) < MAINTAINER), "id", "release-signer"),
        named(_unless_after(held, line, "authority", "effective"), "id", "release-authority"),
    ]
    return reduce(DataFrame.unionByName, views)


def collectable(problems: DataFrame) -> DataFrame:
    """(refused, damaged): a collection goes on only if nothing is damaged; broken rules don't stop it."""
    return problems.agg(F.coalesce(F.max("integrity"), F.lit(False)).alias("refused"), F.coalesce(F.sum(F.col("integrity").cast("long")), F.lit(0)).alias("damaged"))


def receive(violations: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, recorded): a batch of objects (batch, id) is recorded whole, or not at all if one of them is in violation."""
    bad = batches.join(violations.select("id").distinct(), "id", "left_semi").select("batch", F.lit(True).alias("bad")).distinct()
    return batches.select("batch").distinct().join(bad, "batch", "left").select("batch", F.col("bad").isNull().alias("recorded"))


def missing_entries(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(tree_id, name, hash): tree entries whose object isn't stored with the type the entry says."""
    stored = objects.select(F.col("id").alias("hash"), F.col("type").alias("entry_type"))
    return entries.join(stored, ["hash", "entry_type"], "left_anti").select("tree_id", "name", "hash")


def policy_violations(records: DataFrame, allowed: list[str], builtin: list[str]) -> DataFrame:
    """Merge records (path, handler) whose handler the policy doesn't allow."""
    from ..functions.paths import handler_allowed

    return records.where(~handler_allowed(F.col("handler"), allowed, builtin)).select("path", "handler")


#: What a projection does with an edge, fixed values: by kind of edge for the modes full, release and metadata.
PROJECTION = {
    "native_authority": ("retain", "retain", "retain"),
    "release_ref": ("retain", "retain", "retain"),
    "release_envelope": ("retain", "retain", "retain"),
    "parent_release": ("retain", "retain", "retain"),
    "predecessor_other_tree": ("reject", "reject", "reject"),
    "predecessor_same_tree": ("retain", "retain", "verify-then-omit"),
    "release_tree_or_blob": ("retain", "retain", "verify-then-omit"),
    "commit_parent": ("retain", "verify-then-omit", "verify-then-omit"),
    "foreign_fork_closure": ("retain", "verify-then-omit", "verify-then-omit"),
    "foreign_fork_boundary": ("retain", "retain", "retain"),
    "transaction_evidence": ("retain", "retain", "retain"),
    "branch_ref": ("retain", "omit", "omit"),
}
MODES = ["full", "release", "metadata"]


def project_edges(edges: DataFrame, mode: str) -> DataFrame:
    """edges (src, dst, kind) with `action`: the decision of a projection for each; unknown kinds are rejected."""
    at = MODES.index(mode)
    table = F.create_map(*[x for kind, row in PROJECTION.items() for x in (F.lit(kind), F.lit(row[at]))])
    return edges.withColumn("action", F.coalesce(table[F.col("kind")], F.lit("reject")))


def projection_closure(edges: DataFrame, roots: DataFrame, mode: str, parts: DataFrame | None = None) -> DataFrame:
    """(id, member): what a projection from roots (root) retains, and the boundary that it verifies but leaves out (member false).

    Retained edges are followed; edges to verify lead to a boundary object and no further. An edge to reject, from a retained object, raises.
    """
    from .graph import _written, reached

    judged = _written(project_edges(edges, mode))
    kept = reached(judged.where("action = 'retain'").select("src", "dst"), roots, parts)
    refused = judged.where("action = 'reject'").join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
    if not refused.isEmpty():
        raise ValueError("the projection rejects an edge of a retained object")
    border = judged.where("action = 'verify-then-omit'").join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    border = border.join(kept, "id", "left_anti")
    return kept.select("id", F.lit(True).alias("member")).unionAll(border.select("id", F.lit(False).alias("member")))


def read_verdict(kind: Column, size: Column, wanted: str, most: int) -> Column:
    """A bounded, typed read: refused by size before it is by type."""
    return F.when(size > most, "too-large").when(kind != wanted, "wrong-type").otherwise("ok")


def pack_limits(objects: DataFrame, by: list[str], most_bytes: int, most_object: int, most_objects: int = 1_000_000) -> DataFrame:
    """(by, objects, decoded, largest, refused): the size of packs and whether it is beyond a limit."""
    sums = objects.groupBy(*by).agg(F.count("*").alias("objects"), F.sum("size").alias("decoded"), F.max("size").alias("largest"))
    return sums.withColumn("refused", (F.col("decoded") > most_bytes) | (F.col("largest") > most_object) | (F.col("objects") > most_objects))


def gc_counts(dead: DataFrame, grace_days: int) -> DataFrame:
    """(deleted, kept_young): unreferenced objects beyond the days of grace, and those within."""
    old = F.col("age_days") > grace_days
    return dead.agg(F.sum(old.cast("long")).alias("deleted"), F.sum((~old).cast("long")).alias("kept_young"))


def ref_state_digest(refs: DataFrame) -> DataFrame:
    """(repo, digest): the hash of a repository's references in canonical order."""
    row = F.concat_ws(":", "name", F.col("target").cast("string"))
    return refs.groupBy("repo").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ";"), 256).alias("digest"))
