"""Rules against a plain model of the same repository."""

import random

import pytest

from loomstone.operators import graph as G
from loomstone.operators import rules as R


def made(spark, seed=11, n=80):
    rng = random.Random(seed)
    roles = {m: rng.choice([1, 2, 3, 4]) for m in range(6)}
    commits, parents = [], []
    for k in range(n):
        ups = rng.sample(range(k), min(k, rng.choice([0, 1, 1, 2]))) if k else []
        parents += [(k, o, p) for o, p in enumerate(ups)]
        commits.append((k, 0, rng.randrange(8), rng.randrange(1, 4), int(rng.random() < 0.1), rng.random() < 0.9))
    c = spark.createDataFrame(commits, "id long, repo long, author long, cited long, modifies int, sig_valid boolean")
    p = spark.createDataFrame(parents, "commit_id long, ordinal int, parent_id long")
    m = spark.createDataFrame([(0, k, r) for k, r in roles.items()], "repo long, member long, role int")
    return commits, parents, roles, c, p, m


def test_history(spark):
    commits, parents, roles, c, p, m = made(spark)
    effective = {k: cited + modifies for k, _, _, cited, modifies, _ in commits}
    wanted = set()
    for k, _, author, cited, modifies, valid in commits:
        ups = [b for a, _, b in parents if a == k]
        if not valid:
            wanted.add((k, "signature"))
        if roles.get(author, 0) < (4 if modifies else 2):
            wanted.add((k, "signer"))
        if ups and cited < max(effective[b] for b in ups):
            wanted.add((k, "monotone"))
        if not ups and cited != 1:
            wanted.add((k, "root"))
    assert {tuple(r) for r in R.rule_h(c, p, m).collect()} == wanted
    report = R.history_report(c, p, R.rule_h(c, p, m)).first()
    assert (report["commits"], report["invalid"]) == (len(commits), len({k for k, _ in wanted}))


def test_admission(spark):
    # 1 <- 2 <- 3 and 1 <- 4
    parents = spark.createDataFrame([(2, 0, 1), (3, 0, 2), (4, 0, 1)], "commit_id long, ordinal int, parent_id long")
    refs = spark.createDataFrame([(r, f"refs/branches/{n}", t) for r in range(3) for n, t in (("main", 2), ("side", 4), ("same", 4))], "repo long, name string, target long")
    members = spark.createDataFrame([(r, m, role) for r in range(3) for m, role in ((7, 2), (8, 1), (9, 3))], "repo long, member long, role int")
    repos = spark.createDataFrame([(0, True, True), (1, False, True), (2, True, False)], "repo long, has_current boolean, proved boolean")
    rows = [
        (1, 0, 9, "main", 2, 3, False, "admitted"),
        (2, 0, 7, "main", 3, 3, False, "stale"),
        (3, 0, 8, "main", 2, 3, False, "signer"),
        (4, 0, 9, "main", 2, 4, False, "unforced"),
        (5, 0, 7, "side", 4, 3, True, "protected"),  # a forced rewrite needs a maintainer
        (6, 0, 9, "side", 4, 3, True, "admitted"),
        (7, 0, 7, "main", 2, 3, False, "protected"),  # as does any update of a protected branch
        (8, 0, 9, "main", 2, 4, False, "unforced"), (8, 0, 9, "side", 4, 4, True, "unforced"),
        (9, 0, 7, "new", None, 3, False, "admitted"),
        (10, 0, 7, "new", None, None, False, "shape"),
        (11, 0, 7, "side", 4, None, False, "admitted"),  # another reference still reaches it
        (12, 0, 9, "main", 2, None, False, "unforced"),  # none does
        (13, 0, 9, "main", 2, None, False, "admitted"), (13, 0, 9, "side", 4, 4, False, "admitted"), (13, 0, 9, "new", None, 3, False, "admitted"),
        (14, 1, 9, "main", 2, 3, False, "no-current"),
        (15, 2, 9, "main", 2, 3, False, "unproved"),
        (16, 0, 9, "main", 2, 3, False, "incomplete"),
        (17, 0, 9, "main", 2, 3, False, "history"),
        (18, 0, 9, "main", 2, 3, False, "boundary"),
        (19, 0, 9, "main", 2, 3, False, "fork"),
        (20, 0, 9, "main", 2, 3, False, "shape"), (20, 0, 9, "main", 2, 3, False, "shape"),
        (21, 0, 9, "main", 2, 3, False, "boundary"),
        (22, 0, 9, "main", 2, 3, False, "admitted"),
    ]
    updates = spark.createDataFrame([(t, r, s, f"refs/branches/{n}", e, w, f) for t, r, s, n, e, w, f, _ in rows], "txn long, repo long, signer long, name string, expected long, new long, force boolean")
    facts = {16: (1, 0, 0, None, 0, None), 17: (0, 2, 0, None, 0, None), 18: (0, 0, 1, False, 0, None), 19: (0, 0, 0, None, 1, False), 21: (0, 0, 2, True, 0, None), 22: (0, 0, 1, True, 1, True)}
    exposed = spark.createDataFrame([(k, *x) for k, x in facts.items()], "txn long, missing int, violations int, boundaries int, boundary_ok boolean, forks int, fork_ok boolean")
    reach = G.reaches(parents, R.asked_of_reach(updates, refs))
    found = {r["txn"]: r["verdict"] for r in R.admit(updates, refs, repos, members, reach, exposed, ["main"]).collect()}
    assert found == {t: v for t, *_, v in rows}
    notes = updates.where("txn = 9").selectExpr("txn", "repo", "signer", "'refs/notes/x' AS name", "expected", "new", "force")
    assert [r["verdict"] for r in R.admit(notes, refs, repos, members, reach, exposed, ["main"]).collect()] == ["shape"]
    assert set(found.values()) == {*R.PRECEDENCE, "admitted"}


def test_projection_rejects(spark):
    edges = spark.createDataFrame([(1, 2, "release_envelope"), (2, 3, "commit_parent"), (3, 4, "commit_parent"), (9, 8, "predecessor_other_tree")], "src long, dst long, kind string")
    root = spark.createDataFrame([(1,)], "root long")
    assert {tuple(r) for r in R.projection_closure(edges, root, "release").collect()} == {(1, True), (2, True), (3, False)}
    assert {tuple(r) for r in R.projection_closure(edges, root, "full").collect()} == {(k, True) for k in (1, 2, 3, 4)}
    with pytest.raises(ValueError, match="rejects"):
        R.projection_closure(edges, spark.createDataFrame([(9,)], "root long"), "full")


def test_lineage_and_gate(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 4)], "src long, dst long")
    ids = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    ancestry = G.closure(links, ids.selectExpr("id AS root")).select("root", "id")
    current = spark.createDataFrame([(0, 3)], "repo long, current long")
    assert {r["id"] for r in R.conflicting_lineage(ids, ancestry, current).collect()} == {4, 5}
    bad = spark.createDataFrame([(2, "root")], "id long, rule string")
    batches = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "batch long, id long")
    assert {tuple(r) for r in R.receive(bad, batches).collect()} == {(1, False), (2, True)}
