"""Graph, log, path and source operators against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone import queries
from loomstone.functions.paths import glob_match, ignored, normalised, path_under, valid_ref_name
from loomstone.functions.text import has_conflict_markers, looks_binary
from loomstone.operators import graph as G
from loomstone.operators import log as L
from loomstone.operators import mirror as M
from loomstone.operators import revisions as V
from loomstone.operators import snapshots as S
from loomstone.sources import records as B
from loomstone.sources.objects import PackSource, decode_pack, encode_pack, object_bytes, parse_object
from loomstone.streaming import log as stream


def some_graph(n=60, seed=3):
    rng = random.Random(seed)
    return [(k, o, p) for k in range(1, n) for o, p in enumerate(rng.sample(range(k), min(k, rng.choice([1, 1, 2]))))]


def reach_of(rows):
    up = {}
    for a, _, b in rows:
        up.setdefault(a, []).append(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, [])
        return seen

    return reach


@pytest.mark.parametrize("block_edges", [1_000_000, 7])
def test_closures(spark, block_edges):
    """One block, and many between which the search goes to and fro, come to the same."""
    rows = some_graph()
    reach = reach_of(rows)
    parents = spark.createDataFrame(rows, "commit_id long, ordinal int, parent_id long")
    roots = spark.createDataFrame([(59,), (30,), (0,)], "root long")
    found = {tuple(r) for r in G.closure(G.commit_edges(parents), roots, block_edges=block_edges).select("root", "id").collect()}
    assert found == {(r, x) for r in (59, 30, 0) for x in reach(r)}
    pairs = spark.createDataFrame([(a, b) for a in (59, 41, 7) for b in range(0, 60, 7)], "start long, goal long")
    found = {(r["start"], r["goal"]): r["reaches"] for r in G.reaches(parents, pairs, block_edges=block_edges).collect()}
    assert found == {(a, b): b in reach(a) for a in (59, 41, 7) for b in range(0, 60, 7)}
    depth = {r["id"]: r["depth"] for r in G.topo_depth(parents, spark.range(60), block_edges).collect()}
    up = {}
    for a, _, b in rows:
        up.setdefault(a, []).append(b)
    wanted = {}
    for k in range(60):
        wanted[k] = 1 + max((wanted[b] for b in up.get(k, [])), default=-1)
    assert depth == wanted


def test_reached_by_parts(spark):
    rows = some_graph()
    reach = reach_of(rows)
    parents = spark.createDataFrame(rows, "commit_id long, ordinal int, parent_id long")
    parts = spark.range(60).select("id", (F.col("id") % 4).alias("part"))
    roots = spark.createDataFrame([(59,), (30,)], "root long")
    assert {r["id"] for r in G.reached(G.commit_edges(parents), roots, parts).collect()} == reach(59) | reach(30)
    none = spark.createDataFrame([], "root long")
    assert G.reached(G.commit_edges(parents), none).count() == 0 and G.closure(G.commit_edges(parents), none).count() == 0
    empty = spark.createDataFrame([], "commit_id long, ordinal int, parent_id long")
    assert {r["id"] for r in G.reached(G.commit_edges(empty), roots).collect()} == {59, 30}


def test_places_bound_rounds(spark, monkeypatch):
    """Blocks by place: a chain of 400 in blocks of 20 edges takes about 20 rounds, where blocks by hash take hundreds; with some edges that lead to later places too."""
    monkeypatch.setattr(G, "BLOCK_EDGES", 20)
    rows = [(k, k - 1) for k in range(1, 400)] + [(k, k + 25) for k in range(0, 300, 60)] + [(500, 399), (501, 500)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    parts = spark.range(400).select("id", F.lit(1).alias("part"), (F.col("id") * 10).alias("place"))
    rounds, kept = [], G._written
    monkeypatch.setattr(G, "_written", lambda df: (rounds.append(1), kept(df))[1])
    assert {r["id"] for r in G.reached(edges, spark.createDataFrame([(501,)], "root long"), parts).collect()} == {*range(400), 500, 501}
    assert len(rounds) < 60
    some = some_graph()
    reach = reach_of(some)
    edges = G.commit_edges(spark.createDataFrame(some, "commit_id long, ordinal int, parent_id long"))
    found = G.difference(edges, spark.createDataFrame([(30,)], "root long"), spark.createDataFrame([(59,)], "root long"), spark.range(60).select("id", (F.col("id") % 2).alias("part"), F.col("id").alias("place")))
    assert {r["id"] for r in found.collect()} == reach(59) - reach(30)


def test_cycles_end(spark):
    ring = spark.createDataFrame([(1, 0, 2), (2, 0, 3), (3, 0, 1)], "commit_id long, ordinal int, parent_id long")
    tip = spark.createDataFrame([(1,)], "root long")
    assert sorted((r["id"], r["depth"]) for r in G.first_parent_log(ring, tip).collect()) == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(Exception, match="cycle"):
        G.topo_depth(ring, spark.range(1, 4)).collect()


def test_long_chain(spark):
    parents = spark.range(1, 301).select(F.col("id").alias("commit_id"), F.lit(0).alias("ordinal"), (F.col("id") - 1).alias("parent_id"))
    line = G.first_parent_log(parents, spark.createDataFrame([(300,), (9,)], "root long"))
    assert {(r["root"], r["id"], r["depth"]) for r in line.collect()} == {(t, k, t - k) for t in (300, 9) for k in range(t + 1)}


def test_merge_base_is_first_hit(spark):
    # 5 has parents 3 and 4; the walk from 5 takes 4 first.
    rows = [(3, 0, 1), (4, 0, 2), (5, 0, 3), (5, 1, 4), (6, 0, 1), (6, 1, 2)]
    parents = spark.createDataFrame(rows, "commit_id long, ordinal int, parent_id long")
    pairs = spark.createDataFrame([(6, 5), (1, 2), (3, 3)], "a long, b long")
    assert {tuple(r) for r in G.merge_bases(parents, pairs).collect()} == {(6, 5, 2), (1, 2, None), (3, 3, 3)}


def plain_base(rows, a, b):
    reach, up = reach_of(rows), {}
    for x, _, y in sorted(rows):
        up.setdefault(x, []).append(y)
    of_a, seen, todo = reach(a), set(), [b]
    while todo:
        x = todo.pop()
        if x in of_a:
            return x
        if x not in seen:
            seen.add(x)
            todo += up.get(x, [])


@pytest.mark.parametrize("tips", [512, 3])
def test_merge_bases_of_parts(spark, monkeypatch, tips):
    """In parts, over parts, without parts, and over a cycle; tips swept together or few at a time."""
    monkeypatch.setattr(G, "SWEPT_TIPS", tips)
    rows = some_graph() + [(100 + a, o, 100 + b) for a, o, b in some_graph(40, 9)] + [(200, 0, 201), (201, 0, 202), (202, 0, 200), (203, 0, 201)]
    pairs = [(a, b) for a in (59, 40, 12, 7) for b in (58, 33, 5)] + [(100 + a, 100 + b) for a in (39, 20, 11) for b in (38, 3)] + [(200, 203), (203, 202), (7, 300), (203, 5)]
    parents, asked = spark.createDataFrame(rows, "commit_id long, ordinal int, parent_id long"), spark.createDataFrame(pairs, "a long, b long")
    wanted = {(a, b, plain_base(rows, a, b)) for a, b in pairs}
    parts = spark.range(204).select("id", F.floor(F.col("id") / 100).alias("part"))
    assert {tuple(r) for r in G.merge_bases(parents, asked, parts).collect()} == wanted
    inner = asked.where("floor(a / 100) = floor(b / 100)")
    assert {tuple(r) for r in G.merge_bases(parents, inner, parts).collect()} == {x for x in wanted if x[0] // 100 == x[1] // 100}


@pytest.mark.parametrize("late", [0, 7])
def test_reaches_by_places(spark, late):
    """Places prune where no edge leads to a later one, and only there."""
    rows = some_graph()
    reach = reach_of(rows)
    parents = spark.createDataFrame(rows, "commit_id long, ordinal int, parent_id long")
    places = spark.range(58).select("id", F.lit(0).alias("part"), (F.col("id") / 3).cast("long").alias("place") if not late else (F.col("id") * 31 % late).alias("place"))
    pairs = spark.createDataFrame([(a, b) for a in (59, 41, 7) for b in range(0, 60, 3)], "start long, goal long")
    found = {(r["start"], r["goal"]): r["reaches"] for r in G.reaches(parents, pairs, places, block_edges=30).collect()}
    assert found == {(a, b): b in reach(a) for a in (59, 41, 7) for b in range(0, 60, 3)}


def plain_verdicts(rows, ttl, skew):
    """Requests (request, key, nonce, ts, now) in order, each nonce remembered from when it was last accepted."""
    seen, out = {}, {}
    for request, key, nonce, ts, now in sorted(rows, key=lambda r: (r[3], r[0])):
        if now - ts > skew:
            out[request] = "Late"
        elif ts - now > skew:
            out[request] = "Early"
        elif (key, nonce) in seen and ts - seen[key, nonce] <= ttl:
            out[request] = "Replayed"
        else:
            seen[key, nonce] = ts
            out[request] = "Fresh"
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_replay_guard(spark, batches):
    """A refused repeat extends nothing, a nonce may come again after its time, and no cut of the stream changes a verdict."""
    second, rng = 1_000_000, random.Random(4)
    times = [0, 500, 1000, 1100, 1601, 1602]
    rows = [(k, 1, 7, t * second, t * second) for k, t in enumerate(times)] + [(100, 1, 8, 0, 400 * second), (101, 1, 8, 10 * second, 10 * second), (102, 1, 8, 20 * second, -400 * second)]
    rows += [(200 + k, rng.randrange(3), rng.randrange(4), (t := rng.randrange(5000)) * second, (t + rng.randrange(-400, 400)) * second) for k in range(150)]
    start = 1_700_000_000 * second
    rows = [(r, k, n, start + t, start + now) for r, k, n, t, now in rows]
    wanted = plain_verdicts(rows, 600 * second, 300 * second)
    assert [wanted[k] for k in range(6)] == ["Fresh", "Replayed", "Fresh", "Replayed", "Fresh", "Replayed"] and wanted[100] == "Late" and wanted[102] == "Early"
    df = spark.createDataFrame(rows, "request long, key long, nonce long, ts_us long, now_us long")
    assert {r["request"]: r["verdict"] for r in L.replay_verdicts(df).collect()} == wanted
    assert {r["request"]: r["verdict"] for r in stream.replay(df, stream.replay_guard, "ts_us", batches).collect()} == wanted


@pytest.mark.parametrize("lots", [1, 64])
def test_coalesced_in_lots(spark, monkeypatch, lots):
    """Operations of a lot don't mix, whatever batch an attempt comes in."""
    monkeypatch.setattr(stream, "LOTS", lots)
    rng = random.Random(4)
    rows = [(ns, (1 << 60) + op, attempt, rng.choice("xy")) for ns in (0, 1) for op in range(40) for attempt in range(rng.choice([1, 2, 3]))]
    led, wanted = {}, set()
    for ns, op, attempt, digest in sorted(rows, key=lambda r: r[2]):
        first = led.setdefault((ns, op), digest)
        wanted.add((ns, op, attempt, "BecomeLeader" if not attempt else "ReturnDurable" if first == digest else "OperationIdMismatch"))
    df = spark.createDataFrame(rows, "ns long, op_id long, attempt int, digest string").withColumn("at", F.col("attempt"))
    found = stream.replay(df, lambda x: stream.coalesce(x.drop("at")), "at")
    assert {tuple(r) for r in found.collect()} == wanted


def test_full_guard(spark):
    rows = [(0, 1, 1, 0), (0, 2, 2, 10), (0, 3, 3, 20), (0, 4, 1, 30), (0, 5, 3, 150), (0, 6, 1, 160)]
    df = spark.createDataFrame([(n, r, x, t * 1_000_000) for n, r, x, t in rows], "ns long, request long, nonce long, ts_us long")
    found = {r["request"]: r["verdict"] for r in L.bounded_replay(df, ttl_s=100, most=2).collect()}
    assert found == {1: "Fresh", 2: "Fresh", 3: "Full", 4: "Replayed", 5: "Fresh", 6: "Fresh"}


def test_ordered_fold_streams(spark):
    """A key's state goes on from one Arrow batch to the next."""
    df = spark.range(50_000).select(F.lit(3).cast("long").alias("ns"), F.col("id").alias("seq"), F.lit(0).alias("name"), F.when(F.col("id") > 0, F.col("id") - 1).alias("expected"), F.col("id").alias("new"))
    assert L.speculative_cas(df.repartition(7)).where("accepted").count() == 50_000


def test_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b.txt", "b.txt", "build/x", "src/build/y", "keep.log", "x.log", ".control/z", "sub/.control/z")], "path string")
    left = {r["path"] for r in paths.where(~ignored(F.col("path"), ["*.log", "!keep.log", "/build"])).collect()}
    assert left == {"a/b.txt", "b.txt", "src/build/y", "keep.log"}
    assert paths.where(path_under(F.col("path"), ["a"])).count() == 1 and paths.where(path_under(F.col("path"), ["."])).count() == 8
    names = spark.createDataFrame([("a/b",), ("a//b",), ("../x",), ("",)], "n string")
    assert [r[0] for r in names.select(valid_ref_name(F.col("n"))).collect()] == [True, False, False, False]
    for glob, name, hit in [("a*[!b]?", "axyz", True), ("a*[!b]?", "axbz", False), ("[^a]", "^", True), ("[^a]", "b", False), ("[a-c]x", "bx", True), ("[&&[]", "[", True), ("*.log", "a.log\n", False), ("a.c", "abc", False), ("[]]", "]", True), ("[!]]", "]", False)]:
        assert spark.createDataFrame([(name,)], "n string").select(glob_match(F.col("n"), glob)).first()[0] == hit, (glob, name)
    given = spark.createDataFrame([(p,) for p in ("b", "../b", "../../b", "/b/./c", "", "a\\b")], "p string")
    assert [r[0] for r in given.select(normalised(F.col("p"), "in")).collect()] == ["in/b", "b", None, "b/c", "in", "in/a/b"]


def test_text(spark):
    rows = spark.createDataFrame([(bytearray(b"plain"),), (bytearray(b"a\x00b"),), (bytearray(b"\xff\xfe"),)], "b binary")
    assert [r[0] for r in rows.select(looks_binary(F.col("b"))).collect()] == [False, True, True]
    marked = spark.createDataFrame([("x\n<<<<<<< ours\na\n=======\nb\n>>>>>>> theirs\n",), ("=======\n",)], "t string")
    assert [r[0] for r in marked.select(has_conflict_markers(F.col("t"))).collect()] == [True, False]


def test_groups_and_compaction(spark):
    arrivals = spark.createDataFrame([(0, k, k * 10, 10) for k in range(10)] + [(0, 10, 100, 10_000), (0, 11, 101, 10)], "shard long, op_id long, ts_us long, bytes long")
    groups = {r["op_id"]: r["grp"] for r in L.form_groups(arrivals, txns=4, size=1000, open_us=1000).collect()}
    assert [groups[k] for k in range(12)] == [0] * 4 + [1] * 4 + [2, 2, 3, 4]
    assert L.compaction_groups([(1, 5, 0), (2, 5, 0), (3, 5, 0), (4, 50, 0)], 60) == [[4, 3, 2]]
    assert L.compaction_groups([(1, 5, 0), (2, 5, 1)], 60) == []
    # A lone run keeps older groups waiting, unless it has no entries.
    assert L.compaction_groups([(1, 5, 0), (2, 5, 0), (3, 5, 1), (4, 5, 0), (5, 5, 0)], 60) == [[5, 4]]
    assert L.compaction_groups([(1, 5, 0), (2, 5, 0), (3, 0, 1), (4, 5, 0), (5, 5, 0)], 60) == [[5, 4], [2, 1]]


def test_empty_snapshots(spark):
    none = spark.createDataFrame([], "path string, hash string, exec boolean")
    one = spark.createDataFrame([("a", "", False)], "path string, hash string, exec boolean")
    assert S.tree_diff(none, none).count() == 0
    assert [r["change"] for r in S.tree_diff(none, one).collect()] == ["A"]
    assert [r["class"] for r in S.three_way(one, one, none).collect()] == ["theirs-deleted"]


def test_packs(spark, tmp_path):
    objects = [("blob", b"x" * 10), ("blob", bytes(range(256)) * 20), ("blob", bytes(range(256)) * 20 + b"tail"), ("tree", b"")]
    data = encode_pack(objects)
    assert decode_pack(data) == objects and len(data) < 6000
    assert parse_object(object_bytes("tree", b"abc")) == ("tree", b"abc")
    for broken in (data[:-1], data + b"x", b"NOPE" + data[4:]):
        try:
            decode_pack(broken)
            raise AssertionError
        except ValueError:
            pass
    (tmp_path / "one.pack").write_bytes(data)
    spark.dataSource.register(PackSource)
    assert spark.read.format("loompack").option("paths", str(tmp_path / "one.pack")).load().count() == 4


def test_flatten_bounds(spark):
    deep = "/".join(f"d{k}" for k in range(34)) + "/file"
    files = spark.createDataFrame([(deep, "1", False), ("top", "2", True)], "path string, hash string, exec boolean")
    edges = S.tree_edges(files)
    assert {tuple(r) for r in S.flatten_tree(edges).collect()} == {(deep, "1", False), ("top", "2", True)}
    with pytest.raises(ValueError, match="bounds"):
        S.flatten_tree(edges, longest=10)
    ring = spark.createDataFrame([("", "a", "tree", "x", False), ("a", "a", "tree", "x", False), ("a/a", "a", "tree", "x", False)], "dir string, name string, kind string, id string, exec boolean")
    assert S.flatten_tree(ring).count() == 0


def test_flatten_beyond_the_bound(spark, monkeypatch):
    """The query has every file of the snapshot, also beyond the bound for untrusted trees, which stays."""
    files = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.lit("1").alias("hash"), F.lit(False).alias("exec"))
    edges = S.tree_edges(files)
    with pytest.raises(ValueError, match="bounds"):
        S.flatten_tree(edges, most=40)
    assert S.flatten_tree(edges, most=None).count() == 40
    monkeypatch.setattr(S.flatten_tree, "__defaults__", ("", S.LONGEST_PATH, 40))
    assert queries.tree_flatten({"tree_base": files}).count() == 40


def test_revisions(spark):
    ids = {k: f"{k:02x}" * 32 for k in range(1, 8)}
    ids[8] = "0101" + "ff" * 30
    objects = spark.createDataFrame([(ids[k], "commit", None) for k in (1, 2, 3, 4, 8)] + [(ids[5], "release", ids[3]), (ids[6], "tree", None)], "id string, type string, predecessor string")
    refs = spark.createDataFrame([("refs/branches/main", ids[4]), ("refs/branches/x", ids[2]), ("refs/releases/x", ids[5]), ("refs/releases/v1", ids[5]), ("refs/branches/0606", ids[1])], "name string, target string")
    parents = spark.createDataFrame([(ids[4], 0, ids[3]), (ids[4], 1, ids[2]), (ids[3], 0, ids[1])], "commit_id string, ordinal int, parent_id string")
    head = spark.createDataFrame([(ids[4],)], "target string")
    wanted = {
        "HEAD": (ids[4], None), "main~": (ids[3], None), "main~2": (ids[1], None), "main~3": (None, "no-parent"), "main^2": (ids[2], None), "main^3": (None, "no-parent"), "main^0": (ids[4], None),
        "x": (ids[2], None), "v1": (ids[5], None), "v1~1": (ids[1], None), "0606": (ids[1], None), "0101": (None, "ambiguous"), "0101f": (ids[8], None), "01": (None, "unknown"), "0303": (ids[3], None),
        "main~x": (None, "bad-suffix"), "nothing": (None, "unknown"), ids[6]: (ids[6], None), "07" * 32: (ids[7], None), "060": (None, "unknown"),
    }
    found = {r["spec"]: (r["id"], r["problem"]) for r in V.resolve(spark.createDataFrame([(s,) for s in wanted], "spec string"), refs, objects, parents, head).collect()}
    assert found == wanted
    none = V.resolve(spark.createDataFrame([("HEAD",)], "spec string"), refs, objects, parents, head.limit(0)).first()
    assert (none["id"], none["problem"]) == (None, "no-head")


def test_bodies(spark, tmp_path):
    i = lambda k: f"{k:064x}"
    tree = B.encode_tree([("b", "blob", i(1), True), ("a", "tree", i(2), False)])
    assert B.decode_tree(tree) == [("a", "tree", i(2), False), ("b", "blob", i(1), True)]
    commit = B.decode_commit(B.encode_commit(i(3), i(4), [i(5), i(6)], i(7), -5, "é"))
    assert (commit["parents"], commit["micros"], commit["message"]) == ([i(5), i(6)], -5, "é")
    release = B.encode_release(i(3), i(4), i(5), None, i(6), 9, "v1")
    assert [x[0] for x in B.links_of("release", release)] == ["tree", "predecessor", "authority"]
    body = B.encode_authority(i(1), i(2), 3, [(i(9), 4, "me")], {"public_read": "true"})
    assert B.decode_authority(body)["members"] == [(i(9), 4, "me")] and B.links_of("authority", body) == [("previous", 0, None, i(2))]
    for broken in (tree[:-1], tree + b"x", B.encode_tree([("..", "blob", i(1), False)])):
        with pytest.raises(ValueError):
            B.decode_tree(broken)
    index = B.encode_index([("z", i(1), 73, 1, 5, 6), ("a", i(2), 0, 3, 7, 8)])
    assert [e[0] for e in B.decode_index(index)] == ["a", "z"]
    for broken in (index[:-1], index + b"x", b"NOPE" + index[4:]):
        with pytest.raises(ValueError):
            B.decode_index(broken)
    (tmp_path / "refs/branches/team").mkdir(parents=True)
    (tmp_path / "refs/branches/team/a").write_text(i(10) + "\n")
    (tmp_path / "refs/branches/b").write_text("no id")
    refs = B.read_refs(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in refs.collect()} == {("refs/branches/team/a", i(10), None), ("refs/branches/b", None, "unparsable")}
    assert [tuple(r) for r in B.refs_under(refs, "branches").collect()] == [("team/a", i(10))]
    (tmp_path / "work/.control").mkdir(parents=True)
    for name in ("x.txt", "x.log", ".control/y"):
        (tmp_path / "work" / name).write_text("1")
    assert [r["path"] for r in B.walk_folder(spark, f"file://{tmp_path}/work", ["*.log"]).collect()] == ["x.txt"]


def test_plain_documents_read_as_toml(monkeypatch):
    """What the pattern reads and what it leaves to the parser come to what the parser makes of it; a long plain list isn't parsed member by member."""
    import tomllib

    member = '[[members]]\nkey = "{}"\nhandle = "h{}"\nrole = "owner"\n'
    head, tail = 'repo_id = "ab"\nversion = 3\nprevious_authority = "cd"\n', '[policy]\npublic_read = true\n'
    many = "".join(member.format(k, k) for k in range(3))
    odd = [head + many + tail, head + many, head + tail, many + tail, head + many + '[policy]\nmembers = "x"\n', head + 'x = """\n' + many + '"""\n' + tail, head + "x = '''\n" + many + "'''\n", head + many.replace('"h1"', '"h\\u0031"') + tail,
           head + many.replace('role = "owner"\n', 'role = "owner"\nsince = 4\n', 1) + tail, head + many + tail + many, head + "# note\n" + many, head.replace("\n", "\r\n") + many, head + "members = 4\n" + many, head + many.replace('"h2"', '"h\t2"'), head + many + "[policy", head + head + many, head + "a = [\n" + many]
    for text in odd:
        try:
            wanted = tomllib.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                B._toml(text)
        else:
            assert B._toml(text) == wanted
    read = []
    monkeypatch.setattr(B.tomllib, "loads", lambda text, kept=tomllib.loads: (read.append(len(text)), kept(text))[1])
    assert len(B.parse_authority(head + "".join(member.format(k, k) for k in range(5000)) + tail)["members"]) == 5000 and max(read) < 200


def test_store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    objects = spark.createDataFrame([("aa01", "blob", bytearray(b"123")), ("bb02", "tree", bytearray(b"")), ("aa01", "blob", bytearray(b"123"))], "id string, type string, body binary")
    B.write_objects(objects, at)
    B.write_objects(objects.unionAll(spark.createDataFrame([("cc03", "blob", bytearray(b"x"))], objects.schema)), at)
    assert sorted(r["id"] for r in B.read_store(spark, at).select("id").collect()) == ["aa01", "bb02", "cc03"]
    read = lambda *a: B.read_object(spark, at, *a).first()
    assert read("aa01", "blob")["verdict"] == "ok" and read("aa01", "tree")["verdict"] == "wrong-type" and read("aa01", "blob", 2)["verdict"] == "too-large" and read("dd04") is None


def test_mirror(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 4), (4, 1)], "src long, dst long")
    refs = lambda **x: spark.createDataFrame([(f"refs/{k.replace('_', '/')}", n) for k, n in x.items()], "name string, target long")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    objects, moved = M.sync(refs(branches_main=2, branches_own=1), refs(branches_main=3, releases_v=5), edges, ids)
    assert {r["id"] for r in objects.collect()} == {3, 4, 5}
    assert {tuple(r) for r in moved.collect()} == {("refs/branches/main", 3, "advanced"), ("refs/branches/own", 1, "kept"), ("refs/releases/v", 5, "created")}
    objects, _ = M.sync(refs(branches_main=3, releases_v=5), refs(branches_main=3, releases_v=5), edges, ids)
    assert objects.count() == 0
    with pytest.raises(ValueError):
        M.wanted(refs(branches_a=1), "half")
