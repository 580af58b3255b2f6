"""Registered queries: every operator on the repository that plans.binding derives, with the SQL that says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as X
from .operators import graph as G
from .operators import log as L
from .operators import rules as R
from .operators import snapshots as S
from .operators.merge.dispatch import BY_EXTENSION, diff_report, merge_files
from .registry import query
from .sources.objects import pack_objects, unpack_objects
from .streaming import log as stream

# ---- snapshots

DIFF = "SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN '{a}' WHEN r.path IS NULL THEN '{d}' ELSE '{m}' END AS change FROM {old} l FULL JOIN {new} r ON l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR l.hash <> r.hash OR l.exec <> r.exec"


@query("tree_diff", DIFF.format(a="A", d="D", m="M", old="tree_base", new="tree_theirs"))
def tree_diff(v):
    return S.tree_diff(v["tree_base"], v["tree_theirs"])


@query("staged_changes", DIFF.format(a="New", d="Forgotten", m="Changed", old="tree_base", new="tree_ours"))
def staged_changes(v):
    return S.staged_changes(v["tree_base"], v["tree_ours"])


THREE = """SELECT coalesce(b.path, o.path, t.path) AS path, CASE WHEN o.hash IS NOT DISTINCT FROM t.hash THEN CASE WHEN o.hash IS NULL THEN 'deleted-both' ELSE 'agree' END
    WHEN b.hash IS NOT DISTINCT FROM o.hash THEN CASE WHEN t.hash IS NULL THEN 'theirs-deleted' ELSE 'theirs-only' END
    WHEN b.hash IS NOT DISTINCT FROM t.hash THEN CASE WHEN o.hash IS NULL THEN 'ours-deleted' ELSE 'ours-only' END
    WHEN o.hash IS NULL OR t.hash IS NULL THEN 'modify-delete' ELSE 'both-changed' END AS class
    FROM tree_base b FULL JOIN tree_ours o ON b.path = o.path FULL JOIN tree_theirs t ON coalesce(b.path, o.path) = t.path"""


@query("three_way_classes", THREE)
def three_way_classes(v):
    return S.three_way(v["tree_base"], v["tree_ours"], v["tree_theirs"])


@query("merge_summary", f"SELECT class, count(*) AS paths FROM ({THREE}) x GROUP BY class")
def merge_summary(v):
    return S.merge_summary(S.three_way(v["tree_base"], v["tree_ours"], v["tree_theirs"]))


@query("no_auto_conflicts", f"SELECT CASE WHEN class IN ('theirs-deleted', 'theirs-only') THEN 'conflict' ELSE class END AS class, count(*) AS paths FROM ({THREE}) x GROUP BY 1")
def no_auto_conflicts(v):
    return S.merge_summary(S.three_way(v["tree_base"], v["tree_ours"], v["tree_theirs"], no_auto=True))


WORK = "SELECT path, hash, exec, CASE WHEN length(path) % 11 = 0 THEN 'symlink' WHEN length(path) % 13 = 0 THEN 'other' ELSE 'file' END AS kind FROM tree_theirs"


@query("status_groups", f"""SELECT path, groups FROM (SELECT coalesce(h.path, i.path, w.path) AS path, concat_ws(',', CASE WHEN i.conflicted THEN 'conflicted' END,
    CASE WHEN h.path IS NULL AND i.path IS NOT NULL THEN 'new' END, CASE WHEN h.path IS NOT NULL AND i.path IS NOT NULL AND (h.hash <> i.hash OR h.exec <> i.exec) THEN 'staged' END,
    CASE WHEN h.path IS NOT NULL AND i.path IS NULL THEN 'forgotten' END, CASE WHEN i.path IS NOT NULL AND w.kind = 'file' AND (w.hash <> i.hash OR w.exec <> i.exec) THEN 'modified' END,
    CASE WHEN i.path IS NOT NULL AND w.path IS NULL THEN 'deleted' END, CASE WHEN i.path IS NOT NULL AND w.kind <> 'file' THEN 'replaced' END,
    CASE WHEN i.path IS NULL AND h.path IS NULL AND w.kind = 'file' THEN 'untracked' END, CASE WHEN i.path IS NULL AND h.path IS NULL AND w.kind = 'symlink' THEN 'symlinks' END) AS groups
    FROM tree_base h FULL JOIN (SELECT path, hash, exec, length(path) % 7 = 0 AS conflicted FROM tree_ours) i ON h.path = i.path FULL JOIN ({WORK}) w ON coalesce(h.path, i.path) = w.path) x WHERE groups <> ''""")
def status_groups(v):
    index = v["tree_ours"].withColumn("conflicted", F.length("path") % 7 == 0)
    return S.status(v["tree_base"], index, v.sql(WORK)).select("path", F.array_join("groups", ",").alias("groups"))


@query("checkout_plan", """SELECT path, action FROM (SELECT coalesce(h.path, t.path, w.path) AS path,
    CASE WHEN (h.hash IS NOT DISTINCT FROM t.hash) AND (h.exec IS NOT DISTINCT FROM t.exec) THEN CASE WHEN NOT ((w.hash IS NOT DISTINCT FROM h.hash) AND (w.exec IS NOT DISTINCT FROM h.exec)) THEN 'carry' END
    WHEN (w.hash IS NOT DISTINCT FROM t.hash) AND (w.exec IS NOT DISTINCT FROM t.exec) THEN NULL WHEN NOT ((w.hash IS NOT DISTINCT FROM h.hash) AND (w.exec IS NOT DISTINCT FROM h.exec)) THEN 'refuse'
    WHEN t.path IS NULL THEN 'remove' ELSE 'write' END AS action
    FROM tree_base h FULL JOIN tree_ours t ON h.path = t.path FULL JOIN tree_theirs w ON coalesce(h.path, t.path) = w.path) x WHERE action IS NOT NULL""")
def checkout_plan(v):
    return S.checkout_plan(v["tree_base"], v["tree_ours"], v["tree_theirs"])


@query("path_scope", "SELECT path FROM tree_base WHERE path = 'o1' OR starts_with(path, 'o1/') OR path = 'o7' OR starts_with(path, 'o7/')")
def path_scope(v):
    return v["tree_base"].where(P.path_under(F.col("path"), ["o1", "o7"])).select("path")


@query("scoped_commit", "SELECT path, hash, exec FROM tree_theirs WHERE starts_with(path, 'o3/') UNION ALL SELECT path, hash, exec FROM tree_base WHERE NOT starts_with(path, 'o3/')")
def scoped_commit(v):
    return S.scoped_commit(v["tree_base"], v["tree_theirs"], P.path_under(F.col("path"), ["o3"]))


ROW = "name || ':' || kind || ':' || id || ':' || CAST(exec AS STRING)"


@query("tree_ids", f"""WITH files AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, split_part(path, '/', 3) AS name, 'blob' AS kind, hash AS id, exec FROM tree_base),
    low AS (SELECT dir, sha256(string_agg({ROW}, ';' ORDER BY {ROW})) AS id FROM files GROUP BY dir),
    mid_rows AS (SELECT split_part(dir, '/', 1) AS dir, split_part(dir, '/', 2) AS name, 'tree' AS kind, id, false AS exec FROM low),
    mid AS (SELECT dir, sha256(string_agg({ROW}, ';' ORDER BY {ROW})) AS id FROM mid_rows GROUP BY dir),
    top_rows AS (SELECT '' AS dir, dir AS name, 'tree' AS kind, id, false AS exec FROM mid),
    top AS (SELECT dir, sha256(string_agg({ROW}, ';' ORDER BY {ROW})) AS id FROM top_rows GROUP BY dir)
    SELECT * FROM low UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM top""")
def tree_ids(v):
    return S.tree_edges(v["tree_base"]).groupBy("dir").agg(S.tree_id().alias("id"))


@query("tree_flatten", "SELECT path, hash, exec FROM tree_base")
def tree_flatten(v):
    """The whole snapshot, as the SQL has it; an untrusted tree would be refused beyond S.MOST_ENTRIES."""
    return S.flatten_tree(S.tree_edges(v["tree_base"]), most=None)


@query("ignore_filter", """SELECT path FROM tree_base WHERE NOT (CASE WHEN starts_with(path, 'o9/') THEN true WHEN path LIKE '%.n' AND NOT path LIKE 'o1%' THEN true ELSE false END)""")
def ignore_filter(v):
    return v["tree_base"].where(~P.ignored(F.col("path"), ["*.n", "!/o1*", "/o9/"])).select("path")


@query("handler_select", """SELECT handler, count(*) AS files FROM (SELECT CASE WHEN regexp_full_match(path, 'o1.*\\.r') THEN 'textual' WHEN regexp_full_match(path, '.*\\.r') THEN 'json' WHEN regexp_full_match(path, 'o[0-3]/.*') THEN 'prose' ELSE 'textual' END AS handler FROM tree_base) x GROUP BY handler""")
def handler_select(v):
    chosen = P.effective_handler(F.col("path"), [("*.r", "json"), ("o[0-3]/*", "prose")], [("o1*.r", "textual"), ("*.n", "xml")])
    return v["tree_base"].select(chosen.alias("handler")).groupBy("handler").agg(F.count("*").alias("files"))


@query("policy_violations", "SELECT path, CASE WHEN path LIKE '%.r' THEN 'wasm-x' ELSE 'textual' END AS handler FROM tree_base WHERE path LIKE '%.r'")
def policy_violations(v):
    records = v["tree_base"].select("path", P.first_handler(F.col("path"), [("*.r", "wasm-x")]).alias("handler"))
    return R.policy_violations(records, ["builtin", "pinned"], ["textual", "json"])


@query("write_once", "SELECT hash AS id, min(path) AS first_path FROM tree_ours WHERE hash NOT IN (SELECT hash FROM tree_base) GROUP BY hash")
def write_once(v):
    objects = v["tree_ours"].groupBy(F.col("hash").alias("id")).agg(F.min("path").alias("first_path"))
    return S.write_once(objects, v["tree_base"].select(F.col("hash").alias("id")).distinct())


UPDATES = "SELECT id AS txn, repo, branch AS signer, branch AS name, CASE WHEN id % 31 = 0 THEN CAST(NULL AS BIGINT) ELSE first_parent END AS expected, CASE WHEN id % 37 = 0 THEN coalesce(repo_prev, id) ELSE id END AS new, id % 3 = 0 AS force, nth AS seq FROM commit_order"
#: The update under way on each branch: its last commit, against what the branch was before it.
LAST = f"SELECT u.txn, u.repo, u.signer, CAST(u.name AS STRING) AS name, u.expected, u.new, u.force FROM ({UPDATES}) u JOIN refs r ON r.target = u.txn"
BEFORE = "SELECT o.repo, CAST(o.branch AS STRING) AS name, o.first_parent AS target FROM commit_order o JOIN refs r ON r.target = o.id WHERE o.first_parent IS NOT NULL"


@query("ref_cas", f"SELECT u.repo, u.name, u.expected, u.new, b.target AS current, u.expected IS NOT DISTINCT FROM b.target AS accepted FROM ({LAST}) u LEFT JOIN ({BEFORE}) b ON u.repo = b.repo AND u.name = b.name")
def ref_cas(v):
    return S.compare_and_set(v.sql(LAST), v.sql(BEFORE)).select("repo", "name", "expected", "new", "current", "accepted")


@query("multi_ref_transaction", f"""SELECT txn, min(CASE WHEN u.expected IS NOT DISTINCT FROM b.target THEN 1 ELSE 0 END) = 1 AS committed, count(*) AS updates
    FROM (SELECT repo AS txn, repo, name, expected FROM ({LAST}) y) u LEFT JOIN ({BEFORE}) b ON u.repo = b.repo AND u.name = b.name GROUP BY txn""")
def multi_ref_transaction(v):
    return S.all_or_nothing(S.compare_and_set(v.sql(LAST).withColumn("txn", F.col("repo")), v.sql(BEFORE)))


#: Transactions that were interrupted: some references already hold the new value, some were moved by others since.
TORN = f"SELECT u.txn, u.repo, u.name, u.expected, u.new FROM ({LAST}) u"
HALF = f"SELECT u.repo, u.name, CASE u.txn % 3 WHEN 0 THEN u.new WHEN 1 THEN u.expected ELSE u.txn + 1000000 END AS target FROM ({LAST}) u WHERE u.txn % 3 <> 1 OR u.expected IS NOT NULL"


@query("ref_recovery", f"""SELECT r.txn, r.repo, r.name, CASE WHEN h.target IS NOT DISTINCT FROM r.expected THEN 'untouched' WHEN h.target IS NOT DISTINCT FROM r.new THEN 'restore' ELSE 'foreign' END AS action,
    CASE WHEN h.target IS DISTINCT FROM r.expected AND h.target IS DISTINCT FROM r.new THEN h.target ELSE r.expected END AS value FROM ({TORN}) r LEFT JOIN ({HALF}) h ON h.repo = r.repo AND h.name = r.name""")
def ref_recovery(v):
    return S.recovery(v.sql(TORN), v.sql(HALF))


# ---- graph

UP = "WITH RECURSIVE up(id) AS (SELECT target FROM refs WHERE {where} UNION SELECT p.parent_id FROM up JOIN commit_parents p ON p.commit_id = up.id) "


def tips(v, where):
    return v["refs"].where(where).select(F.col("target").alias("root"))


def parts(v):
    """The repository of each commit: searches stay in it."""
    return v["commits"].select("id", F.col("repo").alias("part"))


def places(v):
    """parts() with the time of each commit, which its parents don't come after."""
    return v["commits"].select("id", F.col("repo").alias("part"), F.expr(MICROS).alias("place"))


@query("ancestors", """WITH RECURSIVE up(root, id) AS (SELECT target, target FROM refs WHERE branch < 10 UNION SELECT up.root, p.parent_id FROM up JOIN commit_parents p ON p.commit_id = up.id) SELECT root, id FROM up""")
def ancestors(v):
    """The history of one branch of each repository, the first."""
    return G.ancestors(v["commit_parents"], tips(v, "branch < 10"), parts(v))


@query("have_want_diff", """WITH RECURSIVE want(id) AS (SELECT target FROM refs UNION SELECT p.parent_id FROM want JOIN commit_parents p ON p.commit_id = want.id),
    have(id) AS (SELECT target FROM refs WHERE branch % 3 = 0 UNION SELECT p.parent_id FROM have JOIN commit_parents p ON p.commit_id = have.id)
    SELECT id FROM want WHERE id NOT IN (SELECT id FROM have)""")
def have_want_diff(v):
    return G.have_want(v["commit_parents"], tips(v, "branch % 3 = 0"), tips(v, "true"), parts(v))


@query("unreachable_objects", UP.format(where="branch % 2 = 0") + "SELECT id FROM commits WHERE id NOT IN (SELECT id FROM up)")
def unreachable_objects(v):
    return G.unreachable(v["commits"].select("id"), v["commit_parents"], v["refs"].where("branch % 2 = 0"), parts(v))


LINE = "WITH RECURSIVE line(root, id, depth) AS (SELECT target, target, CAST(0 AS BIGINT) FROM refs UNION ALL SELECT root, p.parent_id, depth + 1 FROM line JOIN commit_parents p ON p.commit_id = line.id AND p.ordinal = 0) "


def lines_of_all(v):
    return G.first_parent_log(v["commit_parents"], tips(v, "true"), parts(v))


@query("first_parent_log", LINE + "SELECT root, id, depth FROM line")
def first_parent_log(v):
    return lines_of_all(v)


@query("log_since", LINE + "SELECT l.root, l.id, l.depth FROM line l LEFT JOIN (SELECT root, min(depth) AS cut FROM line WHERE id % 10 = 0 GROUP BY root) c ON c.root = l.root WHERE c.cut IS NULL OR l.depth < c.cut")
def log_since(v):
    return G.log_since(lines_of_all(v), v["commits"].where("id % 10 = 0").select("id"))


@query("release_chain", """WITH RECURSIVE newest AS (SELECT repo, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, id DESC) AS k FROM releases) x WHERE k = 1),
    chain(repo, id, depth) AS (SELECT repo, id, CAST(0 AS BIGINT) FROM newest UNION ALL SELECT chain.repo, r.parent_release, depth + 1 FROM chain JOIN releases r ON r.id = chain.id WHERE r.parent_release IS NOT NULL) SELECT repo, id, depth FROM chain""")
def release_chain(v):
    return G.release_chain(v["releases"])


@query("revision_hops", """SELECT r.target AS root, c.parent_id AS id FROM refs r JOIN commit_parents a ON a.commit_id = r.target AND a.ordinal = 0 JOIN commit_parents b ON b.commit_id = a.parent_id AND b.ordinal = 0
    JOIN commit_parents c ON c.commit_id = b.parent_id AND c.ordinal = 1""")
def revision_hops(v):
    return G.hops(v["commit_parents"], tips(v, "true"), [("~", 2), ("^", 2)])


@query("topo_depth", """WITH RECURSIVE d(id, depth) AS (SELECT id, 0 FROM commits WHERE id NOT IN (SELECT commit_id FROM commit_parents) UNION SELECT p.commit_id, d.depth + 1 FROM d JOIN commit_parents p ON p.parent_id = d.id)
    SELECT id, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY id""")
def topo_depth(v):
    return G.topo_depth(v["commit_parents"], v["commits"].withColumn("part", F.col("repo")))


#: Each branch with the next of its repository.
NEIGHBOURS = "SELECT a, b FROM (SELECT target AS a, lead(target) OVER (PARTITION BY repo ORDER BY branch) AS b FROM refs) x WHERE b IS NOT NULL"


@query("merge_base")
def merge_base(v):
    return G.merge_bases(v["commit_parents"], v.sql(NEIGHBOURS), parts(v))


@query("reaches", f"""WITH RECURSIVE up(root, id) AS (SELECT DISTINCT a, a FROM ({NEIGHBOURS}) n UNION SELECT up.root, p.parent_id FROM up JOIN commit_parents p ON p.commit_id = up.id)
    SELECT n.a AS start, o.first_parent AS goal, u.id IS NOT NULL AS reaches FROM ({NEIGHBOURS}) n JOIN commit_order o ON o.id = n.b LEFT JOIN up u ON u.root = n.a AND u.id = o.first_parent WHERE o.first_parent IS NOT NULL""")
def reaches(v):
    """If a branch holds what the next one of its repository held before its last commit."""
    before = v["commit_order"].where("first_parent IS NOT NULL").select(F.col("id").alias("b"), F.col("first_parent").alias("goal"))
    return G.reaches(v["commit_parents"], v.sql(NEIGHBOURS).join(before, "b").select(F.col("a").alias("start"), "goal"), places(v))


@query("effective_authority", "SELECT id, CASE WHEN modifies = 1 THEN cited + 1 ELSE cited END AS effective FROM authority_of")
def effective_authority(v):
    return R.effective_authority(v["authority_of"]).withColumn("effective", F.col("effective").cast("long"))


# ---- rules

HISTORY = "SELECT a.id, a.repo, a.branch AS author, CAST(a.cited AS BIGINT) - CASE WHEN a.id % 53 = 0 THEN 1 ELSE 0 END AS cited, a.modifies, c.sig_valid FROM authority_of a JOIN commits c ON a.id = c.id"
VIOLATIONS = f"""SELECT id, 'signature' AS rule FROM ({HISTORY}) h WHERE NOT sig_valid
    UNION ALL SELECT h.id, 'signer' AS rule FROM ({HISTORY}) h LEFT JOIN members m ON h.repo = m.repo AND h.author = m.member WHERE coalesce(m.role, 0) < CASE WHEN h.modifies = 1 THEN 4 ELSE 2 END
    UNION ALL SELECT h.id, 'monotone' AS rule FROM ({HISTORY}) h JOIN (SELECT p.commit_id, max(e.effective) AS held FROM commit_parents p JOIN (SELECT id, CASE WHEN modifies = 1 THEN cited + 1 ELSE cited END AS effective FROM ({HISTORY}) z) e ON p.parent_id = e.id GROUP BY p.commit_id) q ON q.commit_id = h.id WHERE h.cited < q.held
    UNION ALL SELECT h.id, 'root' AS rule FROM ({HISTORY}) h WHERE h.cited <> 1 AND h.id NOT IN (SELECT commit_id FROM commit_parents)"""


@query("rule_h_violations", VIOLATIONS)
def rule_h_violations(v):
    return R.rule_h(v.sql(HISTORY), v["commit_parents"], v["members"])


@query("history_report", f"""SELECT c.repo, count(*) AS commits, sum(CASE WHEN k.last IS NULL THEN 1 ELSE 0 END) AS roots, sum(CASE WHEN k.last > 0 THEN 1 ELSE 0 END) AS merges, sum(CASE WHEN b.id IS NOT NULL THEN 1 ELSE 0 END) AS invalid
    FROM commits c LEFT JOIN (SELECT commit_id, max(ordinal) AS last FROM commit_parents GROUP BY commit_id) k ON k.commit_id = c.id LEFT JOIN (SELECT DISTINCT id FROM ({VIOLATIONS}) y) b ON b.id = c.id GROUP BY c.repo""")
def history_report(v):
    return R.history_report(v["commits"], v["commit_parents"], R.rule_h(v.sql(HISTORY), v["commit_parents"], v["members"]))


REPOS = "SELECT DISTINCT repo, repo % 3 = 0 AS public_read, repo % 5 <> 4 AS proved FROM commits"
#: Every member asks for their own repository and for the one after it, of which they are none.
ASKED = "SELECT repo, member AS principal FROM members UNION ALL SELECT (repo + 1) % 10 AS repo, member AS principal FROM members"


@query("read_permission", f"SELECT a.repo, a.principal, r.proved AND (r.public_read OR coalesce(m.role, 0) >= 1) AS may_read FROM ({ASKED}) a JOIN ({REPOS}) r ON a.repo = r.repo LEFT JOIN members m ON m.repo = a.repo AND m.member = a.principal")
def read_permission(v):
    return R.readers(v.sql(REPOS), v["members"], v.sql(ASKED))


@query("receive_gate", f"SELECT b.branch AS batch, max(CASE WHEN x.id IS NULL THEN 0 ELSE 1 END) = 0 AS recorded FROM commits b LEFT JOIN (SELECT DISTINCT id FROM ({VIOLATIONS}) y WHERE rule <> 'signer') x ON x.id = b.id GROUP BY b.branch")
def receive_gate(v):
    bad = R.rule_h(v.sql(HISTORY), v["commit_parents"], v["members"]).where("rule <> 'signer'")
    return R.receive(bad, v["commits"].select(F.col("branch").alias("batch"), "id"))


@query("tree_completeness", "SELECT split_part(path, '/', 1) AS tree_id, path AS name, hash FROM tree_ours WHERE hash NOT IN (SELECT hash FROM tree_base)")
def tree_completeness(v):
    entries = v["tree_ours"].select(F.split("path", "/")[0].alias("tree_id"), F.col("path").alias("name"), "hash", F.lit("blob").alias("entry_type"))
    objects = v["tree_base"].select(F.col("hash").alias("id"), F.lit("blob").alias("type")).distinct()
    return R.missing_entries(entries, objects)


#: A commit's first parents are ordinary ones, second ones come from a foreign closure; every 13th commit is a release's predecessor.
EDGE_KINDS = """SELECT commit_id AS src, parent_id AS dst, CASE WHEN commit_id % 13 = 0 AND ordinal = 0 THEN CASE WHEN commit_id % 2 = 0 THEN 'predecessor_same_tree' ELSE 'predecessor_other_tree' END
    WHEN ordinal = 0 THEN 'commit_parent' WHEN commit_id % 3 = 0 THEN 'foreign_fork_closure' ELSE 'note' END AS kind FROM commit_parents"""


@query("projection_modes", f"""SELECT src, dst, kind, mode, CASE kind WHEN 'predecessor_other_tree' THEN 'reject' WHEN 'note' THEN 'reject' ELSE CASE WHEN mode = 'full' THEN 'retain'
    WHEN kind = 'predecessor_same_tree' AND mode = 'release' THEN 'retain' ELSE 'verify-then-omit' END END AS action FROM ({EDGE_KINDS}) e JOIN (SELECT 'full' AS mode UNION ALL SELECT 'release' AS mode UNION ALL SELECT 'metadata' AS mode) m ON true""")
def projection_modes(v):
    edges = v.sql(EDGE_KINDS)
    out = [R.project_edges(edges, mode).withColumn("mode", F.lit(mode)) for mode in R.MODES]
    return out[0].unionAll(out[1]).unionAll(out[2])


#: Releases with their chain, the commits that they were declared on, and those commits' parents.
RELEASE_EDGES = """SELECT id AS src, parent_release AS dst, 'parent_release' AS kind FROM (SELECT id + 10000000 AS id, parent_release + 10000000 AS parent_release, predecessor FROM releases) r WHERE parent_release IS NOT NULL
    UNION ALL SELECT id + 10000000 AS src, predecessor AS dst, 'predecessor_same_tree' AS kind FROM releases WHERE predecessor IS NOT NULL
    UNION ALL SELECT commit_id AS src, parent_id AS dst, 'commit_parent' AS kind FROM commit_parents"""


@query("projection_closure", f"""WITH kept AS (SELECT id + 10000000 AS id FROM releases UNION SELECT predecessor AS id FROM releases WHERE predecessor IS NOT NULL)
    SELECT id, true AS member FROM kept UNION ALL SELECT DISTINCT p.parent_id AS id, false AS member FROM commit_parents p JOIN kept k ON k.id = p.commit_id WHERE p.parent_id NOT IN (SELECT id FROM kept)""")
def projection_closure(v):
    return R.projection_closure(v.sql(RELEASE_EDGES), v["releases"].select((F.col("id") + 10_000_000).alias("root")), "release")


# ---- log

HOLES = "SELECT ns, seq, digest, prev_digest FROM txn_log WHERE op_id % 29 <> 0"


@query("sequence_gaps", f"""SELECT ns, seq, problem FROM (SELECT ns, seq, CASE WHEN seq <> coalesce(p + 1, 1) THEN 'gap' WHEN prev_digest IS DISTINCT FROM d THEN 'chain' END AS problem
    FROM (SELECT ns, seq, prev_digest, lag(seq) OVER (PARTITION BY ns ORDER BY seq) AS p, lag(digest) OVER (PARTITION BY ns ORDER BY seq) AS d FROM ({HOLES}) h) x) y WHERE problem IS NOT NULL""")
def sequence_gaps(v):
    return L.sequence_gaps(v.sql(HOLES))


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
DUCK_MICROS = "epoch_us(ts)"
REQUESTS = "SELECT event_id AS request, user_id AS key, event_id % 3 AS nonce, {us} AS ts, {us} AS ts_us, {us} + (event_id % 700 - 350) * CAST(1000000 AS BIGINT) AS now_us FROM events"


DAY = 86_400_000_000
VERDICTS = f"""WITH RECURSIVE r AS (SELECT *, CASE WHEN now_us - ts_us > 300000000 THEN 'Late' WHEN now_us - ts_us < -300000000 THEN 'Early' END AS skewed FROM ({REQUESTS.format(us=DUCK_MICROS)}) q),
    acc(key, nonce, t) AS (SELECT key, nonce, min(ts_us) FROM r WHERE skewed IS NULL GROUP BY key, nonce
    UNION ALL SELECT key, nonce, t FROM (SELECT a.key, a.nonce, min(n.ts_us) AS t FROM acc a JOIN r n ON n.key = a.key AND n.nonce = a.nonce AND n.skewed IS NULL AND n.ts_us > a.t + {5 * DAY} GROUP BY a.key, a.nonce) x)
    SELECT request, CASE WHEN skewed IS NOT NULL THEN skewed WHEN a.t IS NOT NULL THEN 'Fresh' ELSE 'Replayed' END AS verdict FROM r LEFT JOIN acc a ON a.key = r.key AND a.nonce = r.nonce AND a.t = r.ts_us"""


@query("replay_verdicts", VERDICTS)
def replay_verdicts(v):
    return L.replay_verdicts(v.sql(REQUESTS.format(us=MICROS)), ttl_s=5 * 86_400)


#: With room for a single nonce and no forgetting, the first one keeps its place and every other is refused.
@query("replay_full", f"""SELECT request, CASE WHEN nonce <> first_nonce THEN 'Full' WHEN k = 1 THEN 'Fresh' ELSE 'Replayed' END AS verdict
    FROM (SELECT request, nonce, first_value(nonce) OVER (PARTITION BY key ORDER BY ts_us, request) AS first_nonce, row_number() OVER (PARTITION BY key ORDER BY ts_us, request) AS k FROM ({REQUESTS.format(us=DUCK_MICROS)}) r) x""")
def replay_full(v):
    return L.bounded_replay(v.sql(REQUESTS.format(us=MICROS)).withColumn("ns", F.col("key")), ttl_s=10_000 * 86_400, most=1)


CLAIMS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'd' || CAST(event_id % 2 AS STRING) END AS durable, CASE WHEN event_id % 5 < 3 THEN 'd' || CAST(event_id % 4 AS STRING) END AS registered, 'd' || CAST(event_id % 2 AS STRING) AS incoming FROM events"


@query("coalescing", f"""SELECT event_id, CASE WHEN durable = incoming THEN 'ReturnDurable' WHEN durable IS NOT NULL THEN 'OperationIdMismatch' WHEN registered = incoming THEN 'AttachToLeader'
    WHEN registered IS NOT NULL THEN 'OperationIdMismatch' ELSE 'BecomeLeader' END AS decision FROM ({CLAIMS.replace("'d' || CAST(event_id % 2 AS STRING) END AS durable", "'d' || CAST(event_id % 7 % 2 AS STRING) END AS durable")}) c""")
def coalescing(v):
    claims = v.sql(CLAIMS.replace("'d' || CAST(event_id % 2 AS STRING) END AS durable", "'d' || CAST(event_id % 7 % 2 AS STRING) END AS durable"))
    return claims.select("event_id", L.coalescing(F.col("durable"), F.col("registered"), F.col("incoming")).alias("decision"))


@query("append_deadline", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'RemainResolving' WHEN event_id % 100 > 50 THEN 'RejectReceiptExpired' ELSE 'ContinuePreAppend' END AS decision FROM events")
def append_deadline(v):
    e = F.col("event_id")
    return v["events"].select("event_id", L.deadline(e % 100, F.lit(50), e % 4 == 0).alias("decision"))


OUTCOMES = """SELECT ns, op_id, attempt, CASE WHEN k = 1 THEN 'BecomeLeader' WHEN digest = lead_digest THEN 'ReturnDurable' ELSE 'OperationIdMismatch' END AS outcome
    FROM (SELECT ns, op_id, attempt, digest, row_number() OVER (PARTITION BY ns, op_id ORDER BY attempt) AS k, first_value(digest) OVER (PARTITION BY ns, op_id ORDER BY attempt) AS lead_digest FROM submissions) x"""


@query("idempotent_ops", OUTCOMES)
def idempotent_ops(v):
    return L.idempotent_outcomes(v["submissions"])


@query("retry_window", """SELECT event_id, CASE WHEN abs(issued - now_us) > 300000000 THEN 'skewed' WHEN deadline < issued THEN 'deadline-before-issue' WHEN deadline > issued + 3600000000 THEN 'too-long' WHEN deadline < now_us THEN 'expired' ELSE 'ok' END AS reason
    FROM (SELECT event_id, CAST(event_id * 1000000 AS BIGINT) AS issued, CAST(event_id * 1000000 + (event_id % 9 - 1) * 600000000 AS BIGINT) AS deadline, CAST(event_id * 1000000 + (event_id % 7) * 60000000 AS BIGINT) AS now_us FROM events) x""")
def retry_window(v):
    e = F.col("event_id")
    issued = e * 1_000_000
    return v["events"].select("event_id", L.retry_window(issued, issued + (e % 9 - 1) * 600_000_000, issued + (e % 7) * 60_000_000, 300_000_000, 3_600_000_000).alias("reason"))


@query("receipt_lifecycle", """SELECT event_id, CASE WHEN now_s <= visible THEN 'Committed' WHEN now_s <= visible + 20 THEN 'Expired' ELSE 'Unknown' END AS state
    FROM (SELECT event_id, event_id % 100 AS now_s, greatest(event_id % 13, event_id % 11 + 30) AS visible FROM events) x""")
def receipt_lifecycle(v):
    e = F.col("event_id")
    return v["events"].select("event_id", L.receipt_state(e % 100, e % 13, e % 11, 30, 20).alias("state"))


KEPT = "SELECT ns, seq, digest FROM txn_log WHERE seq > 5"
CURSORS = "SELECT DISTINCT user_id AS ns, user_id % 90 AS after FROM events"


@query("cursor_disposition", f"""SELECT c.ns, c.after, CASE WHEN after < low THEN 'Resnapshot' WHEN after > high THEN 'Error' ELSE 'ReplayFrom' END AS disposition, CASE WHEN after >= low AND after <= high THEN high - after END AS events
    FROM ({CURSORS}) c JOIN (SELECT ns, min(seq) - 1 AS low, max(seq) AS high FROM ({KEPT}) k GROUP BY ns) l ON c.ns = l.ns""")
def cursor_disposition(v):
    return L.cursor_disposition(v.sql(CURSORS), v.sql(KEPT))


MOVES = "SELECT ns, op_id % 4 AS name, seq, CASE WHEN op_id % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE op_id END AS target FROM txn_log"


@query("snapshot_at", f"SELECT ns, name, target FROM (SELECT ns, name, target, row_number() OVER (PARTITION BY ns, name ORDER BY seq DESC) AS k FROM ({MOVES}) m WHERE seq <= 20) x WHERE k = 1 AND target IS NOT NULL")
def snapshot_at(v):
    return L.snapshot_at(v.sql(MOVES), 20)


@query("index_lookup", "SELECT ns, object, generation, off FROM (SELECT *, row_number() OVER (PARTITION BY ns, object ORDER BY generation DESC) AS k FROM index_runs) x WHERE k = 1")
def index_lookup(v):
    return L.newest_wins(v["index_runs"])


@query("index_pressure", "SELECT ns, count(*) AS entries, CASE WHEN count(*) >= 70 THEN 'SealRequired' WHEN count(*) * 4 >= 210 THEN 'Backpressure' ELSE 'Ok' END AS pressure FROM index_runs GROUP BY ns")
def index_pressure(v):
    return v["index_runs"].groupBy("ns").agg(F.count("*").alias("entries")).withColumn("pressure", L.index_pressure(F.col("entries"), 70))


CACHE = "SELECT CAST(doc_id AS STRING) AS path, (doc_id * 7919 % 100003) * CAST(1000000000 AS BIGINT) AS mtime, n_chars AS size FROM documents"


@query("cache_eviction", f"SELECT path, (SELECT sum(size) FROM ({CACHE}) t) - coalesce(sum(size) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1000000 AS evicted FROM ({CACHE}) c")
def cache_eviction(v):
    return L.evict(v.sql(CACHE), 1_000_000)


@query("pack_delta_base", "SELECT event_id AS id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS base FROM events")
def pack_delta_base(v):
    return L.delta_base(v["events"].select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("pos")))


FRAMES = "SELECT event_id % 8 AS shard, event_id AS pos, event_id % 401 <> 400 AS whole FROM events"


@query("valid_prefix", f"SELECT f.shard, f.pos, f.whole FROM ({FRAMES}) f LEFT JOIN (SELECT shard, min(pos) AS bad FROM ({FRAMES}) g WHERE NOT whole GROUP BY shard) b ON f.shard = b.shard WHERE bad IS NULL OR pos < bad")
def valid_prefix(v):
    return L.valid_prefix(v.sql(FRAMES))


LIFE = "SELECT ns, seq, CASE WHEN op_id % 6 = 0 THEN 'bind' ELSE 'advance' END AS kind, CASE op_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'frozen' ELSE 'retired' END AS lifecycle FROM txn_log"


@query("namespace_lifecycle", f"""SELECT ns, max(CASE WHEN good_seq = seq THEN lifecycle END) AS lifecycle, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS refused
    FROM (SELECT *, max(CASE WHEN ok THEN seq END) OVER (PARTITION BY ns) AS good_seq FROM (SELECT ns, seq, lifecycle, CASE WHEN kind = 'bind' THEN before = 0 ELSE before = 1 END AS ok
    FROM (SELECT *, coalesce(max(CASE WHEN kind = 'bind' THEN 1 ELSE 0 END) OVER (PARTITION BY ns ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({LIFE}) l) x) y) z GROUP BY ns""")
def namespace_lifecycle(v):
    return L.namespace_states(v.sql(LIFE))


#: Sessions of four chunks: a chunk comes twice, some with another digest; some are sealed too early, finalized unsealed, aborted, or go on after their end.
STAGING = """SELECT ns AS session, seq, CASE WHEN seq = 1 THEN CASE WHEN ns % 17 = 0 THEN 'put_chunk' ELSE 'begin' END WHEN seq < 7 + ns % 4 THEN 'put_chunk' WHEN seq = 7 + ns % 4 THEN CASE WHEN ns % 11 = 0 THEN 'finalize' ELSE 'seal' END
    WHEN seq = 8 + ns % 4 THEN CASE WHEN ns % 13 = 0 THEN 'abort' ELSE 'finalize' END WHEN seq = 9 + ns % 4 THEN 'adopt' ELSE CASE WHEN op_id % 2 = 0 THEN 'put_chunk' ELSE 'begin' END END AS kind,
    CAST((seq + ns) % 5 AS BIGINT) AS chunk, 'd' || CAST(op_id % 2 AS STRING) AS digest, seq * CAST(1000 AS BIGINT) AS ts_us, CAST(5 AS BIGINT) AS total FROM txn_log WHERE seq <= 5 + ns % 9"""
STEPS = f"""WITH RECURSIVE e AS ({STAGING}), s(session, seq, outcome, state, have, since) AS (SELECT DISTINCT session, CAST(0 AS BIGINT), '', '', CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT) FROM e
    UNION ALL SELECT session, seq, outcome, CASE outcome WHEN 'Begun' THEN 'Open' WHEN 'Aborted' THEN 'Aborted' WHEN 'Moved' THEN CASE kind WHEN 'seal' THEN 'Sealed' WHEN 'finalize' THEN 'Finalizing' ELSE 'Adopted' END ELSE state END,
    CASE outcome WHEN 'Stored' THEN list_append(have, CAST(chunk AS VARCHAR) || ':' || digest) ELSE have END, CASE WHEN outcome IN ('Begun', 'Stored', 'Moved', 'Aborted') THEN ts_us ELSE since END
    FROM (SELECT s.session, e.seq, s.state, s.have, s.since, e.kind, e.chunk, e.digest, e.ts_us, CASE WHEN e.kind = 'begin' THEN CASE WHEN s.state = '' THEN 'Begun' ELSE 'refused: begun' END WHEN s.state = '' THEN 'refused: unknown'
    WHEN e.kind = 'abort' THEN CASE WHEN s.state IN ('Open', 'Sealed') THEN 'Aborted' ELSE 'refused: ' || s.state END
    WHEN s.state <> CASE e.kind WHEN 'put_chunk' THEN 'Open' WHEN 'seal' THEN 'Open' WHEN 'finalize' THEN 'Sealed' ELSE 'Finalizing' END THEN 'refused: ' || s.state
    WHEN e.kind = 'put_chunk' AND list_contains(s.have, CAST(e.chunk AS VARCHAR) || ':' || e.digest) THEN 'AlreadyPresent' WHEN e.kind = 'put_chunk' AND (list_contains(s.have, CAST(e.chunk AS VARCHAR) || ':d0') OR list_contains(s.have, CAST(e.chunk AS VARCHAR) || ':d1')) THEN 'refused: digest'
    WHEN e.kind = 'put_chunk' THEN 'Stored' WHEN e.kind = 'seal' AND len(s.have) <> e.total THEN 'refused: incomplete' ELSE 'Moved' END AS outcome FROM s JOIN e ON e.session = s.session AND e.seq = s.seq + 1) x) """
STEP_ROWS = STEPS + "SELECT session, seq, outcome, CASE WHEN state <> '' THEN state END AS state, CAST(len(have) AS BIGINT) AS chunks FROM s WHERE seq > 0"


@query("staging_steps", STEP_ROWS)
def staging_steps(v):
    return L.staging_steps(v.sql(STAGING))


@query("staging_sessions", STEPS + """SELECT session, CASE WHEN state IN ('Open', 'Sealed') AND 20000 - since > 10000 THEN 'Expired' ELSE state END AS state, chunks, refused
    FROM (SELECT session, arg_max(state, seq) AS state, arg_max(CAST(len(have) AS BIGINT), seq) AS chunks, max(since) AS since, CAST(sum(CASE WHEN starts_with(outcome, 'refused') THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM s WHERE seq > 0 GROUP BY session) x WHERE state <> ''""")
def staging_sessions(v):
    return L.staging_states(v.sql(STAGING), 20_000, 10_000)


@query("chain_digests", """WITH RECURSIVE c(ns, seq, chained) AS (SELECT ns, seq, sha256(digest) FROM txn_log WHERE seq = 1 UNION ALL SELECT t.ns, t.seq, sha256(c.chained || t.digest) FROM c JOIN txn_log t ON t.ns = c.ns AND t.seq = c.seq + 1)
    SELECT ns, seq, chained FROM c""")
def chain_digests(v):
    return L.chain_digests(v["txn_log"])


ARRIVALS = "SELECT user_id AS shard, event_id AS op_id, event_id * CAST(100 AS BIGINT) AS ts_us, 1000 + event_id % 5000 AS bytes FROM events"


@query("group_formation", f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts_us, op_id) AS k FROM ({ARRIVALS}) x),
    g(shard, op_id, k, grp, n, held, opened) AS (SELECT shard, op_id, k, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(bytes AS BIGINT), ts_us FROM a WHERE k = 1
    UNION ALL SELECT a.shard, a.op_id, a.k, CASE WHEN c.closes THEN g.grp + 1 ELSE g.grp END, CASE WHEN c.closes THEN 1 ELSE g.n + 1 END, CASE WHEN c.closes THEN a.bytes ELSE g.held + a.bytes END, CASE WHEN c.closes THEN a.ts_us ELSE g.opened END
    FROM g JOIN a ON a.shard = g.shard AND a.k = g.k + 1, LATERAL (SELECT g.n >= 8 OR g.held + a.bytes > 20000 OR a.ts_us - g.opened > 100000 AS closes) c) SELECT shard, op_id, grp FROM g""")
def group_formation(v):
    return L.form_groups(v.sql(ARRIVALS), txns=8, size=20_000, open_us=100_000)


#: Moves of four references by namespace; most expect what the one before set, some what was there earlier.
CAS = "SELECT ns, seq, op_id % 4 AS name, CASE WHEN op_id % 7 = 0 THEN CAST(NULL AS BIGINT) WHEN op_id % 5 = 0 THEN two ELSE one END AS expected, op_id AS new FROM (SELECT *, lag(op_id) OVER (PARTITION BY ns, op_id % 4 ORDER BY seq) AS one, lag(op_id, 2) OVER (PARTITION BY ns, op_id % 4 ORDER BY seq) AS two FROM txn_log) x"


@query("speculative_cas", f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY ns, name ORDER BY seq) AS k FROM ({CAS}) c),
    s(ns, name, k, seq, accepted, held) AS (SELECT ns, name, k, seq, expected IS NULL, CASE WHEN expected IS NULL THEN new END FROM m WHERE k = 1
    UNION ALL SELECT m.ns, m.name, m.k, m.seq, m.expected IS NOT DISTINCT FROM s.held, CASE WHEN m.expected IS NOT DISTINCT FROM s.held THEN m.new ELSE s.held END FROM s JOIN m ON m.ns = s.ns AND m.name = s.name AND m.k = s.k + 1)
    SELECT ns, seq, accepted FROM s""")
def speculative_cas(v):
    return L.speculative_cas(v.sql(CAS))


COUNTERS = "SELECT user_id % 4 AS shard, CAST(floor(event_id / 7) AS BIGINT) AS fence, event_id % 3 + 1 AS commits, 100 + event_id % 900 AS bytes FROM events"


@query("store_counters", f"SELECT shard, CAST(sum(n) AS BIGINT) AS transactions, CAST(sum(c) AS BIGINT) AS commits, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS fences, max(n) AS largest_fence FROM (SELECT shard, fence, count(*) AS n, sum(commits) AS c, sum(bytes) AS b FROM ({COUNTERS}) l GROUP BY shard, fence) x GROUP BY shard")
def store_counters(v):
    return L.store_counters(v.sql(COUNTERS))


# ---- text and merges


@query("line_split", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+')) AS BIGINT) AS lines FROM documents")
def line_split(v):
    return v["documents"].select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("lines"))


@query("message_subject", "SELECT doc_id, split_part(text, chr(10), 1) AS subject FROM documents")
def message_subject(v):
    return v["documents"].select("doc_id", X.subject(F.col("text")).alias("subject"))


MARKED = """CASE doc_id % 5 WHEN 0 THEN concat(text, chr(10), '<<<<<<< ours', chr(10), 'a', chr(10), '=======', chr(10), 'b', chr(10), '>>>>>>> theirs', chr(10)) WHEN 1 THEN concat('=======', chr(10), text, chr(10), '<<<<<<< x', chr(10))
    WHEN 2 THEN concat('<<<<<<< x', chr(13), chr(10), '=======', chr(13), chr(10), '>>>>>>>', chr(13), chr(10)) WHEN 3 THEN concat('<<<<<<< x', chr(10), '======= ', chr(10), '>>>>>>>') ELSE text END"""


@query("conflict_markers", "SELECT doc_id, doc_id % 5 IN (0, 2) AS marked FROM documents")
def conflict_markers(v):
    return v.sql(f"SELECT doc_id, {MARKED} AS text FROM documents").select("doc_id", X.has_conflict_markers(F.col("text")).alias("marked"))


FILES = "SELECT concat(CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.log' END) AS path, text AS base FROM documents"


def three_texts(v):
    rows = F.split("base", "\n")
    ours = F.array_join(F.transform(rows, lambda x, k: F.when(k % 5 == 0, F.upper(x)).otherwise(x)), "\n")
    theirs = F.array_join(F.filter(rows, lambda x, k: k % 7 != 6), "\n")
    return v.sql(FILES).select("path", "base", ours.alias("ours"), theirs.alias("theirs"))


@query("textual_merge")
def textual_merge(v):
    return merge_files(three_texts(v)).select("path", "status", F.sha2("content", 256).alias("content"), F.size("regions").alias("conflicts"))


@query("handler_merge")
def handler_merge(v):
    return merge_files(three_texts(v), BY_EXTENSION).select("path", "status", "handler", F.sha2("content", 256).alias("content"), F.size("regions").alias("conflicts"))


@query("json_merge", "SELECT CAST(event_id AS VARCHAR) || '.json' AS path, CASE WHEN event_id % 6 = 0 THEN 'conflict' ELSE 'merged' END AS status FROM events")
def json_merge(v):
    variant = lambda n, x: F.when(F.col("event_id") % n == 0, F.to_json(F.struct(F.lit(x).alias("k"), F.lit(True).alias("seen")))).otherwise(F.lit('{"k": -1}'))
    files = v["events"].select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit('{"k": -1}').alias("base"), variant(2, 1000).alias("ours"), variant(3, 2000).alias("theirs"))
    return merge_files(files, BY_EXTENSION).select("path", "status")


@query("xml_merge", "SELECT CAST(page_id AS VARCHAR) || '.xml' AS path, 'merged' AS status, '<page><url>' || regexp_replace(url, '[&<>]', '_', 'g') || '</url><n>1</n></page>' AS content FROM pages")
def xml_merge(v):
    page = F.concat(F.lit("<page><url>"), F.regexp_replace("url", "[&<>]", "_"), F.lit("</url><n>"))
    files = v["pages"].select(F.concat(F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), *[F.concat(page, F.lit(n), F.lit("</n></page>")).alias(s) for s, n in (("base", "0"), ("ours", "1"), ("theirs", "0"))])
    return merge_files(files, BY_EXTENSION).select("path", "status", "content")


@query("line_diff")
def line_diff(v):
    return diff_report(three_texts(v).select("path", F.col("base").alias("old"), F.col("theirs").alias("new"))).groupBy("path", "op").agg(F.count("*").alias("rows"))


# ---- objects and packs


@query("pack_round_trip", "SELECT 'blob' AS type, sha256(text) AS body, count(*) AS objects FROM documents GROUP BY text")
def pack_round_trip(v):
    objects = v["documents"].select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")).cast("binary"), 256).alias("id"), F.lit("blob").alias("type"), F.col("text").cast("binary").alias("body"))
    return unpack_objects(pack_objects(objects, per_pack=256)).groupBy("type", F.sha2("body", 256).alias("body")).agg(F.count("*").alias("objects"))


# ---- reads and counts of objects

OBJECTS = "SELECT sha2(CAST(doc_id AS STRING), 256) AS id, CASE doc_id % 4 WHEN 0 THEN 'tree' WHEN 1 THEN 'commit' ELSE 'blob' END AS type, n_chars AS size, doc_id % 30 AS age_days FROM documents"


@query("prefix_scan", f"SELECT id FROM ({OBJECTS}) o WHERE id LIKE 'a1%'")
def prefix_scan(v):
    return v.sql(OBJECTS).where(F.col("id").startswith("a1")).select("id")


@query("ambiguous_prefix", f"SELECT id, count(*) OVER () > 1 AS ambiguous FROM (SELECT id FROM ({OBJECTS}) o WHERE id LIKE '0%' ORDER BY id LIMIT 5) x")
def ambiguous_prefix(v):
    return G.resolve_prefix(v.sql(OBJECTS), "0", shortest=1)


@query("typed_read", f"SELECT id, CASE WHEN size > 5000 THEN 'too-large' WHEN type <> 'blob' THEN 'wrong-type' ELSE 'ok' END AS verdict FROM ({OBJECTS}) o")
def typed_read(v):
    return v.sql(OBJECTS).select("id", R.read_verdict(F.col("type"), F.col("size"), "blob", 5000).alias("verdict"))


@query("pack_limits", f"SELECT type, count(*) AS objects, CAST(sum(size) AS BIGINT) AS decoded, max(size) AS largest, sum(size) > 500000 OR max(size) > 20000 AS refused FROM ({OBJECTS}) o GROUP BY type")
def pack_limits(v):
    return R.pack_limits(v.sql(OBJECTS), ["type"], most_bytes=500_000, most_object=20_000)


@query("gc_counts", f"""WITH RECURSIVE {UP.format(where="branch % 2 = 0")[len("WITH RECURSIVE ") :]} SELECT CAST(sum(CASE WHEN event_id % 30 > 14 THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN event_id % 30 <= 14 THEN 1 ELSE 0 END) AS BIGINT) AS kept_young FROM events WHERE event_id NOT IN (SELECT id FROM up)""")
def gc_counts(v):
    dead = G.unreachable(v["commits"].select("id"), v["commit_parents"], v["refs"].where("branch % 2 = 0"))
    return R.gc_counts(dead.withColumn("age_days", F.col("id") % 30), grace_days=14)


@query("ref_state_digest", "SELECT repo, sha256(string_agg(CAST(branch AS VARCHAR) || ':' || CAST(target AS VARCHAR), ';' ORDER BY CAST(branch AS VARCHAR) || ':' || CAST(target AS VARCHAR))) AS digest FROM refs GROUP BY repo")
def ref_state_digest(v):
    return R.ref_state_digest(v["refs"].select("repo", F.col("branch").cast("string").alias("name"), "target"))


@query("newest_release", "SELECT repo, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, id DESC) AS k FROM releases) x WHERE k = 1")
def newest_release(v):
    return v["releases"].groupBy("repo").agg(F.max(F.struct("ts", "id")).alias("m")).select("repo", "m.id")


@query("shard_of", "SELECT id, CAST(('0x' || substr(id, 3, 2) || substr(id, 1, 2)) AS BIGINT) % 4 AS shard FROM (SELECT sha256(CAST(user_id AS VARCHAR)) AS id FROM (SELECT DISTINCT user_id FROM events) u) x")
def shard_of(v):
    ids = v["events"].select(F.sha2(F.col("user_id").cast("string"), 256).alias("id")).distinct()
    return ids.select("id", L.shard_of(F.col("id"), 4).alias("shard"))


#: Runs of very different sizes in two bands, 40 is the newest.
RUNS = "SELECT CASE WHEN generation % 100 < 60 THEN 10 WHEN generation % 100 < 80 THEN 20 WHEN generation % 100 < 90 THEN 30 WHEN generation % 100 < 96 THEN 35 ELSE 40 END AS run, CASE WHEN generation % 100 < 60 THEN 1 ELSE 0 END AS band, ns, object, generation, off FROM index_runs"


@query("compaction", f"""WITH RECURSIVE sizes AS (SELECT run, max(band) AS band, count(*) AS n, row_number() OVER (ORDER BY run DESC) AS k FROM ({RUNS}) r GROUP BY run),
    pick(k, run, band, held, grp) AS (SELECT k, run, band, n, 1 FROM sizes WHERE k = 1 UNION ALL SELECT s.k, s.run, s.band, CASE WHEN s.band = p.band AND p.held + s.n <= {{most}} THEN p.held + s.n ELSE s.n END, CASE WHEN s.band = p.band AND p.held + s.n <= {{most}} THEN p.grp ELSE p.grp + 1 END FROM pick p JOIN sizes s ON s.k = p.k + 1),
    groups AS (SELECT grp, count(*) AS c FROM pick GROUP BY grp), good AS (SELECT run FROM pick JOIN groups USING (grp) WHERE c > 1 AND grp < (SELECT coalesce(min(grp), 1000) FROM groups WHERE c = 1))
    SELECT ns, object, generation, off FROM (SELECT *, row_number() OVER (PARTITION BY ns, object ORDER BY generation DESC) AS k FROM ({RUNS}) r WHERE run IN (SELECT run FROM good)) x WHERE k = 1""".replace("{most}", "(SELECT count(*) * 15 / 100 FROM events)"))
def compaction(v):
    return L.compacted(v.sql(RUNS), v["events"].count() * 15 / 100)[0]


# ---- streams


@query("stream_coalesce", OUTCOMES)
def stream_coalesce(v):
    return stream.replay(v["submissions"].withColumn("at", F.col("op_id") * 2 + F.col("attempt")), lambda x: stream.coalesce(x.drop("at")), "at")


@query("stream_sequence", f"""SELECT ns, seq, problem FROM (SELECT ns, seq, CASE WHEN seq <> coalesce(p + 1, 1) THEN 'gap' WHEN prev_digest IS DISTINCT FROM d THEN 'chain' END AS problem
    FROM (SELECT ns, seq, prev_digest, lag(seq) OVER (PARTITION BY ns ORDER BY seq) AS p, lag(digest) OVER (PARTITION BY ns ORDER BY seq) AS d FROM ({HOLES}) h) x) y WHERE problem IS NOT NULL""")
def stream_sequence(v):
    return stream.replay(v.sql(HOLES).withColumn("seq", F.col("seq").cast("long")), stream.sequence_check, "seq")


@query("stream_replay_guard", VERDICTS)
def stream_replay_guard(v):
    return stream.replay(v.sql(REQUESTS.format(us=MICROS)), lambda x: stream.replay_guard(x, ttl_s=5 * 86_400), "ts_us")


@query("stream_staging", STEP_ROWS)
def stream_staging(v):
    return stream.replay(v.sql(STAGING).withColumn("seq", F.col("seq").cast("long")), stream.staging, "seq")
