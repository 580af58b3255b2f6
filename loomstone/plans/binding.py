"""A repository derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Each view is a SELECT over tables and over views before it. `frames()` makes DataFrames of them; `oracle()` puts
the views that a query needs in front of it as common table expressions for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # Commits and their graph: events of a user are a branch, users of one last digit a repository.
    "commits": "SELECT event_id AS id, user_id % 10 AS repo, user_id AS branch, user_id AS author, ts, event_type, event_id % 97 <> 0 AS sig_valid FROM events",
    "commit_order": """SELECT id, repo, branch, event_type, ts, lag(id) OVER (PARTITION BY branch ORDER BY ts, id) AS first_parent,
        lag(id) OVER (PARTITION BY repo ORDER BY ts, id) AS repo_prev, lag(branch) OVER (PARTITION BY repo ORDER BY ts, id) AS repo_prev_branch,
        row_number() OVER (PARTITION BY branch ORDER BY ts, id) AS nth FROM commits""",
    "commit_parents": """SELECT id AS commit_id, 0 AS ordinal, first_parent AS parent_id FROM commit_order WHERE first_parent IS NOT NULL
        UNION ALL SELECT id AS commit_id, 1 AS ordinal, repo_prev AS parent_id FROM commit_order
        WHERE event_type = 'purchase' AND first_parent IS NOT NULL AND repo_prev IS NOT NULL AND repo_prev_branch <> branch""",
    "refs": "SELECT repo, branch, max(id) AS target FROM (SELECT id, repo, branch, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, id DESC) AS k FROM commits) x WHERE k = 1 GROUP BY repo, branch",
    "releases": """SELECT id, repo, ts, lag(id) OVER (PARTITION BY repo ORDER BY ts, id) AS parent_release, first_parent AS predecessor
        FROM commit_order WHERE event_type = 'signup' AND id % 5 = 0""",
    # Authority: an error by an owner installs the next version.
    "authority_steps": "SELECT id, repo, ts, branch, CASE WHEN event_type = 'error' AND CAST(floor(branch / 10) AS INT) % 4 = 3 THEN 1 ELSE 0 END AS modifies FROM commit_order",
    "authority_of": """SELECT id, repo, branch, ts, modifies, 1 + coalesce(sum(modifies) OVER (PARTITION BY repo ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cited FROM authority_steps""",
    "members": "SELECT DISTINCT user_id % 10 AS repo, user_id AS member, 1 + CAST(floor(user_id / 10) AS INT) % 4 AS role FROM events",
    # Authorities by version, numbered within their repository; a member is left out of every seventh.
    "authority_versions": "SELECT DISTINCT repo, version, repo * 100000 + version AS id FROM (SELECT repo, cited AS version FROM authority_of UNION ALL SELECT repo, cited + 1 AS version FROM authority_of WHERE modifies = 1) x",
    "authority_members": "SELECT a.id, a.repo, a.version, m.member, m.role FROM authority_versions a JOIN members m ON m.repo = a.repo WHERE m.member % 7 <> a.version % 7 OR m.role = 4",
    # History as it was pushed: some commits cite an authority too old, install a wrong one, or can't be read.
    "pushed_commits": """SELECT a.id, a.repo, a.branch AS author, CAST(a.repo * 100000 + a.cited - CASE WHEN a.id % 53 = 0 THEN 1 ELSE 0 END AS BIGINT) AS authority,
        CASE WHEN a.modifies = 1 THEN CAST(a.repo * 100000 + a.cited + CASE WHEN a.id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) END AS installs, a.id % 211 <> 0 AS readable, c.sig_valid FROM authority_of a JOIN commits c ON c.id = a.id""",
    "pushed_releases": "SELECT r.id, r.repo, p.author AS declarer, p.authority, r.predecessor FROM releases r JOIN pushed_commits p ON p.id = r.id",
    # Objects of all types and what they link to.
    "typed_links": """SELECT 'c' || CAST(id AS STRING) AS src, 'tree' AS link, CASE WHEN id % 307 = 0 THEN 'b' ELSE 't' END || CAST(id % 300 AS STRING) AS dst FROM commits
        UNION ALL SELECT 'c' || CAST(id AS STRING) AS src, 'authority' AS link, 'a' || CAST(repo * 100000 + cited AS STRING) AS dst FROM authority_of
        UNION ALL SELECT 'c' || CAST(commit_id AS STRING) AS src, 'parent' AS link, 'c' || CAST(parent_id AS STRING) AS dst FROM commit_parents
        UNION ALL SELECT 'r' || CAST(id AS STRING) AS src, 'predecessor' AS link, 'c' || CAST(predecessor AS STRING) AS dst FROM releases WHERE predecessor IS NOT NULL
        UNION ALL SELECT 'r' || CAST(id AS STRING) AS src, 'parent_release' AS link, 'r' || CAST(parent_release AS STRING) AS dst FROM releases WHERE parent_release IS NOT NULL
        UNION ALL SELECT 'r' || CAST(id AS STRING) AS src, 'tree' AS link, 't' || CAST(id % 400 AS STRING) AS dst FROM releases
        UNION ALL SELECT 'a' || CAST(id AS STRING) AS src, 'previous' AS link, 'a' || CAST(id - 1 AS STRING) AS dst FROM authority_versions WHERE version > 1
        UNION ALL SELECT DISTINCT 't' || CAST(id % 500 AS STRING) AS src, 'blob_entry' AS link, 'b' || CAST(id % 500 % 60 AS STRING) AS dst FROM commits
        UNION ALL SELECT DISTINCT 't' || CAST(id % 500 AS STRING) AS src, 'tree_entry' AS link, 'u' || CAST(id % 500 % 40 AS STRING) AS dst FROM commits
        UNION ALL SELECT DISTINCT 'u' || CAST(id % 45 AS STRING) AS src, 'blob_entry' AS link, 'b' || CAST(60 + id % 45 AS STRING) AS dst FROM commits""",
    "typed_objects": """SELECT 'c' || CAST(id AS STRING) AS id, 'commit' AS type, id % 211 <> 0 AS readable, id % 30 AS age_days FROM commits UNION ALL SELECT 'r' || CAST(id AS STRING) AS id, 'release' AS type, true AS readable, id % 30 AS age_days FROM releases
        UNION ALL SELECT 'a' || CAST(id AS STRING) AS id, 'authority' AS type, true AS readable, 20 AS age_days FROM authority_versions UNION ALL SELECT DISTINCT 't' || CAST(id % 500 AS STRING) AS id, 'tree' AS type, true AS readable, id % 500 % 30 AS age_days FROM commits
        UNION ALL SELECT DISTINCT 'u' || CAST(id % 45 AS STRING) AS id, 'tree' AS type, id % 45 <> 7 AS readable, 20 AS age_days FROM commits UNION ALL SELECT DISTINCT 'b' || CAST(id % 105 AS STRING) AS id, 'blob' AS type, true AS readable, id % 105 % 30 AS age_days FROM commits""",
    # Snapshots: (l_orderkey, l_linenumber) grouped; base, ours and theirs drop and edit different residues.
    "tree_all": """SELECT 'o' || CAST(l_orderkey % 64 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '.' || lower(max(l_returnflag)) AS path,
        min(l_partkey) AS p, CAST(min(l_partkey) AS STRING) || ':' || CAST(count(*) AS STRING) AS content FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "tree_base": "SELECT path, sha2(content, 256) AS hash, p % 5 = 0 AS exec FROM tree_all WHERE p % 17 <> 0 AND p % 23 <> 0",
    "tree_ours": "SELECT path, sha2(CASE WHEN p % 11 = 0 THEN 'o' || content ELSE content END, 256) AS hash, p % 5 = 0 AS exec FROM tree_all WHERE p % 13 <> 0 AND p % 23 <> 0",
    "tree_theirs": "SELECT path, sha2(CASE WHEN p % 7 = 0 THEN 't' || content ELSE content END, 256) AS hash, p % 5 = 0 AS exec FROM tree_all WHERE p % 19 <> 0 AND p % 17 <> 0",
    # The transaction log: a user's events in order; every 41st is submitted twice.
    "txn_log": """SELECT user_id AS ns, event_id AS op_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
        sha2(CAST(event_id AS STRING) || event_type, 256) AS digest, lag(sha2(CAST(event_id AS STRING) || event_type, 256)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_digest, ts FROM events""",
    "submissions": """SELECT user_id AS ns, event_id AS op_id, 0 AS attempt, sha2(CAST(event_id AS STRING), 256) AS digest, ts FROM events
        UNION ALL SELECT user_id AS ns, event_id AS op_id, 1 AS attempt, sha2(CAST(event_id AS STRING) || CASE WHEN event_id % 82 = 0 THEN 'x' ELSE '' END, 256) AS digest, ts FROM events WHERE event_id % 41 = 0""",
    "index_runs": "SELECT user_id AS ns, event_id % 20 AS object, event_id AS generation, event_id % 1000 AS off FROM events",
}


def needed(sql: str) -> list[str]:
    """Views that a query needs, those that others need first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def for_duckdb(sql: str) -> str:
    return re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", sql).replace("AS STRING)", "AS VARCHAR)")


def oracle(sql: str) -> str:
    """A query over views and tables, for DuckDB."""
    views = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    text = sql.strip()
    if not views:
        return for_duckdb(text)
    if re.match(r"(?i)WITH\s+RECURSIVE\b", text):
        return for_duckdb(f"WITH RECURSIVE {', '.join(views)}, {text[len('WITH RECURSIVE') :].strip()}")
    if re.match(r"(?i)WITH\b", text):
        return for_duckdb(f"WITH {', '.join(views)}, {text[4:].strip()}")
    return for_duckdb(f"WITH {', '.join(views)} {text}")


class Frames:
    """Tables and views of a folder as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self.made[name] = self.sql(VIEWS[name])
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        names = [n for n in [*TABLES, *VIEWS] if re.search(rf"(?i)\b(?:FROM|JOIN)\s+{n}\b", text)]
        for n in names:
            text = re.sub(rf"(?i)\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: self[n] for n in names})
