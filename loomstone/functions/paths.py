"""Predicates on paths and reference names, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """A whole-string regular expression of a glob: `*` crosses `/`, `?` is any character, `[...]` and `[!...]` are classes of characters and ranges."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            while k + 1 < len(pattern) and pattern[k + 1] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + (3 if pattern[k + 1 : k + 2] == "!" else 2))) > 0:
            body = pattern[k + 1 : end]
            negated, body = body[0] == "!", body[1:] if body[0] == "!" else body
            out.append(("[^" if negated else "[") + class_body(body) + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + r"\z"


def class_body(body: str) -> str:
    """The inside of a class: a `-` between two characters is a range; all that a regular expression would read otherwise is escaped."""
    out, k = [], 0
    plain = lambda c: c if c.isalnum() or c in " _/.," else "\\" + c
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            if body[k] <= body[k + 2]:
                out.append(f"{plain(body[k])}-{plain(body[k + 2])}")
            k += 3
        else:
            out.append(plain(body[k]))
            k += 1
    return "".join(out) or "&&[^\\s\\S]"


def glob_match(column: Column, pattern: str) -> Column:
    return column.rlike(glob_to_regex(pattern))


def path_under(path: Column, scope: list[str]) -> Column:
    """If a path lies in the scope: an empty scope, "" and "." hold everything; else the path itself or what is below it."""
    if not scope or any(r in ("", ".") for r in scope):
        return F.lit(True)
    out = F.lit(False)
    for r in scope:
        out = out | (path == r) | path.startswith(f"{r}/")
    return out


def first_handler(path: Column, rules: list[tuple[str, str]], default: str = "textual") -> Column:
    """The handler of the first glob that the whole path matches."""
    out = F.lit(default)
    for pattern, handler in reversed(rules):
        out = F.when(glob_match(path, pattern), F.lit(handler)).otherwise(out)
    return out


def effective_handler(path: Column, shared: list[tuple[str, str]], local: list[tuple[str, str]]) -> Column:
    """Shared rules decide; a local rule may keep that choice or fall back to `textual`."""
    chosen, own = first_handler(path, shared), first_handler(path, local, "")
    return F.when(own == "textual", F.lit("textual")).otherwise(chosen)


def _matching(regex: str):
    return lambda x: x.rlike(regex)


def ignored(path: Column, rules: list[str]) -> Column:
    """If an ignore file's rules leave a path out: the last rule that matches wins, `!` takes back, a leading `/` anchors; a rule that isn't
    anchored also matches any one component or what lies below it. The control folder is always left out."""
    verdict = F.lit(False)
    for raw in rules:
        rule = raw.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = (True, rule[1:]) if rule.startswith("!") else (False, rule)
        anchored, rule = rule.startswith("/"), rule.strip("/")
        hit = path.rlike(glob_to_regex(rule)) | path.rlike(glob_to_regex(f"{rule}/*"))
        if not anchored:
            whole = glob_to_regex(rule)
            hit = hit | F.exists(F.split(path, "/"), _matching(whole))
        verdict = F.when(hit, F.lit(not keep)).otherwise(verdict)
    return verdict | F.exists(F.split(path, "/"), lambda x: x == ".control")


def normalised(path: Column, cwd: str = "") -> Column:
    """A path as given in a folder of the repository (cwd, from its root), from the root and with `.`, `..` and empty components gone; null if it leads
    outside. A path that starts with `/` is one from the root."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{cwd.strip('/')}/" if cwd.strip("/") else ""), path))
    step = lambda state, c: F.when((c == "") | (c == "."), state).when(c != "..", F.struct(F.concat(state["at"], F.array(c)).alias("at"), state["out"].alias("out"))).otherwise(
        F.struct(F.slice(state["at"], F.lit(1), F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"), (state["out"] | (F.size(state["at"]) == 0)).alias("out"))
    )
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    end = F.aggregate(F.split(F.regexp_replace(whole, "\\\\", "/"), "/"), start, step)
    return F.when(~end["out"], F.array_join(end["at"], "/"))


def valid_ref_name(name: Column, longest: int = 4096) -> Column:
    """Non-empty components, none of them `.` or `..`, no NUL or backslash, not too long."""
    bad = F.exists(F.split(name, "/"), lambda x: (x == "") | (x == ".") | (x == ".."))
    return (F.length(name) <= longest) & ~bad & ~name.contains("\x00") & ~name.contains("\\")


def protected(branch: Column, patterns: list[str]) -> Column:
    """If a branch is protected: a pattern matches its name or its full reference."""
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(branch, p) | glob_match(F.concat(F.lit("refs/branches/"), branch), p)
    return out


#: Handlers that only choose a side; they come with the engine.
FLOW = ["ours-only", "theirs-only", "agree", "deleted-both"]


def handler_allowed(handler: Column, allowed: list[str], builtin: list[str], digest: Column | None = None) -> Column:
    """A policy of handlers: an empty list allows all; `builtin` stands for those that come with the engine; `name:hash` allows one whose digest is that."""
    if not allowed:
        return F.lit(True)
    names = [x for x in allowed if x != "builtin" and ":" not in x] + ([*builtin, *FLOW] if "builtin" in allowed else [])
    pins = [x for x in allowed if ":" in x]
    return handler.isin(names) | (F.concat_ws(":", handler, digest).isin(pins) if pins and digest is not None else F.lit(False))
