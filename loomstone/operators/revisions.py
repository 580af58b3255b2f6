"""Revisions and paths: what a text like `main~2^1` names, and what lies at a path of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name an object in full, and those that a prefix must have.
FULL, SHORTEST = 64, 4


def parsed(specs: DataFrame) -> DataFrame:
    """(spec, base, ops, bad): the base of each spec, its steps (`~`, `~N`, `^`, `^N`; a number left out is 1), and if something else follows the base."""
    at = F.regexp_extract("spec", r"^([^~^]*)", 1)
    rest = F.expr("substring(spec, char_length(regexp_extract(spec, '^([^~^]*)', 1)) + 1)")
    ops = F.regexp_extract_all(rest, F.lit(r"([~^][0-9]*)"), F.lit(1))
    return specs.select("spec", at.alias("base"), ops.alias("ops"), (F.array_join(ops, "") != rest).alias("bad"))


def resolve(specs: DataFrame, refs: DataFrame, objects: DataFrame, parents: DataFrame, head: DataFrame) -> DataFrame:
    """(spec, id, problem) for each spec: HEAD, then a branch, a release, a full id, and at last a prefix that only one commit or release has.

    refs: (name, target) under refs/branches/ and refs/releases/; objects: (id, type, predecessor); parents: (commit_id, ordinal, parent_id);
    head: (target). With steps a release stands for its predecessor. problem: `bad-suffix`, `no-head`, `unknown`, `ambiguous`, `no-parent`.
    """
    every = parsed(specs.select("spec").distinct())
    named = {}
    for kind in ("branches", "releases"):
        named[kind] = refs.where(F.col("name").startswith(f"refs/{kind}/")).select(F.expr(f"substring(name, {len(f'refs/{kind}/') + 1})").alias("base"), F.col("target").alias(kind))
        every = every.join(named[kind], "base", "left")
    at_head = head.agg(F.max("target").alias("head"))  # one row
    every = every.crossJoin(F.broadcast(at_head))
    hexa = F.lower("base")
    is_hex = F.col("base").rlike("^[0-9a-fA-F]+\\z")
    full = is_hex & (F.length("base") == FULL)
    prefix = is_hex & (F.length("base") >= SHORTEST) & (F.length("base") < FULL)
    revisions = objects.where(F.col("type").isin("commit", "release")).select(F.col("id").alias("found"), F.substring("id", 1, SHORTEST).alias("start"))
    asked = every.where(prefix).select("spec", hexa.alias("prefix"), F.substring(hexa, 1, SHORTEST).alias("start"))
    hits = asked.join(revisions, "start").where(F.col("found").startswith(F.col("prefix"))).groupBy("spec").agg(F.min("found").alias("only"), F.count("*").alias("times"))
    every = every.join(hits, "spec", "left")
    start = F.when(F.col("base") == "HEAD", F.col("head")).otherwise(F.coalesce("branches", "releases", F.when(full, hexa), F.when(F.col("times") == 1, F.col("only"))))
    # A step `~N` is N first parents, `^N` the N-th parent and `^0` none: one list of ordinals.
    number = lambda op: F.when(F.length(op) == 1, F.lit(1)).otherwise(F.substring(op, 2, 9).cast("int"))
    steps = F.flatten(F.transform("ops", lambda op: F.when(op.startswith("~"), F.array_repeat(F.lit(0), number(op))).when(number(op) > 0, F.array(number(op) - 1)).otherwise(F.array().cast("array<int>"))))
    state = every.select("spec", "bad", "base", F.col("times").alias("times"), start.alias("at"), steps.alias("steps"))
    kinds = objects.where("type = 'release'").select(F.col("id").alias("at"), "predecessor")
    state = state.join(kinds, "at", "left").withColumn("at", F.when((F.size("steps") > 0) & F.col("predecessor").isNotNull(), F.col("predecessor")).otherwise(F.col("at"))).drop("predecessor")
    problem = F.when(F.col("bad"), "bad-suffix").when((F.col("base") == "HEAD") & F.col("at").isNull(), "no-head").when(F.col("at").isNull() & (F.col("times") > 1), "ambiguous").when(F.col("at").isNull(), "unknown")
    state = state.select("spec", "at", "steps", problem.alias("problem"))
    longest = state.agg(F.max(F.size("steps"))).first()[0] or 0
    up = parents.select(F.col("commit_id").alias("at"), F.col("ordinal").alias("nth"), F.col("parent_id").alias("next"))
    for k in range(longest):
        moves = F.col("problem").isNull() & (F.size("steps") > k)
        here = state.withColumn("nth", F.when(moves, F.get("steps", F.lit(k)))).join(up, ["at", "nth"], "left")
        state = here.select("spec", F.when(moves, F.col("next")).otherwise(F.col("at")).alias("at"), "steps", F.when(moves & F.col("next").isNull(), "no-parent").otherwise(F.col("problem")).alias("problem"))
    return state.select("spec", F.when(F.col("problem").isNull(), F.col("at")).alias("id"), "problem")


def lookup(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, kind, id) of paths in a tree of entries (dir, name, kind, id); null where there is nothing. Empty paths and `.` name the root, whose kind is tree."""
    clean = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", "")
    asked = paths.select("path").distinct().withColumn("clean", F.when(clean == ".", "").otherwise(clean))
    asked = asked.withColumn("dir", F.regexp_extract("clean", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("clean", "([^/]*)$", 1))
    found = asked.join(entries.select("dir", "name", "kind", "id"), ["dir", "name"], "left")
    return found.select("path", F.when(F.col("clean") == "", "tree").otherwise(F.col("kind")).alias("kind"), "id")
