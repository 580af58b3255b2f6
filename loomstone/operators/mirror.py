"""Incremental mirrors: what one store lacks of another's history, and its references moved to where the other's are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import difference


def wanted(remote_refs: DataFrame, mode: str) -> DataFrame:
    """The references (name, target) that a mirror of a mode carries: `full` all, `release` only releases and the current authority."""
    if mode not in ("full", "release"):
        raise ValueError(f"mirror mode {mode!r}")
    return remote_refs if mode == "full" else remote_refs.where(~F.col("name").startswith("refs/branches/"))


def sync(local_refs: DataFrame, remote_refs: DataFrame, edges: DataFrame, local_ids: DataFrame, mode: str = "full", parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, refs): one pass. objects (id): what the wanted references reach, local ones don't, and the store hasn't yet; refs (name, target, action): each
    reference `created`, `advanced` or `kept`, local ones that the remote doesn't have `kept` too. References move only after their objects."""
    roots = lambda df: df.select(F.col("target").alias("root")).distinct()
    objects = difference(edges, roots(local_refs), roots(wanted(remote_refs, mode)), parts).join(local_ids.select("id"), "id", "left_anti")
    return objects, moves(local_refs, remote_refs, mode)


def moves(local_refs: DataFrame, remote_refs: DataFrame, mode: str = "full") -> DataFrame:
    """The references (name, target, action) after a pass; no search is needed to tell."""
    want = wanted(remote_refs, mode)
    both = want.select("name", F.col("target").alias("new")).join(local_refs.select("name", F.col("target").alias("old")), "name", "full_outer")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull() | (F.col("new") == F.col("old")), "kept").otherwise("advanced")
    return both.select("name", F.coalesce("new", "old").alias("target"), action.alias("action"))
