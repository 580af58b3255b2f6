"""Merging a DataFrame of files: each row by the handler its path's rule names."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.paths import first_handler
from .lines import line_diff, merge_text
from .outcome import SCHEMA, Outcome
from .sections import merge_markdown, merge_prose, merge_python
from .values import merge_json, merge_toml, merge_xml, merge_yaml

BUILTIN: dict[str, Callable[..., Outcome]] = {
    "textual": merge_text, "json": merge_json, "yaml": merge_yaml, "toml": merge_toml, "xml": merge_xml,
    "markdown": merge_markdown, "prose": merge_prose, "python": merge_python,
    "ours-only": lambda b, o, t: Outcome("merged", "ours-only", o or ""),
    "theirs-only": lambda b, o, t: Outcome("merged", "theirs-only", t or ""),
}

#: Rules by extension, to be named by a configuration; without rules everything is textual.
BY_EXTENSION = [("*.json", "json"), ("*.yaml", "yaml"), ("*.yml", "yaml"), ("*.toml", "toml"), ("*.xml", "xml"), ("*.md", "markdown"), ("*.txt", "prose"), ("*.py", "python")]


class Registry:
    """Handlers by name; a plugin is a Python callable pinned by the digest of its source."""

    def __init__(self) -> None:
        self.handlers = dict(BUILTIN)

    def register(self, name: str, handler: Callable[..., Outcome], pin: str | None = None) -> str:
        found = hashlib.sha256(inspect.getsource(handler).encode()).hexdigest()
        if pin and pin != found:
            raise ValueError(f"{name}: its source isn't the pinned one")
        self.handlers[name] = handler
        return found

    def merge(self, handler: str, base: str | None, ours: str | None, theirs: str | None) -> Outcome:
        """Binary content is a conflict that keeps ours; what a handler can't read goes on as text."""
        if handler in BUILTIN and any("\x00" in x for x in (base, ours, theirs) if x):
            return Outcome("conflict", "none", ours or "")
        out = self.handlers[handler](base, ours, theirs) if handler in self.handlers else Outcome("not-applicable", handler)
        return merge_text(base, ours, theirs) if out.status == "not-applicable" else out


def merge_files(files: DataFrame, rules: list[tuple[str, str]] = (), registry: Registry | None = None, no_auto: bool = False) -> DataFrame:
    """(path, status, handler, content, regions, notes) of files (path, base, ours, theirs); null contents are absent. no_auto makes every change by theirs a conflict."""
    registry = registry or Registry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda x: x if isinstance(x, str) else None
        for batch in batches:
            rows = []
            for path, handler, *sides in zip(batch["path"], batch["handler"], batch["base"], batch["ours"], batch["theirs"]):
                base, ours, theirs = map(clean, sides)
                out = registry.merge(handler, base, ours, theirs)
                if no_auto and base != theirs:
                    out = Outcome("conflict", out.handler, ours or "", out.regions, ["changed by theirs"])
                rows.append((path, out.status, out.handler, out.content, [asdict(r) for r in out.regions], out.notes))
            yield pd.DataFrame(rows, columns=["path", "status", "handler", "content", "regions", "notes"])

    chosen = files.select("path", first_handler(F.col("path"), list(rules)).alias("handler"), "base", "ours", "theirs")
    return chosen.mapInPandas(run, SCHEMA)


def diff_report(files: DataFrame) -> DataFrame:
    """(path, op, old_line, new_line, text) of files (path, old, new); binary ones have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, a, b in zip(batch["path"], batch["old"], batch["new"]) if "\x00" not in (a or "") + (b or "") for r in line_diff(a or "", b or "")]
            yield pd.DataFrame(rows, columns=["path", "op", "old_line", "new_line", "text"]).astype({"old_line": "Int64", "new_line": "Int64"})

    return files.select("path", "old", "new").mapInPandas(run, "path string, op string, old_line long, new_line long, text string")
