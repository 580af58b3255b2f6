"""What every merge handler returns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Region:
    description: str
    base: str
    ours: str
    theirs: str


@dataclass
class Outcome:
    """status: merged, conflict, or not-applicable (the content isn't of the handler's kind)."""

    status: str
    handler: str
    content: str = ""
    regions: list[Region] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def same(handler: str, base: str | None, ours: str | None, theirs: str | None) -> Outcome | None:
    """What needs no merge: both sides alike, or only one changed."""
    if ours == theirs or base == theirs:
        return Outcome("merged", handler, ours or "")
    if base == ours:
        return Outcome("merged", handler, theirs or "")
    return None


SCHEMA = "path string, status string, handler string, content string, regions array<struct<description: string, base: string, ours: string, theirs: string>>, notes array<string>"
