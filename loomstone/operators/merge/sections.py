"""Merges of Markdown sections, prose paragraphs and Python blocks: pieces by key, text inside a piece line by line."""

from __future__ import annotations

import ast
import hashlib

from .lines import merge_text, split_lines
from .outcome import Outcome, same


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def sections(text: str) -> dict[str, str]:
    """Sections by the text of their heading, levels alike; what stands before the first heading by its content. Of equal keys the first counts.

    Any line whose trimmed text starts with # is a heading, in fenced code too."""
    out: dict[str, str] = {}
    key, lines = None, []

    def close() -> None:
        body = "".join(lines)
        if body:
            out.setdefault(f"content:{digest(body)}" if key is None else f"heading:{key}", body)

    for line in split_lines(text):
        if line.strip().startswith("#"):
            close()
            key, lines = line.strip().lstrip("#").strip(), [line]
        else:
            lines.append(line)
    close()
    return out


def merge_markdown(base: str | None, ours: str | None, theirs: str | None) -> Outcome:
    """Sections in ours' order, then those that only theirs has; a section both changed is merged line by line."""
    if done := same("markdown", base, ours, theirs):
        return done
    b, o, t = (sections(x or "") for x in (base, ours, theirs))
    out, regions = [], []
    for key in [*o, *[k for k in t if k not in o]]:
        x, y, z = b.get(key), o.get(key), t.get(key)
        if y is None or z is None:
            kept = y if z is None else z
            # Deleted by one side and unchanged by the other: gone. Changed by the other: a conflict that keeps it.
            if x is not None and x == kept:
                continue
            if x is not None:
                found = merge_text(x, y, z)
                regions += found.regions
                out.append(found.content)
                continue
            out.append(kept)
            continue
        found = merge_text(x, y, z)
        for r in found.regions:
            r.description = f"{key}: {r.description}"
        regions += found.regions
        out.append(found.content)
    return Outcome("conflict" if regions else "merged", "markdown", "".join(out), regions)


def paragraphs(text: str) -> list[str]:
    """Paragraphs with the one blank line that closes them; further blank lines and leading ones are dropped."""
    out, lines = [], []
    for line in split_lines(text):
        if line.strip():
            lines.append(line)
        elif lines:
            out.append("".join([*lines, line]))
            lines = []
    return out + (["".join(lines)] if lines else [])


def merge_prose(base: str | None, ours: str | None, theirs: str | None) -> Outcome:
    """Paragraphs by their trimmed content: ours', without those that ours deleted, then theirs' new ones.

    A deletion by theirs isn't followed. If a paragraph of the base is in neither side, the text is merged line by line."""
    if done := same("prose", base, ours, theirs):
        return done
    b, o, t = (paragraphs(x or "") for x in (base, ours, theirs))
    keys = lambda ps: {digest(p.strip()) for p in ps}
    in_base, in_ours, in_theirs = keys(b), keys(o), keys(t)
    if in_base - in_ours - in_theirs:
        return merge_text(base, ours, theirs, "prose")
    seen, out = set(), []
    for p in [*o, *[p for p in t if digest(p.strip()) not in in_base | in_ours]]:
        if (k := digest(p.strip())) not in seen:
            seen.add(k)
            if out and not out[-1].endswith(("\n\n", "\n\r\n")):
                out[-1] = out[-1].rstrip("\r\n") + "\n\n"
            out.append(p)
    return Outcome("merged", "prose", "".join(out))


def python_blocks(text: str) -> dict[tuple[str, str], str]:
    """Top-level statements by kind and name, or kind and content; comments and blanks go with what follows."""
    lines, out, at = split_lines(text), {}, 0
    for node in ast.parse(text).body:
        block = "".join(lines[at : node.end_lineno])
        at = node.end_lineno
        name = getattr(node, "name", None) or digest(block.strip())
        out.setdefault((type(node).__name__, name), block.strip("\n") + "\n")
    if rest := "".join(lines[at:]).strip("\n"):
        out.setdefault(("rest", digest(rest)), rest + "\n")
    return out


def merge_python(base: str | None, ours: str | None, theirs: str | None) -> Outcome:
    """Blocks in ours' order, then theirs' additions, a blank line between; a block both changed is merged line by line."""
    if done := same("python", base, ours, theirs):
        return done
    try:
        b, o, t = (python_blocks(x or "") for x in (base, ours, theirs))
    except (SyntaxError, ValueError):
        return Outcome("not-applicable", "python")
    out, regions = [], []
    for key in [*o, *[k for k in t if k not in o]]:
        x, y, z = b.get(key), o.get(key), t.get(key)
        if (y is None or z is None) and x is not None and x == (y if z is None else z):
            continue
        if y is None and x is None or z is None and x is None:
            out.append(y or z)
            continue
        found = merge_text(x, y, z)
        for r in found.regions:
            r.description = f"{key[0]} {key[1]}: {r.description}"
        regions += found.regions
        out.append(found.content)
    return Outcome("conflict" if regions else "merged", "python", "\n".join(out), regions)
