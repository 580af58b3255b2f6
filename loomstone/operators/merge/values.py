"""Merges of values: JSON, YAML and TOML by one model, XML by elements."""

from __future__ import annotations

import datetime
import json
import re
import xml.parsers.expat
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .outcome import Outcome, Region, same

ABSENT = object()


def shown(value: Any) -> str:
    return "" if value is ABSENT else json.dumps(value, ensure_ascii=False, sort_keys=True)


def alike(a: Any, b: Any) -> bool:
    """Equal as JSON: true isn't 1, and 1 isn't 1.0."""
    return a is b or (a is not ABSENT and b is not ABSENT and shown(a) == shown(b))


def merge_values(base: Any, ours: Any, theirs: Any, at: str, regions: list[Region]) -> Any:
    """Objects by key; arrays as a union, ours first; anything else both sides changed is a conflict that keeps the side that has a value, ours if both."""
    if alike(ours, theirs) or alike(base, theirs):
        return ours
    if alike(base, ours):
        return theirs
    if isinstance(ours, dict) and isinstance(theirs, dict):
        old = base if isinstance(base, dict) else {}
        out = {}
        for key in sorted({*old, *ours, *theirs}):
            value = merge_values(old.get(key, ABSENT), ours.get(key, ABSENT), theirs.get(key, ABSENT), f"{at}/{key}", regions)
            if value is not ABSENT:
                out[key] = value
        return out
    if isinstance(ours, list) and isinstance(theirs, list):
        have = {shown(x) for x in ours}
        return ours + [x for x in theirs if shown(x) not in have]
    regions.append(Region(at or "/", shown(base), shown(ours), shown(theirs)))
    return theirs if ours is ABSENT else ours


def structured(handler: str, read: Callable[[str], Any], write: Callable[[Any], str]) -> Callable[..., Outcome]:
    def merge(base: str | None, ours: str | None, theirs: str | None) -> Outcome:
        if done := same(handler, base, ours, theirs):
            return done
        try:
            values = [read(x) if x and x.strip() else ABSENT for x in (base, ours, theirs)]
        except Exception:  # not of this format: the caller goes on with text
            return Outcome("not-applicable", handler)
        regions: list[Region] = []
        value = merge_values(*values, "", regions)
        try:
            content = "" if value is ABSENT else write(value)
        except (TypeError, ValueError):
            return Outcome("not-applicable", handler)
        return Outcome("conflict" if regions else "merged", handler, content, regions)

    return merge


def plain(value: Any) -> Any:
    """A value of JSON's model: dates and times are text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, datetime.date | datetime.time) else value


def read_toml(text: str) -> Any:
    import tomllib

    return plain(tomllib.loads(text))


def toml_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z0-9_-]+", key) else json.dumps(key, ensure_ascii=False)


def toml_value(value: Any) -> str:
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{toml_key(k)} = {toml_value(v)}" for k, v in value.items()) + " }" if value else "{}"
    if isinstance(value, list):
        return "[" + ", ".join(map(toml_value, value)) + "]"
    if value is None:
        return '""'
    return str(value).lower() if isinstance(value, bool) else json.dumps(value, ensure_ascii=False) if isinstance(value, str) else repr(value)


def write_toml(value: Any, at: tuple[str, ...] = ()) -> str:
    if not isinstance(value, dict):
        raise ValueError("a TOML document is a table")
    own = [f"{toml_key(k)} = {toml_value(v)}" for k, v in sorted(value.items()) if not isinstance(v, dict)]
    head = [f"[{'.'.join(map(toml_key, at))}]"] if at and (own or not value) else []
    parts = ["\n".join(head + own) + "\n"] if head or own else []
    parts += [write_toml(v, (*at, k)) for k, v in sorted(value.items()) if isinstance(v, dict)]
    return "\n".join(parts)


def read_yaml(text: str) -> Any:
    import yaml

    return plain(yaml.safe_load(text))


def write_yaml(value: Any) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=True, allow_unicode=True, default_flow_style=False)


merge_json = structured("json", json.loads, lambda v: json.dumps(v, indent=2, ensure_ascii=False, sort_keys=True) + "\n")
merge_toml = structured("toml", read_toml, write_toml)
merge_yaml = structured("yaml", read_yaml, write_yaml)


@dataclass
class Node:
    """An element, or a text or raw piece (comment, declaration, CDATA and the like, kept as written)."""

    kind: str
    text: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def write(self) -> str:
        if self.kind != "element":
            return self.text
        attributes = "".join(f' {k}="{v}"' for k, v in sorted(self.attributes.items()))
        inner = "".join(c.write() for c in self.children)
        return f"<{self.text}{attributes}>{inner}</{self.text}>" if self.children else f"<{self.text}{attributes}/>"


TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>|</?[^>]+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def parse_xml(text: str) -> Node:
    """Pieces as written, references unresolved; raises for what isn't well formed."""
    xml.parsers.expat.ParserCreate().Parse(text.lstrip("﻿").encode(), True)
    root = Node("element", "")
    stack, at = [root], 0
    for m in TAG.finditer(text):
        if m.start() > at:
            stack[-1].children.append(Node("text", text[at : m.start()]))
        tag, at = m[0], m.end()
        if tag.startswith(("<!", "<?")):
            stack[-1].children.append(Node("raw", tag))
        elif tag.startswith("</"):
            stack.pop()
        else:
            name = re.match(r"<([^\s/>]+)", tag)[1]
            node = Node("element", name, {a: b or c for a, b, c in ATTRIBUTE.findall(tag[1 + len(name) :])})
            stack[-1].children.append(node)
            if not tag.endswith("/>"):
                stack.append(node)
    if at < len(text):
        stack[-1].children.append(Node("text", text[at:]))
    return root


def merge_nodes(base: Node | None, ours: Node | None, theirs: Node | None, at: str, regions: list[Region]) -> Node | None:
    """Children are paired by place; attributes by name; elements of other names or kinds conflict, ours stays."""
    texts = [n.write() if n else None for n in (base, ours, theirs)]
    if texts[1] == texts[2] or texts[0] == texts[2]:
        return ours
    if texts[0] == texts[1]:
        return theirs
    if not (ours and theirs) or ours.kind != "element" or theirs.kind != "element" or ours.text != theirs.text:
        regions.append(Region(at or "/", *[t or "" for t in texts]))
        return ours or theirs
    old = base if base and base.kind == "element" and base.text == ours.text else Node("element", ours.text)
    out = Node("element", ours.text)
    for key in sorted({*old.attributes, *ours.attributes, *theirs.attributes}):
        b, o, t = (n.attributes.get(key) for n in (old, ours, theirs))
        value = o if o == t or b == t else t if b == o else o if o is not None else t
        if o != t and b not in (o, t):
            regions.append(Region(f"{at}/@{key}", b or "", o or "", t or ""))
        if value is not None:
            out.attributes[key] = value
    pick = lambda n, k: n.children[k] if k < len(n.children) else None
    for k in range(max(len(n.children) for n in (old, ours, theirs))):
        child = merge_nodes(pick(old, k), pick(ours, k), pick(theirs, k), f"{at}/{k}", regions)
        if child:
            out.children.append(child)
    return out


def merge_xml(base: str | None, ours: str | None, theirs: str | None) -> Outcome:
    if done := same("xml", base, ours, theirs):
        return done
    try:
        nodes = [parse_xml(x) if x and x.strip() else Node("element", "") for x in (base, ours, theirs)]
    except (xml.parsers.expat.ExpatError, IndexError):
        return Outcome("not-applicable", "xml")
    regions: list[Region] = []
    merged = merge_nodes(*nodes, "", regions)
    return Outcome("conflict" if regions else "merged", "xml", "".join(c.write() for c in merged.children), regions)
