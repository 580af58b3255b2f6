"""The seven properties of a textual merge, and cases of each handler."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.operators.merge.dispatch import BY_EXTENSION, Registry, merge_files
from loomstone.operators.merge.lines import edits, line_diff, merge_text, split_lines
from loomstone.operators.merge.sections import merge_markdown, merge_prose, merge_python
from loomstone.operators.merge.values import merge_json, merge_toml, merge_xml, merge_yaml

document = st.lists(st.text("abc", max_size=3), max_size=9).map(lambda rows: "".join(f"{r}\n" for r in rows))


@settings(max_examples=200, deadline=None)
@given(document, document, document)
def test_properties(base, ours, theirs):
    assert merge_text(base, base, base).content == base
    assert merge_text(base, base, theirs).content == theirs
    assert merge_text(base, ours, base).content == ours
    assert merge_text(base, ours, ours).content == ours
    out = merge_text(base, ours, theirs)
    assert out.content.count("<<<<<<< ours\n") == len(out.regions)
    assert (out.status == "merged") == (not out.regions)
    if out.status == "merged":
        assert "=======\n" not in out.content


@settings(max_examples=200, deadline=None)
@given(document, document)
def test_edit_script(a, b):
    x, y = split_lines(a), split_lines(b)
    out, at = [], 0
    for a0, a1, b0, b1 in edits(x, y):
        out += x[at:a0] + y[b0:b1]
        at = a1
    assert out + x[at:] == y
    rows = line_diff(a, b)
    assert "".join(t for op, _, _, t in rows if op != "delete") == b and "".join(t for op, _, _, t in rows if op != "insert") == a
    # Shortest: as many changes as a longest common subsequence leaves.
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    assert sum(op != "equal" for op, *_ in rows) == len(x) + len(y) - 2 * table[-1][-1]


def test_lines():
    assert split_lines("a\r\nb\rc\nd") == ["a\r\n", "b\r", "c\n", "d"]
    assert merge_text("1\n2\n3\n4\n", "x\n2\n3\n4\n", "1\n2\n3\ny\n").content == "x\n2\n3\ny\n"
    touching = merge_text("1\n2\n", "x\n2\n", "1\ny\n")
    assert touching.status == "conflict" and len(touching.regions) == 1
    assert merge_text(None, "a\n", "a\n").content == "a\n"


def test_json():
    assert json.loads(merge_json('{"a": 1}', '{"a": 1, "b": 2}', '{"a": 3}').content) == {"a": 3, "b": 2}
    both = merge_json('{"a": 1}', '{"a": 2}', '{"a": 3}')
    assert both.status == "conflict" and json.loads(both.content) == {"a": 2}
    gone = merge_json('{"a": 1, "b": 1}', '{"b": 1}', '{"a": 2, "b": 1}')
    assert gone.status == "conflict" and json.loads(gone.content) == {"a": 2, "b": 1}
    assert json.loads(merge_json('{"a": [1, 2]}', '{"a": [2, 3]}', '{"a": [1, 4]}').content) == {"a": [2, 3, 1, 4]}
    assert merge_json("{", "{1", "{2").status == "not-applicable"


def test_other_values():
    assert merge_toml("a = 1\n", "a = 1\nb = 'x'\n", "a = 2\n").content == 'a = 2\nb = "x"\n'
    assert merge_yaml("a: 1\n", "a: 1\nb: 2\n", "a: 3\n").content == "a: 3\nb: 2\n"
    assert merge_xml("<a><b>1</b><c/></a>", "<a><b>2</b><c/></a>", '<a><b>1</b><c k="v"/></a>').content == '<a><b>2</b><c k="v"/></a>'
    assert merge_xml("<a>1</a>", "<a>2</a>", "<a>3</a>").status == "conflict"
    assert merge_xml("<a>", "<b>", "<c>").status == "not-applicable"


def test_sections():
    base = "# A\none\n# B\ntwo\n"
    out = merge_markdown(base, "# A\nONE\n# B\ntwo\n", "# A\none\n# B\ntwo\n# C\nthree\n")
    assert out.status == "merged" and out.content == "# A\nONE\n# B\ntwo\n# C\nthree\n"
    assert merge_markdown(base, "# A\nx\n# B\ntwo\n", "# A\ny\n# B\ntwo\n").status == "conflict"
    # A deletion by ours holds, one by theirs doesn't.
    assert merge_prose("a\n\nb\n\nc\n", "b\n\nc\n", "a\n\nb\n\nc\n\nd\n").content == "b\n\nc\n\nd\n"
    assert merge_prose("a\n\nb\n", "a\n\nb\n\nc\n", "b\n").content == "a\n\nb\n\nc\n"


def test_python():
    base = "def f():\n    return 1\n"
    out = merge_python(base, base + "\ndef g():\n    pass\n", base.replace("1", "2"))
    assert out.status == "merged" and "return 2" in out.content and "def g" in out.content
    assert merge_python("def f(", "x = (", "y = (").status == "not-applicable"


def test_dispatch(spark):
    rows = [("a.json", '{"a": 1}', '{"a": 1, "b": 2}', '{"a": 3}'), ("b.json", "{", "{x", "{y"), ("c.bin", "\x00a", "\x00b", "\x00c"), ("d", None, "new\n", None), ("e.txt", "a\n", "b\n", "c\n")]
    files = spark.createDataFrame(rows, "path string, base string, ours string, theirs string")
    found = {r["path"]: r for r in merge_files(files, BY_EXTENSION).collect()}
    assert found["a.json"]["status"] == "merged" and found["a.json"]["handler"] == "json"
    assert found["b.json"]["handler"] == "textual" and found["b.json"]["status"] == "conflict"
    assert found["c.bin"]["handler"] == "none" and found["c.bin"]["content"] == "\x00b"
    assert found["d"]["content"] == "new\n"
    assert {r["status"] for r in merge_files(files, no_auto=True).where("path = 'a.json'").collect()} == {"conflict"}
    registry = Registry()
    try:
        registry.register("x", test_python, pin="0")
        raise AssertionError
    except ValueError:
        pass
