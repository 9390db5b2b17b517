"""Stored histories written and read back, files and their edits."""

import pytest

from parley.functions import text as X
from parley.operators import scaffold, view
from parley.sources import history

ROWS = [(1, 0, "a", "USER", "hi\n\u2028", True), (1, 1, "b", "ASSISTANT", "", False), (2, 0, "a", "USER", "x", False)]
SCHEMA = "conv_id bigint, pos bigint, id string, author string, text string, is_favorite boolean"


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_save_and_load(spark, messages, tmp_path):
    path = str(tmp_path / "store")
    assert rows(history.load(spark, path)) == []
    assert history.save(messages, path) == path and rows(history.load(spark, path)) == sorted(ROWS)
    # what is stored may be read while it is replaced
    history.save(history.load(spark, path).where("conv_id = 1"), path)
    assert rows(history.load(spark, path)) == sorted(ROWS[:2])
    # a crash between the two renames leaves the old folder beside the new one
    (tmp_path / "store").rename(tmp_path / "store.old")
    assert rows(history.load(spark, path)) == sorted(ROWS[:2])
    history.save(messages, path)
    assert rows(history.load(spark, path, strict=True)) == sorted(ROWS) and not (tmp_path / "store.old").exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rows(history.load(spark, str(tmp_path / "none"), strict=True))


def test_export(spark, messages, tmp_path):
    folder = str(tmp_path / "out")
    paths = history.export(messages, folder).collect()
    assert sorted(r["conv_id"] for r in paths) == [1, 2]
    for r in paths:  # each file is a history by itself
        assert rows(history.read_history(spark, r["path"], r["conv_id"], strict=True)) == sorted(x for x in ROWS if x[0] == r["conv_id"])
    assert rows(history.read_exports(spark, folder)) == sorted(ROWS) and rows(history.read_exports(spark, str(tmp_path / "none"))) == []


def test_read_history(spark, tmp_path):
    assert rows(history.read_history(spark, str(tmp_path / "none.json"))) == []
    for name, said in (("blank", " \n"), ("broken", "{"), ("lacks", '{"version": 1, "messages": [{"id": "a"}]}')):
        (tmp_path / name).write_text(said)
        assert rows(history.read_history(spark, str(tmp_path / name))) == []
        with pytest.raises(Exception, match="not a history"):
            rows(history.read_history(spark, str(tmp_path / name), strict=True))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rows(history.read_history(spark, str(tmp_path / "none.json"), strict=True))


def test_files(spark, tmp_path):
    (tmp_path / "a.kt").write_text("x\r\ny\rz\n")
    files = scaffold.read_sources(spark, str(tmp_path / "a.kt"))
    assert [(r["pos"], r["line"]) for r in scaffold.lines_of(files).orderBy("pos").collect()] == [(0, "x"), (1, "y"), (2, "z"), (3, "")]
    targets, there = (spark.createDataFrame([(p,) for p in x], "path string") for x in ("ab", "b"))
    assert rows(scaffold.write_plan(targets, there)) == [("a", "CREATE"), ("b", "SKIP")] and rows(scaffold.write_plan(targets, there, force=True)) == [("a", "CREATE"), ("b", "CREATE")]
    lists = spark.createDataFrame([(1, "a.kt, b.kt,build/c.kt,d.txt")], "id bigint, csv string")
    assert rows(scaffold.changed_files(lists, spark.createDataFrame([("b.kt",), ("build/c.kt",)], "path string"))) == [(1, "b.kt")]
    assert rows(scaffold.changed_files(lists, excluded=("a.kt",))) == [(1, "b.kt"), (1, "build/c.kt")]
    shown = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "a boolean, b boolean, c boolean")
    for r in shown.select("*", *(c.alias(n) for n, c in view.actions_shown(shown.a, shown.b, shown.c).items())).collect():
        assert r["has_actions"] == (r["a"] or r["b"]) and r["can_speak"] == (r["a"] and r["c"])
    assert shown.limit(1).select(X.lines(shown.a.cast("string"))).first()[0]


X1, Y1, Z1, NEW = 'include("x")', "  include(y)", 'include("z")', 'include("new")'
#: lines, section, lines wanted
INCLUDES = {
    "in its section": (["// A", X1, "// B", Y1], "// A", ["// A", X1, NEW, "// B", Y1]),
    "in the last section": (["// A", X1, "// B", Y1], "// B", ["// A", X1, "// B", Y1, NEW]),
    "no such section": (["// A", X1, "// B", Y1, "end"], "// C", ["// A", X1, "// B", Y1, NEW, "end"]),
    "no include at all": (["other", ""], "// A", ["other", "", NEW]),
    "none after the section's line": ([X1, "// B", "other"], "// B", [X1, "// B", "other", NEW]),
    "a remark before the section's first": (["// A", "// remark", X1, "// B", Y1], "// A", ["// A", "// remark", X1, NEW, "// B", Y1]),
    "other lines between them": (["// A", X1, "", "other", Z1, "//", Y1], "// A", ["// A", X1, "", "other", Z1, NEW, "//", Y1]),
    "already there, indented": (["// A", X1, "// B", "    " + NEW], "// A", ["// A", X1, "// B", "    " + NEW]),
    "a section's line that is indented": (["  // A", X1, "// B"], "// A", ["  // A", X1, NEW, "// B"]),
}


def included(spark, files, plans):
    lines = spark.createDataFrame([(f, i, x) for f, own in files.items() for i, x in enumerate(own)], "file string, pos bigint, line string")
    found = {}
    for r in scaffold.wire_include(lines, spark.createDataFrame(plans, "file string, section string, new string")).orderBy("file", "pos").collect():
        found.setdefault(r["file"], []).append(r["line"])
    return found


def test_includes(spark):
    found = included(spark, {f: lines for f, (lines, _, _) in INCLUDES.items()}, [(f, section, NEW) for f, (_, section, _) in INCLUDES.items()])
    assert found == {f: want for f, (_, _, want) in INCLUDES.items()}


def test_includes_keep_all_else(spark):
    """Several edits of each of many files: every new line stands once, all others keep their order."""
    kinds = ["// A", "// B", X1, Y1, "", "other", "//"]
    files = {f"f{i}": [kinds[(i * 7 + j * j * 3 + i // (j + 1)) % len(kinds)] for j in range(i % 9)] or [""] for i in range(40)}
    new = ['include("n1")', 'include("n2")', 'include("n3")']
    found = included(spark, files, [(f, s, n) for f in files for s, n in zip(("// A", "// B", "// None"), new, strict=True)] + [(f, "// B", X1) for f in files if X1 in files[f]])
    for f, own in files.items():
        assert [x for x in found[f] if x not in new] == own and sorted(x for x in found[f] if x in new) == new


def test_entries_without_a_list(spark):
    lines = spark.createDataFrame([("f", 0, "package x")], "file string, pos bigint, line string")
    with pytest.raises(Exception, match="no includes"):
        scaffold.wire_entry(lines, spark.createDataFrame([("f", "a")], "file string, new string")).collect()
    empty = spark.createDataFrame([("f", 0, "  includes("), ("f", 1, "  )")], "file string, pos bigint, line string")
    assert [r["line"] for r in scaffold.wire_entry(empty, spark.createDataFrame([("f", "b"), ("f", "a")], "file string, new string")).orderBy("pos").collect()] == ["  includes(", "      a,", "      b", "  )"]
