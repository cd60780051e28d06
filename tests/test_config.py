"""Configurations and patterns."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.config import ConfigError, decode_documented, decode_graph
from plumbline.functions.globs import GlobError, GlobSet, compile_glob, glob_table, members
from plumbline.operators.modules import candidates_of, module_names, package_entry

REF = dict(type="markdown", files=["docs/**"])


def config(claim=None, **reference):
    return {"claims": [dict(type="markdown", files=["*.md"], reference=REF | reference) | (claim or {})]}


def cites(kind, **reference):
    """One claim of a kind with this reference."""
    return {"claims": [dict(type=kind, files=["a"], reference=reference)]}


def test_defaults():
    c = decode_graph(config()).claims[0]
    assert c.symbols == c.references[0].symbols == tuple("file h1 h2 h3 h4".split())
    ts = decode_graph({"claims": [dict(type="typescript", files=["src/**"], reference=[dict(type="typescript", file="./src/../api.ts"), dict(type="swagger", file="a.yaml")])]}).claims[0]
    assert ts.symbols == ("type", "function", "property")
    assert (ts.references[0].symbols, ts.references[0].entry, ts.references[0].by_entry) == (("type",), "api.ts", True)
    assert ts.references[1].symbols == ("operation",)
    assert decode_documented(None) == decode_documented({}) == ("type", "function", "property")
    assert decode_documented({"symbol": "type"}) == ("type",)


@pytest.mark.parametrize(
    "bad",
    [
        None,
        {},
        {"claims": {}},
        {"claims": []},
        {"claims": [1]},
        config() | {"severity": "error"},
        config() | {"sources": []},
        config({"type": "swagger"}),
        config({"type": "other"}),
        config({"name": 1}),
        config({"files": []}),
        config({"files": ["!a"]}),
        config({"files": "a"}),
        config({"symbol": []}),
        config({"symbol": "h9"}),
        config({"symbol": {}}),
        config({"reference": []}),
        config({"reference": 3}),
        config({"citedBy": []}),
        config(file="a.md"),
        config(package="x"),
        config(type="swagger"),
        cites("typescript", type="typescript"),
        cites("typescript", type="typescript", file="a", files=["b"]),
        *[cites("typescript", type="typescript", file=f) for f in ("", " a", "/a", "../a", ".", 1)],
        *[cites("typescript", type="typescript", package=p) for p in ("", "./x", "/x", "a/b", "@a", "@a/b/c", 1)],
        *[cites("markdown", type="swagger", file=f) for f in ("", "ftp://x/y", "http://", "http://x/y#z", "/a", "../a", 5)],
    ],
)
def test_refused(bad):
    with pytest.raises(ConfigError):
        decode_graph(bad)


def test_all_problems_are_told_in_order():
    with pytest.raises(ConfigError) as e:
        decode_graph({"claims": [dict(type="markdown", files=["../a"], reference={}, zz=1, aa=2)]})
    assert [re.sub(":.*", "", p.split(", ", 1)[1]) for p in e.value.problems] == ["claims[0].aa", "claims[0].zz", "claims[0].files", "claims[0].reference.type", "claims[0].reference.files"]


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("a/*.md", "a/b.md", True), ("a/*.md", "a/b/c.md", False), ("a/**", "a/b/c", True), ("a/**", "a", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**/x", "a/x", True), ("a?c", "aéc", True), ("a?c", "a/c", False), ("[ab]", "a", False), ("[ab]", "[ab]", True), ("./a/", "a", True), ("a\\b", "a/b", True), ("a**b", "axxb", True), ("a**b", "a/b", False), ("a.b", "axb", False)],
)
def test_patterns(pattern, path, want):
    assert GlobSet([pattern]).matches(path) is want


@pytest.mark.parametrize("bad", ["", "/a", "C:/a", "a//b", "../a", "a/../b", ".", "!"])
def test_patterns_refused(bad):
    with pytest.raises(GlobError):
        compile_glob(bad)


def test_the_last_match_decides_and_pruning_ignores_exclusions():
    g = GlobSet(["docs/**", "!docs/old/**", "docs/old/keep.md"])
    assert [g.matches(p) for p in ("docs/a.md", "docs/old/a.md", "docs/old/keep.md", "x")] == [True, False, True, False]
    assert g.below("docs") and g.below("docs/old") and not g.below("src")
    assert GlobSet(["a/b/*.md", "a/**", "d/c.md"]).roots() == ["a/", "d/"]


def _match(pattern, path):
    """Direct recursive matching of segments."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return _match(pattern[1:], path) or bool(path) and _match(pattern, path[1:])
    return bool(path) and _segment(pattern[0], path[0]) and _match(pattern[1:], path[1:])


def _segment(p, s):
    if not p:
        return not s
    if p[0] == "*":
        return _segment(p[1:], s) or bool(s) and _segment(p, s[1:])
    return bool(s) and p[0] in ("?", s[0]) and _segment(p[1:], s[1:])


SEG = st.text(alphabet="ab.*?", min_size=1, max_size=3).filter(lambda s: s not in (".", "..") and not set(s) == {"."})


@settings(max_examples=300)
@given(st.lists(st.one_of(st.just("**"), SEG), min_size=1, max_size=4), st.lists(st.text(alphabet="ab.", min_size=1, max_size=3), min_size=1, max_size=4))
def test_regex_agrees_with_direct_matching(pattern, path):
    assert GlobSet(["/".join(pattern)]).matches("/".join(path)) == _match(pattern, path)


def test_members_in_spark(spark):
    sets = {"x": GlobSet(["**", "!a/**", "a/k*"]), "y": GlobSet(["a/*"])}
    paths = ["a/k1", "a/z", "b", "a/q/k"]
    got = {(r.owner, r.path) for r in members(spark.createDataFrame([(p,) for p in paths], "path string"), glob_table(spark, sets), __import__("pyspark").sql.functions.col("path")).collect()}
    assert got == {(o, p) for o, g in sets.items() for p in paths if g.matches(p)}


def test_module_names():
    assert candidates_of("a/b.js")[:2] == ["a/b.js", "a/b.ts"] and candidates_of("a")[-1] == "a/index.d.cts"
    assert module_names("src/x.ts", "../y", None)[1] == "y.ts"
    assert module_names("src/x.ts", "/abs", None) == []
    assert module_names("x.ts", "pkg/deep", None)[0] == "node_modules/pkg/deep"
    assert module_names("x.ts", "pkg", None) == []


@pytest.mark.parametrize(
    ("manifest", "subpath", "want"),
    [
        ('{"types": "a.d.ts"}', None, "a.d.ts"),
        ('{"typings": "b.d.ts", "main": "x.js"}', None, "b.d.ts"),
        ('{"main": "x.js"}', None, None),
        ('{"exports": {"types": "c.d.ts"}}', None, "c.d.ts"),
        ('{"exports": {".": {"default": {"types": "d.d.ts"}}, "./s": {"types": "s.d.ts"}}}', "s", "s.d.ts"),
        ('{"exports": "x.js", "types": "e.d.ts"}', None, "e.d.ts"),
        ('{"typesVersions": {"*": {"*": ["f.d.ts"]}}, "types": "g.d.ts"}', None, "f.d.ts"),
        ("not json", None, None),
        (None, "s", None),
    ],
)
def test_package_entry(manifest, subpath, want):
    assert package_entry(manifest, subpath) == want
