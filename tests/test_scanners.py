"""Scanners on texts."""

import json

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from plumbline.sources import inventory, markdown, openapi, tags, typescript


def parsed(text):
    return [(t.tag, t.target, t.is_link, t.reason, t.offset) for t in tags.tags(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@cite a.md#b since it is", [("cite", "a.md#b", False, "since it is", 0)]),
        ("/**\n * Words.\n * @citeExclude x\n *   not now\n * @param q z\n * more\n */", [("citeExclude", "x", False, "not now", 2)]),
        ("\n@cite\n target\n reason goes\n on", [("cite", "target", False, "reason goes\non", 1)]),
        ("@cite {@link A.b} r", [("cite", "A.b", True, "r", 0)]),
        ("@cite {@linkcode A }r", [("cite", "A", True, "r", 0)]),
        ("@cite {@link A b} r", [("cite", "{@link", False, "A b} r", 0)]),
        ("@cite {@link } r", [("cite", "{@link", False, "} r", 0)]),
        ("@citeOther x y\nan @cite in a line", []),
        ("@cite a b\n@param still the reason", [("cite", "a", False, "b\n@param still the reason", 0)]),
    ],
)
def test_tags(text, want):
    assert parsed(text) == want


@pytest.mark.parametrize(("title", "want"), [("Hello, World", "hello-world"), ("  A --  b ", "a-b"), ("Déjà vu_x", "déjà-vu_x"), ("***", ""), ("a\u00a0b", "a-b"), ("-x-", "x")])
def test_slug(title, want):
    assert markdown.slug(title) == want


def outline(text, path="d.md"):
    return [(u["symbol"], u["target"].partition("#")[2], u["line"]) for u in markdown.scan(path, text)["units"]]


def test_outline():
    text = "# One\n## Two {#second}\n#### Deep ##\n## Three#\n##### five\n#no\n    # indented\n"
    assert outline(text) == [("file", "", 1), ("h1", "one", 1), ("h2", "second", 2), ("h4", "deep", 3), ("h2", "three", 4)]
    parents = {u["target"]: u["parent_id"] for u in markdown.scan("d.md", text)["units"]}
    assert parents["d.md#deep"] == "markdown:d.md:h2:2" and parents["d.md#three"] == "markdown:d.md:h1:1" and parents["d.md#one"] == "markdown:d.md:file"


def test_fences_and_comments_hide_headings():
    text = "```\n# in fence\n<!-- @cite a b -->\n````\n# out\n<!--\n# in comment\n@cite c d\n-->\n~~~\n# unclosed\n"
    assert outline(text) == [("file", "", 1), ("h1", "out", 5)]
    found = markdown.scan("d.md", text)["declarations"]
    assert [(d["target"], d["hosts"], d["line"], d["seq"]) for d in found] == [("c", ["h1"], 8, 1)]


def test_heading_without_anchor_closes_its_level():
    r = markdown.scan("d.md", "# A\n## B\n## !!!\n### C\n")
    assert [p["symbol"] for p in r["problems"]] == ["h2"]
    assert r["units"][-1]["parent_id"] == "markdown:d.md:h1:1"


@given(st.text(alphabet="#`~<!->\n ab@", max_size=80))
def test_any_markdown_is_scanned(text):
    r = markdown.scan("d.md", text)
    lines = text.count("\n") + 1
    ids = {u["id"] for u in r["units"]}
    assert all(1 <= u["line"] <= lines and (u["parent_id"] in ids or u["symbol"] == "file") for u in r["units"])


def ts(text, path="a.ts"):
    return typescript.scan(path, text)


def units(text, path="a.ts"):
    return {(u["symbol"], u["target"]) for u in ts(text, path)["units"]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("interface Hidden {}", set()),
        ("export interface I<T = { a: 1 }> extends B<T> { a: Map<string, number>; m(): void; readonly b?: () => void, get c(): 1 }", {("type", "I"), ("property", "I.a"), ("property", "I.b")}),
        ("export type A = { x: 1 }\nexport type B = { x: 1 } | null\nexport type C = { [K in keyof A]: 1 }", {("type", "A"), ("property", "A.x"), ("type", "B"), ("type", "C")}),
        ("export const f = () => 1, g = function () {}, h = 2, i = (async (x) => x) as any, j = f!", {("function", "f"), ("function", "g"), ("property", "h"), ("function", "i"), ("property", "j")}),
        ("export let f = () => {};\nexport declare const g: () => void;", {("property", "f"), ("property", "g")}),
        ("export const k = <T,>(x: T): T => x satisfies T;\nexport const call = make<A>(() => 1);", {("function", "k"), ("property", "call")}),
        ("export const { a, b: { c }, ...rest } = x, [d = 1, , e] = y;", {("property", n) for n in ("a", "c", "rest", "d", "e")}),
        ("export class C { m() {} static s = () => {}; private p() {} protected q = () => {}; n: () => void; o: string; accessor z = () => {}; get g() { return 1 } constructor() {} 'two words'() {} [key]() {} #h() {} }", {("function", "C.prototype.m"), ("function", "C.s"), ("function", "C.prototype.n")}),
        ("export namespace A.B { export const x = 1; const y = 2; export namespace C { export type T = 1 } }", {("type", "A"), ("type", "A.B"), ("property", "A.B.x"), ("type", "A.B.C"), ("type", "A.B.C.T")}),
        ("export declare namespace N { const z: number; function f(): void; interface I {} }", {("type", "N"), ("property", "N.z"), ("function", "N.f"), ("type", "N.I")}),
        ("namespace N { export const v = 1; export type T = 1 }\nexport type { N };", {("type", "N"), ("type", "N.T")}),
        ("function a() {}\ninterface b {}\nexport { a as x, b as default, b };", {("function", "x"), ("type", "b")}),
        ("export default function named() {}\nexport default class {}", {("function", "named")}),
        ("export enum E { A = 1 }", set()),
        ("const s = `${ `}` } export const no = 1`;\nconst r = /export const no = {/;\nexport const yes = 'it''s';", {("property", "yes")}),
        ("if (a) { export_ } else { b }\nfor (const x of y) { z() }\nexport const after = 1", {("property", "after")}),
    ],
)
def test_units(text, want):
    assert units(text) == want


def test_merged_declarations_are_one_unit_at_the_first():
    r = ts("\nexport interface I { a: 1 }\nexport interface I { a: 1; b: 2 }\nexport function I() {}\n")
    assert [(u["symbol"], u["target"], u["line"]) for u in r["units"]] == [("type", "I", 2), ("property", "I.a", 2), ("property", "I.b", 3), ("function", "I", 4)]


def test_identities_differ_where_names_agree():
    a, b = ts("export class S { m() {} }")["units"][0], ts("export class S { static 'prototype.m' = () => {} }")["units"][0]
    assert a["target"] == b["target"] and a["id"] != b["id"]


def test_imports_and_exports():
    r = ts('import d, { a as b, type c } from "./x";\nimport * as n from "y";\nimport "side";\nimport q = require("z");\nexport * from "./s";\nexport * as t from "./t";\nexport { e as f } from "./e";\nexport const g = 1;\n')
    assert {(i["local"], i["imported"], i["is_namespace"]) for i in r["imports"]} == {("d", "default", False), ("b", "a", False), ("c", "c", False), ("n", None, True)}
    assert [(e["public"], e["local"], e["specifier"], e["imported"], e["is_namespace"]) for e in r["exports"]] == [(None, None, "./s", None, False), ("f", None, "./e", "e", False), ("g", "g", None, None, False), ("t", None, "./t", None, True)]


def test_citations_and_hosts():
    text = "/** @cite a.md x */\nexport interface I {\n  /** @cite b.md y */\n  p: 1;\n}\n/** @cite c.md z */\nfunction hidden() {}\n/** @cite d.md w */\nexport const { a } = s, run = () => {};\n"
    assert [(d["target"], d["hosts"], d["line"]) for d in ts(text)["declarations"]] == [("a.md", ["type"], 1), ("b.md", ["property"], 3), ("c.md", [], 6), ("d.md", ["function", "property"], 8)]


@example(["class ", "${"])
@example(["enum "])
@example(["import ", "*"])
@example(["export ", "*", "as "])
@example(["namespace ", "a", "."])
@example(["const ", "{"])
@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["export ", "enum ", "function ", "async ", "static ", "default ", "get ", "@", "#", "?", "!", ".", "...", "1", "declare ", "global ", "using ", "\\", "\u2028", "'x'", "const ", "a", "=", "{", "}", "(", ")", "<", ">", "=>", ":", ";", "\n", "class ", "interface ", "`", "${", "'", "/", "/**", "*/", "namespace ", ",", "[", "]", "type ", "import ", "from ", "*", "as "]), max_size=40))
def test_any_text_is_scanned(parts):
    typescript.scan("a.ts", "".join(parts))


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_characters_are_scanned(text):
    typescript.scan("a.ts", text)
    markdown.scan("a.md", text)


@pytest.mark.parametrize("text", ["export namespace a {" * 3000, "(" * 20_000, "export const a = " + "(" * 20_000 + ")" * 20_000, "export const " + "{a:" * 5000, "`${" * 5000, "export type A = " + "<" * 20_000, "class A { " * 3000, "/* /** " * 20_000, "export const a = f<" * 3000])
def test_deep_texts_are_scanned(text):
    typescript.scan("a.ts", text)


def test_one_bad_file_is_a_problem_of_its_own(spark):
    rows = [("a.ts", bytearray(b"export type A = 1")), ("b.ts", bytearray(b"\xff\xfe")), ("c.ts", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: ([u.target for u in r.units], [(p.code, p.symbol) for p in r.problems]) for r in inventory.scan_typescript(files).collect()}
    assert got == {"a.ts": (["A"], []), "b.ts": ([], [("ts_unreadable", "*")]), "c.ts": ([], [("ts_unreadable", "*")])}
    assert [r.problems[0].code for r in inventory.scan_markdown(files.filter("path <> 'a.ts'")).collect()] == ["md_unreadable"] * 2


def test_tag_names_are_a_parameter():
    words = ("done", "won't")
    assert [(t.tag, t.target) for t in tags.tags("@done a b\n@won't c d\n@cite e f", words)] == [("done", "a"), ("won't", "c")]
    assert [d["tag"] for d in typescript.scan("a.ts", "/** @done a b */ export type A = 1; /** @cite x y */", words)["declarations"]] == ["done"]
    assert [d["tag"] for d in markdown.scan("a.md", "<!-- @won't a b -->", words)["declarations"]] == ["won't"]


def test_operations():
    doc = {"swagger": "2.0", "paths": {"/b": {"post": {}, "parameters": []}, "/a": {"get": {}, "additionalOperations": {"LINK": {}}}}}
    assert openapi.operations(doc) == [("GET", "/a"), ("LINK", "/a"), ("POST", "/b")]
    with pytest.raises(openapi.SourceError):
        openapi.operations({"paths": {"/a": {"get": {}, "additionalOperations": {"GET": {}}}}})
    for odd in ([], "x", {"/a": {"additionalOperations": [1]}}):
        with pytest.raises(openapi.SourceError):
            openapi.operations({"paths": odd})
    assert openapi.operations({"paths": {1: {"get": {}}, "/a": None}}) == [("GET", "1")] and openapi.operations({"paths": None}) == []
    paths = {"a": {"get": {}}, "/b c": {"get": {}}, "/c": {"additionalOperations": {"a b": {}, 1: {}}}}
    row = openapi.scan("s.json", lambda: json.dumps({"openapi": "3.1.0", "paths": paths}).encode())
    assert [p["code"] for p in row["problems"]] == ["swagger_bad_operation"] * 3 and [u["target"] for u in row["units"]] == ["1:/c"]
    assert [p["code"] for p in openapi.scan("s.json", lambda: b"{")["problems"]] == ["swagger_normalize"]


@pytest.mark.parametrize("data", [b"\xff", b"[1]", b'{"openapi": "4.0"}', b"{", b"x" * ((16 << 20) + 1)])
def test_descriptions_refused(data):
    with pytest.raises(openapi.SourceError):
        openapi.parse(data)


def test_yaml():
    pytest.importorskip("yaml")
    assert openapi.operations(openapi.parse(b"swagger: '2.0'\npaths:\n  /x:\n    get: {}\n")) == [("GET", "/x")]
