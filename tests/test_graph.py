"""The graph rule on small projects."""

import json

import pytest

from plumbline.config import ConfigError
from plumbline.plans.graph import check_files, check_tree, report
from plumbline.plans.rules import hints

SPEC = "# Orders\n\n## Place\n\ntext\n\n### Retry\n\n## Cancel\n"


def graph(spark, files, claims, **kw):
    rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    return check_files(spark, rows, {"claims": claims}, **kw)


def codes(g):
    return sorted((r.code, r.claim_idx, r.ref_idx) for r in g.diagnostics.collect())


def md_claim(symbol=None, ref_symbol=("h2", "h3"), **more):
    reference = dict(type="markdown", files=["spec/**"], symbol=list(ref_symbol))
    return dict(type="markdown", files=["ledger/*.md"], reference=reference, **({"symbol": symbol} if symbol else {}), **more)


def test_one_missing_unit(spark):
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @cite spec/a.md#place done -->"}, [md_claim()])
    assert [r.unit_id for r in g.missing.collect()] == ["markdown:spec/a.md:h2:9"]
    assert codes(g) == [("missing", 0, 0)]
    assert "spec/a.md#cancel" in report(g).first().message


def test_ancestor_covers_descendants_and_not_the_reverse(spark):
    whole = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @citeExclude spec/a.md later -->"}, [md_claim()])
    assert codes(whole) == []
    child = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @cite ./spec/a.md#retry done -->"}, [md_claim()])
    assert sorted(r.unit_id for r in child.missing.collect()) == ["markdown:spec/a.md:h2:3", "markdown:spec/a.md:h2:9"]


def test_failures_are_told_apart(spark):
    ledger = "<!--\n@cite spec/a.md#place\n@cite spec/a.md#nowhere because\n@cite spec/a.md all\n@cite spec/a.md#place again\n-->\n"
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": ledger}, [md_claim()])
    assert codes(g) == [("duplicate", 0, 0), ("malformed", None, None), ("unresolved", None, None)]


def test_duplicate_anchor_is_ambiguous(spark):
    g = graph(spark, {"spec/a.md": "## Same\n## Same\n", "ledger/l.md": "<!-- @cite spec/a.md#same x -->"}, [md_claim()])
    assert [c for c, *_ in codes(g)] == ["ambiguous", "missing", "missing"]


def test_out_of_scope_host(spark):
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "## H\n<!-- @cite spec/a.md x -->"}, [md_claim(symbol="h3")])
    assert [c for c, *_ in codes(g)] == ["missing"] * 3 + ["out_of_scope"]


def test_claims_and_references_never_pool(spark):
    other = md_claim() | {"files": ["other/*.md"]}
    two = md_claim() | {"reference": [dict(type="markdown", files=["spec/**"], symbol="h3"), dict(type="markdown", files=["spec/**"], symbol="h2")]}
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @cite spec/a.md#retry x -->", "other/o.md": "text"}, [two, other])
    assert codes(g) == [("missing", 0, 1), ("missing", 0, 1), ("missing", 1, 0), ("missing", 1, 0), ("missing", 1, 0)]


def test_partition_of_selected_units(spark):
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @cite spec/a.md#place x -->"}, [md_claim()])
    selected = {r.id for r in g.reference_units.collect()}
    acknowledged = {r.unit_id for r in g.acknowledged.collect()}
    missing = {r.unit_id for r in g.missing.collect()}
    assert selected == acknowledged | missing and not acknowledged & missing


def test_empty_populations(spark):
    g = graph(spark, {"spec/a.md": "text"}, [md_claim()])
    assert codes(g) == [("claim_no_files", 0, None), ("ref_no_units", 0, 0)]
    g = graph(spark, {"ledger/l.md": "text"}, [md_claim()])
    assert codes(g) == [("ref_no_files", 0, 0)]


def test_blank_in_path_and_empty_anchor(spark):
    g = graph(spark, {"spec/a b.md": SPEC, "spec/c.md": "## ***\n", "ledger/l.md": ""}, [md_claim()])
    assert [c for c, *_ in codes(g)] == ["md_no_anchor", "md_path_whitespace"]


API = json.dumps(dict(openapi="3.1.0", paths={"/members": dict(get={}, post={}), "/a": dict(additionalOperations=dict(copy={}))}))


def test_operations(spark):
    claim = dict(type="markdown", files=["l.md"], reference=dict(type="swagger", file="api.json"))
    g = graph(spark, {"api.json": API, "l.md": "<!-- @cite POST:/members x -->"}, [claim])
    assert sorted(r.unit_id for r in g.missing.collect()) == ["swagger:api.json:COPY:/a", "swagger:api.json:GET:/members"]
    old = graph(spark, {"api.json": API.replace("3.1.0", "1.2"), "l.md": ""}, [claim])
    assert codes(old) == [("swagger_normalize", None, None)]
    none = graph(spark, {"l.md": ""}, [claim])
    assert codes(none) == [("swagger_normalize", None, None)]
    remote = claim | {"reference": dict(type="swagger", file="https://me:secret@x.test/api?key=1")}
    g = graph(spark, {"l.md": ""}, [remote], fetch=lambda _: API.encode())
    assert len(codes(g)) == 3 and all("secret" not in r.message and "key" not in r.message for r in g.diagnostics.collect())


TS_REF = dict(type="typescript", files=["api/**"], symbol=["type", "function"])
API_TS = "export interface ISale { price: number }\nexport function get(): void {}\n"


def ts_claim(**reference):
    return dict(type="typescript", files=["src/**"], reference=TS_REF | reference)


def cite(*targets, imports='import type { ISale, get } from "../api/sale";'):
    return imports + "".join(f"\n/** @cite {t} why */\nexport const c{k} = 1;" for k, t in enumerate(targets))


def test_links_resolve_through_imports(spark):
    g = graph(spark, {"api/sale.ts": API_TS, "src/a.ts": cite("{@link ISale}", "{@link get}")}, [ts_claim()])
    assert codes(g) == []
    ns = cite("{@link api.ISale}", "{@link api.get}", imports='import * as api from "../api/sale.js";')
    assert codes(graph(spark, {"api/sale.ts": API_TS, "src/a.ts": ns}, [ts_claim()])) == []


@pytest.mark.parametrize(
    ("target", "imports", "code"),
    [
        ("{@link ISale}", "", "unimported"),
        ("{@link ISale}", 'import { ISale } from "./gone";', "unresolved_module"),
        ("{@link api}", 'import * as api from "../api/sale";', "incomplete"),
        ("{@link api.Nope}", 'import * as api from "../api/sale";', "unreachable"),
        ("ISale", 'import { ISale } from "../api/sale";', "unbraced"),
        ("IGone", "", "unresolved"),
    ],
)
def test_each_step_has_its_own_failure(spark, target, imports, code):
    g = graph(spark, {"api/sale.ts": API_TS, "src/a.ts": cite(target, imports=imports)}, [ts_claim(symbol="type")])
    assert sorted(c for c, *_ in codes(g)) == sorted([code, "missing"])


def test_link_in_markdown_and_two_kinds_of_one_name(spark):
    claim = dict(type="markdown", files=["l.md"], reference=TS_REF | dict(symbol="type"))
    g = graph(spark, {"api/sale.ts": API_TS, "l.md": "<!-- @cite {@link ISale} x -->\n<!-- @cite ISale x -->"}, [claim])
    assert [c for c, *_ in codes(g)] == ["link_not_typescript"]
    both = "export interface X {}\nexport function X() {}\n"
    g = graph(spark, {"api/sale.ts": both, "src/a.ts": cite("{@link X}", imports='import { X } from "../api/sale";')}, [ts_claim()])
    assert [c for c, *_ in codes(g)] == ["ambiguous_in_module", "missing", "missing"]


def test_entry_population(spark):
    files = {
        "api/index.ts": 'export * from "./a";\nexport * as ns from "./b";\nexport { Deep as Renamed } from "./a";\n',
        "api/a.ts": 'export interface Deep { x: number }\nexport * from "./index";\n',
        "api/b.ts": "export type B = { y: string };\nexport interface Hidden {}\n",
        "api/alone.ts": "export interface Unreached {}\n",
        "src/a.ts": "export const x = 1;\n",
    }
    claim = dict(type="typescript", files=["src/**"], reference=dict(type="typescript", file="api/index", symbol=["type", "property"]))
    g = graph(spark, files, [claim])
    units = {r.target: sorted(r.aliases) for r in g.reference_units.collect()}
    assert units == {"Deep": ["Renamed"], "Deep.x": ["Renamed.x"], "ns.B": [], "ns.B.y": [], "ns.Hidden": []}
    used = files | {"src/a.ts": cite("{@link Renamed}", "{@link ns}", "{@link ns.B}", "{@link ns.Hidden}", imports='import { Renamed, ns } from "../api";')}
    g = graph(spark, used, [claim])
    assert [c for c, *_ in codes(g)] == ["unreachable"]
    lost = graph(spark, files, [claim | {"reference": dict(type="typescript", file="api/gone")}])
    assert codes(lost) == [("entry_missing", 0, 0)]


def test_package_population(spark):
    files = {
        "node_modules/@x/sdk/package.json": json.dumps(dict(exports={".": {"import": dict(types="./lib/index.d.ts")}})),
        "node_modules/@x/sdk/lib/index.d.ts": 'export * from "./api/sale";\n',
        "node_modules/@x/sdk/lib/api/sale.d.ts": "export interface ISale { price: number }\nexport interface IOther {}\n",
        "node_modules/@x/sdk/node_modules/y/i.d.ts": "export interface Nested {}\n",
        "src/a.ts": cite("{@link ISale}", imports='import type { ISale } from "@x/sdk";'),
    }
    by_entry = dict(type="typescript", files=["src/**"], reference=dict(type="typescript", package="@x/sdk"))
    g = graph(spark, files, [by_entry])
    assert [(r.code, r.message.split("'")[1]) for r in g.diagnostics.collect()] == [("missing", "IOther")]
    by_glob = by_entry | {"reference": dict(type="typescript", package="@x/sdk", files=["lib/**"])}
    g = graph(spark, files, [by_glob])
    assert sorted(r.target for r in g.reference_units.collect()) == ["IOther", "ISale"]
    none = by_entry | {"reference": dict(type="typescript", package="@x/sdk", files=["dist/**"])}
    assert ("package_no_files", 0, 0) in codes(graph(spark, files, [none]))


def test_config_errors_stop_the_check(spark):
    with pytest.raises(ConfigError):
        graph(spark, {}, [])


def test_tree_and_hints(spark, tmp_path):
    for name, text in {"spec/a.md": SPEC, "ledger/l.md": "<!-- @cite spec/a.md all -->", "ignored/x.md": "## Never read"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    g = check_tree(spark, str(tmp_path), {"claims": [md_claim(ref_symbol=("file", "h2"))]})
    assert codes(g) == []
    got = [(r.ord, r.after, r.insert) for r in hints(spark, g).orderBy("after", "ord").collect()]
    assert [x[2] for x in got[:3]] == ["spec/a.md#place", "spec/a.md#cancel", "spec/a.md"] and len(got) == 6
    (tmp_path / "spec/a.md").write_text(SPEC.replace("Place", "Buy"))
    (tmp_path / "ledger/l.md").write_text("<!-- @cite spec/a.md#place x -->")
    again = check_tree(spark, str(tmp_path), {"claims": [md_claim()]})
    assert [c for c, *_ in codes(again)] == ["missing"] * 3 + ["unresolved"]
    assert hints(spark, again).count() == 0


def test_root_that_is_missing_or_no_folder(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    for name, code in (("gone", "root_unresolved"), ("file", "root_unreadable")):
        g = check_tree(spark, str(tmp_path / name), {"claims": [md_claim()]})
        assert codes(g) == [(code, None, None)] and name in report(g).first().message


def test_unreadable_files_are_diagnostics(spark):
    rows = [("spec/a.md", bytearray(SPEC.encode())), ("spec/bad.md", bytearray(b"\xff\xfe")), ("other/bad.md", bytearray(b"\xff")), ("ledger/l.md", bytearray(b"<!-- @cite spec/a.md all -->"))]
    g = check_files(spark, spark.createDataFrame(rows, "path string, content binary"), {"claims": [md_claim()]})
    assert [(r.code, r.path) for r in g.diagnostics.collect()] == [("md_unreadable", "spec/bad.md")]


def test_a_source_that_is_there_twice(spark):
    claim = dict(type="markdown", files=["l.md"], reference=dict(type="swagger", file="api.json"))
    rows = [("api.json", bytearray(API.encode()))] * 2 + [("l.md", bytearray(b"<!-- @cite GET:/members x -->"))]
    g = check_files(spark, spark.createDataFrame(rows, "path string, content binary"), {"claims": [claim]})
    assert "swagger_repeated" in {r.code for r in g.diagnostics.collect()}


def test_tag_names_of_a_project(spark):
    g = graph(spark, {"spec/a.md": SPEC, "ledger/l.md": "<!-- @done spec/a.md#place x -->\n<!-- @cite spec/a.md#cancel x -->"}, [md_claim(ref_symbol=("h2",))], words=("done", "left"))
    assert codes(g) == [("missing", 0, 0)] and "'@done spec/a.md#cancel <reason>', or '@left" in report(g).first().message


def test_long_chain_of_barrels(spark):
    n = 12
    files = {f"api/b{k}.ts": f'export * from "./b{k + 1}";\n' for k in range(n)} | {f"api/b{n}.ts": "export interface Deep {}\n", "src/a.ts": cite("{@link Deep}", imports='import { Deep } from "../api/b0";')}
    g = graph(spark, files, [dict(type="typescript", files=["src/**"], reference=dict(type="typescript", file="api/b0"))])
    assert codes(g) == [] and [r.target for r in g.reference_units.collect()] == ["Deep"]
