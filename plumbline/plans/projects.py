"""Queries that make the tables' rows into project files and run scanners and rules on them.

Every row gives a file, so the rules run over whole tables; the SQL says what
must come out.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import shared_folder
from plumbline.functions.text import redacted
from plumbline.plans.catalogue import _page_path, _query, _table
from plumbline.plans.graph import check_files, check_tree
from plumbline.plans.rules import documented, hints, singular
from plumbline.sources.inventory import flat, scan_markdown, scan_openapi, scan_typescript, spread, write_tree

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def _file(path: Column, text: Column) -> list[Column]:
    return [path.alias("path"), F.encode(text, "UTF-8").alias("content")]


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rows(spark: SparkSession, sf_dir: str, table: str, *columns: Column) -> DataFrame:
    """Narrow columns of a table, k first, as rows that files are made of."""
    return spread(_table(spark, sf_dir, table).select(*columns), "k")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "pages", F.col("page_id").cast("string").alias("k"), _page_path().alias("where"))


@_query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
wrong AS (
  SELECT 'missing' AS code, 'spec/' || page_id || '.md' AS path, 3 AS line FROM p WHERE path NOT LIKE 'en/%' AND path NOT LIKE 'fr/%'
  UNION ALL SELECT 'unresolved', 'ledger/' || page_id || '.md', 3 FROM p WHERE path LIKE '%.html'
  UNION ALL SELECT 'duplicate', 'ledger/' || page_id || '.md', 4 FROM p WHERE path LIKE 'fr/%')
SELECT code, path, line FROM wrong""")
def graph_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification and a ledger a page: pages in English cite a section, pages in French its file and the section again."""
    p = _pages(spark, sf_dir)
    spec = p.select(*_file(_say("spec/", F.col("k"), ".md"), _say("# Page ", F.col("k"), "\n\n## Details\n")))
    name = _say("spec/", F.col("k"), ".md")
    first = F.when(F.col("where").like("en/%"), _say("@cite ", name, "#details done\n")).when(F.col("where").like("fr/%"), _say("@citeExclude ", name, " later\n")).otherwise("\n")
    second = F.when(F.col("where").like("%.html"), _say("@cite ", name, "#gone done\n")).otherwise("\n")
    third = F.when(F.col("where").like("fr/%"), _say("@cite ./", name, "#details done\n")).otherwise("")
    ledger = p.select(*_file(_say("ledger/", F.col("k"), ".md"), _say("<!--\n", first, second, third, "-->\n")))
    claim = dict(type="markdown", files=["ledger/*.md"], reference=dict(type="markdown", files=["spec/**"], symbol="h2"))
    return check_files(spark, spec.unionByName(ledger), {"claims": [claim]}).diagnostics.select("code", "path", "line")


@_query("""
WITH t AS (SELECT p_partkey AS k, p_size, p_brand, p_type FROM part)
SELECT CASE WHEN p_type = 'PROMO' THEN 'unimported' WHEN p_type = 'SMALL' THEN 'unresolved_module' WHEN p_type = 'LARGE' THEN 'unreachable' ELSE 'unbraced' END AS code, 'src/u' || k || '.ts' AS path, 2 AS line
FROM t WHERE p_type IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM')
UNION ALL SELECT 'missing', 'api/m' || k || '.ts', 1 FROM t WHERE p_type IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM')""")
def import_scope_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module and a module that cites it for each part; the part's type says what is wrong with the citation."""
    p = _rows(spark, sf_dir, "part", F.col("p_partkey").cast("string").alias("k"), F.col("p_type").alias("t"))
    api = p.select(*_file(_say("api/m", F.col("k"), ".ts"), _say("export interface I", F.col("k"), " { size: number }\n")))
    source = F.when(F.col("t") == "SMALL", "../gone/m").otherwise("../api/m")
    imported = F.when(F.col("t") == "PROMO", "\n").otherwise(_say("import type { I", F.col("k"), ", Other } from '", source, F.col("k"), ".js';\n"))
    name = F.when(F.col("t") == "LARGE", "Other").otherwise(_say("I", F.col("k")))
    target = F.when(F.col("t") == "MEDIUM", name).otherwise(_say("{@link ", name, "}"))
    use = p.select(*_file(_say("src/u", F.col("k"), ".ts"), _say(imported, "/** @cite ", target, " used here */\nexport const use = 1;\n")))
    claim = dict(type="typescript", files=["src/**"], reference=dict(type="typescript", files=["api/**"]))
    return check_files(spark, api.unionByName(use), {"claims": [claim]}).diagnostics.select("code", "path", "line")


@_query("""
WITH d AS (SELECT doc_id, source, n_chars, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)
SELECT 'docs/' || doc_id || '.md' AS path, 'file' AS symbol, '' AS anchor, 1 AS line, '' AS parent FROM d
UNION ALL SELECT 'docs/' || doc_id || '.md', 'h1', source || '-of-' || doc_id, 1, 'file' FROM d
UNION ALL SELECT 'docs/' || doc_id || '.md', 'h3', 'length', n + 6, 'h1:1' FROM d
UNION ALL SELECT 'docs/' || doc_id || '.md', 'h2', 'n' || n_chars, n + 7, 'h1:1' FROM d""")
def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines around whole texts: a heading in a fence is none, a named anchor counts, a section's parent is the nearest open one."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "source", F.col("n_chars").cast("string").alias("n"), "text")
    text = _say("# ", F.upper("source"), " -- of ", F.col("k"), " #\n", F.col("text"), "\n```\n## fenced\n```\n### Length\n## Two words {#n", F.col("n"), "}\n##### five\n")
    units = flat(scan_markdown(d.select(*_file(_say("docs/", F.col("k"), ".md"), text))), "units")
    parent = F.coalesce(F.regexp_extract("parent_id", "\\.md:(.*)$", 1), F.lit(""))
    return units.select("path", "symbol", F.regexp_extract("target", "#(.*)$", 1).alias("anchor"), "line", parent.alias("parent"))


@_query("""
SELECT user_id::VARCHAR || '.json' AS source, upper(event_type) || ':/events/' || CAST(json_extract(props, '$.k') AS VARCHAR) AS target
FROM events GROUP BY ALL""")
def openapi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API description a user, with an operation for each kind of event and key."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k")).distinct()
    item = e.groupBy("user_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("summary"), F.lit("x"))))).alias("ops"))
    paths = item.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(_say("/events/", F.col("k")), F.struct(F.col("ops").alias("additionalOperations"))))).alias("paths"))
    document = F.to_json(F.struct(F.lit("3.2.0").alias("openapi"), F.col("paths")))
    units = flat(scan_openapi(paths.select(*_file(_say(F.col("user_id").cast("string"), ".json"), document))), "units")
    return units.select(F.col("path").alias("source"), "target")


@_query("""
WITH t AS (SELECT p_partkey AS k, p_type FROM part)
SELECT 'src/Part' || k || '.ts' AS path, CASE WHEN p_type = 'SMALL' THEN 2 ELSE 1 END AS line FROM t WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')""")
def singular_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a part: small ones declare two identities, large ones another, promoted ones a nameless default."""
    p = _rows(spark, sf_dir, "part", F.col("p_partkey").cast("string").alias("k"), F.col("p_type").alias("t"))
    own = _say("export class Part", F.col("k"), " { run() {} }\n")
    merged = _say(own, "export namespace Part", F.col("k"), " { export const x = 1 }\n")
    text = F.when(F.col("t") == "SMALL", _say(own, "export interface Extra {}\n")).when(F.col("t") == "LARGE", "export type Other = { a: 1 };\n").when(F.col("t") == "PROMO", "export default () => 1;\n").when(F.col("t") == "MEDIUM", 'export * from "./x";\n').otherwise(merged)
    return singular(p.select(*_file(_say("src/Part", F.col("k"), ".ts"), text))).select("path", "line")


@_query("""
WITH t AS (SELECT p_partkey AS k, p_type FROM part)
SELECT 'src/p' || k || '.ts' AS path, 2 AS line, 'no documentation of exported property ''IPart.size''' AS message FROM t
UNION ALL SELECT 'src/p' || k || '.ts', 4, CASE WHEN p_type = 'SMALL' THEN 'empty' ELSE 'no' END || ' documentation of exported function ''run''' FROM t WHERE p_type IN ('SMALL', 'LARGE')""")
def documented_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a part, whose function is documented, or by an empty block, or not at all."""
    p = _rows(spark, sf_dir, "part", F.col("p_partkey").cast("string").alias("k"), F.col("p_type").alias("t"))
    block = F.when(F.col("t") == "SMALL", "/** * */").when(F.col("t") == "LARGE", "// line").otherwise("/** Runs. */")
    text = _say("/** A part. */ export interface IPart {\n  size: number }\n", block, "\nexport const run = (): void => {};\nconst hidden = 1;\n")
    return documented(p.select(*_file(_say("src/p", F.col("k"), ".ts"), text))).select("path", "line", "message")


@_query("""
SELECT 'src/c' || c_custkey || '.ts' AS path, 'property' AS symbol, 'N.balance' AS target, 2 AS line FROM customer
UNION ALL SELECT 'src/c' || c_custkey || '.ts', 'type', 'N', 1 FROM customer
UNION ALL SELECT 'src/c' || c_custkey || '.ts', 'function', 'N.C.prototype.' || lower(c_mktsegment), 3 FROM customer""")
def typescript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a module a customer: a namespace with a value and a class."""
    c = _rows(spark, sf_dir, "customer", F.col("c_custkey").cast("string").alias("k"), F.lower("c_mktsegment").alias("m"))
    text = _say("export namespace N {\n  export const balance = `${ {a: '}'} }`;\n  export class C<T> { ", F.col("m"), "(x: T): { y: 1 } { return { y: 1 } } private no() {} get g() { return 1 } }\n  class Inner { m() {} }\n}\n")
    units = flat(scan_typescript(c.select(*_file(_say("src/c", F.col("k"), ".ts"), text)), parts=("units",)), "units")
    return units.select("path", "symbol", "target", "line")


@_query("""
SELECT 'pages/' || page_id || '.md' AS path, 'spec/' || page_id || '.md' AS target, 'h2' AS host, length(html) - length(replace(html, chr(10), '')) + 3 AS line, 'as said in' || chr(10) || 'two lines' AS reason FROM pages""")
def html_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in a comment behind whole pages: their line, and the heading above them."""
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("k"), "html")
    text = _say(F.col("html"), "\n## Notes\n<!-- @cite spec/", F.col("k"), ".md as said in\n two lines -->\n")
    found = flat(scan_markdown(p.select(*_file(_say("pages/", F.col("k"), ".md"), text))), "declarations")
    return found.select("path", "target", F.array_join("hosts", ",").alias("host"), "line", "reason")


@_query("""
SELECT 'src/d' || doc_id || '.ts' AS path, 'docs/' || doc_id || '.md' AS target, 'property' AS host, length(text) - length(replace(text, chr(10), '')) + 3 AS line, false AS is_link FROM documents
UNION ALL SELECT 'src/d' || doc_id || '.ts', 'D' || doc_id, 'type', length(text) - length(replace(text, chr(10), '')) + 6, true FROM documents""")
def block_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations at the end of documentation blocks that hold whole texts, and of one that is a link."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "text")
    text = _say("/**\n", F.col("text"), "\n@cite docs/", F.col("k"), ".md since it is there\n*/\nexport const { doc } = x;\n/** @cite {@link D", F.col("k"), "} by type */ export type T = D", F.col("k"), ";\n")
    found = flat(scan_typescript(d.select(*_file(_say("src/d", F.col("k"), ".ts"), text)), parts=("declarations",)), "declarations")
    return found.select("path", "target", F.array_join("hosts", ",").alias("host"), "line", "is_link")


_FORMS = {
    0: ("export declare namespace N.M { const z: number; function f(): void; interface I { p: 1 } }", [("type", "N"), ("type", "N.M"), ("property", "N.M.z"), ("function", "N.M.f"), ("type", "N.M.I"), ("property", "N.M.I.p")]),
    1: ("namespace N { export const v = 1; export type T = 1 }\nexport type { N as Renamed };", [("type", "Renamed"), ("type", "Renamed.T")]),
    2: ("export const { a, b: { c }, ...rest } = x, [d = 1, , e] = y;", [("property", n) for n in ("a", "c", "rest", "d", "e")]),
    3: ("export let f = () => {};\nexport declare const g: () => void;\nexport const h = (async (x) => x) as any;", [("property", "f"), ("property", "g"), ("function", "h")]),
    4: ("export class C { m() {} static s = () => {}; private p() {} n: () => void; o: string; accessor z = () => {}; constructor() {} 'two words'() {} #h() {} }", [("function", "C.prototype.m"), ("function", "C.s"), ("function", "C.prototype.n")]),
    5: ("export interface I { a: 1 }\nexport interface I { a: 1; b: 2 }\nexport function I() {}", [("type", "I"), ("property", "I.a"), ("property", "I.b"), ("function", "I")]),
    6: ("function a() {}\ninterface b {}\nexport { a as x, b as default, b };\nexport enum E { A }", [("function", "x"), ("type", "b")]),
    7: ("export type A<T> = { x: T };\nexport type B = { x: 1 } | null;\nexport type C = { [K in keyof A<1>]: 1 };", [("type", "A"), ("property", "A.x"), ("type", "B"), ("type", "C")]),
}


@_query(
    "WITH forms(form, symbol, target) AS (VALUES "
    + ", ".join(f"({k}, '{symbol}', '{target}')" for k, (_, units) in _FORMS.items() for symbol, target in units)
    + f""") SELECT 'src/p' || p_partkey || '.ts' AS path, symbol, target, 'typescript:src/p' || p_partkey || '.ts:' || symbol || ':' AS stem FROM part JOIN forms ON p_size % {len(_FORMS)} = form"""
)
def typescript_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of declaration, chosen by a part's size: ambient and merged ones, patterns, aliases, members."""
    p = _rows(spark, sf_dir, "part", F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") % len(_FORMS)).alias("form"))
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _FORMS.values()]), F.col("form") + 1)
    units = flat(scan_typescript(p.select(*_file(_say("src/p", F.col("k"), ".ts"), text)), parts=("units",)), "units")
    return units.select("path", "symbol", "target", F.regexp_extract("id", "^(.*?\\.ts:[a-z]+:)", 1).alias("stem"))


@_query("""
WITH p AS (SELECT page_id, page_id % 5 AS kind FROM pages)
SELECT CASE kind WHEN 0 THEN 'malformed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'out_of_scope' ELSE 'link_not_typescript' END AS code, 'ledger/' || page_id || '.md' AS path, CASE kind WHEN 2 THEN 1 ELSE 2 END AS line FROM p WHERE kind < 4
UNION ALL SELECT 'md_no_anchor', 'spec/' || page_id || '.md', NULL FROM p WHERE kind = 4
UNION ALL SELECT 'missing', 'spec/' || page_id || '.md', 1 FROM p WHERE kind < 4
UNION ALL SELECT 'missing', 'spec/' || page_id || '.md', 2 FROM p WHERE kind = 1""")
def citation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification and a ledger a page, with one thing wrong: no reason, two units of a name, a host that isn't selected, a link, no anchor."""
    p = _rows(spark, sf_dir, "pages", F.col("page_id").cast("string").alias("k"), (F.col("page_id") % 5).alias("kind"))
    name, kind = _say("spec/", F.col("k"), ".md"), F.col("kind")
    spec = p.select(*_file(name, F.when(kind == 1, "## Same\n## Same\n").when(kind == 4, "## ***\n").otherwise("## Same\n")))
    target = F.when(kind == 3, "{@link Same} it is").when(kind == 0, _say(name, "#same")).otherwise(_say(name, "#same it is"))
    cited = F.when(kind == 4, "text").otherwise(_say("<!-- @cite ", target, " -->"))
    ledger = p.select(*_file(_say("ledger/", F.col("k"), ".md"), _say(F.when(kind == 2, "").otherwise("# Ledger\n"), cited, "\n")))
    claim = dict(type="markdown", files=["ledger/*.md"], symbol="h1", reference=dict(type="markdown", files=["spec/**"], symbol="h2"))
    return check_files(spark, spec.unionByName(ledger), {"claims": [claim]}).diagnostics.select("code", "path", "line")


def _description(address: str) -> bytes:
    """What a supplier's description says: sound, in JSON or YAML, with a bad operation, of an unknown version, no object, or none at all."""
    k = int(re.search(r"/s(\d+)", address)[1])
    path = f"/s/{k}"
    if k % 6 == 5:
        raise RuntimeError("no answer")
    if k % 6 == 4:
        return b"[1]"
    if k % 6 == 3:
        return b"openapi: '4.0'\npaths: {}\n"
    if k % 6 == 2:
        return json.dumps({"openapi": "3.2.0", "paths": {path: {"get": {}}, "nowhere": {"get": {}}}}).encode()
    if k % 6 == 1:
        return f"swagger: '2.0'\npaths:\n  {path}:\n    get: {{}}\n    parameters: []\n".encode()
    return json.dumps({"openapi": "3.1.0", "paths": {path: {"get": {}, "x-note": {}}}}).encode()


@_query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS kind FROM supplier),
found AS (
  SELECT k, 'unit' AS what, 'GET:/s/' || k AS target FROM s WHERE kind < 3
  UNION ALL SELECT k, 'swagger_bad_operation', '' FROM s WHERE kind = 2
  UNION ALL SELECT k, 'swagger_normalize', '' FROM s WHERE kind IN (3, 4)
  UNION ALL SELECT k, 'swagger_bridge', '' FROM s WHERE kind = 5)
SELECT 'https://***@api.test/s' || k || '?<redacted>' AS source, what, target FROM found""")
def openapi_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote description a supplier, fetched by a function in place of the network."""
    k = _rows(spark, sf_dir, "supplier", F.col("s_suppkey").cast("string").alias("k"))
    asked = k.select(_say("https://me:secret@api.test/s", F.col("k"), "?key=1").alias("path"), F.lit(None).cast("binary").alias("content"))
    scan = scan_openapi(asked, _description)
    units = flat(scan, "units").select(F.col("path").alias("source"), F.lit("unit").alias("what"), "target")
    return units.unionByName(flat(scan, "problems").select(redacted(F.col("file")).alias("source"), F.col("code").alias("what"), F.lit("").alias("target")))


@_query("""
WITH s AS (SELECT n_nationkey AS k, n_regionkey = 0 AS aliased, n_nationkey % 3 = 0 AS cited FROM nation)
SELECT 'unit' AS what, 'S' || k AS target, CASE WHEN aliased THEN 'Also' || k ELSE '' END AS aliases FROM s
UNION ALL SELECT 'missing', 'S' || k, '' FROM s WHERE NOT cited""")
def entry_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an entry module exports from a module a nation, some under a second name, and what two thirds of the nations leave uncited."""
    s = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), (F.col("n_regionkey") == 0).alias("aliased"), (F.col("n_nationkey") % 3 == 0).alias("cited"))
    line = F.when(F.col("aliased"), _say("export { S", F.col("k"), " as Also", F.col("k"), " } from './s", F.col("k"), "';\n")).otherwise("")
    line = _say(line, "export * from './s", F.col("k"), ".js';\n")
    index = s.agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("t")).select(*_file(F.lit("api/index.ts"), F.col("t")))
    api = s.select(*_file(_say("api/s", F.col("k"), ".ts"), _say("export interface S", F.col("k"), " {}\ninterface Hidden {}\n")))
    use = s.filter("cited").select(*_file(_say("src/u", F.col("k"), ".ts"), _say("import type { S", F.col("k"), " as Own } from '../api';\n/** @cite {@link Own} used */\nexport const u = 1;\n")))
    rest = s.filter("not cited").select(*_file(_say("src/u", F.col("k"), ".ts"), F.lit("export const u = 1;\n")))
    claim = dict(type="typescript", files=["src/**"], reference=dict(type="typescript", file="api/index"))
    g = check_files(spark, index.unionByName(api).unionByName(use).unionByName(rest), {"claims": [claim]})
    units = g.reference_units.select(F.lit("unit").alias("what"), "target", F.array_join("aliases", ",").alias("aliases"))
    return units.unionByName(g.missing.select(F.lit("missing").alias("what"), "target", F.lit("").alias("aliases")))


@_query("""
SELECT 0 AS ref, 'N' || n_nationkey AS target FROM nation UNION ALL SELECT 1, 'N' || n_nationkey FROM nation WHERE n_regionkey < 2
UNION ALL SELECT 2, '' FROM (SELECT 1)""")
def package_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an installed package: what its manifest's entry exports, what patterns select; and a package that isn't there."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_regionkey").cast("string").alias("r"))
    lib = n.select(*_file(_say("node_modules/@geo/nations/lib/r", F.col("r"), "/n", F.col("k"), ".d.ts"), _say("export interface N", F.col("k"), " { size: number }\n")))
    index = n.agg(F.array_join(F.array_sort(F.collect_list(_say("export * from './r", F.col("r"), "/n", F.col("k"), "';\n"))), "").alias("t"))
    one = spark.range(1)
    manifest = json.dumps({"exports": {".": {"import": {"types": "./lib/index.d.ts"}}}})
    files = lib.unionByName(index.select(*_file(F.lit("node_modules/@geo/nations/lib/index.d.ts"), F.col("t"))))
    files = files.unionByName(one.select(*_file(F.lit("node_modules/@geo/nations/package.json"), F.lit(manifest)))).unionByName(one.select(*_file(F.lit("src/a.ts"), F.lit("export const a = 1;\n"))))
    package = dict(type="typescript", package="@geo/nations")
    claim = dict(type="typescript", files=["src/**"], reference=[package, package | {"files": ["lib/r0/**", "lib/r1/*.d.ts"]}, dict(type="typescript", package="gone")])
    g = check_files(spark, files, {"claims": [claim]})
    lost = g.diagnostics.filter("code = 'package_entry_missing'").select(F.col("ref_idx").alias("ref"), F.lit("").alias("target"))
    return g.missing.select(F.col("ref_idx").alias("ref"), "target").unionByName(lost)


@_query("""
WITH units AS (
  SELECT 0 AS rank, 'spec/' || n_nationkey || '.md' AS path, 1 AS line, 'spec/' || n_nationkey || '.md#' || lower(replace(n_name, ' ', '-')) AS target FROM nation
  UNION ALL SELECT 1, 'spec/' || n_nationkey || '.md', 1, 'spec/' || n_nationkey || '.md' FROM nation),
ranked AS (SELECT row_number() OVER (ORDER BY rank, path, line) AS ord, target FROM units)
SELECT ord, after, target AS insert FROM ranked, (VALUES ('@done '), ('@left ')) t(after)""")
def project_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completion offers in a project without problems, whose tags have names of their own."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    spec = n.select(*_file(_say("spec/", F.col("k"), ".md"), _say("# ", F.col("name"), "\n")))
    tag = F.when(F.col("r") == 0, "@left ").otherwise("@done ")
    ledger = n.select(*_file(_say("ledger/", F.col("k"), ".md"), _say("<!-- ", tag, "spec/", F.col("k"), ".md whole -->\n")))
    claim = dict(type="markdown", files=["ledger/*.md"], reference=dict(type="markdown", files=["spec/**"], symbol=["file", "h1"]))
    g = check_files(spark, spec.unionByName(ledger), {"claims": [claim]}, words=("done", "left"))
    return hints(spark, g).select("ord", "after", "insert")


@_query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages WHERE page_id IS NOT NULL)
SELECT 'missing' AS code, 'spec/s' || page_id || '.md' AS path, 3 AS line FROM p WHERE path NOT LIKE 'en/%'""")
def tree_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph rule over a folder of files, of which only what is asked for is listed."""
    p = _pages(spark, sf_dir).filter("k is not null")
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    spec = p.select(*_file(_say("spec/s", F.col("k"), ".md"), _say("# Page ", F.col("k"), "\n\n## Details\n")))
    cited = F.when(F.col("where").like("en/%"), _say("<!-- @cite spec/s", F.col("k"), ".md#details read -->\n")).otherwise("nothing\n")
    ledger = p.select(*_file(_say("ledger/l", F.col("k"), ".md"), cited))
    other = p.select(*_file(_say("other/o", F.col("k"), ".md"), F.lit("## Never read\n")))
    write_tree(spec.unionByName(ledger).unionByName(other), root)
    claim = dict(type="markdown", files=["ledger/*.md"], reference=dict(type="markdown", files=["spec/**"], symbol="h2"))
    return check_tree(spark, root, {"claims": [claim]}).diagnostics.select("code", "path", "line")
