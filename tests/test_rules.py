"""File rules, text functions and the query catalogue."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.operators import closure, coverage, resolve
from plumbline.plans import catalogue, rules
from plumbline.plans.rules import documented, singular
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def files(spark, **texts):
    return spark.createDataFrame([(p.replace("__", "/") + ".ts", bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")


def test_singular(spark):
    rows = singular(
        files(
            spark,
            Good="export class Good {}\nexport namespace Good { export const x = 1 }",
            two="export const a = 1, b = 2;",
            other="export interface IThing {}",
            index="export interface IThing {}",
            nameless="export default () => 1;",
            barrel='export * from "./Good"; import { x } from "y"; export { x };',
            alias="function f() {}\nexport { f as alias, f as second };",
            assigned="const assigned = 1;\nexport = assigned;",
            empty="",
            nested__button="export class Button {}",
        )
    ).collect()
    assert {r.path: (r.line, r.message.split()[0]) for r in rows} == {"two.ts": (1, "one"), "other.ts": (1, "the"), "nameless.ts": (1, "the"), "nested/button.ts": (1, "the")}


def test_documented(spark):
    text = "/** says */\nexport interface A { x: 1 }\n/** */\nexport type B = 1;\n// no\nexport const c = 1, d = 2;\n/** f */\nexport function f(): void;\nexport function f(x?: 1) {}\nexport class K { /** m */ m() {} n() {} }\ninterface hidden {}\n"
    rows = documented(files(spark, a=text)).collect()
    assert sorted((r.line, r.message) for r in rows) == [
        (2, "no documentation of exported property 'A.x'"),
        (4, "empty documentation of exported type 'B'"),
        (6, "no documentation of exported property 'c', 'd'"),
        (10, "no documentation of exported function 'K.prototype.n'"),
    ]
    assert documented(files(spark, a=text), {"symbol": "type"}).count() == 1


def test_closure_of_deep_chain_and_cycle(spark):
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(14)] + [("x", "y"), ("y", "x")], "id string, parent_id string")
    got = closure.ancestor_closure(chain).filter("id = '13'").count()
    assert got == 14
    assert closure.ancestor_closure(chain).filter("id = 'x'").select("scope_id").distinct().count() == 2


def test_first_of_is_stable_under_order(spark):
    rows = [(1, "b", 2), (1, "a", 3), (1, "a", 1), (2, "c", 9)]
    for order in (rows, rows[::-1]):
        got = coverage.ranked(spark.createDataFrame(order, "u int, path string, seq int").repartition(3), ["u"], ["path", "seq"]).filter("kind = 'first'").collect()
        assert {(r.u, r.path, r.seq) for r in got} == {(1, "a", 1), (2, "c", 9)}


def test_catalogue_has_sql_for_every_query():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and len(catalogue.queries()) >= 27


@pytest.mark.parametrize("name", ["missing_ack_by_claim", "target_cardinality", "ordered_globs", "prefix_containment", "scope_cascade_coverage", "nearest_heading_host", "alias_canonical", "ranked_hints", "graph_rule", "markdown_scan", "openapi_scan", "singular_rule", "documented_rule", "typescript_scan"])
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["claim", "unit", "name"]
    assert "missing_ack_by_claim" in entry.queries()


def test_hint_order_spans_partitions(spark):
    rows = spark.range(1000).select(F.format_string("%04d", F.col("id")).alias("target"), F.lit(0).alias("rank")).repartition(7)
    got = rules.in_order(rows, "rank", "target").select("ord", "target").collect()
    assert all(int(r.target) == r.ord for r in got)


def test_closure_of_any_depth_and_of_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(150)] + [(200 + k, 200 + (k + 1) % 5) for k in range(5)] + [(300, 999), (301, 301)]
    got = {(r.id, r.scope_id): r.depth for r in closure.ancestor_closure(spark.createDataFrame(chain, "id int, parent_id int")).collect()}
    want = {(a, b): a - b for a in range(150) for b in range(a + 1)}
    want |= {(200 + a, 200 + (a + d) % 5): d for a in range(5) for d in range(5)} | {(300, 300): 0, (301, 301): 0}
    assert got == want


def test_reachability_has_no_limit(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 0)], "src int, dst int")
    got = {r.node: r.depth for r in closure.least_distances(edges, spark.createDataFrame([(3,)], "start int")).collect()}
    assert got == {(3 + d) % 31: d for d in range(31)}


def test_completeness(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "source string")
    got = resolve.completeness(asked, spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "source string"), "source")
    assert {r.source: r.status for r in got.collect()} == {"a": "one", "b": "repeated", "c": "no result", "x": "not configured"}
