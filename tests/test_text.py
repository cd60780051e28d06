"""Text functions as columns agree with the scanners' own."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.sources import markdown, openapi, tags, typescript


def values(spark, inputs, f, schema="x string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, {schema}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_slugs(spark):
    titles = ["Hello, World", "  A --  b ", "Déjà vu_x", "***", "a b", "-x-", "한국어 제목", "x\u0085y", "Ünï 9½"]
    assert values(spark, titles, T.slug) == [markdown.slug(t) for t in titles]
    assert values(spark, ["A {#b.c}", "A {#}", "A {#b} c"], T.anchor) == ["b.c", "a", "a-b-c"]


def test_tags(spark):
    plain = ["a  b c ", " a", "a\nb", "a"]
    got = zip(values(spark, plain, T.tag_target), values(spark, plain, T.tag_reason))
    assert list(got) == [(t, r) for t, _, r in map(tags.body_of, plain)]


def test_addresses(spark):
    sources = ["https://me:pw@h.test/a?k=v#f", "http://h/x", "docs/a?b.json", "https://h?q"]
    assert values(spark, [s for s in sources if "://" in s], T.redacted) == [openapi.shown(s) for s in sources if "://" in s]
    assert openapi.shown("docs/a?b.json") == "docs/a?b.json"
    parts = [["Service", "prototype", "run"], ["é"], ["a.b", "c"]]
    assert values(spark, parts, T.encoded_identity, "x array<string>") == [typescript.identity_id("", "", p).removeprefix("typescript:::") for p in parts]
    assert values(spark, ["./a", "././b\\c", "../d", "e"], T.plain_path) == ["a", "b/c", "../d", "e"]
    assert values(spark, ["@a/b/c/d", "x", "x/y"], T.package_name) == ["@a/b", "x", "x"]
    assert values(spark, ["a/foo.test.ts", "b", "c/.d"], T.base_name)[:2] == ["foo.test", "b"]
    assert values(spark, ["A.TS", "a.d.ts", "a.js", "x.mts"], T.is_module) == [True, True, False, True]
