"""The operators' queries on star-schema, event and text tables, each with its SQL.

The tables stand in for the relations of a project: regions, nations and their
suppliers and customers are a hierarchy of units, customers of a market segment
acknowledge nations, pages are files with addresses.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.globs import GlobSet, glob_table, members
from plumbline.operators import closure, coverage, resolve
from plumbline.plans.rules import offers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    importlib.import_module("plumbline.plans.projects")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module("plumbline.plans.projects")
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A customer with more on the account acknowledges what it is asked for.
ACK_BALANCE = 9000


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim, unit, decl): customers acknowledging their nation for their segment."""
    c = _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > ACK_BALANCE)
    return c.select(F.col("c_mktsegment").alias("claim"), F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("decl"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("claim")).distinct()


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id): regions, nations, suppliers and customers."""
    r = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"))
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(s).unionByName(c)


_GEOGRAPHY_SQL = """units AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


@_query(f"""
WITH RECURSIVE {_GEOGRAPHY_SQL},
walk AS (
  SELECT id, id AS scope_id, parent_id AS up, 0 AS depth FROM units
  UNION ALL SELECT w.id, u.id, u.parent_id, w.depth + 1 FROM walk w JOIN units u ON u.id = w.up)
SELECT id, scope_id, depth FROM walk""")
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its ancestors."""
    return closure.ancestor_closure(_geography(spark, sf_dir))


@_query("""
WITH line AS (SELECT o_custkey AS c, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT a.id, b.id AS scope_id, a.k - b.k AS depth FROM line a JOIN line b ON a.c = b.c AND b.k <= a.k""")
def deep_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below the same customer's order before them: chains of any depth."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    before = F.lag("id").over(W.partitionBy("o_custkey").orderBy("id"))
    return closure.ancestor_closure(o.select("id", before.alias("parent_id")))


@_query("""
SELECT claim, n_nationkey AS unit, n_name AS name
FROM (SELECT DISTINCT c_mktsegment AS claim FROM customer), nation
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal > 9000 AND c.c_mktsegment = claim AND c.c_nationkey = n_nationkey)""")
def missing_ack_by_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that no customer of a segment acknowledges."""
    units = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"))
    selected = _claims(spark, sf_dir).crossJoin(units)
    return coverage.missing(selected, _acks(spark, sf_dir), ["claim", "unit"]).select("claim", "unit", "name")


@_query("""
WITH claims AS (SELECT DISTINCT c_mktsegment AS claim FROM customer),
selected AS (
  SELECT claim, 0 AS ref, 'n' || n_nationkey AS unit FROM claims, nation
  UNION ALL SELECT claim, 1, p_brand || '/' || p_size FROM claims, (SELECT DISTINCT p_brand, p_size FROM part)),
acks AS (
  SELECT c_mktsegment AS claim, 0 AS ref, 'n' || c_nationkey AS unit FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT c_mktsegment, 1, p_brand || '/' || p_size FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 9000)
SELECT claim, ref, unit FROM selected s WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.claim = s.claim AND a.ref = s.ref AND a.unit = s.unit)""")
def independent_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two populations of a claim, each judged alone: nations, and brands by size."""
    claims = _claims(spark, sf_dir)
    nations = _table(spark, sf_dir, "nation").select(F.lit(0).alias("ref"), F.concat(F.lit("n"), "n_nationkey").alias("unit"))
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("unit"))
    selected = claims.crossJoin(nations.unionByName(part.select(F.lit(1).alias("ref"), "unit").distinct()))
    acks = _acks(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("decl"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    by_brand = acks.select("claim", "decl").join(orders, "decl").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("claim", F.lit(1).alias("ref"), "unit").distinct()
    both = acks.select("claim", F.lit(0).alias("ref"), F.concat(F.lit("n"), "unit").alias("unit")).unionByName(by_brand)
    return coverage.missing(selected, both, ["claim", "ref", "unit"])


@_query("""
WITH scopes AS (
  SELECT 'n' || n_nationkey AS scope_id, n_nationkey AS unit FROM nation
  UNION ALL SELECT 'r' || n_regionkey, n_nationkey FROM nation),
resolved AS (
  SELECT c_mktsegment AS claim, c_custkey AS decl, CASE WHEN c_acctbal > 9990 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS scope_id
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000),
cover AS (SELECT claim, unit, min(decl) AS first_decl, count(*) AS n FROM resolved JOIN scopes USING (scope_id) GROUP BY ALL),
selected AS (SELECT claim, n_nationkey AS unit FROM (SELECT DISTINCT c_mktsegment AS claim FROM customer), nation)
SELECT claim, unit, coalesce(n, 0) AS n, first_decl, CASE WHEN n IS NULL THEN 'missing' ELSE 'covered' END AS status FROM selected LEFT JOIN cover USING (claim, unit)""")
def scope_cascade_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acknowledgement of a region covers its nations, one of a nation covers it alone."""
    nation = _table(spark, sf_dir, "nation")
    places = _geography(spark, sf_dir).filter("id like 'r%' or id like 'n%'")
    scopes = closure.ancestor_closure(places).filter("id like 'n%'").select("scope_id", F.substring("id", 2, 9).cast("int").alias("unit"))
    c = _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > ACK_BALANCE).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    scope = F.when(F.col("c_acctbal") > 9990, F.concat(F.lit("r"), "n_regionkey")).otherwise(F.concat(F.lit("n"), "n_nationkey"))
    resolved = c.select(F.col("c_mktsegment").alias("claim"), F.col("c_custkey").alias("decl"), scope.alias("scope_id"))
    cover = coverage.expand(resolved, scopes, ["scope_id"]).groupBy("claim", "unit").agg(F.min("decl").alias("first_decl"), F.count("*").alias("n"))
    selected = _claims(spark, sf_dir).crossJoin(nation.select(F.col("n_nationkey").alias("unit")))
    joined = selected.join(cover, ["claim", "unit"], "left")
    return joined.select("claim", "unit", F.coalesce("n", F.lit(0)).alias("n"), "first_decl", F.when(F.col("n").isNull(), "missing").otherwise("covered").alias("status"))


@_query("""
SELECT c_mktsegment AS claim, c_nationkey AS unit, c_custkey AS decl, first_value(c_custkey) OVER w AS first_decl,
  CASE WHEN row_number() OVER w = 1 THEN 'first' ELSE 'overlap' END AS kind
FROM customer WHERE c_acctbal > 9000 WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey)""")
def first_ack_and_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first acknowledgement of a unit counts, later ones overlap it."""
    return coverage.ranked(_acks(spark, sf_dir), ["claim", "unit"], ["decl"]).select("claim", "unit", "decl", "first_decl", "kind")


@_query("""
WITH allowed AS (SELECT unnest(['BUILDING', 'MACHINERY', 'FURNITURE']) AS claim, unnest([['URGENT', 'HIGH'], ['HIGH', 'LOW'], ['NOT', 'SPECIFIED']]) AS kinds)
SELECT c_mktsegment AS claim, o_orderkey AS decl, o_orderpriority AS host
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN allowed ON claim = c_mktsegment
WHERE NOT coalesce(list_has_any(kinds, string_split(substr(o_orderpriority, 3), ' ')), false)""")
def host_filter_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose kinds their segment doesn't accept."""
    sets = {"BUILDING": ["URGENT", "HIGH"], "MACHINERY": ["HIGH", "LOW"], "FURNITURE": ["NOT", "SPECIFIED"]}
    allowed = F.create_map(*[x for k, v in sets.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    cover = _table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    _, outside = coverage.out_of_scope(cover, F.split(F.substring("o_orderpriority", 3, 99), " "), allowed[F.col("c_mktsegment")])
    return outside.select(F.col("c_mktsegment").alias("claim"), F.col("o_orderkey").alias("decl"), F.col("o_orderpriority").alias("host"))


@_query(r"""
SELECT conv_id, turn, target, reason, CASE WHEN target <> '' AND reason <> '' THEN 'valid' ELSE 'malformed' END AS status
FROM (SELECT conv_id, turn, regexp_extract(text, '^\s*(\S+)', 1) AS target, regexp_extract(text, '^\s*\S+\s+([\s\S]*?)\s*$', 1) AS reason FROM conversations)""")
def declaration_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as tag bodies: target, reason, and whether both are there."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tag_target(F.col("text")).alias("target"), T.tag_reason(F.col("text")).alias("reason"))
    return c.withColumn("status", F.when((F.col("target") != "") & (F.col("reason") != ""), "valid").otherwise("malformed"))


@_query("""
WITH wanted AS (SELECT DISTINCT p_name AS name, p_brand AS brand, 51 - p_size AS size FROM part),
found AS (
  SELECT name, brand, size, count(DISTINCT p_partkey) AS n, min(p_partkey) AS unit, string_agg(DISTINCT p_type || ' ' || p_partkey, '; ' ORDER BY p_type || ' ' || p_partkey) AS matches
  FROM wanted LEFT JOIN part ON p_name = name AND p_brand = brand AND p_size = size GROUP BY ALL)
SELECT name, brand, size, n, CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN unit END AS unit, CASE WHEN n > 1 THEN matches END AS matches FROM found""")
def target_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite names with none, one or several parts."""
    part = _table(spark, sf_dir, "part")
    named = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_partkey", "p_type")
    wanted = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (51 - F.col("p_size")).alias("size")).distinct()
    return resolve.cardinality(wanted, named, ["name", "brand", "size"], "p_partkey", F.concat_ws(" ", "p_type", "p_partkey")).select("name", "brand", "size", "n", "status", "unit", "matches")


_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def _page_path() -> Column:
    return F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)


def _page_host() -> Column:
    return F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)


@_query(f"""
WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages),
wanted AS (SELECT page_id AS decl, CASE WHEN path LIKE '%/' OR path LIKE '%.html' THEN path ELSE './' || path END AS target FROM p)
SELECT decl, page_id AS unit FROM wanted JOIN p ON path = target
UNION SELECT decl, page_id FROM wanted JOIN p ON path = regexp_replace(replace(target, chr(92), '/'), '^(\\./)+', '')""")
def normalised_target_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that match as written or in their plain form."""
    p = _table(spark, sf_dir, "pages").select("page_id", _page_path().alias("path"))
    as_is = F.col("path").like("%/") | F.col("path").like("%.html")
    wanted = p.select(F.col("page_id").alias("decl"), F.when(as_is, F.col("path")).otherwise(F.concat(F.lit("./"), "path")).alias("target"))
    targets = p.select(F.col("path").alias("target"), F.col("page_id").alias("unit"))
    return resolve.with_fallback(wanted, targets, "target", "decl", T.plain_path(F.col("target")))


@_query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_PATH_SQL} AS path FROM pages)
SELECT page_id, host FROM p WHERE host IN (SELECT host FROM p WHERE path LIKE 'en/%') AND host NOT IN (SELECT host FROM p WHERE path LIKE '%.html')""")
def unbraced_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is in one lookup and not in another."""
    p = _table(spark, sf_dir, "pages").select("page_id", _page_host().alias("host"), _page_path().alias("path"))
    return resolve.only_in(p, p.filter("path like 'en/%'"), p.filter("path like '%.html'"), "host").select("page_id", "host")


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderkey IS NULL THEN 'no order' WHEN c_custkey IS NULL THEN 'no customer' WHEN n_nationkey IS NULL THEN 'no nation' ELSE 'resolved' END AS stage
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON o_orderkey = l_orderkey
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = c_nationkey""")
def staged_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in a chain; the first that fails names the result."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    nations = _table(spark, sf_dir, "nation").filter("n_regionkey <> 0").select("n_nationkey")
    # the small ends first: orders carry the outcome, and the large side is joined once
    ends = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    chain = orders.join(ends, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = items.join(chain, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    stage = resolve.stage_of([("no order", F.col("o_orderkey").isNull()), ("no customer", F.col("c_custkey").isNull()), ("no nation", F.col("n_nationkey").isNull())], "resolved")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stage.alias("stage"))


@_query(f"""
WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages),
stems AS (SELECT page_id, regexp_replace(path, '(\\.html|/)$', '') AS stem FROM p),
candidates AS (SELECT page_id, stem || '.html' AS candidate, 0 AS ord FROM stems UNION ALL SELECT page_id, stem || '/', 1 FROM stems UNION ALL SELECT page_id, stem, 2 FROM stems)
SELECT page_id, arg_min(candidate, ord) AS candidate, min(ord) AS ord FROM candidates WHERE candidate IN (SELECT path FROM p) GROUP BY page_id""")
def first_match_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names that a page may stand for, the first that exists."""
    p = _table(spark, sf_dir, "pages").select("page_id", _page_path().alias("path"))
    stem = F.regexp_replace("path", "(\\.html|/)$", "")
    names = F.array(F.concat(stem, F.lit(".html")), F.concat(stem, F.lit("/")), stem)
    candidates = p.select("page_id", F.posexplode(names).alias("ord", "candidate"))
    return resolve.first_match(candidates, p.select(F.col("path").alias("candidate")), ["page_id"])


@_query(f"""
WITH a AS (SELECT DISTINCT list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')) AS address FROM pages),
b AS (SELECT address FROM a UNION SELECT address[1:3] FROM a)
SELECT array_to_string(o.address, '.') AS owner, array_to_string(m.address, '.') AS member FROM b o JOIN b m ON len(m.address) > len(o.address) AND m.address[1:len(o.address)] = o.address""")
def prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses within addresses: hosts below their domains."""
    full = _table(spark, sf_dir, "pages").select(F.reverse(F.split(_page_host(), "\\.")).alias("address"))
    both = full.unionByName(full.select(F.slice("address", 1, 3).alias("address")))
    found = closure.containment(both)
    return found.select(T.qualified(F.col("owner")).alias("owner"), T.qualified(F.col("member")).alias("member"))


@_query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, lead(event_type) OVER w AS next, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
edges AS (SELECT DISTINCT user_id || ':' || event_type AS src, user_id || ':' || next AS dst FROM e WHERE next <> event_type),
walk AS (
  SELECT user_id || ':' || event_type AS start, user_id || ':' || event_type AS node, 0 AS depth FROM e WHERE k = 1
  UNION SELECT start, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 8)
SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node""")
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that a user's first leads to, one after the other, with cycles, by the fewest steps."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    state = lambda kind: F.concat_ws(":", "user_id", kind)
    edges = e.withColumn("next", F.lead("event_type").over(line)).filter("next <> event_type").select(state("event_type").alias("src"), state("next").alias("dst")).distinct()
    starts = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("_f")).select(state("_f.event_type").alias("start"))
    return closure.least_distances(edges, starts)


GLOBS = {"english": ["en/**", "!en/1*", "en/1?5*"], "leaves": ["**/*.html", "*/[0-9]", "!fr/**"], "all but german": ["**", "!de/**", "de/2*"]}


@_query(f"""
WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages),
globs(owner, ord, regex, positive) AS (VALUES
  ('english', 0, '^en(/.*)?$', true), ('english', 1, '^en/1[^/]*$', false), ('english', 2, '^en/1[^/]5[^/]*$', true),
  ('leaves', 0, '^([^/]+/)*[^/]*\\.html$', true), ('leaves', 1, '^[^/]*/\\[0-9\\]$', true), ('leaves', 2, '^fr(/.*)?$', false),
  ('all but german', 0, '^.*$', true), ('all but german', 1, '^de(/.*)?$', false), ('all but german', 2, '^de/2[^/]*$', true))
SELECT owner, page_id, path FROM (SELECT owner, page_id, path, arg_max(positive, ord) AS inside FROM p JOIN globs ON regexp_matches(path, regex) GROUP BY ALL) WHERE inside""")
def ordered_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths selected by ordered patterns, the last match deciding."""
    p = _table(spark, sf_dir, "pages").select("page_id", _page_path().alias("path"))
    return members(p, glob_table(spark, {k: GlobSet(v) for k, v in GLOBS.items()}), F.col("path"))


_H1_SQL = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


@_query(rf"""
SELECT page_id, trim(regexp_replace(regexp_replace(lower({_H1_SQL}), '[^\p{{L}}\p{{N}}_\-\s\x{{85}}\p{{Z}}]', '', 'g'), '[\-\s\x{{85}}\p{{Z}}]+', '-', 'g'), '-') AS slug FROM pages""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the pages' headings."""
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return _table(spark, sf_dir, "pages").select("page_id", T.slug(h1).alias("slug"))


@_query(r"""
SELECT page_id, unnest(range(1, len(found) + 1)) - 1 AS k, unnest(found) AS anchor
FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS found FROM pages)""")
def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page, in order."""
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("k", "anchor"))


@_query(r"""
SELECT page_id, unnest(range(1, len(found) + 1)) - 1 AS k, trim(unnest(found)) AS body
FROM (SELECT page_id, regexp_extract_all(html, '<!--((?s:.*?))-->', 1) AS found FROM pages)""")
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment of a page, in order."""
    found = F.regexp_extract_all("html", F.lit("<!--((?s:.*?))-->"), 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("k", "body")).withColumn("body", F.trim("body"))


@_query("""
WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hosts AS (SELECT *, last_value(CASE WHEN length(body) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS host FROM lines)
SELECT doc_id, line, coalesce(host, 0) AS host FROM hosts""")
def nearest_heading_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest short line at or before each line; 0: the document."""
    lines = F.split("text", "\n")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "body")).select("doc_id", (F.col("pos") + 1).alias("line"), (F.length("body") < 20).alias("short"))
    host = F.last(F.when(F.col("short"), F.col("line")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line"))
    return rows.select("doc_id", "line", F.coalesce(host, F.lit(0)).alias("host"))


@_query("""
SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(list_transform(l, lambda s: length(s))) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def line_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered within their document."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).select("doc_id", (F.col("pos") + 1).alias("line"), F.length("body").alias("chars"))


@_query("""
WITH ops AS (SELECT upper(event_type) || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS target, event_id FROM events)
SELECT target, count(*) AS n, min(event_id) AS first_event, count(*) > 1 AS repeated FROM ops GROUP BY target""")
def operations_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a nested document as operations, with those that repeat."""
    ops = _table(spark, sf_dir, "events").select("event_id", T.operation_target(F.col("event_type"), F.get_json_object("props", "$.k")).alias("target"))
    return ops.groupBy("target").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).withColumn("repeated", F.col("n") > 1)


@_query("""
SELECT n_nationkey AS file, count(s_suppkey) AS identities,
  CASE WHEN count(s_suppkey) > 4 THEN 'several' WHEN count(s_suppkey) FILTER (s_acctbal < 0) > 0 THEN 'anonymous default' WHEN count(s_suppkey) > 0 AND NOT bool_or(s_suppkey % 25 = n_nationkey) THEN 'name differs' ELSE 'fine' END AS finding,
  (list_sort(list(s_name) FILTER (s_name IS NOT NULL)))[2] AS second
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def singular_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of the one-identity rule, with suppliers as a nation's identities."""
    s = _table(spark, sf_dir, "supplier")
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"))
    per = s.groupBy(F.col("s_nationkey").alias("file")).agg(F.count("*").alias("identities"), F.max(F.col("s_acctbal") < 0).alias("anonymous"), F.max((F.col("s_suppkey") % 25) == F.col("s_nationkey")).alias("named"))
    # the two least names of a nation are all that a task keeps
    order = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_name"))
    second = s.withColumn("_k", order).filter("_k <= 2").filter("_k = 2").select(F.col("s_nationkey").alias("file"), F.col("s_name").alias("second"))
    finding = F.when(F.col("identities") > 4, "several").when(F.col("anonymous"), "anonymous default").when((F.col("identities") > 0) & ~F.col("named"), "name differs").otherwise("fine")
    return n.join(per, "file", "left").join(second, "file", "left").select("file", F.coalesce("identities", F.lit(0)).alias("identities"), finding.alias("finding"), "second")


@_query("""
SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'documented' WHEN count(l.doc_id) > 0 THEN 'empty' ELSE 'missing' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY doc_id""")
def documented_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a block that says something, only empty ones, or none."""
    blocks = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    ids = _table(spark, sf_dir, "documents").select("doc_id").distinct()
    return ids.join(blocks.withColumn("_there", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("q") == 1, "documented").when(F.col("_there"), "empty").otherwise("missing").alias("status"))


@_query("""
SELECT l_orderkey, l_returnflag, count(*) AS n, string_agg(l_linenumber::VARCHAR || ':' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey) AS names
FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def shared_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one statement and kind as one finding with all names."""
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    grouped = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), pairs.alias("pairs"))
    named = F.transform("pairs", lambda p: F.concat_ws(":", p["l_linenumber"], p["l_partkey"]))
    return grouped.select("l_orderkey", "l_returnflag", "n", F.array_join(named, ", ").alias("names"))


@_query("""
WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url FROM pages),
named AS (SELECT *, first_value(url) OVER (PARTITION BY host ORDER BY length(url), url) AS canonical FROM u)
SELECT host, canonical, url AS alias FROM named WHERE url <> canonical
UNION ALL SELECT DISTINCT host, canonical, '' FROM named""")
def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest address of a host, and a row for each other; no host's addresses are collected."""
    u = _table(spark, sf_dir, "pages").select(_page_host().alias("host"), "url").distinct()
    first = u.groupBy("host").agg(F.min(F.struct(F.length("url").alias("n"), F.col("url").alias("canonical"))).alias("_f")).select("host", "_f.canonical")
    others = u.join(first, "host").filter("url <> canonical").select("host", "canonical", F.col("url").alias("alias"))
    return others.unionByName(first.withColumn("alias", F.lit("")))


@_query("""
SELECT DISTINCT c_mktsegment || ': ' || n_name || ' is acknowledged ' || CASE WHEN c_acctbal > 9500 THEN 'twice' ELSE 'once' END AS message
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000""")
def distinct_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without repeats."""
    n = _table(spark, sf_dir, "nation")
    c = _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > ACK_BALANCE).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    message = F.concat("c_mktsegment", F.lit(": "), "n_name", F.lit(" is acknowledged "), F.when(F.col("c_acctbal") > 9500, "twice").otherwise("once"))
    return coverage.distinct_diagnostics(c.select(message.alias("message")))


@_query("""
WITH units AS (
  SELECT 'h2' AS kind, 'r' || r_regionkey AS id, r_name AS target FROM region
  UNION ALL SELECT 'file', 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'operation', 's' || s_suppkey, s_name FROM supplier),
ranked AS (SELECT target, row_number() OVER (ORDER BY CASE kind WHEN 'h2' THEN 0 WHEN 'file' THEN 1 ELSE 2 END, target, id) AS ord FROM units)
SELECT trigger, ord, target FROM ranked, (VALUES ('@cite '), ('@citeExclude ')) t(trigger)""")
def ranked_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completion offers after either tag: headings, files, operations."""
    r = _table(spark, sf_dir, "region").select(F.lit("h2").alias("kind"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("target"))
    n = _table(spark, sf_dir, "nation").select(F.lit("file").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("target"))
    s = _table(spark, sf_dir, "supplier").select(F.lit("operation").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("target"))
    units = r.unionByName(n).unionByName(s).select(F.col("kind").alias("symbol"), F.col("target").alias("place"), F.lit(0).alias("line"), "id", "target", F.col("target").alias("readable"))
    return offers(units).select(F.col("after").alias("trigger"), "ord", F.col("insert").alias("target"))


@_query(r"""
SELECT page_id, regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1***@'), '\?[^#]*', '?<redacted>', 'g') AS source FROM pages""")
def redacted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without users and query values."""
    return _table(spark, sf_dir, "pages").select("page_id", T.redacted(F.col("url")).alias("source"))


@_query(f"""
WITH p AS (SELECT page_id, string_split(trim({_PATH_SQL}, '/'), '/') AS parts FROM pages)
SELECT page_id, array_to_string(parts, '.') AS name, array_to_string(list_transform(parts, lambda s: octet_length(encode(s)) || ':' || s || ';'), '') AS identity FROM p""")
def encoded_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as dotted names and as unmistakable identities."""
    parts = F.split(F.trim(_page_path(), F.lit("/")), "/")
    return _table(spark, sf_dir, "pages").select("page_id", T.qualified(parts).alias("name"), T.encoded_identity(parts).alias("identity"))


@_query("""
WITH l AS (SELECT doc_id, list(quality) AS q FROM labels GROUP BY doc_id),
got AS (SELECT doc_id, count(*) AS rows FROM documents GROUP BY doc_id)
SELECT coalesce(got.doc_id, l.doc_id) AS source, CASE WHEN got.doc_id IS NULL THEN 'not configured' WHEN l.doc_id IS NULL THEN 'no result' WHEN len(l.q) > 1 THEN 'repeated' ELSE 'one' END AS status
FROM got FULL JOIN l ON got.doc_id = l.doc_id""")
def source_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured sources against results: none, one, repeated, or not asked for."""
    asked = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"))
    return resolve.completeness(asked, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source")), "source")
