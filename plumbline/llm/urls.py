"""URL filter by empirical-Bayes host reputation.

Pages show documents: the number that ends a URL's path is the document's id,
and its label is the page's outcome, bad if quality is 0 or toxic is 1. Rates of
bad pages are shrunk down a tree, corpus to suffix to registered domain to host:
the posterior mean of a node is the prior mean of its children, and each level
has one beta-binomial prior strength, by the method of moments on the spread of
the level's labelled nodes. Nodes that differ no more than chance explains have
an infinitely strong prior, that is the mean of their parent; fewer than two
labelled nodes tell nothing of the spread, and the prior is the weakest (one
page, which is also the least strength that a spread can give). A host is
refused when even the upper bound of its rate of good pages (posterior mean and
Z deviations) is below SHARE of the corpus's rate, so hosts without labels are
judged by their domain and stay unless that is surely bad, and a corpus whose
hosts don't differ loses nothing.

Suffixes are those of a table in the notation of the public suffix list (plain
rules, "*.ck", "!www.ck"), the longest rule that matches counting, or, without a
table, the last label or one of the usual second-level suffixes (SECOND).

Defined cases: a null URL, or one without host, has the host '' and is judged
with the others of that kind. Addresses are their own domain and have the suffix
''. Pages whose URL ends in no number, or whose
document has no label, count as unlabelled. Several labels of a document count
as one, the worst. Repeated pages count as often as they occur. A bound equal to
the limit is kept. Without any labels every page is kept. Empty tables give no
rows. Further columns pass through ``url_filter`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import checkpointed, free, small

#: A host is refused below this share of the corpus's rate of good pages.
SHARE = 0.95
Z = 1.645

SECOND = "(?:(?:ac|co|com|edu|gob|gouv|gov|govt|go|gv|ltd|mil|ne|net|nom|or|org|plc)\\.[a-z]{2}|github\\.io|gitlab\\.io|blogspot\\.com|herokuapp\\.com|netlify\\.app|pages\\.dev|vercel\\.app|web\\.app)"
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^]]*\\]|[^/?#:\\[]+)"
_DOMAIN = f"([^.]+\\.(?:{SECOND}|[^.]+))$"
_SUFFIX = f"\\.({SECOND}|[^.]+)$"
_ADDRESS = "^[0-9.]+$|^\\["
_NUMBER = "/([0-9]{1,18})(?:\\.html)?/?(?:[?#].*)?$"


def host_of(url: Column) -> Column:
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: the label before the suffix and the suffix; an address or a single label is its own."""
    found = F.regexp_extract(host, _DOMAIN, 1)
    return F.when(host.rlike(_ADDRESS) | (found == ""), host).otherwise(found)


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(_ADDRESS), F.lit("")).otherwise(F.regexp_extract(host, _SUFFIX, 1))


def placed_by(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (distinct) with domain and suffix by the rules of the column suffix of suffixes."""
    labels = F.split("host", "\\.")
    tails = hosts.select("host", labels.alias("_l"), F.posexplode(labels).alias("_at", "_first")).filter(~F.col("host").rlike(_ADDRESS))
    tails = tails.select("host", "_l", "_at", F.array_join(F.slice("_l", F.col("_at") + 1, F.size("_l")), ".").alias("_tail"), F.array_join(F.concat(F.array(F.lit("*")), F.slice("_l", F.col("_at") + 2, F.size("_l"))), ".").alias("_wild"))
    forms = tails.select("host", "_l", "_at", F.explode(F.array(F.struct(F.col("_tail").alias("r"), F.lit(0).alias("skip")), F.struct(F.col("_wild").alias("r"), F.lit(0).alias("skip")), F.struct(F.concat(F.lit("!"), "_tail").alias("r"), F.lit(1).alias("skip")))).alias("_f")).select("host", "_l", "_at", "_f.r", "_f.skip")
    rules = suffixes.filter("suffix is not null").select(F.lower("suffix").alias("r")).distinct()
    # an exception decides; else the longest rule; else the last label
    best = forms.join(rules, "r").groupBy("host").agg(F.max(F.struct("skip", -F.col("_at"), (F.col("_at") + F.col("skip")).alias("start"))).alias("b")).select("host", "b.start")
    start = F.coalesce("start", F.size(labels) - 1)
    cut = hosts.join(best, "host", "left").withColumn("_start", start).withColumn("_l", labels)
    suffix = F.when(F.col("host").rlike(_ADDRESS), "").when(F.col("_start") > 0, F.array_join(F.slice("_l", F.col("_start") + 1, F.size("_l")), ".")).otherwise("")
    domain = F.when(F.col("host").rlike(_ADDRESS) | (F.col("_start") < 1), F.col("host")).otherwise(F.array_join(F.slice("_l", F.greatest("_start", F.lit(1)), F.size("_l")), "."))
    return cut.withColumns({"domain": domain, "suffix": suffix}).drop("_start", "_l", "start")


def _looseness(nodes: DataFrame) -> DataFrame:
    """One row, 1 / prior strength of the level, 0 to 1; nodes have n, bad and the prior mean mu."""
    v = F.col("mu") * (1 - F.col("mu"))
    sums = nodes.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("mu")) * (F.col("bad") / F.col("n") - F.col("mu")) - v).alias("over"),
        F.sum(v * (F.col("n") - 1)).alias("room"),
        F.count("*").alias("nodes"),
    )
    rho = F.col("over") / F.col("room")
    spread = (F.col("room") > 0) & (F.col("over") > 0)
    loose = F.when(F.col("nodes") < 2, F.lit(1.0)).when(spread & (rho < 0.5), rho / (1 - rho)).when(spread, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(loose.alias("loose"))


def reputations(pages: DataFrame, labels: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, good_mean, good_upper, kept) of every host of pages."""
    outcome = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("_bad"))
    number = F.nullif(F.regexp_extract(pages["url"], _NUMBER, 1), F.lit("")).cast("long")
    # one row a document and host before the join, so that no host's pages are moved
    seen = pages.select(host_of(pages["url"]).alias("host"), number.alias("_doc")).groupBy("host", "_doc").agg(F.count("*").alias("_pages"))
    labelled = F.col("_bad").isNotNull()
    hosts = seen.join(outcome, "_doc", "left").groupBy("host").agg(F.sum(F.when(labelled, F.col("_pages")).otherwise(0)).alias("n"), F.sum(F.when(labelled, F.col("_pages") * F.col("_bad")).otherwise(0)).alias("bad"))
    hosts = checkpointed(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}) if suffixes is None else placed_by(hosts, suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    corpus = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mu"))

    def posterior(nodes: DataFrame, keys: list[str]) -> DataFrame:
        """Posterior means of the nodes and 1 / (weight + 1)."""
        whole = nodes.crossJoin(_looseness(nodes))  # one row
        mean = (F.col("mu") + F.col("loose") * F.col("bad")) / (1 + F.col("loose") * F.col("n"))
        return whole.select(*keys, "n", "bad", mean.alias("mean"), (F.col("loose") / (1 + F.col("loose") * F.col("n") + F.col("loose"))).alias("shrunk"))

    s = checkpointed(posterior(ends.crossJoin(corpus), ["suffix"]))
    d = checkpointed(posterior(domains.join(s.select("suffix", F.col("mean").alias("mu")), "suffix"), ["domain", "suffix"]))
    h = posterior(hosts.join(d.select("domain", "suffix", F.col("mean").alias("mu")), ["domain", "suffix"]), ["host"])
    good = 1 - F.col("mean")
    upper = F.round(F.least(F.lit(1.0), good + Z * F.sqrt(good * F.col("mean") * F.col("shrunk"))), 6)
    whole = h.crossJoin(corpus.select(F.col("mu").alias("_corpus")))
    return whole.select("host", "n", "bad", F.round(good, 6).alias("good_mean"), upper.alias("good_upper"), (upper >= F.round(SHARE * (1 - F.col("_corpus")), 6)).alias("kept"))


def url_scores(pages: DataFrame, labels: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, the host's figures and its verdict, of every page."""
    rated = checkpointed(reputations(pages, labels, suffixes))
    return pages.select("page_id", host_of(pages["url"]).alias("host")).join(small(rated), "host")


def url_filter(pages: DataFrame, labels: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """The pages whose hosts aren't refused, with all their columns."""
    key = free("_refused", pages.columns)
    refused = checkpointed(reputations(pages, labels, suffixes).filter(~F.col("kept")).select(F.col("host").alias(key)))
    return pages.join(small(refused), host_of(pages["url"]) == F.col(key), "left_anti")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the verdict on its host."""
    return url_scores(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level(name: str, source: str, keys: str) -> str:
    return f"""
{name}_m AS (
  SELECT CASE WHEN nodes < 2 THEN 1.0::DOUBLE WHEN room > 0 AND excess > 0 AND excess / room < 0.5 THEN (excess / room) / (1 - excess / room) WHEN room > 0 AND excess > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loose
  FROM (SELECT sum(n * (bad / n - mu) * (bad / n - mu) - mu * (1 - mu)) AS excess, sum(mu * (1 - mu) * (n - 1)) AS room, count(*) AS nodes FROM {source} WHERE n > 0)),
{name} AS (SELECT {keys}, n, bad, (mu + loose * bad) / (1 + loose * n) AS mean, loose / (1 + loose * n + loose) AS shrunk FROM {source}, {name}_m)"""


SQL = f"""
WITH outcome AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
seen AS (
  SELECT page_id, coalesce(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host, CAST(nullif(regexp_extract(url, '{_NUMBER}', 1), '') AS BIGINT) AS doc FROM pages),
counted AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM seen LEFT JOIN outcome ON doc = doc_id GROUP BY host),
hosts AS (
  SELECT *, CASE WHEN regexp_matches(host, '{_ADDRESS}') OR regexp_extract(host, '{_DOMAIN}', 1) = '' THEN host ELSE regexp_extract(host, '{_DOMAIN}', 1) END AS domain,
    CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN '' ELSE regexp_extract(host, '{_SUFFIX}', 1) END AS suffix FROM counted),
corpus AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mu FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mu FROM corpus) AS mu FROM hosts GROUP BY suffix),
{_level("s", "s0", "suffix")},
d0 AS (SELECT domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.mean) AS mu FROM hosts h JOIN s ON s.suffix = h.suffix GROUP BY domain, h.suffix),
{_level("d", "d0", "domain, suffix")},
h0 AS (SELECT host, h.n, h.bad, d.mean AS mu FROM hosts h JOIN d ON d.domain = h.domain AND d.suffix = h.suffix),
{_level("h", "h0", "host")},
rated AS (
  SELECT host, n::BIGINT AS n, bad::BIGINT AS bad, round(1 - mean, 6) AS good_mean, round(least(1.0, 1 - mean + {Z}::DOUBLE * sqrt((1 - mean) * mean * shrunk)), 6) AS good_upper FROM h)
SELECT page_id, host, n, bad, good_mean, good_upper, good_upper >= round({SHARE}::DOUBLE * (1 - (SELECT mu FROM corpus)), 6) AS kept FROM seen JOIN rated USING (host)
"""
