"""The rules on single files, and completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import model
from plumbline.config import decode_documented
from plumbline.functions.lineage import cut
from plumbline.functions.text import base_name, in_order_of_rank
from plumbline.plans.graph import Graph
from plumbline.sources.inventory import flat, in_program, scan_typescript

FINDINGS = "path string, line int, rule string, message string"


def _checked(files: DataFrame, part: str) -> DataFrame:
    """Scans, for one of their arrays, of the modules that file rules look at: no declaration files, no packages."""
    return scan_typescript(files.filter(in_program(F.col("path")) & ~F.col("path").rlike("\\.d\\.[mc]?ts$")), parts=(part,))


def singular(files: DataFrame) -> DataFrame:
    """(path, line, rule, message): files with several identities, a nameless one, or another name than their identity."""
    s = _checked(files, "identities").select("path", "identities", "anonymous_line")
    names = F.transform("identities", lambda x: F.concat(F.array_join(F.when(F.size(x["addresses"]) > 0, x["addresses"]).otherwise(F.array(x["local"])), "' / '"), F.lit(" (line "), x["line"].cast("string"), F.lit(")")))
    only = F.col("identities")[0]
    fits = F.when(F.size(only["addresses"]) > 0, only["addresses"]).otherwise(F.array(only["local"]))
    base = base_name(F.regexp_extract("path", "([^/]+)$", 1))
    n = F.size("identities")
    message = (
        F.when(n > 1, F.concat(F.lit("one public identity a file: this one has "), n.cast("string"), F.lit(", "), F.array_join(names, ", ")))
        .when(F.col("anonymous_line").isNotNull(), F.lit("the default export has no name"))
        .when((n == 1) & (base != "index") & ~F.array_contains(fits, base), F.concat(F.lit("the file isn't named after '"), F.array_join(fits, "' / '"), F.lit("'")))
    )
    line = F.when(n > 1, F.try_element_at("identities", F.lit(2))["line"]).when(F.col("anonymous_line").isNotNull(), F.col("anonymous_line")).otherwise(only["line"])
    return s.select("path", line.alias("line"), F.lit("singular").alias("rule"), message.alias("message")).filter("message is not null")


def documented(files: DataFrame, options: dict | None = None) -> DataFrame:
    """(path, line, rule, message): selected exports whose first declaration has no block, or only empty ones."""
    kinds = decode_documented(options)
    hosts = flat(_checked(files, "doc_hosts"), "doc_hosts").filter(F.col("symbol").isin(list(kinds)) & ~F.col("has_content"))
    what = F.concat(F.lit(" of exported "), "symbol", F.lit(" '"), F.array_join("targets", "', '"), F.lit("'"))
    state = F.when(F.col("has_empty"), F.lit("empty documentation")).otherwise(F.lit("no documentation"))
    return hosts.select(F.col("file").alias("path"), "line", F.lit("documented").alias("rule"), F.concat(state, what).alias("message"))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ord, their place in the order, counted from 0.

    Range partitions are numbered by themselves and moved on by the sizes of
    those before, so no task sees all rows.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("ord", F.col("_before") + at).drop("_part", "_before", "_id")


def offers(units: DataFrame, words: tuple[str, str] = model.TAGS, link: bool = False) -> DataFrame:
    """(ord, after, insert, label, detail): what completion offers after either tag, headings, files, then operations.

    units has symbol, place, line, id, target and readable; link: the start of
    an inline link comes first.
    """
    spark = units.sparkSession
    ranked = in_order(units.withColumn("_rank", in_order_of_rank(F.col("symbol"))), "_rank", "place", "line", "id")
    ranked = ranked.select((F.col("ord") + 1).alias("ord"), F.col("target").alias("insert"), F.lit(None).cast("string").alias("label"), F.col("readable").alias("detail"))
    if link:
        ranked = spark.createDataFrame([(0, "{@link ", "{@link", "TypeScript symbol, resolved by the imports of the file")], "ord long, insert string, label string, detail string").unionByName(ranked)
    after = spark.createDataFrame([(f"@{w} ",) for w in words], "after string")
    return ranked.crossJoin(F.broadcast(after)).select("ord", "after", "insert", "label", "detail")


def hints(spark: SparkSession, graph: Graph) -> DataFrame:
    """What completion offers for a project; nothing if the check found anything wrong."""
    if not graph.diagnostics.isEmpty():
        return spark.createDataFrame([], "ord long, after string, insert string, label string, detail string")
    units = graph.reference_units.filter(F.col("artifact") != model.TYPESCRIPT).dropDuplicates(["id"])
    return offers(units.withColumn("place", F.coalesce("shown", "path")), graph.words, bool(graph.config.references(model.TYPESCRIPT)))
