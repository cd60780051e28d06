"""Resolution of names to units: cardinality, fallbacks, first match and staged lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cardinality(wanted: DataFrame, targets: DataFrame, keys: list[str], unit: str, label: Column) -> DataFrame:
    """wanted with n, the distinct units that match, status (unresolved, resolved, ambiguous), the unit and, if ambiguous, the matches.

    targets is reduced to distinct (keys, unit) first, so both sides of the join
    are as small as they can be.
    """
    ids = targets.select(*keys, F.col(unit).alias("_unit"), label.alias("_label")).distinct()
    groups = ids.groupBy(*keys).agg(F.count_distinct("_unit").alias("n"), F.min("_unit").alias("unit"), F.array_join(F.array_sort(F.collect_set("_label")), "; ").alias("matches"))
    status = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return wanted.join(groups, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", status).withColumn("unit", F.when(F.col("n") == 1, F.col("unit"))).withColumn("matches", F.when(F.col("n") > 1, F.col("matches")))


def with_fallback(wanted: DataFrame, targets: DataFrame, key: str, id_column: str, normal: Column, fallback: DataFrame | None = None) -> DataFrame:
    """Distinct rows of targets, with the id, that match by the key as it is or, where normalising changes it, by the normal form.

    targets has target and further columns; the normal form is looked up in
    fallback, if there is one.
    """
    plain = wanted.select(id_column, F.col(key).alias("target"))
    other = wanted.filter(normal != F.col(key)).select(id_column, normal.alias("target"))
    if fallback is None:
        found = plain.unionByName(other).join(targets, "target")
    else:
        found = plain.join(targets, "target").unionByName(other.join(fallback, "target"))
    return found.drop("target").distinct()


def only_in(rows: DataFrame, inside: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in one table and not in the other."""
    return rows.join(inside.select(key), key, "left_semi").join(outside.select(key), key, "left_anti")


def first_match(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate and ord of each group's first candidate that exists; candidates has keys, candidate, ord."""
    there = candidates.join(existing.select("candidate").distinct(), "candidate", "left_semi")
    return there.groupBy(*keys).agg(F.min_by("candidate", "ord").alias("candidate"), F.min("ord").alias("ord"))


def stage_of(stages: list[tuple[str, Column]], done: str) -> Column:
    """The name of the first stage that failed, or done."""
    out = F
    for name, failed in stages:
        out = out.when(failed, name)
    return out.otherwise(done)


def completeness(asked: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, status) of every key asked for or in the results: one, repeated, no result, or not configured."""
    got = results.groupBy(key).agg(F.count("*").alias("_n"))
    both = asked.select(key).distinct().withColumn("_asked", F.lit(True)).join(got, key, "full")
    status = F.when(F.col("_asked").isNull(), "not configured").when(F.col("_n").isNull(), "no result").when(F.col("_n") > 1, "repeated").otherwise("one")
    return both.select(key, status.alias("status"))
