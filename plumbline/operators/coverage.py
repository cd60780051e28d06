"""Coverage of selected units by acknowledgements, separately for each population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(resolved: DataFrame, scope_units: DataFrame, on: list[str]) -> DataFrame:
    """The units below every resolved scope."""
    return resolved.join(scope_units, on)


def first_of(cover: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """keys and, prefixed first_, order and keep of each group's least row.

    An aggregate rather than a window, so that a unit with very many
    acknowledgements is combined before it is shuffled.
    """
    least = cover.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_least"))
    return least.select(*keys, *[F.col(f"_least.{c}").alias(f"first_{c}") for c in dict.fromkeys([*order, *keep])])


def ranked(cover: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """cover with first_<order> of its group and kind, 'first' or 'overlap'."""
    first = first_of(cover, keys, order, [])
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    return cover.join(first, keys).withColumn("kind", F.when(same, F.lit("first")).otherwise(F.lit("overlap")))


def missing(selected: DataFrame, acknowledged: DataFrame, keys: list[str]) -> DataFrame:
    """The selected units without acknowledgement."""
    return selected.join(acknowledged.select(*keys), keys, "left_anti")


def out_of_scope(cover: DataFrame, hosts: Column, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose host kinds are allowed, the others); no hosts are never allowed."""
    inside = F.coalesce(F.arrays_overlap(hosts, allowed), F.lit(False))
    return cover.filter(inside), cover.filter(~inside)


def distinct_diagnostics(problems: DataFrame) -> DataFrame:
    """The problems without empty messages, one of each message; sorted where they are shown."""
    return problems.filter(F.col("message") != "").dropDuplicates(["message"])
