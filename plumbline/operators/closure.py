"""Hierarchies, reachability and prefix containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut


#: Span from which on a closure looks for the cycles that it may be walking.
_LONG = 64


def ancestor_closure(units: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, scope_id, depth): every unit with itself and its ancestors within the same keys.

    Doubling: after k rounds ancestors up to 2**k levels are known, each found
    once, so a hierarchy of depth d takes log2(d) joins, whatever d is. A parent
    that isn't among the units ends the walk. In a cycle every member has the
    others as ancestors, by the fewest steps; it is noticed once a walk is LONG.
    """
    known = units.select(*keys, "id")
    steps = units.filter("parent_id is not null").select(*keys, "id", F.col("parent_id").alias("scope_id"))
    steps = steps.join(known.withColumnRenamed("id", "scope_id"), [*keys, "scope_id"], "left_semi")
    reach, span, size = steps.select(*keys, "id", "scope_id", F.lit(1).alias("depth")), 1, -1
    jump = reach
    while True:
        via = jump.select(*keys, F.col("scope_id").alias("_next"), F.col("id").alias("scope_id"))
        longer = reach.join(via, [*keys, "scope_id"]).select(*keys, "id", F.col("_next").alias("scope_id"), (F.col("depth") + span).alias("depth"))
        # in a walk without end a pair comes again with more steps; jumps are kept apart from the least
        jump = longer.filter(F.col("depth") == 2 * span)
        reach = reach.unionByName(longer)
        span *= 2
        if span < 4:
            continue
        if span > _LONG:
            jump = cut(jump)
            reach = cut(reach.groupBy(*keys, "id", "scope_id").agg(F.min("depth").alias("depth")))
            before, size = size, reach.count()
            if jump.isEmpty() or size == before:
                break
        else:
            reach = cut(reach)
            jump = reach.filter(F.col("depth") == span)
            if jump.isEmpty():
                break
    return known.select(*keys, "id", F.col("id").alias("scope_id"), F.lit(0).alias("depth")).unionByName(reach.filter("id <> scope_id"))


def least_distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): every node that a start reaches over edges (src, dst), by the fewest edges.

    Each round follows the edges from the nodes found last, until nothing new is
    found; so a cycle ends.
    """
    found = cut(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    front, depth = found, 0
    while not front.isEmpty():
        depth += 1
        front = cut(front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct().join(found, ["start", "node"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def prefixes(address: Column) -> Column:
    """The proper, non-empty prefixes of an array."""
    return F.when(F.size(address) > 1, F.transform(F.sequence(F.lit(1), F.size(address) - 1), lambda n: F.slice(address, F.lit(1), n)))


def containment(addresses: DataFrame, *keys: str) -> DataFrame:
    """(keys, owner, member): pairs of addresses of which the first is a proper prefix of the second.

    Prefixes are exploded, so this is an equi-join.
    """
    owners = addresses.select(*keys, F.col("address").alias("owner")).distinct()
    members = addresses.select(*keys, F.col("address").alias("member")).distinct()
    return members.withColumn("owner", F.explode(prefixes(F.col("member")))).join(owners, [*keys, "owner"]).select(*keys, "owner", "member")
