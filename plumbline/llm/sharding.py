"""Shards that each match the corpus's mixture of sources.

Rows of a source are shuffled by a seeded hash and ranked; rank k of n becomes
the fraction (2k + 1) / 2n. Sorted by fraction, the sources interleave in
proportion, and equal cuts of that order have every source in its share, within
one row. Both ranks are made without a window over a whole source or the whole
table: rows fall into cells that follow the order (a prefix of the hash, a range
of fractions), cells are counted, and a rank is the rows of earlier cells plus
the place within the cell. Only doc_id, source and a row number are moved for
that; ``write_shards`` then joins whole rows with their places by row number, so
repeated ids and missing ones keep all their rows, and moves them to tasks of
like size in the order of their places.

Defined cases: a null source is a source; a null doc_id hashes as ''. Rows
without doc_id, or with one id, are ordered by a hash of their numbers, so that
any number of them spreads over cells. Repeated
rows are rows of their own, next to each other. Equal fractions are ordered by
source, null first. With fewer rows than shards some shards are empty; an empty
table gives no rows. Further columns pass through ``write_shards`` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpointed, free, scratch, small, stable, written

SHARDS = 64
SEED = 17
#: Rows that a cell should hold.
CELL = 100_000
#: Rows that a task writes.
TASK = 5_000


def _celled(keyed: DataFrame, cell: int) -> DataFrame:
    """keyed with cell, the prefix of the key that about cell rows of the source share.

    The prefix is as long as uniform keys need; where one id's rows make a cell
    much larger, it is taken beyond what the cell's keys have in common, until
    no such cell is left.
    """
    most = keyed.groupBy("source").count().agg(F.max("count")).first()[0] or 1

    def digits(n: Column) -> Column:
        return F.ceil(F.log2(F.greatest(n / cell, F.lit(1.0))) / 4).cast("int")

    out = keyed.withColumn("digits", digits(F.lit(float(most))))
    while True:
        out = out.withColumn("cell", F.expr("substring(key, 1, digits)"))
        crowded = out.groupBy("source", "cell").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).filter(F.col("n") > 4 * cell)
        alike = F.size(F.filter(F.sequence(F.lit(1), F.length("lo")), lambda k: F.col("lo").substr(F.lit(1), k) == F.col("hi").substr(F.lit(1), k)))
        crowded = checkpointed(crowded.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), (alike + F.greatest(digits(F.col("n")), F.lit(1))).alias("_digits")))
        if crowded.isEmpty():
            return out.drop("digits")
        longer = out.join(small(crowded), out["source"].eqNullSafe(F.col("_source")) & (out["cell"] == F.col("_cell")), "left")
        out = written(longer.withColumn("digits", F.coalesce("_digits", "digits")).drop("_source", "_cell", "_digits", "cell"), "cells")


def _places(numbered: DataFrame, shards: int, seed: int, cell: int) -> DataFrame:
    """(doc_id, source, row, shard, position, rank) of rows of (doc_id, source, row)."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # the second half only splits cells that one id would fill
    keyed = numbered.withColumn("key", F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), F.lpad(F.hex(F.xxhash64("row")), 16, "0")))
    keyed = written(keyed, "keys")
    sizes = checkpointed(keyed.groupBy("source").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    celled = _celled(keyed, cell)
    earlier = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = celled.groupBy("source", "cell").agg(F.count("*").alias("c")).select("source", "cell", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(sizes, starts["source"].eqNullSafe(sizes["source"])).select(starts["source"].alias("_source"), F.col("cell").alias("_cell"), "start", "n")
    placed = celled.withColumn("k", F.row_number().over(W.partitionBy("source", "cell").orderBy("key")) - 1)
    cells = small(checkpointed(starts))
    fraction = (2 * (F.col("start") + F.col("k")) + 1) / (2 * F.col("n"))
    ranked = placed.join(cells, placed["source"].eqNullSafe(F.col("_source")) & (placed["cell"] == F.col("_cell"))).select("doc_id", "source", "row", fraction.alias("fraction"))
    ranges = max(1, -(-total // cell))
    split = written(ranked.withColumn("range", F.floor(F.col("fraction") * ranges).cast("long")), "fractions")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = split.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    order = F.row_number().over(W.partitionBy("range").orderBy("fraction", "source", "doc_id")) - 1
    global_rank = split.withColumn("r", order).join(small(checkpointed(offsets)), "range").withColumn("rank", F.col("offset") + F.col("r"))
    shard = F.expr(f"rank * {shards} div {max(1, total)}")
    return global_rank.withColumn("shard", shard).select("doc_id", "source", "row", "shard", (F.col("rank") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).alias("position"), "rank")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """(doc_id, source, shard, position): the place of every row."""
    numbered = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"))
    return _places(numbered, shards, seed, cell).select("doc_id", "source", "shard", "position")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, cell: int = CELL) -> tuple[str, str]:
    """Every row of docs in one folder a shard, sorted by position; the names of the columns of shard and position."""
    row, shard, position, rank = (free(c, docs.columns) for c in ("_row", "_shard", "_position", "_rank"))
    numbered = stable(docs).withColumn(row, F.monotonically_increasing_id())
    places = _places(numbered.select("doc_id", "source", F.col(row).alias("row")), shards, seed, cell)
    places = places.select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("position").alias(position), F.floor(F.col("rank") / TASK).alias(rank))
    joined = numbered.join(places, row).drop(row)
    joined.repartition(rank).sortWithinPartitions(shard, position).drop(rank).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return shard, position


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of documents, written and read again: the place of every row and the length of the text that is there."""
    path = scratch(spark, "shards")
    shard, position = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return spark.read.parquet(path).select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.col(shard).cast("long").alias("shard"), F.col(position).cast("long").alias("position"))


SQL = f"""
WITH ranked AS (
  SELECT doc_id, source, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k,
    count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents),
placed AS (SELECT doc_id, source, chars, total, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n), source NULLS FIRST, doc_id NULLS FIRST) - 1 AS g FROM ranked)
SELECT doc_id, source, chars, g * {SHARDS} // total AS shard, g - ((g * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS position FROM placed
"""
