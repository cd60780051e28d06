"""Best-fit packing planned on a histogram of lengths.

A document's length is its number of tokens (runs without white space). One
longer than CONTEXT is cut into whole pieces of CONTEXT and a remainder. The plan
needs only the counts of pieces by length, at most CONTEXT numbers for any
corpus: best-fit decreasing runs over counts, so that thousands of equal pieces
meet thousands of equal bins in one step. Pieces then take the planned slots: a
piece's rank within its length is joined with the plan's rank ranges.

Ranks are made without a window over a whole length: pieces of one length are
spread over hash cells, cells are counted, and a rank is the cells before plus
the place in the cell.

Defined cases: null, blank or empty texts have no tokens and take no slot.
Pieces of rows without doc_id, and of repeated rows, take slots like others.
Ties in length are ordered by the hash and value of doc_id, then piece. An empty
table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import small, written

CONTEXT = 2048
#: Pieces of one length that a hash cell should hold.
CELL = 200_000


def plan(counts: dict[int, int], context: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank_lo, rank_hi, bin, per_bin, offset): of the pieces of that
    length, ranks rank_lo to rank_hi (exclusive) go to bins bin, bin + 1, ...,
    per_bin in each, the first at token offset of its bin.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    stock = _Rooms()
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = stock.least(length)
            if room is None:
                per = context // length
                need = -(-left // per)
                stock.put(context, bins, need)
                bins += need
                room = context
            first, size = stock.take(room)
            per = room // length
            full = min(size, left // per)
            at = first
            if full:
                out.append((length, rank, rank + full * per, at, per, context - room))
                rank, left, at = rank + full * per, left - full * per, at + full
                if room - per * length > 0:
                    stock.put(room - per * length, first, full)
            if at < first + size and 0 < left < per:
                out.append((length, rank, rank + left, at, left, context - room))
                if room - left * length > 0:
                    stock.put(room - left * length, at, 1)
                rank, left, at = rank + left, 0, at + 1
            if at < first + size:
                stock.put(room, at, first + size - at)
    return out


class _Rooms:
    """Ranges of bins by the room left in them."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, size: int) -> None:
        heappush(self.of.setdefault(room, []), (first, size))

    def take(self, room: int) -> tuple[int, int]:
        got = heappop(self.of[room])
        if not self.of[room]:
            del self.of[room]
        return got

    def least(self, length: int) -> int | None:
        """The least room that a piece fits in."""
        return min((r for r in self.of if r >= length), default=None)


def token_count(text: Column) -> Column:
    """Tokens of a text: each of them, and the white space behind it, becomes one sign."""
    blank = " \t\n\f\r"
    signs = F.regexp_replace(F.ltrim(text, F.lit(blank)), "[^ \\t\\n\\f\\r]++[ \\t\\n\\f\\r]*+", "x")
    return F.length(signs)


def pieces(sized: DataFrame, context: int) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens) of rows of (doc_id, n)."""
    cut = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(context).cast("long"))).alias("piece", "start_token"))
    return cut.select("doc_id", "piece", "start_token", F.least(F.lit(context).cast("long"), F.col("n") - F.col("start_token")).alias("n_tokens"))


def pack(docs: DataFrame, context: int = CONTEXT, cell: int = CELL) -> DataFrame:
    """(bin, slot_offset, doc_id, piece, start_token, n_tokens): every piece in its slot."""
    spark = docs.sparkSession
    # lengths are written before any filter, which would count all tokens again
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(docs["text"]).cast("long").alias("n")), "lengths")
    cut = pieces(sized.filter("n > 0"), context)
    counts: Counter[int] = Counter({r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()})  # context rows at most
    slots = spark.createDataFrame(plan(counts, context), "p_length long, rank_lo long, rank_hi long, bin long, per_bin long, p_offset long")
    cells = max(1, -(-max(counts.values(), default=1) // cell))
    celled = cut.withColumn("h", F.xxhash64("doc_id", "piece")).withColumn("cell", F.expr(f"pmod(h, {cells}L)"))
    by_length = W.partitionBy("n_tokens").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    before = celled.groupBy("n_tokens", "cell").agg(F.count("*").alias("n")).select("n_tokens", "cell", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    placed = celled.withColumn("k", F.row_number().over(W.partitionBy("n_tokens", "cell").orderBy("h", "doc_id", "piece")))
    ranked = placed.join(small(written(before, "cells")), ["n_tokens", "cell"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    on = (F.col("n_tokens") == F.col("p_length")) & (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi"))
    # the plan's size depends on context alone, and is checked all the same
    seated = ranked.join(small(slots), on)
    turn = F.col("rank") - F.col("rank_lo")
    return seated.select(
        (F.col("bin") + F.floor(turn / F.col("per_bin"))).cast("long").alias("bin"),
        (F.col("p_offset") + (turn % F.col("per_bin")) * F.col("n_tokens")).cast("long").alias("slot_offset"),
        "doc_id",
        F.col("piece").cast("long").alias("piece"),
        "start_token",
        "n_tokens",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
