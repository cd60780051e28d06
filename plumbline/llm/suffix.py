"""Repeated windows by a depth-limited radix sort of suffixes.

A token is a run of bytes without white space. Two suffixes are only ordered
through their first DEPTH tokens, most significant digit first; a digit is the
64-bit hash of DIGIT tokens. What is equal after the last digit is exactly the
set of windows of DEPTH tokens that occur more than once.

The first pass runs before anything is moved: the digit of a window is its
least DIGIT-token gram (its anchor) and the offset of that gram. Equal windows
have equal anchors, so a suffix whose anchor occurs once is in order already
and leaves the sort. Only one anchor in about (DEPTH - DIGIT) / 2 tokens is
counted, with map-side combining. Survivors travel as runs, windows with one
anchor, carrying the token hashes they cover; the other passes run on the
partition of the anchor, rows in (anchor, doc_id, position) order, in batches
of bounded size: an anchor that is open at the end of a batch leaves one
suffix of each group behind, so an anchor with any number of copies needs the
memory of its distinct windows only. Suffixes of an anchor with more than HOT
runs would all meet in one task; they are spread by all their digits at once,
and first occurrences are found by an aggregate that is combined before it is
shuffled.

A token is told by 32 of its hash's bits (64 within the anchor), so windows that
differ in one token alone pass for equal with probability 2**-32.

The first occurrence of a window, by (doc_id, position), stays; every other one
is marked. A span is a maximal stretch covered by marked windows that overlap
or touch. Overlapping repeats inside one text count like others.

Defined cases: null, empty and shorter texts have no windows. Rows without
doc_id take no part, and stay in the filter. Rows with one
doc_id take part as one text each; positions are told apart by doc_id only, so a
repeated row counts as one occurrence and its windows aren't repeats of
themselves. An empty table gives no spans. Further columns pass through
``deduplicate`` whatever their names; a text cut to nothing goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytekernels import SPACE, U64, binary, chunks, column, gram_hashes, mix, owners, sliding_min, tidy, token_hashes, tokens
from .storage import checkpointed, free, small, written

#: Tokens of a window.
DEPTH = 50
#: Tokens of a digit.
DIGIT = 10
#: Suffixes sorted at once.
BATCH = 1 << 19
#: Tokens that travel in one batch.
PAYLOAD = 1 << 26
#: Runs of an anchor that one task sorts.
HOT = 200_000


def _anchors(codes: np.ndarray, bounds: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, anchor hash, anchor position) of every window of a chunk; the least gram is the anchor, the leftmost of equal ones."""
    grams = gram_hashes(codes, digit)
    span = depth - digit + 1
    # the upper half of a gram decides, then its position: the same choice in equal windows
    key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    at = (sliding_min(key, span) & U64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U64), none
    owner = owners(bounds)
    starts = np.flatnonzero(owner[: len(at)] == owner[depth - 1 :])
    at = at[starts]
    return starts, grams[at], at


def _runs(starts: np.ndarray, least: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of consecutive windows with one anchor."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]])


def anchors(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(anchor, doc_id): one row a run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in chunks(column(b, "_text")):
                s, e, bounds = tokens(data, offs, SPACE)
                starts, least, at = _anchors(token_hashes(data, s, e), bounds, depth, digit)
                first, _ = _runs(starts, least, at)
                if len(first):
                    doc = owners(bounds)[starts[first]] + lo
                    yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), ids.take(pa.array(doc))], ["anchor", "doc_id"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(tidy(run), "anchor long, doc_id long")


def _suffix_runs(docs: DataFrame, depth: int, digit: int) -> DataFrame:
    """Runs of the windows whose anchors are in the document's list ``_anchors`` (sorted, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            lists = b.column(2).to_pylist()
            for lo, hi, data, offs in chunks(column(b, "_text")):
                s, e, bounds = tokens(data, offs, SPACE)
                codes = token_hashes(data, s, e)
                starts, least, at = _anchors(codes, bounds, depth, digit)
                first, end = _runs(starts, least, at)
                if not len(first):
                    continue
                doc = owners(bounds)[starts[first]]
                wanted = np.zeros(len(first), bool)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    x, y = edges[i], edges[i + 1]
                    if x < y:
                        wanted[x:y] = np.isin(least[first[x:y]], np.frombuffer(lists[lo + i], "<u8"))
                first, end, doc = first[wanted], end[wanted], doc[wanted]
                if not len(first):
                    continue
                length = end - first + depth - 1
                # Arrow's offsets are 32 bits wide: a very long text gives several batches
                part = np.cumsum(length) // PAYLOAD
                for k in np.unique(part):
                    one, own, size = first[part == k], doc[part == k], length[part == k]
                    begin = starts[one]
                    off = np.concatenate([[0], np.cumsum(size)])
                    index = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(begin, size)
                    payload = (codes[index] >> U64(32)).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(least[one].view(np.int64)),
                            ids.take(pa.array(own + lo)),
                            pa.array((begin - bounds[own]).astype(np.int32)),
                            pa.array((at[one] - begin).astype(np.int32)),
                            binary(off * 4, payload),
                        ],
                        ["anchor", "doc_id", "pos", "shift", "tokens"],
                    )

    kept = docs.select("doc_id", "_text", "_anchors")
    return kept.mapInArrow(tidy(run), "anchor long, doc_id long, pos int, shift int, tokens binary")


def radix_groups(digits: np.ndarray) -> np.ndarray:
    """Group number of each row, -1 for rows unlike all others: one pass a digit, most significant first.

    Rows that are alone after a pass are in place and take no part in the next.
    """
    n = len(digits)
    group = np.full(n, -1)
    live = np.arange(n)
    prefix = np.zeros(n, U64)
    for k in range(digits.shape[1]):
        key = mix(prefix ^ (digits[live, k] + U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(live), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        edges = np.flatnonzero(new)
        size = np.diff(np.append(edges, len(live)))
        number = np.repeat(np.arange(len(edges)), size)
        keep = np.repeat(size > 1, size)
        chosen = order[keep]
        live, prefix, number = live[chosen], key[chosen], number[keep]
        if not len(live):
            return group
    group[live] = number
    return group


def _expand(anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, shift: np.ndarray, lists: list[bytes], depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Suffixes of the runs: digits (the first from anchor and shift), run's anchor, doc, position."""
    size = np.array([len(x) // 4 for x in lists])
    count = size - depth + 1
    codes = mix(np.frombuffer(b"".join(lists), np.uint32).astype(U64) + U64(1))
    off = np.concatenate([[0], np.cumsum(size)])[:-1]
    total = int(count.sum())
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(off, count) + step
    own = np.repeat(np.arange(len(lists)), count)
    columns = [mix(anchor[own].view(U64) + (shift[own] - step).astype(np.int64).view(U64))]
    grams = gram_hashes(codes, digit)
    columns += [grams[at + k] for k in range(0, depth - digit + 1, digit)]
    if depth % digit:
        columns.append(grams[at + depth - digit])
    return np.stack(columns, axis=1), anchor[own], doc[own], pos[own] + step


def sort_runs(batches: Iterator[pa.RecordBatch], depth: int, digit: int, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, position, doc of the first occurrence) of the marked windows; runs come in (anchor, doc, position) order."""
    carry: tuple[np.ndarray, ...] | None = None

    def settle(parts: tuple[np.ndarray, ...], last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal carry
        held = 0
        if carry is not None:
            held = len(carry[1])
            parts = tuple(np.concatenate([a, b]) for a, b in zip(carry, parts))
        digits, anchor, doc, pos = parts
        carry = None
        if not len(doc):
            return
        group = radix_groups(digits)
        rows = np.flatnonzero(group >= 0)
        rows = rows[np.lexsort((pos[rows], doc[rows], group[rows]))]
        leads = np.ones(len(rows), bool)
        leads[1:] = group[rows][1:] != group[rows][:-1]
        again = np.zeros(len(rows), bool)  # the same place of a repeated row
        again[1:] = ~leads[1:] & (doc[rows][1:] == doc[rows][:-1]) & (pos[rows][1:] == pos[rows][:-1])
        first = rows[np.flatnonzero(leads)[np.cumsum(leads) - 1]] if len(rows) else rows
        again &= (doc[rows] == doc[first]) & (pos[rows] == pos[first])
        marked = ~leads & ~again & (rows >= held)
        if marked.any():
            yield doc[rows[marked]], pos[rows[marked]], doc[first[marked]]
        if not last:
            alone = (group < 0) | np.isin(np.arange(len(doc)), rows[leads])
            stay = np.flatnonzero(alone & (anchor == anchor[-1]))
            carry = (digits[stay], anchor[stay], doc[stay], pos[stay])

    for b in batches:
        anchor, doc = np.asarray(b.column(0)), np.asarray(b.column(1))
        pos, shift = np.asarray(b.column(2)).astype(np.int64), np.asarray(b.column(3)).astype(np.int64)
        lists = b.column(4).to_pylist()
        ends = np.cumsum([len(x) // 4 - depth + 1 for x in lists])
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + batch, "right")))
            yield from settle(_expand(anchor[lo:hi], doc[lo:hi], pos[lo:hi], shift[lo:hi], lists[lo:hi], depth, digit), False)
            lo = hi


def marked_stretches(runs: DataFrame, depth: int, digit: int) -> DataFrame:
    """(doc_id, lo, hi, first_doc_id): marked windows at positions lo to hi of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, pos, first in sort_runs(batches, depth, digit):
            order = np.lexsort((pos, doc))
            doc, pos, first = doc[order], pos[order], first[order]
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)) + 1
            a, z = np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]])
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(pos[a]), pa.array(pos[z - 1]), pa.array(np.minimum.reduceat(first, a))], ["doc_id", "lo", "hi", "first_doc_id"])

    # every copy of a window is in the partition of its anchor
    placed = runs.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "pos")
    return placed.mapInArrow(tidy(run), "doc_id long, lo long, hi long, first_doc_id long")


def hot_stretches(runs: DataFrame, depth: int, digit: int) -> DataFrame:
    """The same for anchors of any number of runs, a row a window: windows are grouped by a hash of all their digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                anchor, doc = np.asarray(part.column(0)), np.asarray(part.column(1))
                pos, shift = np.asarray(part.column(2)).astype(np.int64), np.asarray(part.column(3)).astype(np.int64)
                digits, _, docs, places = _expand(anchor, doc, pos, shift, part.column(4).to_pylist(), depth, digit)
                one, two = np.zeros(len(docs), U64), np.full(len(docs), 0x9E3779B97F4A7C15, U64)
                for j in range(digits.shape[1]):
                    one, two = mix(one ^ digits[:, j]), mix(two + digits[:, j] * U64(0xD6E8FEB86659FD93))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(docs), pa.array(places)], ["one", "two", "doc_id", "pos"])

    windows = written(runs.mapInArrow(tidy(run), "one long, two long, doc_id long, pos long"), "windows")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(first, ["one", "two"]).filter("doc_id <> first.doc_id or pos <> first.pos")
    return later.select("doc_id", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.col("first.doc_id").alias("first_doc_id"))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """(doc_id, start_token, end_token, first_doc_id): spans covered by windows that occurred before.

    end_token is exclusive; first_doc_id is the least document in which one of
    the span's windows occurs first.
    """
    found = written(anchors(docs, depth, digit), "anchors")
    counts = checkpointed(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    lists = found.join(counts.select("anchor"), "anchor").groupBy("doc_id").agg(F.array_sort(F.collect_set("anchor")).alias("a"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(1)
            off = np.asarray(a.offsets).astype(np.int64)
            flat = np.asarray(a.values)[off[0] : off[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), binary((off - off[0]) * 8, flat)], ["doc_id", "_anchors"])

    packed = lists.mapInArrow(tidy(pack), "doc_id long, _anchors binary")
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    runs = _suffix_runs(texts.join(packed, "doc_id"), depth, digit)
    crowds = counts.filter(F.col("n") > hot).select("anchor")
    if crowds.isEmpty():
        marks = marked_stretches(runs, depth, digit)
    else:
        runs, crowds = written(runs, "runs"), small(crowds)
        marks = marked_stretches(runs.join(crowds, "anchor", "left_anti"), depth, digit).unionByName(hot_stretches(runs.join(crowds, "anchor", "left_semi"), depth, digit))
    line = W.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))
    islands = marks.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before + depth), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "_island").agg(F.min("lo").alias("start_token"), (F.max("hi") + depth).alias("end_token"), F.min("first_doc_id").alias("first_doc_id")).drop("_island")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the tokens of the spans and the white space after each of them."""
    data = np.frombuffer(text.encode(), np.uint8)
    s, _, _ = tokens(data, np.array([0, len(data)]), SPACE)
    edge = np.append(s, len(data))
    keep = np.ones(len(data), bool)
    for lo, hi in spans:
        keep[edge[min(lo, len(s))] : edge[min(hi, len(s))]] = False
    return data[keep].tobytes().decode()


def deduplicate(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """The documents with later occurrences of repeated windows cut out; n_chars, if there, is set anew.

    Documents without repeats are untouched; those of which nothing but white
    space is left go.
    """
    names = docs.columns
    held, key, left = free("_spans", names), free("_span_id", names), free("_left", names)
    spans = repeated_spans(docs, depth, digit).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_token", "end_token"))).alias(held)).withColumnRenamed("doc_id", key)
    joined = docs.join(small(checkpointed(spans)), docs["doc_id"] == F.col(key), "left")

    @F.pandas_udf("string")
    def cut(text, spans):  # noqa: ANN001, ANN202
        return text.combine(spans, lambda t, s: cut_text(t, [(x["start_token"], x["end_token"]) for x in s]))

    whole = joined.filter(F.col(key).isNull()).select(*[docs[c] for c in names])
    torn = joined.filter(F.col(key).isNotNull()).select(*[docs[c] for c in names], cut(docs["text"], F.col(held)).alias(left)).filter(F.col(left).rlike("[^ \\t\\n\\f\\r]"))
    new = {"text": F.col(left), "n_chars": F.length(left).cast("long")}
    return whole.unionByName(torn.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in names]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH words AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k, first_value(doc_id) OVER (PARTITION BY win ORDER BY doc_id, pos) AS first_doc_id FROM windows),
marks AS (SELECT doc_id, pos, first_doc_id FROM ranked WHERE k > 1),
steps AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS fresh FROM marks),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM steps)
SELECT doc_id, min(pos) AS start_token, max(pos) + 50 AS end_token, min(first_doc_id) AS first_doc_id FROM islands GROUP BY doc_id, island
"""
