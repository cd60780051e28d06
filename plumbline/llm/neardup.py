"""Near duplicates: improved consistent weighted sampling, banded, verified.

A text is the weighted set of its shingles: SHINGLE lower-cased tokens without
punctuation (all tokens of a shorter text). The weight is term frequency times
inverse document frequency, log(1 + 1 / share), share being the part of all
texts with tokens that have the shingle, RARE at least: what is rarer weighs no
more, at any size of the corpus. Shares come from a count-min sketch of the
whole corpus, HASHES rows of DF_SLOTS, whose size is fixed. With L distinct
shingles a text, a slot holds L / DF_SLOTS of the texts by collision, also at any
size; while that is below RARE, the weight of a rare shingle is exact unless a
common one meets it in every row (sf0.1: 0.35 % of the distinct shingles weigh over 1 % too little).
Sketches are summed as a stream, so no task holds those of others.

Sampling draws, for each of SAMPLES numbers, the shingle and quantised weight
that minimise c / (y exp r) (improved consistent weighted sampling); two texts
agree on a sample with the probability of their weighted Jaccard similarity.
The draws of r, c and beta come from a table that the shingle's hash indexes.
ROWS samples make a band. Texts that share a band are candidates.

Copies whose normal form is the same are linked without comparing. Of a band's
members, the least id is the centre and each other member is compared with its
centres, first with the least of them and with the others only where that left
the two unconnected. Should members of a band then still be in several
components, each component's least member in the band leads those that are
within RADIUS of it (weighted Jaccard distance, which is a metric); others lead
themselves. Leaders of different components are compared, and members of two
leaders only where the leaders' distance, less the farthest member of each,
leaves room for a pair. So every pair of candidates is compared, connected
through pairs that were, or known to be too far apart, and no candidate is given
up, while a band of thousands of copies of a few texts costs a few comparisons
each. A band of very many texts that are all unlike each other still costs the
pairs of its leaders.
A group is a connected component; its least id is kept.

Defined cases: null, empty and token-free texts are in no group, nor are rows
without doc_id. A repeated row is no copy of
itself; rows with one doc_id are kept or dropped together. An empty table gives no pairs. Texts
are used whole, however long. Further columns pass through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytekernels import NONWORD, U64, chunks, column, give_back, gram_hashes, mix, owners, tidy, token_hashes, tokens
from .storage import checkpointed, free, small, written

SHINGLE = 3
DF_SLOTS, HASHES = 1 << 20, 2
#: Share of the texts below which shingles weigh alike.
RARE = 1e-3
#: Slots that travel as one row while frequencies are summed, and tasks' rows that are summed first.
SLICE, LANES = 1 << 16, 16
#: Two texts at the threshold share a band with probability 0.96, at 0.6 with 0.997.
ROWS, BANDS = 3, 24
SAMPLES = ROWS * BANDS
#: Weighted Jaccard similarity of near duplicates.
THRESHOLD = 0.5
#: Distance up to which a member follows a leader.
RADIUS = 0.2
DRAWS = 1 << 16

_rng = np.random.default_rng(991)
_R = _rng.gamma(2, 1, DRAWS).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2, 1, DRAWS)).astype(np.float32)
_BETA = _rng.random(DRAWS).astype(np.float32)
_SLOT_KEYS = np.array([1, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], U64)
_KEYS = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) | U64(1)
#: Added to logarithms so that they are positive and order as their bits do.
_LIFT = np.float32(256)


def shingles(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, frequency, distinct shingles before each text, hash of all tokens) of a lower-cased chunk."""
    s, e, bounds = tokens(data, offs, NONWORD)
    codes = token_hashes(data, s, e)
    n = np.diff(bounds)
    owner = owners(bounds)
    grams = gram_hashes(codes, width)
    keep = owner[: len(grams)] == owner[width - 1 :] if len(grams) else np.zeros(0, bool)
    doc, made = owner[: len(grams)][keep], grams[keep]
    whole = np.zeros(len(n), U64)
    some = np.flatnonzero(n)
    if len(some):
        place = (np.arange(len(codes)) - np.repeat(bounds[:-1], n)).astype(U64)
        whole[some] = np.add.reduceat(mix(codes + place * U64(0x9E3779B97F4A7C15)), bounds[some])
    short = np.flatnonzero((n > 0) & (n < width))
    doc, made = np.concatenate([doc, short]), np.concatenate([made, whole[short]])
    # by text, then by hash: one sort of the upper bits of both, repaired where those of two hashes agree
    bits = U64(max(1, len(n)).bit_length())
    key = (doc.astype(U64) << (U64(64) - bits)) | (made >> bits)
    order = np.argsort(key)
    key = key[order]
    tie = np.flatnonzero(key[1:] == key[:-1])
    doc, made = doc[order], made[order]
    if (made[tie] != made[tie + 1]).any():
        order = np.lexsort((made, doc))
        doc, made = doc[order], made[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return made[at], np.diff(np.append(at, len(made))), np.searchsorted(doc[at], np.arange(len(n) + 1)), whole


def slot_numbers(made: np.ndarray) -> tuple[np.ndarray, ...]:
    """A shingle's slot in each row of the sketch; rows stand one behind the other."""
    return tuple(((made * (U64(1) if k == 0 else _SLOT_KEYS[k])) >> U64(44)).astype(np.int64) + k * DF_SLOTS for k in range(HASHES))


def inverse_frequencies(slots: np.ndarray, texts: int) -> np.ndarray:
    """log(1 + 1 / share) of slots, from the texts that have a shingle of each; half precision is 0.05 % off at most."""
    return np.log1p(1 / np.maximum(slots / max(texts, 1), max(RARE, 1 / max(texts, 1)))).astype(np.float16)


def document_weights(docs: DataFrame) -> np.ndarray:
    """inverse_frequencies of the slots of all rows of the corpus's sketch."""
    names = ["part", "lane", "counts", "texts"]

    def row(part: int, lane: int, counts: np.ndarray, texts: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lane], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([texts], pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(HASHES * DF_SLOTS, np.int32)
        texts = 0
        for b in batches:
            for _, _, data, offs in chunks(column(b, "_lowered")):
                made, _, at, _ = shingles(data, offs)
                for k, places in enumerate(slot_numbers(made)):
                    slots[k * DF_SLOTS : (k + 1) * DF_SLOTS] += np.bincount(places - k * DF_SLOTS, minlength=DF_SLOTS).astype(np.int32)
                texts += int((np.diff(at) > 0).sum())
        if texts:
            lane = TaskContext.get().partitionId() % LANES
            for part, own in enumerate(slots.reshape(-1, SLICE)):
                yield row(part, lane, own.astype("<i4"), texts)

    def total(batches: Iterator[pa.RecordBatch], kind: str) -> dict[int, tuple[np.ndarray, int, int]]:
        held: dict[int, tuple[np.ndarray, int, int]] = {}
        for b in batches:
            for part, lane, counts, texts in zip(*(c.to_pylist() for c in b.columns)):
                own, lane, have = held.get(part, (np.zeros(SLICE, np.int64), lane, 0))
                own += np.frombuffer(counts, kind)
                held[part] = own, lane, have + texts
        return held

    def by_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (own, lane, texts) in total(batches, "<i4").items():
            yield row(part, lane, own.astype("<i8"), texts)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (own, lane, texts) in total(batches, "<i8").items():
            yield row(part, lane, inverse_frequencies(own, texts), texts)

    schema = "part int, lane int, counts binary, texts long"
    lowered = docs.filter("doc_id is not null and text is not null").select(F.lower("text").alias("_lowered"))
    lanes = lowered.mapInArrow(tidy(count), schema).repartition("part", "lane").mapInArrow(tidy(by_lane), schema)
    out = np.ones(HASHES * DF_SLOTS, np.float16)
    for part, held in lanes.repartition("part").mapInArrow(tidy(weigh), schema).select("part", "counts").collect():
        out[part * SLICE : (part + 1) * SLICE] = np.frombuffer(held, np.float16)
    return out


def weights(made: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Inverse document frequency of shingles: that of the slot with the fewest texts."""
    first, *more = slot_numbers(made)
    out = idf[first]
    for places in more:
        out = np.maximum(out, idf[places])
    return out.astype(np.float32)


def samples(made: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples of each text with shingles, in the order of those texts."""
    heads = at[:-1][np.diff(at) > 0]
    log_w = np.log(weight).astype(np.float32)
    low = (made & U64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(heads), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        i = ((made * _KEYS[k]) >> U64(48)).astype(np.int32)
        r, beta = _R[i], _BETA[i]
        t = np.floor(log_w * _INVERSE_R[i] + beta)
        log_a = _LOG_C[i] - r * (t - beta) - r + _LIFT
        tag = low + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        packed = (log_a.view(np.uint32).astype(U64) << U64(32)) | tag
        out[:, k] = (np.minimum.reduceat(packed, heads) & U64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """One hash a band of each text."""
    n = len(sampled)
    s = sampled.astype(U64).reshape(n, BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64)[None, :] * U64(0xD1B54A32D192ED03)
    key = np.broadcast_to(key, (n, BANDS))
    for j in range(ROWS):
        key = mix(key ^ s[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, form, bands): a hash of the normal form, and the band keys, of every document with tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            ids = b.column(0)
            for lo, _, data, offs in chunks(column(b, "_lowered")):
                made, tf, at, whole = shingles(data, offs)
                if not len(made):
                    continue
                bands = band_keys(samples(made, tf * weights(made, table), at))
                some = np.flatnonzero(np.diff(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                # the form tells texts apart by all tokens and by all shingles with their frequencies
                forms = np.add.reduceat(mix(made + tf.astype(U64) * U64(0x9E3779B97F4A7C15)), at[some])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + lo)), pa.array(whole[some].view(np.int64)), pa.array(forms.view(np.int64)), lists], ["doc_id", "form", "form2", "bands"])

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("_lowered"))
    return rows.mapInArrow(tidy(run), "doc_id long, form long, form2 long, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts given as (shingles in order, frequencies)."""
    wa, wb = a[1] * weights(a[0], idf), b[1] * weights(b[0], idf)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    return float(both / max(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both, 1e-30))


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are similar enough; texts has doc_id and _lowered."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    left = texts.select(F.col("doc_id").alias("a"), F.col("_lowered").alias("_ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("_lowered").alias("_tb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "_ta", "_tb")

    def one(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for lo, hi, data, offs in chunks(col):
            made, tf, at, _ = shingles(data, offs)
            out += [(made[at[i] : at[i + 1]], tf[at[i] : at[i + 1]]) for i in range(hi - lo)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids = np.asarray(b.column(0))
                # a centre's pairs stand together: its shingles are made once
                head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                left = one(column(b, "_ta").take(pa.array(head)))
                which = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1
                right = one(column(b, "_tb"))
                sim = np.array([weighted_jaccard(left[which[i]], right[i], table) for i in range(len(ids))])
                ok = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(sim).take(ok)], ["a", "b", "similarity"])

    return joined.mapInArrow(tidy(run), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id on an edge (a, b): the least id of its component.

    Each round links the neighbours of an id to the least of them and then
    follows the links once (large star, small star), until nothing changes.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = checkpointed(linked)
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _across(split: DataFrame, held: DataFrame, idf: np.ndarray, threshold: float, compared: DataFrame) -> DataFrame:
    """The pairs of like members of different components (band, id, root) that share a band; compared (a, b) are known to be unlike."""
    least = split.groupBy("band", "root").agg(F.min("id").alias("head"))
    followers = split.join(least, ["band", "root"]).filter("id <> head")
    near = checkpointed(verified(followers.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), held, idf, 1 - RADIUS))
    led = followers.join(near.select(F.col("a").alias("head"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("far")), ["head", "id"], "left")
    led = led.withColumn("head", F.when(F.col("far").isNull(), F.col("id")).otherwise(F.col("head"))).select("band", "root", "head", "id", F.coalesce("far", F.lit(0.0)).alias("far"))
    led = checkpointed(led.unionByName(least.select("band", "root", "head", F.col("head").alias("id"), F.lit(0.0).alias("far"))))
    heads = led.groupBy("band", "root", "head").agg(F.max("far").alias("reach"), F.count("*").alias("n"))
    one = heads.select("band", F.col("head").alias("a"), F.col("root").alias("root_a"), F.col("reach").alias("reach_a"), F.col("n").alias("n_a"))
    two = heads.select("band", F.col("head").alias("b"), F.col("root").alias("root_b"), F.col("reach").alias("reach_b"), F.col("n").alias("n_b"))
    pairs = checkpointed(one.join(two, "band").filter("a < b and root_a <> root_b"))
    alone = pairs.filter("n_a = 1 and n_b = 1").select("a", "b").distinct().join(compared, ["a", "b"], "left_anti")
    led_pairs = pairs.filter("n_a > 1 or n_b > 1")
    # the least similarity that still leaves room for a pair of followers
    sims = checkpointed(verified(led_pairs.select("a", "b").distinct(), held, idf, threshold - 2 * RADIUS))
    like = sims.filter(F.col("similarity") >= threshold)
    # similarity - threshold >= -(reach_a + reach_b); leaders that are a pair connect their components
    near_pairs = led_pairs.join(sims, ["a", "b"]).filter((F.col("similarity") < threshold) & (F.col("similarity") + F.col("reach_a") + F.col("reach_b") >= threshold))
    sides = led.select("band", "head", "id")
    members = near_pairs.select("band", "a", "b").join(sides.select("band", F.col("head").alias("a"), F.col("id").alias("x")), ["band", "a"]).join(sides.select("band", F.col("head").alias("b"), F.col("id").alias("y")), ["band", "b"])
    inner = members.filter("x <> a or y <> b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = alone.unionByName(inner.join(compared, ["a", "b"], "left_anti")).distinct()
    return like.unionByName(verified(rest, held, idf, threshold))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that isn't the kept one of its group."""
    idf = document_weights(docs)
    give_back()
    signed = written(signatures(docs, idf), "signatures")
    forms = signed.groupBy("form", "form2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n"))
    copies = signed.join(forms.filter("n > 1").select("form", "form2", "rep"), ["form", "form2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    members = written(forms.select(F.col("rep").alias("id"), F.explode("bands").alias("band")), "bands")
    centres = members.groupBy("band").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    crowded = written(members.join(centres, "band").select("band", "centre", "id"), "crowded")
    star = checkpointed(crowded.filter("id <> centre").groupBy("centre", "id").agg(F.count("*").alias("n")).select(F.col("centre").alias("a"), F.col("id").alias("b")))
    involved = checkpointed(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    lowered = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("_lowered"))
    held = written(lowered.join(small(involved), "doc_id", "left_semi"), "texts")

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs with the components of both ends."""
        for end in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        return pairs

    least = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = checkpointed(verified(least, held, idf, threshold))
    roots = components(found)
    rest = checkpointed(rooted(star.join(least, ["a", "b"], "left_anti"), roots).filter("root_a <> root_b").select("a", "b"))
    if not rest.isEmpty():
        found = checkpointed(found.unionByName(verified(rest, held, idf, threshold)))
        roots = components(found)
    # bands whose members are in several components
    placed = crowded.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    split = checkpointed(placed.join(mixed, "band", "left_semi").select("band", "id", "root"))
    if not split.isEmpty():
        found = checkpointed(found.unionByName(_across(split, held, idf, threshold, star)))
    groups = components(found.select("a", "b").unionByName(copies))
    return groups.filter("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of which a near duplicate is kept."""
    key = free("_gone", docs.columns)
    gone = checkpointed(near_duplicates(docs, threshold).select(F.col("doc_id").alias(key)))
    return docs.join(small(gone), docs["doc_id"] == F.col(key), "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
