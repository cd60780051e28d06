"""Byte-pair encoding by speculation and verification, and decoding.

Words (matches of the vocabulary's pattern) are cut by greedy longest match. A
cut is what exact merging gives if and only if each adjacent pair of its tokens
is what merging gives for the pair's bytes alone; so the distinct pairs of a
batch are looked up together in a sorted array of pairs known to be compatible or
not, new ones are settled once by merging their few bytes, and a word passes if all
its pairs do. Only words that fail are merged exactly. A word that is a token is
that token. Distinct words are cut once while a worker remembers them.

The vocabulary is a file of base64 tokens and ranks whose path is a parameter;
the driver reads it and broadcasts its bytes (about a megabyte).

Defined cases: null text has null tokens, empty text none. Any text decodes to
itself, whatever its characters or length; words of any length are cut whole.
Ids that are unknown, and null ids, decode to nothing; bytes that aren't UTF-8
to U+FFFD. Repeated rows are encoded alike; an empty table gives no rows.
Further columns play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .warc import _open

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pattern of the byte-level vocabulary: contractions, letters, numbers, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Distinct words and pairs that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Longer words aren't remembered.
LONG = 64
#: Bytes up to which a list of pair ranks is quicker than a heap.
SHORT = 48
_NONE = 1 << 60


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        #: rank of every token, -1 for what only begins one
        self.prefixes = {t[:k]: -1 for t in ranks for k in range(1, len(t))} | ranks
        self.words: dict[str, list[int]] = {}
        self._forget_pairs()
        self.failed = self.seen = 0

    def _forget_pairs(self) -> None:
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    @classmethod
    def read(cls, data: bytes, pattern: str = PATTERN) -> Codec:
        return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, data.splitlines()) if t}, pattern)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every byte is a token."""
        get = self.prefixes.get
        out, at, n = [], 0, len(word)
        while at < n:
            end = best = at
            while end < n and (rank := get(word[at : end + 1])) is not None:
                end += 1
                if rank >= 0:
                    best, token = end, rank
            out.append(token)
            at = best
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equal ones."""
        if len(word) > SHORT:
            return self.merge_long(word)
        get = self.ranks.get
        cuts = list(range(len(word) + 1))
        ranks = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            del cuts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(word[cuts[i] : cuts[i + 2]], _NONE)
            if i:
                ranks[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], _NONE)
        return [self.ranks[word[a:z]] for a, z in zip(cuts, cuts[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words of any length."""
        ranks = self.ranks
        n = len(word)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i]:
                continue
            j = nxt[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], nxt[i] = stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heappush(heap, (r, i, end[nxt[i]]))
            if (h := prev[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging gives each pair (left << 32 | right) for the pair's own bytes: a search in the sorted pairs that are settled."""
        uniq, back = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, uniq), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == uniq if len(self.pairs) else np.zeros(len(uniq), bool)
        out = np.empty(len(uniq), bool)
        out[known] = self.good[at[known]]
        if not known.all():
            fresh = uniq[~known]
            out[~known] = settled = [self.merge(self.tokens[p >> 32] + self.tokens[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in fresh.tolist()]
            both, good = np.concatenate([self.pairs, fresh]), np.concatenate([self.good, settled])
            order = np.argsort(both, kind="stable")
            self.pairs, self.good = both[order], good[order]
        return out[back]

    def cut(self, words: list[str]) -> list[list[int]]:
        """The tokens of distinct words."""
        raw = [w.encode() for w in words]
        cuts = [self.propose(w) for w in raw]
        size = np.array([len(c) for c in cuts])
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        inner = np.ones(len(flat), bool)
        inner[first] = False  # a word's first token has no pair on its left
        right = np.flatnonzero(inner)
        bad = right[~self.compatible(flat[right - 1] << 32 | flat[right])] if len(right) else right
        failing = np.unique(np.searchsorted(first, bad, "right") - 1)
        for k in failing.tolist():
            cuts[k] = self.merge(raw[k])
        self.seen += len(words)
        self.failed += len(failing)
        return cuts

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pairs) > 4 * REMEMBERED:
            self._forget_pairs()
        split = [self.pattern.findall(t) for t in texts]
        known = self.words
        new = list(set(chain.from_iterable(split)).difference(known))
        if new:
            known.update(zip(new, self.cut(new)))
        get = known.__getitem__
        out = [list(chain.from_iterable(map(get, s))) for s in split]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: list[int | None]) -> str:
        get = self.tokens.get
        try:
            data = b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            data = b"".join(get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec of a vocabulary, kept from task to task."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec.read(data, pattern)
    return _codecs[key]


def _slices(column: pa.Array, chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts of a column, about chars characters at once."""
    part, size = [], 0
    for k in range(0, len(column), 64):
        texts = column.slice(k, 64).to_pylist()
        part += texts
        size += sum(len(t) for t in texts if t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _stream(path: str):  # noqa: ANN202
    files, inner = _open(path)
    return files.open_input_stream(inner, compression=None)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact): the tokens of every text; exact: they decode to the text."""
    with _stream(vocabulary) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            at = 0
            for texts in _slices(b.column(1)):
                some = [t for t in texts if t is not None]
                made = codec.encode(some)
                exact = iter([codec.decode(ids) == t for ids, t in zip(made, some)])
                lists, sizes = iter(made), iter(map(len, made))
                tokens = pa.array([None if t is None else np.array(next(lists), np.int32) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), tokens, pa.array([None if t is None else next(sizes) for t in texts], pa.int32()), pa.array([None if t is None else next(exact) for t in texts], pa.bool_())],
                    ["doc_id", "tokens", "n_tokens", "exact"],
                )
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("_text")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, exact boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of the rows of (doc_id, tokens)."""
    with _stream(vocabulary) as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, PATTERN)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                lists = b.column(1).slice(k, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 256), pa.array([None if x is None else codec.decode(x) for x in lists], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
