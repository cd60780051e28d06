"""Operators that SQL can't express: brute force, exact round trips, held-out accuracy."""

import gzip
import io
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import ann, bpe, langid, neardup, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (None, "text without id. " * 20, "en", None, 1),
    (5, "words again and more words again " * 10, "en", "a", 350),
    (5, "words again and more words again " * 10, "en", "a", 350),
    (6, "x" * 300_000, None, None, 300_000),
    (7, "é ü", "fr", "b", 3),
]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# nearest neighbours


def exact(ids, x, k):
    d = ((x[:, None, :].astype(np.float64) - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, row))[:k]] for i, row in zip(ids, d)}


def recall(rows, truth):
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    return np.mean([len(got.get(i, set()) & set(t)) / len(t) for i, t in truth.items() if t])


@pytest.mark.parametrize("shard", [150, 10**6])
def test_recall_on_random_vectors(spark, shard):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), "c") for k, v in enumerate(x)], "vec_id long, embedding array<float>, shard string")
    got = ann.neighbours(df, 10, shard, 400).collect()
    assert len(got) == 9000
    assert recall(got, exact(np.arange(900), x, 10)) >= 0.9


def test_neighbours_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding.to_numpy())
    got = ann.op3_neighbours(spark, SF).collect()
    truth = {i: near for i, near in exact(t.vec_id.to_numpy(), x, ann.K).items() if i % ann.QUERY_STEP == 0}
    assert {r.vec_id for r in got} == set(truth) and len(got) == ann.K * len(truth)
    assert recall(got, truth) >= 0.9
    place = {int(i): k for k, i in enumerate(t.vec_id)}
    for r in got[:200]:
        assert r.vec_id != r.neighbor_id
        assert r.distance == pytest.approx(((x[place[r.vec_id]].astype(float) - x[place[r.neighbor_id]]) ** 2).sum())


def test_neighbours_on_hard_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None), (6, []), (7, [nan, 0.0]), (8, [None, 1.0]), (None, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.rank, r.neighbor_id, r.distance) for r in ann.neighbours(df, 2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 4, 0.0), (3, 1, 2, 0.0), (3, 2, 4, 0.0), (4, 1, 2, 0.0), (4, 2, 3, 0.0)]
    some = sorted((r.vec_id, r.rank, r.neighbor_id, r.distance) for r in ann.neighbours(df, 2, queries="vec_id in (1, 4, 7)").collect())
    assert some == [r for r in got if r[0] in (1, 4)]
    assert ann.neighbours(df, 2, queries="vec_id < 0").count() == 0
    assert ann.neighbours(df.limit(0)).count() == 0


def test_a_hub_keeps_the_memory_of_a_step_bounded():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 16)).astype(np.float32)
    graph = np.full((1000, 8), -1, np.int32)
    graph[1:, 0] = 0  # all edges lead to one point
    norms = (x**2).sum(1)
    ann._add_reverse(x, norms, graph, np.arange(1, 1000), 8, 1.2)
    kept = graph[0][graph[0] >= 0]
    assert len(kept) and len(set(kept.tolist())) == len(kept)
    assert norms[0] + norms[kept[0]] - 2 * x[0] @ x[kept[0]] == pytest.approx(((x[1:] - x[0]) ** 2).sum(1).min(), rel=1e-3)


@pytest.mark.parametrize("shard", [150, 10**6])
def test_copies_find_each_other_and_the_rest(spark, shard):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    which = np.concatenate([np.arange(700), np.repeat([0, 1, 2, 3], [400, 100, 20, 5]), np.arange(10, 60)])
    ids = rng.permutation(len(which))
    x = x.astype(np.float32)[which]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, 10, shard, 400).orderBy("rank").collect():
        assert r.rank == len(got.setdefault(r.vec_id, [])) + 1
        got[r.vec_id].append(r.neighbor_id)
    truth = exact(ids, x, 10)
    for i, w in zip(ids, which):
        copies = [j for j in np.sort(ids[which == w]) if j != i][:10]
        assert len(got[i]) == 10 and got[i][: len(copies)] == copies
    for few in (True, False):  # queries of small groups, and of all
        part = [int(i) for i, w in zip(ids, which) if w > 3 or not few]
        assert np.mean([len(set(got[i]) & set(truth[i])) / 10 for i in part]) >= 0.9


def test_many_equal_vectors_still_reach_the_others():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((400, 8)), rng.normal(size=(200, 8)) * 3]).astype(np.float32)
    graph, start = ann.build(x)
    found, _ = ann.search(x, graph, start, x[400:], 11)
    d = ((x[400:, None].astype(float) - x[None]) ** 2).sum(-1)
    truth = np.argsort(d, axis=1, kind="stable")[:, :11]
    kth = np.take_along_axis(d, truth, 1)[:, -1:]
    assert np.mean(np.take_along_axis(d, found, 1) <= kth + 1e-5) >= 0.9


def test_robust_prune_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.01, 0], [0, 5]], np.float32)
    kept = ann.robust_prune(x, (x**2).sum(1), np.array([0]), np.array([[1, 2, 3]]), 3, 1.2)
    assert kept[0].tolist() == [1, 3, -1]


# near duplicates


def shingle_sets(text, width=neardup.SHINGLE):
    made, tf, at, _ = neardup.shingles(*raw([text.lower()]), width)
    return dict(zip(made.tolist(), tf.tolist()))


def raw(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])


def variants(rng, words, n, share):
    out = []
    for _ in range(n):
        w = list(words)
        for i in rng.choice(len(w), int(share * len(w)), replace=False):
            w[i] = f"n{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = np.random.default_rng(4)
    texts = []
    for g in range(12):
        words = [f"g{rng.integers(4000)}" for _ in range(rng.integers(40, 200))]
        texts += [" ".join(words)] + variants(rng, words, 3, (0.02, 0.05, 0.08)[g % 3])
    texts += [" ".join(f"u{rng.integers(10**6)}" for _ in range(80)) for _ in range(40)]
    texts += [texts[0].upper() + "!", texts[0], "short text", "Short, text", "another one"]
    return texts


def brute_similarities(texts):
    sets = [shingle_sets(t) for t in texts]
    have = Counter(x for s in sets for x in s)  # exact, without slots
    n = sum(bool(s) for s in sets)
    weighted = [{x: c * log(1 + 1 / max(have[x] / n, neardup.RARE)) for x, c in s.items()} for s in sets]
    out = {}
    for i, a in enumerate(weighted):
        for j in range(i):
            b = weighted[j]
            both = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
            if both:
                out[j, i] = both / (sum(a.values()) + sum(b.values()) - both)
    return out


def groups_of(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in range(n) if find(i) != i}


def test_near_duplicates_against_brute_force(spark):
    texts = corpus()
    df = docs(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: r.kept_doc_id for r in neardup.near_duplicates(df).collect()}
    similar = brute_similarities(texts)
    most = groups_of([p for p, s in similar.items() if s >= neardup.THRESHOLD - 1e-6], len(texts))
    sure = groups_of([p for p, s in similar.items() if s >= 0.65], len(texts))
    assert all(most.get(i) == k for i, k in got.items()), "no pair below the threshold is joined"
    assert np.mean([got.get(i) == most[i] for i in sure]) >= 0.97
    kept = {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}
    assert kept == set(range(len(texts))) - set(got)


def test_weights_against_exact_frequencies(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    n = table.filter("text rlike '[0-9A-Za-z\\\\x{80}-\\\\x{10ffff}]'").count()
    texts = pa.array([t.lower() for t in table.toPandas().text], pa.large_string())
    made, have = np.unique(np.concatenate([neardup.shingles(d, o)[0] for _, _, d, o in neardup.chunks(texts)]), return_counts=True)
    exact = np.log1p(1 / np.maximum(have / n, neardup.RARE))
    got = neardup.weights(made, neardup.document_weights(table))
    assert (got <= exact * 1.001).all() and np.mean(np.abs(got - exact) > 0.01 * exact) < 0.005
    # as many texts again, of which none is like these: rare shingles keep their weight
    assert neardup.inverse_frequencies(np.array([2]), 10**4) == neardup.inverse_frequencies(np.array([200]), 10**6) == np.float16(log(1001))


def test_a_band_of_several_groups_is_compared_by_its_leaders(spark):
    """Members of different components within a band: all pairs that are like are found, few are compared."""
    rng = np.random.default_rng(6)
    base = [[f"b{g}x{rng.integers(10**6)}" for _ in range(300)] for g in range(4)]
    chain = base[0][:150] + [f"c{k}" for k in range(40)]
    texts = [t for words in base for t in variants(rng, words, 30, 0.004)] + [" ".join(chain)] + [" ".join(f"z{rng.integers(10**6)}" for _ in range(50)) for _ in range(10)]
    df = docs(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])
    idf = neardup.document_weights(df)
    similar = brute_similarities(texts)
    group = groups_of([p for p, s in similar.items() if s >= 0.8], len(texts))
    split = spark.createDataFrame([(7, k, group.get(k, k)) for k in range(len(texts))], "band long, id long, root long")
    compared = []

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    real, neardup.verified = neardup.verified, counting
    try:
        held = df.select("doc_id", F.lower("text").alias("_lowered"))
        got = neardup._across(split, held, idf, 0.5, spark.createDataFrame([], "a long, b long")).collect()
    finally:
        neardup.verified = real
    want = {p for p, s in similar.items() if s >= 0.5 and group.get(p[0], p[0]) != group.get(p[1], p[1])}
    root = lambda extra: groups_of([*group.items(), *extra], len(texts))
    assert root([(r.a, r.b) for r in got]) == root(want) and {(r.a, r.b) for r in got} <= want
    assert sum(compared) < 1500 < len(texts) * (len(texts) - 1) // 4


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(8)
    made = np.sort(rng.integers(1, 2**63, 4000, dtype=np.uint64))
    hits, want = [], []
    for _ in range(12):
        a, b = rng.gamma(1, 2, (2, 300)).astype(np.float32)
        x = rng.choice(made, 300, replace=False)
        x.sort()
        s = [neardup.samples(x, w, np.array([0, 300]))[0] for w in (a, b)]
        hits.append((s[0] == s[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.06


def test_near_duplicates_on_hard_rows(spark):
    rows = [*HARD, (8, "Words AGAIN, and more words again! " * 10, "en", "a", 1), (9, "x" * 300_000, None, None, 1)]
    df = docs(spark, [(*r, 1, "b") for r in rows], DOCS + ", `_gone` int, band string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == [(8, 5), (9, 6)]
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns and out.count() == 8
    assert neardup.near_duplicates(docs(spark, [])).count() == 0 == neardup.drop_near_duplicates(docs(spark, [])).count()


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 240)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups_of([p for p in pairs if p[0] != p[1]], 241)
    assert {i: r for i, r in got.items() if i != r} == want
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# language identification


def test_held_out_accuracy_and_whole_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    table = table[table.text.str.len() > 20]
    half = table.doc_id % 2 == 0
    model = langid.fit([(t.lower(), y) for t, y in zip(table.text[half], table.lang[half])])
    rest = table[~half]
    found, conf = model.judge(pa.array(rest.text.str.lower().tolist(), pa.large_string()))
    names = np.array([*model.langs, "-"])[found]
    assert (found >= 0).mean() > 0.99
    assert (names[found >= 0] == rest.lang.to_numpy()[found >= 0]).mean() > 0.95
    assert conf.max() <= 1
    strange = ["", "   ", "жук и лес", "你好", "0 0 0 ~~", "1234 5678 90", "!!!! ???? ####", "123 456 789 " * 50, "asdkj qwpoe zmxnc", "qwrt zxcv bnmk lkjh " * 20]
    assert (model.judge(pa.array(strange, pa.large_string()))[0] == -1).all()
    mixed = np.random.default_rng(1)
    junk = ["".join(mixed.permutation(list(t))) for t in rest.text[rest.text.str.len() > 100].str.lower()]
    assert (model.judge(pa.array(junk, pa.large_string()))[0] == -1).mean() > 0.95


@pytest.mark.parametrize("count", [2, 3, 4])
def test_long_texts_of_unlabelled_languages_are_rejected(spark, count):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").toPandas()
    table = table[table.text.str.len() > 20].drop_duplicates("doc_id")
    langs, half = sorted(table.lang.dropna().unique()), table.doc_id % 2 == 0
    assert len(langs) == 4
    seen = table[half & table.lang.isin(langs[:count])].groupby("lang").head(langid.SAMPLE)
    model = langid.fit([(t.lower(), y) for t, y in zip(seen.text, seen.lang)])

    def kept(texts):
        return (model.judge(pa.array([t.lower() for t in texts], pa.large_string()))[0] >= 0).mean()

    rest = table[~half]
    assert kept(rest.text[rest.lang.isin(langs[:count])]) > 0.99
    others = rest.text[~rest.lang.isin(langs[:count]) & (rest.text.str.len() > 500)]
    assert not len(others) or kept(others) < 0.25
    foreign = ["kissa ja koira ovat täällä meidän kanssamme tänään mutta huomenna menemme metsään katsomaan lintuja ", "kedi ve köpek bugün burada bizimle birlikte ama yarın kuşları görmek için ormana gideceğiz ", "кошка и собака сегодня здесь с нами а завтра мы пойдём в лес смотреть на птиц "]
    assert kept([t * 20 for t in foreign]) == 0


def test_long_text_is_pooled_whole():
    model = langid.fit([("aaa bbb abab " * 3, "x"), ("ccc ddd cdcd " * 3, "y")] * 10)
    long = "ccc ddd " * 10 + "aaa bbb " * 400_000
    found, _ = model.judge(pa.array([long, "ccc ddd", "aaa"], pa.large_string()))
    assert [model.langs[k] for k in found] == ["x", "y", "x"]


def test_language_on_hard_rows(spark):
    rows = [(100 + k, "the cat and the dog are here with us " * (1 + k % 3), "en", "a", 1) for k in range(30)] + [(200 + k, "der hund und die katze sind hier bei uns " * (1 + k % 3), "de", "a", 1) for k in range(30)]
    df = docs(spark, [(*r, "c", 2) for r in [*rows, *HARD]], DOCS + ", _language string, `_lowered` int")
    out = langid.language_filter(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.lang for r in out.collect()}
    assert all(got[k] == ("en" if k < 200 else "de") for k in got if k and k >= 100) and {100 + k for k in range(30)} <= set(got)
    assert not {1, 2, 3} & set(got)
    assert langid.language_filter(docs(spark, [])).count() == 0 == langid.language_scores(docs(spark, [])).count()
    one = docs(spark, [(1, "only this", "en", "a", 1), (2, "", "en", "a", 1)])
    assert [r.doc_id for r in langid.language_filter(one).collect()] == [1]
    assert langid.language_filter(docs(spark, [(1, "text", None, "a", 1)])).count() == 0


# byte-pair encoding


@pytest.fixture(scope="module")
def codec():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Codec.read(f.read())


@pytest.fixture(scope="module")
def exact_bpe(codec):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_query_equals_exact_merging(spark, exact_bpe):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in bpe.op8_bpe(spark, SF).collect():
        assert r.exact and list(r.tokens) == exact_bpe.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, exact_bpe, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = codec.encode([text])
    assert codec.decode(ids) == text and ids == exact_bpe.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeghilmnorstu", min_size=1, max_size=30))
def test_verification_settles_what_merging_gives(codec, text):
    word = text.encode()
    assert codec.cut([text]) == [codec.merge(word)]


def test_bpe_on_hard_rows(spark):
    df = docs(spark, HARD)
    got = {r.doc_id: r for r in bpe.encode(df).collect()}
    assert got[1].tokens is None and got[1].exact is None and got[2].tokens == [] and got[6].exact
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(bpe.encode(df)).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in HARD), key=repr)
    odd = spark.createDataFrame([(1, [None, 999_999_999]), (2, None)], "doc_id long, tokens array<int>")
    assert sorted(tuple(r) for r in bpe.decode(odd).collect()) == [(1, ""), (2, None)]
    assert bpe.encode(docs(spark, [])).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://h/{k}", "<p>" + "é%d " % k * (k * 50)) for k in range(40)] + [(None, None, None), (41, "a\r\nb", ""), (42, "u", "WARC/1.0\r\n\r\n\r\n"), (42, "u", "WARC/1.0\r\n\r\n\r\n"), (43, "long", "y" * 20_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file int").repartition(2)
    paths = [r.path for r in warc.write_monolithic(df, str(tmp_path / "in")).collect()]
    index = warc.normalise(spark, sorted(paths), str(tmp_path / "out")).collect()
    assert len(index) == len(rows) and not any(r.error for r in index)
    got = []
    for r in index:
        fields, body = warc.read_record(r.file, r.record_offset, r.record_length)
        got.append((fields["warc-record-id"], body))
    assert sorted(got) == sorted((f"<urn:page:{'' if p is None else p}>", (h or "").encode()) for p, _, h in rows)
    for path in {r.file for r in index}:
        whole, own = open(path, "rb").read(), sorted((r.record_offset, r.record_length) for r in index if r.file == path)
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) == len(whole)


def test_damaged_files(tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"

    def index(data):
        (tmp_path / "a.warc.gz").write_bytes(data)
        return list(warc.normalise_file(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz")))

    def gz(data):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    assert [r.get("payload_bytes") for r in index(gz(record * 2) + gz(record))] == [3, 3, 3]
    assert index(b"") == []
    noise = np.random.default_rng(0).bytes(5000)
    big = b"WARC/1.0\r\nContent-Length: 5000\r\n\r\n" + noise + b"\r\n\r\n"
    cut = index(gz(record + big)[:-2000])
    assert cut[0]["payload_bytes"] == 3 and cut[1]["error"] and len(cut) == 2
    assert index(gz(b"no record\r\n\r\n"))[0]["error"]
    assert index(gz(b"WARC/1.0\r\nA: b\r\n\r\n"))[0]["error"]
    assert index(b"not gzip")[0]["error"]


def test_a_long_record_that_is_cut_off_leaves_nothing(tmp_path):
    small = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    noise = np.random.default_rng(0).bytes(40_000_000)
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = squeeze.compress(small + b"WARC/1.0\r\nContent-Length: 40000000\r\n\r\n" + noise + b"\r\n\r\n" + small) + squeeze.flush()
    for size, kept in ((len(data), [small, None, small]), (len(data) // 2, [small])):
        (tmp_path / "a.warc.gz").write_bytes(data[:size])
        rows = list(warc.normalise_file(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz")))
        whole = gzip.open(tmp_path / "b.warc.gz").read()  # to its end
        assert len([r for r in rows if "offset" in r]) == len(kept) and bool(rows[-1].get("error")) == (len(kept) == 1)
        assert whole == (small if len(kept) == 1 else zlib.decompress(data, 31))
        assert sorted(p.name for p in tmp_path.iterdir()) == ["a.warc.gz", "b.warc.gz", "b.warc.gz.idx"]
    assert next(warc.records(io.BytesIO(zlib_gz(b"WARC/1.0" + b"x" * (warc.HEADER + 10)))))[0] == "error"


def zlib_gz(data):
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def test_files_of_one_name_and_an_independent_reader(spark, tmp_path):
    """The normalised bytes, read by the gzip module and cut by their lengths, are the inputs' records."""
    bodies = {}
    for k, name in enumerate(("x/a.warc.gz", "y/a.warc.gz", "y/z/a.warc.gz")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        bodies[name] = b"".join(b"WARC/1.0\r\nWARC-Record-ID: <%d-%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, i, 9 * i, b"\r\n\r\nWARC/" * i) for i in range(20))
        (tmp_path / "in" / name).write_bytes(zlib_gz(bodies[name]))
    paths = [str(tmp_path / "in" / n) for n in bodies]
    rows = warc.normalise(spark, [*paths, paths[0]], str(tmp_path / "out")).collect()
    assert len(rows) == 60 and len({r.file for r in rows}) == 3
    for name, body in bodies.items():
        data = (tmp_path / "out" / name).read_bytes()
        assert gzip.decompress(data) == body
        own = sorted((r for r in rows if r.file == str(tmp_path / "out" / name)), key=lambda r: r.record_offset)
        assert b"".join(gzip.decompress(data[r.record_offset : r.record_offset + r.record_length]) for r in own) == body
        assert [r.payload_bytes for r in own] == [9 * i for i in range(20)]
    assert warc.targets(["/p/a"], "/o") == {"/p/a": "/o/a"} and warc.targets(["s3://b/k/a", "/k/a"], "/o") == {"s3://b/k/a": "/o/s3/b/k/a", "/k/a": "/o/k/a"}


def test_warc_query_and_empty_table(spark, tmp_path):
    got = warc.op7_warc(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id for r in got} == set(pages) and all(r.payload_bytes == len(pages[r.page_id].encode()) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_monolithic(empty, str(tmp_path / "e")).count() == 0
    assert warc.normalise(spark, [], str(tmp_path / "f")).count() == 0
