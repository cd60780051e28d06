"""Operators that SQL can express, on whole small tables and on hard cases."""

import re

import duckdb
import numpy as np
import pytest
from plumbline.llm import packing, quality, sharding, storage, suffix, urls
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def in_sql(sql, columns, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if hasattr(df, "toPandas") else df)
    return sorted(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall(), key=repr)


@pytest.mark.parametrize(("module", "query"), [(urls, "op1_url_filter"), (suffix, "op2_suffix_dedup"), (sharding, "op9_sharding"), (quality, "op10_quality")])
def test_query_against_sql(spark, module, query):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = getattr(module, query)(spark, SF)
    columns = sorted(df.columns)
    assert tuples(df, *columns) == sorted(con.execute(f"select {', '.join(columns)} from ({module.SQL})").fetchall(), key=repr)


HARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (None, "text without id. " * 20, "en", None, 1),
    (5, "word " * 70, "en", "a", 350),
    (5, "word " * 70, "en", "a", 350),
    (6, "x" * 300_000, None, None, 300_000),
    (7, "é" * 5, "fr", "b", 5),
]


# url filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, n int")


def test_url_filter_refuses_what_is_surely_bad(spark):
    rows = [(k, f"http://bad.evil.example/en/{k}", "h", "clash", 1) for k in range(40)] + [(k, f"http://good.example/en/{k}?q#x", "h", "clash", 2) for k in range(40, 390)] + [(1000, None, None, None, None), (1001, "no url", "", "", 0), (1002, "http://new.evil.example/x", "", "", 0), (1003, "http://1.2.3.4/7", "", "", 0)]
    labels = spark.createDataFrame([(k, 0, 1) for k in range(40)] + [(k, 1, 0) for k in range(40, 390)] + [(None, 0, 1), (41, None, None)], "doc_id long, quality int, toxic int")
    kept = urls.url_filter(pages(spark, rows), labels)
    assert kept.columns == ["page_id", "url", "html", "host", "n"]
    ids = {r.page_id for r in kept.collect()}
    assert not ids & set(range(40)) and set(range(40, 390)) <= ids and {1000, 1001} <= ids and 1002 not in ids
    scores = urls.url_scores(pages(spark, rows), labels).collect()
    assert len(scores) == len(rows) and {r.page_id for r in scores if r.kept} == ids
    columns = ["page_id", "host", "n", "bad", "good_mean", "good_upper", "kept"]
    assert tuples(urls.url_scores(pages(spark, rows), labels), *columns) == in_sql(urls.SQL, columns, {"pages": pages(spark, rows), "labels": labels})
    none = labels.limit(0)
    assert urls.url_filter(pages(spark, rows), none).count() == len(rows)
    assert urls.url_scores(pages(spark, []), labels).count() == 0


def test_url_filter_matches_a_direct_computation(spark):
    rng = np.random.default_rng(3)
    hosts = [f"{'www.' if k % 2 else ''}h{k % 7}.{('com', 'co.uk', 'org')[k % 3]}" for k in range(21)]
    rows = [(k, f"https://{hosts[k % 21]}/en/{k}", "", "", 0) for k in range(400)]
    labels = [(k, int(rng.random() > (k % 21) / 30), 0) for k in range(400) if rng.random() < 0.6]
    p, lab = pages(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["page_id", "host", "n", "bad", "good_mean", "good_upper", "kept"]
    assert tuples(urls.url_scores(p, lab), *columns) == in_sql(urls.SQL, columns, {"pages": p, "labels": lab})


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.com", "x.com", "com"), ("a.b.or.jp", "b.or.jp", "or.jp"), ("a.b.gob.mx", "b.gob.mx", "gob.mx"), ("me.github.io", "me.github.io", "github.io"), ("[::1]", "[::1]", ""), ("localhost", "localhost", ""), ("10.0.0.1", "10.0.0.1", ""), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    df = spark.createDataFrame([(host,)], "h string")
    r = df.select(urls.domain_of(df["h"]).alias("d"), urls.suffix_of(df["h"]).alias("s")).first()
    assert (r.d, r.s) == (domain, suffix)


def test_hosts_that_differ_by_chance_are_all_kept(spark):
    rows = [(k, f"http://h{k % 4}.x{k % 2}.org/{k}", "", "", 0) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 20 >= 4), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = urls.url_scores(pages(spark, rows), labels).collect()
    assert len(got) == 400 and all(r.kept for r in got) and len({r.good_upper for r in got}) == 1


def test_suffix_table(spark):
    table = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("github.io",), ("io",), (None,), ("Com",)], "suffix string")
    want = {"a.b.com": ("b.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.z.ck": ("y.z.ck", "z.ck"), "a.www.ck": ("www.ck", "ck"), "me.github.io": ("me.github.io", "github.io"), "a.b.zz": ("b.zz", "zz"), "localhost": ("localhost", ""), "1.2.3.4": ("1.2.3.4", ""), "[::1]": ("[::1]", ""), "": ("", ""), "co.uk": ("co.uk", "")}
    got = urls.placed_by(spark.createDataFrame([(h, 1) for h in want], "host string, n int"), table).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == want and got[0].n == 1
    hosts = [urls.host_of(F.lit(u)) for u in ("http://[2001:db8::1]:80/x", "http://u:p@A.b.C.:8/x?y", "no")]
    assert list(spark.range(1).select(*hosts).first()) == ["[2001:db8::1]", "a.b.c", ""]
    assert urls.url_scores(pages(spark, [(1, "http://a.b.com/1", "", "", 0)]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), table).first().kept


# suffix array


def brute_spans(rows, depth):
    first, marks = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0]):
        words = [w for w in __import__("re").split(r"[ \t\n\f\r]+", text) if w]
        for p in range(len(words) - depth + 1):
            win = tuple(words[p : p + depth])
            if win in first and first[win] != (doc, p):
                marks.setdefault(doc, []).append((p, first[win][0]))
            else:
                first.setdefault(win, (doc, p))
    out = []
    for doc, found in marks.items():
        lo = hi = None
        for p, f in sorted(found):
            if lo is not None and p <= hi + depth:
                hi, least = p, min(least, f)
            else:
                if lo is not None:
                    out.append((doc, lo, hi + depth, least))
                lo, hi, least = p, p, f
        out.append((doc, lo, hi + depth, least))
    return sorted(out)


@pytest.mark.parametrize(("depth", "digit", "words"), [(6, 3, 4), (7, 3, 9), (5, 5, 3)])
def test_spans_match_brute_force(spark, depth, digit, words):
    rng = np.random.default_rng(depth * words)
    vocab = [f"w{k}" for k in range(words)]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 60))) for _ in range(30)]
    texts += [texts[3] + " " + texts[5], texts[7], "w0 " * 40]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (suffix.HOT, 3, 0):  # no anchor, some, and all are spread
        got = suffix.repeated_spans(df, depth, digit, hot).select("doc_id", "start_token", "end_token", "first_doc_id").collect()
        assert sorted(map(tuple, got)) == brute_spans(rows, depth)


def test_suffix_batches_carry_open_groups(spark):
    """An anchor with more copies than a batch holds."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, f"a{k} {passage} z{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix.anchors(df, 6, 3)
    lists = found.groupBy("doc_id").agg(__import__("pyspark").sql.functions.sort_array(__import__("pyspark").sql.functions.collect_set("anchor")).alias("a")).collect()
    packed = spark.createDataFrame([(r.doc_id, bytearray(np.array(sorted(r.a), np.int64).tobytes())) for r in lists], "doc_id long, _anchors binary")
    runs = suffix._suffix_runs(df.withColumnRenamed("text", "_text").join(packed, "doc_id"), 6, 3).toPandas().sort_values(["anchor", "doc_id", "pos"])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(runs, preserve_index=False)
    want = None
    for size in (1, 3, 10, 10**6):
        got = sorted((int(d), int(p), int(f)) for ds, ps, fs in suffix.sort_runs(iter([batch]), 6, 3, size) for d, p, f in zip(ds, ps, fs))
        want = want or got
        assert got == want and {f for *_, f in got} == {0} and len({d for d, *_ in got}) == 49


def test_long_texts_give_several_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PAYLOAD", 40)
    rows = [(k, " ".join(f"w{i % 17}" for i in range(60 + k))) for k in range(4)]
    docs_ = [{"doc_id": d, "_text": t} for d, t in rows]
    import pyarrow as pa

    codes = [b for b in _runs_of(docs_, 6, 3)]
    monkeypatch.setattr(suffix, "PAYLOAD", 1 << 26)
    whole = [b for b in _runs_of(docs_, 6, 3)]
    assert len(codes) > len(whole) == 1 and pa.Table.from_batches(codes).combine_chunks().equals(pa.Table.from_batches(whole).combine_chunks())


def _runs_of(rows, depth, digit):
    """What a worker makes of rows whose anchors are all wanted."""
    import pyarrow as pa

    class Frame:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            text = pa.array([r["_text"] for r in rows])
            codes, every = [], []
            for _, _, data, offs in suffix.chunks(text.cast(pa.large_string())):
                s, e, bounds = suffix.tokens(data, offs, suffix.SPACE)
                codes = suffix.token_hashes(data, s, e)
                _, least, _ = suffix._anchors(codes, bounds, depth, digit)
                every = np.unique(least)
            batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows]), text, pa.array([every.tobytes()] * len(rows))], ["doc_id", "_text", "_anchors"])
            return run(iter([batch]))

    return suffix._suffix_runs(Frame(), depth, digit)


def test_deduplicate(spark):
    body = " ".join(f"b{k}" for k in range(60))
    rows = [(1, f"start {body} end", "en", "a", 1), (2, f"other {body}\nrest ", "en", "a", 1), (3, body, "en", "a", 1), (4, "untouched  text\n", "en", "a", 1), *HARD]
    wide = docs(spark, [(*r, "x", 7) for r in rows], DOCS + ", lo string, `_spans` int")
    out = suffix.deduplicate(wide)
    assert out.columns == wide.columns
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert (1, f"start {body} end", 1) in got and (2, "other rest ", 11) in got and (4, "untouched  text\n", 1) in got
    assert not any(d == 3 for d, *_ in got)
    assert (1, None, 0) in got and any(d is None for d, *_ in got)
    assert suffix.deduplicate(docs(spark, [])).count() == 0
    assert suffix.repeated_spans(docs(spark, HARD[:3])).count() == 0


# packing


def brute_bins(lengths, context):
    room, out = [], []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in room if r >= n), default=None)
        if best is None:
            room.append(context)
            best = context
        room[room.index(best)] -= n
        out.append(n)
    return len(room)


def check_packed(rows, lengths, context):
    bins = {}
    for b, off, _, _, _, n in rows:
        bins.setdefault(b, []).append((off, n))
    for slots in bins.values():
        at = 0
        for off, n in sorted(slots):
            assert off == at
            at += n
        assert at <= context
    assert sorted(n for *_, n in rows) == sorted(lengths)
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 300).tolist() if seed else [64, 1, 1, 63, 40]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = []
    for n, lo, hi, b, per, off in packing.plan(counts, 64):
        rows += [(b + k // per, off + (k % per) * n, 0, 0, 0, n) for k in range(hi - lo)]
    assert check_packed(rows, lengths, 64) == brute_bins(lengths, 64)


@pytest.mark.parametrize("cell", [3, 10**6])
def test_pack(spark, cell):
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 90, 120).tolist()
    rows = [(k, "w " * n, "en", "a", 1) for k, n in enumerate(sizes)] + HARD
    df = docs(spark, [(*r, "b", 1) for r in rows], DOCS + ", bin string, piece int")
    got = [tuple(r) for r in packing.pack(df, 32, cell).select("bin", "slot_offset", "doc_id", "piece", "start_token", "n_tokens").collect()]
    all_sizes = [*sizes, 60, 70, 70, 1, 1]
    pieces = [x for n in all_sizes for x in [32] * (n // 32) + ([n % 32] if n % 32 else [])]
    n_bins = check_packed(got, pieces, 32)
    assert n_bins == brute_bins(pieces, 32)
    starts = {(d, p): s for _, _, d, p, s, _ in got if d is not None}
    assert all(s == 32 * p for (_, p), s in starts.items())
    assert packing.pack(docs(spark, HARD[:3])).count() == 0


def test_packing_query_covers_every_token(spark):
    got = packing.op5_packing(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    total = sum(len(re.findall("[^ \\t\\n\\f\\r]+", r.text)) for r in table.select("text").collect())
    assert sum(r.n_tokens for r in got) == total
    check_packed([(r.bin, r.slot_offset, r.doc_id, r.piece, r.start_token, r.n_tokens) for r in got], [r.n_tokens for r in got], packing.CONTEXT)


# sharding


@pytest.mark.parametrize(("shards", "cell"), [(7, 3), (64, 10**6), (1, 5)])
def test_sharding(spark, shards, cell):
    rows = [(k, None, None, f"s{k % 3}" if k % 10 else "rare", 0) for k in range(200)] + [(None, None, None, None, 0), (5, None, None, "s2", 0), (6, None, None, None, 0)]
    df = docs(spark, [(*r, 1, "c") for r in rows], DOCS + ", shard int, key string")
    got = sharding.assign(df, shards, cell=cell).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for s, own in by.items():
        assert sorted(r.position for r in own) == list(range(len(own)))
        assert abs(len(own) - len(rows) / shards) < 1
        for source in {r.source for r in got}:
            whole = sum(1 for r in got if r.source == source)
            assert abs(sum(1 for r in own if r.source == source) - whole / shards) <= 2
    places = {(r.doc_id, r.source, r.shard, r.position) for r in sharding.assign(df.repartition(5), shards, cell=10).collect()}
    assert places == {(r.doc_id, r.source, r.shard, r.position) for r in got}
    assert sharding.assign(docs(spark, []), shards).count() == 0


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = [(k, f"t{k}", "en", "a", k) for k in range(20)] + [(7, "other", "en", "a", 1)] * 3 + [(None, "x", "en", None, 2), (None, "y", "en", None, 3)]
    for k, df in enumerate((docs(spark, rows).withColumn("_shard", F.lit(5)), docs(spark, rows).withColumn("_shard", F.lit(5)).orderBy("text"))):
        names = sharding.write_shards(df, str(tmp_path / f"out{k}"), shards=4, cell=3)
        back = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert tuples(back, *df.columns) == sorted([(*r, 5) for r in rows], key=repr)
        want = tuples(sharding.assign(df, 4, cell=100), "doc_id", "source", "shard", "position")
        assert tuples(back, "doc_id", "source", *[f"`{n}`" for n in names]) == want
    sharding.write_shards(docs(spark, []), str(tmp_path / "none"))


def test_one_id_with_many_rows_is_split_into_cells(spark):
    keyed = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("row"))
    keyed = keyed.withColumn("key", F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.md5(F.col("row").cast("string"))))
    cells = sharding._celled(keyed, 20)
    sizes = [r["count"] for r in cells.groupBy("source", "cell").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 80
    ordered = [r.cell for r in cells.orderBy("key").collect()]
    assert ordered == sorted(ordered)


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    def hinted(df):
        return "Hint" in df._jdf.queryExecution().logical().toString()

    few, wide = spark.range(10), spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("x"))
    assert hinted(storage.small(few)) and not hinted(storage.small(few, rows=9)) and not hinted(storage.small(wide, size=5000)) and hinted(storage.small(wide, size=50_000))


# quality rules


def test_quality_on_hard_rows(spark):
    good = "A plain sentence with some words in it. " * 8
    rows = [(k + 1000, good + f"Number {k}.", "en", "s", 1) for k in range(150)] + [(500, "### $$$ %%% " * 60, "en", "s", 1), (501, "SHOUTING ALL THE TIME " * 30, "en", "s", 1), (502, "same same " * 80, "en", "s", 1), (503, "one line\n" * 80, "en", "s", 1), *HARD]
    wide = docs(spark, [(*r, 5, "m") for r in rows], DOCS + ", upper_pm int, `_lang` string")
    kept = quality.quality_filter(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(range(1000, 1150)) <= set(ids) and not {500, 501, 502, 503, 1, 2, 3} & set(ids)
    columns = ["doc_id", "lang", "source", *quality.SPREADS]
    plain = wide.select("doc_id", "text", "lang", "source", "n_chars")
    assert tuples(quality.quality_scores(plain), *columns) == in_sql(quality.SQL, columns, {"documents": plain})
    assert sorted(ids, key=repr) == sorted([r.doc_id for r in quality.quality_scores(plain).collect()], key=repr)
    assert quality.quality_filter(docs(spark, [])).count() == 0


def test_quality_keeps_a_uniform_group(spark):
    odd = docs(spark, [(k, "### *** loud LOUD", "zz", "odd", 1) for k in range(120)])
    assert quality.quality_filter(odd).count() == 120


def test_quality_sketches_merge(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    m = quality.measure(table)
    whole = tuples(quality.sketches(m), "lang", "source", "signal", "bucket", "n")
    halves = quality.sketches(m.filter("word_decis % 2 = 0")).unionByName(quality.sketches(m.filter("word_decis % 2 = 1")))
    assert tuples(halves.groupBy("lang", "source", "signal", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), "lang", "source", "signal", "bucket", "n") == whole
