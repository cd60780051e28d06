"""The pipeline, stage by stage against brute force, and on hard rows."""

import duckdb
import numpy as np
import pyarrow as pa
from plumbline.llm import langid, neardup, packing, quality, suffix
from test_exact_operators import brute_bins, brute_spans, check_packed
from test_other_operators import brute_similarities, groups_of

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(11)
    vocab = {"en": [f"th{c}{d}" for c in "abcdefgh" for d in "klmnopqrst"], "de": [f"sch{c}{d}" for c in "abcdefgh" for d in "uvwxyzü"]}
    passage = " ".join(rng.choice(vocab["en"], 70))
    rows = []

    def put(text, lang):
        rows.append((len(rows), text, lang, "s", len(text)))

    for k in range(160):
        lang = ("en", "de")[k % 2]
        words = rng.choice(vocab[lang], rng.integers(30, 220)).tolist()
        text = " ".join(words)
        if k % 20 == 0:
            text = f"{text}\n{passage} {' '.join(rng.choice(vocab['en'], 60))}"
        put(text, lang)
        if k % 15 == 0:
            put(text, lang)
        if k % 25 == 0:
            words[len(words) // 2] = "changed"
            put(" ".join(words), lang)
    put("### $$$ %%% " * 40, "en")
    put("LOUD " * 100, "de")
    return rows


def brute(rows):
    """ids kept by the first three stages, and the texts that the fourth leaves."""
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    good = {r[0] for r in con.execute(f"select doc_id from ({quality.SQL})").fetchall()}
    rows = [r for r in rows if r[0] in good]
    order = sorted({(r[0], r[1].lower(), r[2]) for r in rows}, key=lambda r: (r[0] * 2654435761 % 2**32, r))
    model = langid.fit([(t, y) for _, t, y in order])
    found = [int(model.judge(pa.array([r[1].lower()], pa.large_string()))[0][0]) for r in rows]
    rows = [(r[0], r[1], model.langs[f]) for r, f in zip(rows, found) if f >= 0]
    similar = brute_similarities([r[1] for r in rows])
    gone = groups_of([p for p, s in similar.items() if s >= neardup.THRESHOLD], len(rows))
    rows = [r for k, r in enumerate(rows) if k not in gone]
    spans = {}
    for d, a, z, _ in brute_spans([(r[0], r[1]) for r in rows], suffix.DEPTH):
        spans.setdefault(d, []).append((a, z))
    out = []
    for d, text, lang in rows:
        words = text.split()
        drop = {k for a, z in spans.get(d, ()) for k in range(a, z)}
        left = [w for k, w in enumerate(words) if k not in drop]
        if left:
            out.append((d, left, lang))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k == 3:
            assert sorted((r.doc_id, r.text.split(), r.lang) for r in docs.collect()) == sorted(want)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = [x for _, w, _ in want for x in [packing.CONTEXT] * (len(w) // packing.CONTEXT) + ([len(w) % packing.CONTEXT] if len(w) % packing.CONTEXT else [])]
    slots = [(r.bin, r.slot_offset, r.doc_id, r.piece, r.start_token, r.n_tokens) for r in docs.collect()]
    assert check_packed(slots, pieces, packing.CONTEXT) == brute_bins(pieces, packing.CONTEXT)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.select(*whole.columns).collect()))


def test_pipeline_on_hard_rows_and_none(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "no id here but words " * 9, "en", "a", 1), (4, "two rows of one id " * 20, "en", "a", 1), (4, "two rows of one id " * 20, "en", "a", 1), (5, "wörter auf deutsch " * 20, "de", "b", 1), (6, "y z " * 200_000, None, None, 1)]
    for name, some in (("hard", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, "m", 1) for r in some], DOCS + ", bin string, shingle int").write.parquet(str(folder / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(got) == bool(some)
        check_packed([(r.bin, r.slot_offset, r.doc_id, r.piece, r.start_token, r.n_tokens) for r in got], [r.n_tokens for r in got], packing.CONTEXT)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "suffix-array dedup", "best-fit packing"]


def test_scratch_is_in_the_shared_folder(spark):
    from plumbline.llm import storage

    named = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_dir(spark) == named
    df = storage.written(spark.range(3), "test")
    assert all(named in f for f in df.inputFiles())
    assert storage.free("A", ["a", "b", "a_"]) == "A__"
    assert storage.small(spark.range(5), 5)._jdf.queryExecution().logical().toString().find("broadcast") >= 0
    assert storage.small(spark.range(6), 5)._jdf.queryExecution().logical().toString().find("broadcast") < 0


def test_tidy_passes_all_on():
    from plumbline.llm.bytekernels import tidy

    assert list(tidy(lambda xs: (x + 1 for x in xs))(iter([1, 2]))) == [2, 3]
