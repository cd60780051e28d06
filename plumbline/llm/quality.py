"""Quality rules with adaptive thresholds.

Each signal of a document is a smoothed rate, kept as an integer. A group
(language, source) is summarised by a quantile sketch of each signal: counts of
logarithmic-linear buckets, seven leading bits exact, so a quantile is off by
less than 1/64. Sketches merge by adding counts, so those of a language and of
the corpus come from the same counts. A group's quartiles are shrunk towards its
language's, and those towards the corpus's, as if PRIOR documents of the parent
were added: n documents weigh n / (n + PRIOR). The cutoff is an outer fence,
Q3 + FENCE * max(IQR, the signal's least spread), so a group without outliers
loses nothing. Documents are then
joined with the cutoffs of their group and filtered.

Defined cases: null, empty or blank text is rejected. A null language or source
is a group of its own. Repeated rows count as often as they occur and share
their fate; a value equal to its cutoff is kept. An empty table gives an empty
result. Texts of any length are measured whole. Further columns are passed
through by ``quality_filter``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpointed, small, written

#: Least spread of each signal, in its own unit.
SPREADS = {"symbol_pm": 10, "upper_pm": 60, "repeat_pm": 50, "dupline_pm": 60, "word_decis": 20}
FENCE = 3
#: Documents that the parent of a group counts for.
PRIOR = 100.0


def signals(t: Column) -> Column:
    """Struct of a text's signals, integers of 0 or more.

    symbol_pm: characters that are no letters, digits, white space or usual
    punctuation, a thousand characters (50 added). upper_pm: upper-case letters,
    likewise. repeat_pm: words equal to the next, a thousand words (20 added).
    dupline_pm: lines seen before in the text, a thousand lines (10 added).
    word_decis: mean length of a word in tenths, 20 words of 5 added.
    """
    chars, n_words, lines = F.length(t), F.regexp_count(t, F.lit("[^ \\n]+")), F.split(t, "\\n")
    symbols = F.length(F.regexp_replace(t, "[\\p{L}\\p{N} \\n\\t.,;:'\"?!()-]+", ""))
    # a back-reference, not an array of words: no lambda that the optimiser could fill with a repeated split
    repeats = F.regexp_count(t, F.lit("(?<![^ \\n])([^ \\n]++)(?=[ \\n]+\\1(?![^ \\n]))"))
    return F.struct(
        F.floor(1000 * symbols / (chars + 50)).cast("long").alias("symbol_pm"),
        F.floor(1000 * F.regexp_count(t, F.lit("\\p{Lu}")) / (chars + 50)).cast("long").alias("upper_pm"),
        F.floor(1000 * repeats / (n_words + 20)).cast("long").alias("repeat_pm"),
        F.floor(1000 * (F.size(lines) - F.size(F.array_distinct(lines))) / (F.size(lines) + 10)).cast("long").alias("dupline_pm"),
        F.floor(10 * (chars + 100) / (n_words + 20)).cast("long").alias("word_decis"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): mergeable quantile sketches; measured has lang, source and the signals."""
    long = measured.select("lang", "source", F.explode(F.create_map(*[x for s in SPREADS for x in (F.lit(s), F.col(s))])).alias("signal", "v"))
    drop = F.greatest(F.length(F.bin("v")) - 7, F.lit(0))
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), drop), drop)
    return long.groupBy("lang", "source", "signal", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, one cutoff a signal) for every group of the sketch."""
    levels = sketch.withColumn("level", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    lang, source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))
    merged = levels.groupBy("level", lang.alias("klang"), source.alias("ksource"), "signal", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy("level", "klang", "ksource", "signal")
    ranked = merged.withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    spread = F.create_map(*[F.lit(x) for kv in SPREADS.items() for x in kv])
    fences = ranked.groupBy("level", "klang", "ksource", "signal").agg(
        F.first("total").alias("total"),
        F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )
    groups = sketch.select("lang", "source", "signal").distinct()
    out = groups
    for k in (0, 1, 2):
        f = fences.filter(F.col("level") == k).select(F.col("klang").alias(f"l{k}"), F.col("ksource").alias(f"s{k}"), F.col("signal").alias(f"g{k}"), F.col("total").alias(f"n{k}"), F.col("q1").alias(f"a{k}"), F.col("q3").alias(f"b{k}"))
        on = F.col("signal") == F.col(f"g{k}")
        if k < 2:
            on &= F.col("lang").eqNullSafe(F.col(f"l{k}"))
        if k < 1:
            on &= F.col("source").eqNullSafe(F.col(f"s{k}"))
        out = out.join(f, on, "left")

    def shrunk(q: str) -> Column:
        parent = F.col(f"{q}2").cast("double")
        for k in (1, 0):
            parent = (F.col(f"n{k}") * F.col(f"{q}{k}") + PRIOR * parent) / (F.col(f"n{k}") + PRIOR)
        return parent

    limit = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("signal")].cast("double"))
    out = out.select("lang", "source", "signal", shrunk("a").alias("q1"), shrunk("b").alias("q3")).withColumn("cutoff", limit)
    return out.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"{s}_max") for s in SPREADS])


def _within(measured: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({"lang": "_klang", "source": "_ksource"})
    on = measured["lang"].eqNullSafe(limits["_klang"]) & measured["source"].eqNullSafe(limits["_ksource"])
    for s in SPREADS:
        # not a bare comparison: from that the optimiser infers filters that measure every text again
        on &= F.coalesce(measured[s] <= limits[f"{s}_max"], F.lit(False))
    return measured.join(limits, on, "left_semi")


def measure(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep, lang, source and the signals of every document with text."""
    rows = docs.filter(docs["text"].rlike("[^ \\n\\t]")).select(*keep, docs["lang"].alias("_lang"), docs["source"].alias("_source"), signals(docs["text"]).alias("_signals"))
    kept = rows.columns[: len(keep)]
    return rows.select(*kept, F.col("_lang").alias("lang"), F.col("_source").alias("source"), "_signals.*")


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the signals of the documents that pass."""
    measured = written(measure(docs, docs["doc_id"]), "signals")
    return _within(measured, small(checkpointed(cutoffs(checkpointed(sketches(measured))))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    # rows are written with their signals: measuring costs more than writing and reading them
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    measured = written(measure(docs, row), "signals")
    limits = checkpointed(cutoffs(checkpointed(sketches(measured))))
    return _within(measured, small(limits)).select("_row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


MEASURED_SQL = """
measured AS (
  SELECT *, floor(1000 * (chars - length(regexp_replace(text, '[^\\p{L}\\p{N} \\n\\t.,;:''"?!()-]+', '', 'g'))) / (chars + 50))::BIGINT AS symbol_pm,
    floor(1000 * (chars - length(regexp_replace(text, '\\p{Lu}+', '', 'g'))) / (chars + 50))::BIGINT AS upper_pm,
    floor(1000 * len([1 for i in range(1, len(words)) if words[i] = words[i + 1]]) / (len(words) + 20))::BIGINT AS repeat_pm,
    floor(1000 * (len(lines) - len(list_distinct(lines))) / (len(lines) + 10))::BIGINT AS dupline_pm,
    floor(10 * (chars + 100) / (len(words) + 20))::BIGINT AS word_decis
  FROM (SELECT *, length(text) AS chars, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS words, string_split(text, chr(10)) AS lines
        FROM documents WHERE regexp_matches(text, '[^ \\n\\t]'))),
sketch AS (
  SELECT lang, source, signal, (v >> d) << d AS bucket, count(*) AS n FROM (
    SELECT lang, source, signal, v, greatest(length(bin(v)) - 7, 0)::BIGINT AS d FROM measured
    UNPIVOT (v FOR signal IN (symbol_pm, upper_pm, repeat_pm, dupline_pm, word_decis))) GROUP BY ALL),
merged AS (
  SELECT level, CASE WHEN level < 2 THEN lang END AS klang, CASE WHEN level < 1 THEN source END AS ksource, signal, bucket, sum(n) AS n
  FROM sketch, (VALUES (0), (1), (2)) t(level) GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, klang, ksource, signal ORDER BY bucket) AS cum,
    sum(n) OVER (PARTITION BY level, klang, ksource, signal) AS total FROM merged),
quartiles AS (
  SELECT level, klang, ksource, signal, max(total) AS total, min(bucket) FILTER (4 * cum >= total) AS q1, min(bucket) FILTER (4 * cum >= 3 * total) AS q3
  FROM ranked GROUP BY ALL),
quarters AS (
  SELECT g.lang, g.source, g.signal,
    (a.total * a.q1 + {PRIOR} * ((b.total * b.q1 + {PRIOR} * c.q1::DOUBLE) / (b.total + {PRIOR}))) / (a.total + {PRIOR}) AS q1,
    (a.total * a.q3 + {PRIOR} * ((b.total * b.q3 + {PRIOR} * c.q3::DOUBLE) / (b.total + {PRIOR}))) / (a.total + {PRIOR}) AS q3
  FROM (SELECT DISTINCT lang, source, signal FROM sketch) g
  LEFT JOIN quartiles a ON a.level = 0 AND a.klang IS NOT DISTINCT FROM g.lang AND a.ksource IS NOT DISTINCT FROM g.source AND a.signal = g.signal
  LEFT JOIN quartiles b ON b.level = 1 AND b.klang IS NOT DISTINCT FROM g.lang AND b.signal = g.signal
  LEFT JOIN quartiles c ON c.level = 2 AND c.signal = g.signal),
chosen AS (
  SELECT lang, source, signal, q3 + {FENCE} * greatest(q3 - q1, CASE signal WHEN 'symbol_pm' THEN 10 WHEN 'upper_pm' THEN 60 WHEN 'repeat_pm' THEN 50 WHEN 'dupline_pm' THEN 60 ELSE 20 END::DOUBLE) AS cutoff
  FROM quarters)
""".replace("{PRIOR}", f"{PRIOR}::DOUBLE").replace("{FENCE}", str(FENCE))

SQL = f"""
WITH {MEASURED_SQL}
SELECT doc_id, lang, source, symbol_pm, upper_pm, repeat_pm, dupline_pm, word_decis FROM measured m
WHERE NOT EXISTS (
  SELECT 1 FROM chosen t WHERE t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source
    AND CASE t.signal WHEN 'symbol_pm' THEN symbol_pm WHEN 'upper_pm' THEN upper_pm WHEN 'repeat_pm' THEN repeat_pm WHEN 'dupline_pm' THEN dupline_pm ELSE word_decis END > t.cutoff)
"""
