"""Quality rules with adaptive thresholds.

A fixed base rule rejects very short and very repetitive texts. The texts that pass it
feed quantile sketches, one per language, source and measure; the fences of the second
rule are read off these sketches, so each corner of the corpus is held against itself.

The sketch is a log-linear histogram over whole numbers (64 steps per power of two, hence
at most 1/64 relative error). It merges by adding counts: map tasks combine it before the
shuffle, the sketches of small groups give way to those of their language and then of
all documents, and the result depends on no order of rows.

Null texts have no words; a null language or source is a group of its own; repeated rows
are judged each on its own; an empty table gives an empty result; other columns are kept
as they are by :func:`filter_documents` and ignored by :func:`judge`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.text import read, tidy
from skyloom.plans.shared import materialize

NAME = "op4_adaptive_quality"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Texts a group's sketch must hold before it is used instead of the next wider one.
MIN_GROUP = 50
#: Fences that are sent to every task: some megabytes.
MAX_SENT = 20_000
#: measure: (numerator, factor, denominator, least distance of a fence from the quartile, fence below too)
MEASURES = {
    "symbols": ("n_symbols", 1000, "word_chars", 60, False),
    "capitals": ("n_capitals", 1000, "word_chars", 250, False),
    "lines": ("n_dup_lines", 1000, "n_words", 60, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 180, False),
    "length": ("word_chars", 100, "n_words", 400, True),
}
#: Interquartile ranges between quartile and fence.
REACH = 4

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_dup_lines", "n_repeat_words"]
_STRUCT = pa.struct([(c, pa.int64()) for c in _COUNTS])


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(words: list, window: int = 5) -> int:
    """Words inside a window of so many words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) ** window < 2**62:
        code = np.zeros(n, dtype=np.int64)
        for k in range(window):
            code = code * len(known) + ids[k : k + n]
        code = np.unique(code, return_inverse=True)[1]
    else:
        code = ids[:n]
        for k in range(1, window):
            code = _ranks(code, ids[k : k + n])
    again = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple:
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    codes = np.frombuffer(raw, dtype=np.uint8)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), int(((codes >= 65) & (codes <= 90)).sum()), len(lines) - len(set(lines)), repeated_words(words)


def _counted(text: pa.Array) -> pa.Array:
    rows = zip(*(counts(t.as_py()) for t in text)) if len(text) else [[]] * len(_COUNTS)
    out = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in rows], fields=list(_STRUCT))
    del rows
    tidy()
    return out


def text_counts(text: Column) -> Column:
    """The struct of counts of a text column.

    Declared not deterministic, so that the optimizer makes no second call of it.
    """
    return F.arrow_udf(_counted, "struct<" + ",".join(f"{c}:long" for c in _COUNTS) + ">").asNondeterministic()(text)


def _floor(v: Column) -> Column:
    """The sketch's step that holds ``v``: its seven leading bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(v)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def _measure(name: str, m: str) -> Column:
    top, factor, bottom, _, _ = MEASURES[name]
    return F.expr(f"({m}.{top} * {factor}L) div greatest(1L, {m}.{bottom})")


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def sketch(measured: DataFrame) -> DataFrame:
    """(__lang, __source, measure, step, n) of the rows of (__lang, __source, __m) that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _floor(_measure(k, "__m")).alias("step")) for k in MEASURES])).alias("x")
    rows = measured.where(~base_failed("__m")).select("__lang", "__source", each)
    return rows.groupBy("__lang", "__source", "x.measure", "x.step").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to ``keys``, as rows of (keys, measure, n, q1, q3)."""
    merged = steps.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("step")), "all": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("step")))
    return ranked.groupBy(*keys, "measure").agg(F.first("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(steps: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row of fences per language and source: (__lang, __source, lo_*, hi_*)."""
    own = _quartiles(steps, ["__lang", "__source"])
    wide = _quartiles(steps, ["__lang"]).select("__lang", "measure", *[F.col(c).alias(f"l_{c}") for c in ("n", "q1", "q3")])
    everything = _quartiles(steps, []).select("measure", *[F.col(c).alias(f"a_{c}") for c in ("q1", "q3")])
    rows = own.join(wide, ["__lang", "measure"]).join(everything, "measure")
    pick = lambda q: F.when(F.col("n") >= min_group, F.col(q)).when(F.col("l_n") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    rows = rows.select("__lang", "__source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for k, (_, _, _, least, below) in MEASURES.items():
        mine = F.col("measure") == k
        reach = F.greatest(F.lit(least), REACH * (F.col("q3") - F.col("q1")))
        out.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"hi_{k}"))
        if below:
            out.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"lo_{k}"))
    return rows.groupBy("__lang", "__source").agg(*out)


def within(m: str) -> Column:
    ok = F.lit(True)
    for k, (_, _, _, _, below) in MEASURES.items():
        ok = ok & (_measure(k, m) <= F.col(f"hi_{k}"))
        if below:
            ok = ok & (_measure(k, m) >= F.col(f"lo_{k}"))
    return F.coalesce(ok, F.lit(False))


def _group(c: Column) -> Column:
    """Groups by value with null apart from all of them."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds __base_failed and __kept to rows of (__lang, __source, __m, ...).

    The fences, one row per language and source, are sent to all tasks if there are at most
    ``MAX_SENT`` of them, so that rows stay where they are; else the sides are shuffled.
    """
    fences = materialize(fences, "fences")
    few = fences.limit(MAX_SENT + 1).count() <= MAX_SENT
    fences = fences.select(F.col("__lang").alias("__fl"), F.col("__source").alias("__fs"), *[c for c in fences.columns if c[:2] != "__"])
    fences = F.broadcast(fences) if few else fences
    on = (F.col("__lang") == F.col("__fl")) & (F.col("__source") == F.col("__fs"))
    ok = rows.join(fences, on, "left").withColumns({"__base_failed": base_failed("__m"), "__kept": ~base_failed("__m") & within("__m")})
    return ok.select(*rows.columns, "__base_failed", "__kept")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and verdict of every row, without its text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _group(F.col(lang)).alias("__lang"), _group(F.col(source)).alias("__source"), text_counts(F.col(text).cast("string")).alias("__m"))
    rows = materialize(rows, "quality")
    out = judged(rows, thresholds(sketch(rows)))
    return out.select("doc_id", "__m.*", F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Counting a text again costs less than keeping or shuffling it, so the counts are written
    for the sketches alone and made anew as the rows pass.
    """
    rows = docs.withColumns({"__lang": _group(F.col(lang)), "__source": _group(F.col(source)), "__m": text_counts(F.col(text).cast("string"))})
    fences = thresholds(sketch(materialize(rows.select("__lang", "__source", "__m"), "quality")))
    return judged(rows, fences).where("__kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("n_capitals")


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    measure = {k: f"({top} * {f}) // greatest(1, {bottom})" for k, (top, f, bottom, _, _) in MEASURES.items()}
    steps = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {v} AS v FROM m WHERE NOT base_failed" for k, v in measure.items())
    quart = lambda keys: f"""SELECT {keys} measure, any_value(a) AS n, min(CASE WHEN 4 * upto >= a THEN step END) AS q1, min(CASE WHEN 4 * upto >= 3 * a THEN step END) AS q3 FROM (
      SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY step) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS a FROM (
      SELECT {keys} measure, step, count(*) AS n FROM s GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    pick = lambda q: f"CASE WHEN o.n >= {MIN_GROUP} THEN o.{q} WHEN l.n >= {MIN_GROUP} THEN l.{q} ELSE a.{q} END AS {q}"
    tests = []
    for k, (_, _, _, least, below) in MEASURES.items():
        far = f"greatest({least}, {REACH} * (f.q3 - f.q1))"
        tests.append(f"(f.measure = '{k}' AND ({measure[k]} > f.q3 + {far}" + (f" OR {measure[k]} < f.q1 - {far}" if below else "") + "))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{word}') AS words FROM d),
p AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
five AS (SELECT r, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS five FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos, CASE WHEN five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 THEN 1 ELSE 0 END AS again FROM five),
repeats AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM (SELECT r, max(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '{word}') GROUP BY r),
m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(words) AS base_failed, r
  FROM d JOIN w USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r)),
s AS (SELECT lang, source, measure, (v >> e) << e AS step FROM (SELECT *, greatest(0, length(bin(v)) - 7) AS e FROM ({steps}))),
o AS ({quart("lang, source,")}), l AS ({quart("lang,")}), a AS ({quart("")}),
f AS (SELECT o.lang, o.source, o.measure, {pick("q1")}, {pick("q3")} FROM o JOIN l USING (lang, measure) JOIN a USING (measure)),
bad AS (SELECT DISTINCT m.r FROM m JOIN f USING (lang, source) WHERE {" OR ".join(tests)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM m
"""


ORACLE_SQL = _oracle()
