"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased terms, hashed to 2**31 buckets. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so a pair of terms can count for more, or less, than the two on their own. Fitted by
logistic loss on at most ``max_rows`` labelled rows (those of smallest hashed id) and
``ROW_TERMS`` terms of each (those of smallest hash), which alone reach the driver: these
bounds keep the fit on one machine, while every document is scored in full by the executors.
Rows whose terms agree in four min-hashes are near copies and count once.

The long tail of terms would learn the noise of single labels, so the machine holds terms
for which there is evidence: those that part the classes on their own by 4.5 standard
errors, and those that do in company. For the latter an additive model is fitted first;
each pair of the ``PAIR_TERMS`` most frequent terms, and each pair of one of the strongest
and any other term of ``MIN_PAIR`` rows, is held against it: do the rows that have both come
out toxic more or less often than the two would have it each alone? Pairs beyond 6 standard
errors (of arcsines, which hold for small counts too) bring both their terms in, however
neutral each is on its own. Weights and factors are regularised.

Null and empty texts have no terms and score by ``w0``; a document with several labels counts
as toxic if one says so; rows with null labels or ids are not learned from; without
labels every score is 0; an empty table gives an empty result; extra columns are kept, but
one named ``score`` is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.text import crc_of_id, read

NAME = "op8_factorization_toxicity"
ORACLE_SQL = None  # a fitted model; held against held-out labels instead

BUCKETS = 1 << 31
FACTORS = 8
MAX_ROWS = 12_000
#: Terms of a row that the fit may see; the most frequent ones whose pairs are tested; rows that must hold both of a pair.
ROW_TERMS, PAIR_TERMS, MIN_PAIR = 4096, 2048, 20

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct hashed terms of a whole text, ascending."""
    if not text:
        return np.empty(0, np.int32)
    words = set(text.encode("utf-8", "surrogatepass").translate(_TERMS).split())
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(w) & (buckets - 1) for w in words), np.int32, len(words)))


def _termed(text: pa.Array) -> pa.Array:
    return pa.array([terms(t.as_py()) for t in text], pa.list_(pa.int32()))


def text_terms(text: Column) -> Column:
    return F.arrow_udf(_termed, "array<int>")(text)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that stop at ``ends``; empty runs sum to 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def _places(rows: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' terms among sorted ``ids``, run together without unknown terms, and the ends of the rows."""
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    at = np.searchsorted(ids, flat)
    ok = (at < len(ids)) & (np.append(ids, -1)[np.minimum(at, len(ids))] == flat)
    upto = np.concatenate(([0], np.cumsum(ok)))
    return at[ok], upto[np.cumsum([len(r) for r in rows], dtype=np.int64)]


def _scores(at: np.ndarray, ends: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    inner = _sums(v[at], ends)
    return w0 + _sums(w[at], ends) + 0.5 * ((inner**2).sum(1) - _sums((v[at] ** 2).sum(1), ends))


def logits(rows: list[np.ndarray], model: tuple) -> np.ndarray:
    w0, ids, w, v = model
    return _scores(*_places(rows, ids), w0, w, v) if rows else np.empty(0)


def probabilities(z: np.ndarray) -> np.ndarray:
    """0 to 1; exactly 0 where nothing was learned."""
    return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _apart(rows: list[np.ndarray], labels: np.ndarray, errors: float = 4.5, share: float = 0.0005) -> np.ndarray:
    """Sorted terms that are commoner in one class than chance allows."""
    ids, of = np.unique(np.concatenate([np.empty(0, np.int32), *rows]), return_inverse=True)
    y = np.repeat(labels, [len(r) for r in rows])
    one = np.bincount(of, y, len(ids))
    zero = np.bincount(of, minlength=len(ids)) - one
    n1 = max(1.0, float(labels.sum()))
    n0 = max(1.0, len(labels) - float(labels.sum()))
    both = (zero + one + 1) / (n0 + n1 + 2)
    z = (one / n1 - zero / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    kept = np.flatnonzero((np.abs(z) >= errors) & (zero + one >= max(4, share * len(rows))))
    return ids[kept]


def _once(rows: list[np.ndarray]) -> list[int]:
    """The first row of each set of four min-hashes."""
    first: dict = {}
    for k, r in enumerate(rows):
        mixed = r.astype(np.uint64)
        key = tuple(int(((mixed + np.uint64(1)) * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917, 668265263)) if len(r) else ()
        first.setdefault(key, k)
    return list(first.values())


def _arcsine(n: np.ndarray, hits: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Standard errors by which ``hits`` of ``n`` differ from those expected."""
    angle = lambda k: np.arcsin(np.sqrt(np.clip((k + 0.375) / (n + 0.75), 0, 1)))
    return 2 * np.sqrt(n + 0.75) * (angle(hits) - angle(expected))


def _in_pairs(rows: list[np.ndarray], labels: np.ndarray, chances: np.ndarray, alone: np.ndarray, errors: float = 6.0, frequent: int = PAIR_TERMS, least: int = MIN_PAIR) -> np.ndarray:
    """Terms of pairs whose rows have other labels than ``chances``, an additive model, makes of them."""
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    ids, of, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
    found = np.zeros(len(ids), bool)
    # The most frequent terms among each other.
    top = np.flatnonzero(counts >= least)
    top = top[np.lexsort((ids[top], -counts[top]))[:frequent]]
    place = np.full(len(ids), -1)
    place[top] = np.arange(len(top))
    held = place[of] >= 0
    table = np.zeros((len(rows), len(top)), np.float32)
    table[owner[held], place[of[held]]] = 1
    y, p = labels.astype(np.float32), chances.astype(np.float32)
    for a in range(0, len(top), 256):
        part = table[:, a : a + 256]
        n, hits, expected = ((part * weight[:, None]).T @ table for weight in (np.ones_like(y), y, p))
        z = np.where(n >= least, _arcsine(n, hits, expected), 0)
        z[np.arange(len(z)), np.arange(len(z)) + a] = 0  # a term with itself
        i, j = np.nonzero(np.abs(z) >= errors)
        found[top[a + i]] = found[top[j]] = True
    # Terms that matter on their own with all others.
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    for term in np.searchsorted(ids, alone[:frequent]):
        mine = owner[of == term] if counts[term] >= least else ()
        if not len(mine):
            continue
        sizes = ends[mine] - starts[mine]
        at = of[np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
        n, hits, expected = (np.bincount(at, None if w is None else np.repeat(w[mine], sizes), len(ids)) for w in (None, labels, chances))
        z = np.where(n >= least, _arcsine(n, hits, expected), 0)
        z[term] = 0
        more = np.abs(z) >= errors
        found |= more
        found[term] |= more.any()
    return ids[found]


def _learned(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, factors: int, steps: int, rate: float, decay: tuple[float, float], seed: int) -> tuple:
    """(w0, terms, w, v) by Adam on the whole sample; the same rows in the same order give the same model."""
    share = float(np.clip(labels.mean(), 0.001, 0.999))
    start = float(np.log(share / (1 - share)))
    if not len(ids):
        return start, ids, np.empty(0), np.empty((0, factors))
    at, ends = _places(rows, ids)
    sizes = np.diff(ends, prepend=0)
    rng = np.random.default_rng(seed)
    p = np.concatenate((np.zeros((len(ids), 1)), rng.normal(0, 0.05, (len(ids), factors))), axis=1)
    p = np.vstack((p, [start, *[0.0] * factors]))  # the last row holds w0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        u = p[:-1, 1:]
        z = _scores(at, ends, p[-1, 0], p[:-1, 0], u)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        each = np.repeat(error, sizes)
        g = p * np.array([decay[0], *[decay[1]] * factors])  # of weights and of factors
        g[:-1, 0] += np.bincount(at, each, len(ids))
        if factors:
            pull = each[:, None] * (np.repeat(_sums(u[at], ends), sizes, axis=0) - u[at])
            g[:-1, 1:] += np.stack([np.bincount(at, pull[:, f], len(ids)) for f in range(factors)], 1)
        g[-1] = [error.sum(), *[0.0] * factors]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return float(p[-1, 0]), ids, p[:-1, 0], p[:-1, 1:]


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, steps: int = 400, rate: float = 0.05, decay: tuple[float, float] = (1e-5, 1e-3), seed: int = 7) -> tuple:
    """(w0, terms, w, v) of a machine over the terms that matter alone or in pairs."""
    if not rows:
        return -np.inf, np.empty(0, np.int32), np.empty(0), np.empty((0, factors))
    single = _once(rows)
    rows, labels = [rows[k] for k in single], labels[single]
    alone = _apart(rows, labels)
    additive = _learned(rows, labels, alone, 0, steps // 2, rate, decay, seed)
    pairs = _in_pairs(rows, labels, probabilities(logits(rows, additive)), alone)
    return _learned(rows, labels, np.union1d(alone, pairs), factors, steps, rate, decay, seed)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple:
    """A model of the labelled rows; ids only choose and join the rows."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    # A share by hash leaves a bounded number of rows to order.
    share = min(1.0, 2 * max_rows / max(1, labels.count()))
    chosen = chosen.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_rows)
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select("__id", "__y", F.slice(text_terms(F.col(text).cast("string")), 1, ROW_TERMS).alias("t"))  # max_rows rows at most
    got = rows.toArrow().sort_by([("__id", "ascending")])
    lists = got.column("t").combine_chunks()
    return fit([np.asarray(x.values, np.int32) for x in lists], np.asarray(got.column("__y"), np.float64)) if len(got) else fit([], np.empty(0))


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Adds ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), 512):
            out.append(logits([terms(t.as_py()) for t in texts[a : a + 512]], shared.value))
        z = np.concatenate(out) if out else np.empty(0)
        return pa.array(probabilities(z), pa.float64())

    return docs.withColumn("score", scored(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_of_id(F.col("doc_id")) % 5 != 0))
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out")
    out = score(docs.select("doc_id", held, "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
