"""Language by cross-parsing entropy.

For every language a suffix automaton holds a sample of its labelled text. A text is
parsed greedily into the longest phrases that the automaton knows: follow the text until
no substring of the sample continues it, count a phrase, start again. A language whose
sample resembles the text needs few phrases; phrases per character is the score to beat.

Every letter of the samples is a symbol of its own; an automaton knows those of its language.
The automata become transition tables, sorted lists where the alphabet is large, and texts
are cut into blocks of fixed length whose parses advance side by side, one table lookup per
character for all blocks of a batch. The parse of a whole text is put together from these:
the phrase that crosses a border is followed into the next block until a phrase starts where
one of that block's own parse does; from there on both agree. A text in which that fails to
happen within a block is parsed again from its start. So the phrases are those of the whole
text, wherever borders fall.

Bounds of the fit: at most ``max_languages`` labels, and for each at most ``sample_chars``
characters, at most ``doc_chars`` of them from one document, chosen by hashed id; the
automata of all languages take at most ``TABLE_BYTES``. They do not grow with the corpus. Labels beyond ``max_languages`` raise an error.

Null texts and texts without a letter are ``und`` with score 0; ties go to the first
language by code point; without labelled text all are ``und``; an empty table gives an empty
result; repeated rows are predicted each; extra columns are kept, but those named
``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm.text import crc_of_id, read

NAME = "op5_cross_parsing_langid"
ORACLE_SQL = None  # automata; held against held-out labels instead

SAMPLE_CHARS = 40_000
DOC_CHARS = 2_000
MAX_LANGUAGES = 200
#: Widest alphabet of a language whose automaton is a dense table.
SYMBOLS = 56
BLOCK = 256
#: All automata together, as sent to the executors; with many languages the samples shrink.
TABLE_BYTES = 256 << 20
#: Documents of a language that are drawn to choose the sample from.
DRAWN = 8_000


def alphabet(samples: list[str]) -> np.ndarray:
    """Code point to symbol: 0 parts words, each letter of the samples has a symbol of its own, letters that none holds share the last."""
    letters = sorted({c for s in samples for c in s.lower() if c.isalpha()})
    number = {c: k + 1 for k, c in enumerate(letters)}
    return np.array([number.get(chr(p).lower()[:1], len(letters) + 1) if chr(p).isalpha() else 0 for p in range(0x110000)], dtype=np.int32)


def encode(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text; runs of what is no letter count once."""
    out = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def automaton(sample: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Transition table of the sample's suffix automaton; -1 where nothing continues, state 0 is the empty match."""
    go = np.full((2 * len(sample) + 2, symbols), -1, dtype=np.int32)
    length, link = [0] * len(go), [-1] * len(go)
    size, last = 1, 0
    for c in sample.tolist():
        now, size = size, size + 1
        length[now] = length[last] + 1
        p = last
        while p >= 0 and go[p, c] < 0:
            go[p, c] = now
            p = link[p]
        if p < 0:
            link[now] = 0
        else:
            q = int(go[p, c])
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin, size = size, size + 1
                go[twin] = go[q]
                length[twin], link[twin] = length[p] + 1, link[q]
                while p >= 0 and go[p, c] == q:
                    go[p, c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return go[:size]


class Compact:
    """The automaton of one language over the symbols of its own sample.

    Up to ``SYMBOLS`` symbols its transitions are a dense table ``go``, beyond that sorted
    ``keys`` (state times width plus symbol) and their ``targets``. ``local`` numbers the
    symbols of all languages; those that the sample lacks share the last number.
    """

    def __init__(self, sample: np.ndarray, symbols: int):
        seen = np.unique(np.append(sample, 0))
        self.wide = len(seen) + 1
        self.local = np.full(symbols, self.wide - 1, dtype=np.int64)
        self.local[seen] = np.arange(len(seen))
        inner = self.local[sample] if len(sample) else sample
        self.go = automaton(inner, self.wide) if self.wide <= SYMBOLS else None
        if self.go is None:
            pairs = sorted((p * self.wide + c, q) for p, after in enumerate(_sparse(inner)) for c, q in after.items())
            self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
            self.targets = np.array([q for _, q in pairs], dtype=np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The state after each key, -1 where nothing continues."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.targets[at], -1)


def _sparse(sample: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the sample's suffix automaton by state."""
    go, length, link, last = [{}], [0], [-1], 0
    for c in sample.tolist():
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return go


class _Stepper:
    """One symbol further in an automaton, for many parses at once."""

    def __init__(self, table):
        self.local, self.sparse = None, None
        if isinstance(table, Compact):
            self.local, self.sparse = table.local, table if table.go is None else None
            table = table.go
        if self.sparse:
            self.wide = self.sparse.wide
            self.none = -self.wide
            first = self.sparse.follow(np.arange(self.wide))
            self.first = np.where(first < 0, self.none, first * self.wide)
            return
        # One more state, where nothing continues, stands before the first symbol and
        # after one that the sample lacks: the next symbol starts a phrase.
        self.wide, self.none = table.shape[1], table.size
        self.lookup = np.append(np.ravel(table), np.full(self.wide, -1, np.int32))
        self.first = np.where(table[0] < 0, self.none, table[0].astype(np.int64) * self.wide)

    def __call__(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, parses in which a phrase starts at these symbols)."""
        after = self.sparse.follow(state + symbols) if self.sparse else self.lookup.take(state + symbols)
        hit = np.flatnonzero(after < 0)
        after = after.astype(np.int64) * self.wide
        after[hit] = self.first[symbols[hit]]
        return after, hit


def _one_text(symbols: np.ndarray, step: _Stepper) -> int:
    """Phrases of one text, symbol by symbol."""
    codes = (step.local.take(symbols) if step.local is not None else symbols).tolist()
    first, state, found = step.first.tolist(), step.none, 0
    if step.sparse:
        known = dict(zip(step.sparse.keys.tolist(), step.sparse.targets.tolist()))
        after = lambda key: known.get(key, -1)
    else:
        after = step.lookup.tolist().__getitem__
    for c in codes:
        state = after(state + c) * step.wide
        if state < 0:
            found += 1
            state = first[c]
    return found


def phrases(texts: list[np.ndarray], tables: list, block: int = BLOCK) -> np.ndarray:
    """Phrases that each text needs in each language, shape (texts, languages)."""
    counts = np.array([-(-len(t) // block) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), len(tables)), dtype=np.int64)
    n = int(counts.sum())
    if not n:
        return out
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.concatenate([np.minimum(block, len(t) - block * np.arange(c)) for t, c in zip(texts, counts.tolist()) if c])
    flat = np.zeros((n, block), dtype=np.int64)
    at = 0
    for t, c in zip(texts, counts.tolist()):
        flat[at : at + c].reshape(-1)[: len(t)] = t
        at += c
    order = np.argsort(-size, kind="stable")  # blocks that still run stay in front
    lane = np.empty(n, np.int64)
    lane[order] = np.arange(n)
    columns = np.ascontiguousarray(flat[order].T)
    running = np.searchsorted(-size[order], -np.arange(block), side="left")
    crossing = np.flatnonzero(owner[1:] == owner[:-1])  # blocks that another one of their text follows
    ends_text = np.append(owner[1:] != owner[:-1], True)
    for k, table in enumerate(tables):
        step = _Stepper(table)
        symbols = step.local.take(columns) if step.local is not None else columns
        state, starts = np.full(n, step.none, dtype=np.int64), np.zeros((block, n), dtype=bool)
        for j in range(block):
            m = running[j]
            if not m:
                break
            state[:m], hit = step(state[:m], symbols[j, :m])
            starts[j, hit] = True
        out[:, k] = np.bincount(owner[order], starts.sum(0), len(texts))
        # Follow the phrase over each border until the parses agree.
        live, now = crossing, state[lane[crossing]]
        change, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        before = np.zeros(len(crossing), np.int64)  # own starts passed, less those of the phrases followed
        for j in range(block):
            over = size[live + 1] <= j
            if over.any():  # the text ends before they agree
                np.add.at(change, owner[live[over]], -before[over])
                live, now, before = live[~over], now[~over], before[~over]
            if not len(live):
                break
            ahead = lane[live + 1]
            now, hit = step(now, symbols[j, ahead])
            own = starts[j, ahead]
            start = np.zeros(len(live), bool)
            start[hit] = True
            agree = own & start
            before += own.astype(np.int64) - start
            if agree.any():
                np.add.at(change, owner[live[agree]], -before[agree])
                live, now, before = live[~agree], now[~agree], before[~agree]
        last = ends_text[live + 1]
        np.add.at(change, owner[live[last]], -before[last])
        again[owner[live[~last]]] = True
        out[:, k] += change
        for t in np.flatnonzero(again).tolist():
            out[t, k] = _one_text(texts[t], step)
    return out


def samples(docs: DataFrame, doc_id: str, text: str, lang: str, sample_chars: int, doc_chars: int, max_languages: int) -> dict[str, str]:
    """{language: sample} of labelled rows, the same for the same rows."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("string").alias("id"), F.least(F.lit(doc_chars), F.length(text)).alias("n"))
    rows = rows.where("n > 0").withColumn("h", F.xxhash64("id"))
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).limit(max_languages + 1).collect()
    if len(many) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not many:
        return {}
    sample_chars = min(sample_chars, TABLE_BYTES // (2 * 4 * SYMBOLS * len(many)))
    # A share of each language by hash leaves a bounded number of rows to rank.
    shares = F.create_map(*[F.lit(x) for r in many for x in (r["lang"], min(1.0, DRAWN / r["c"]))])
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * (1 << 30))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1))
    picked = near.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < sample_chars)
    ids = F.broadcast(picked.select("id", F.col("lang").alias("__l")).distinct())  # sample_chars of each language at most
    got = docs.join(ids, (F.col(doc_id).cast("string") == F.col("id")) & (F.col(lang).cast("string") == F.col("__l"))).select("__l", "id", F.substring(F.col(text).cast("string"), 1, doc_chars).alias("t"))
    out: dict[str, list[str]] = {}
    for r in sorted(got.collect(), key=lambda r: (r["__l"], r["id"], r["t"])):
        out.setdefault(r["__l"], []).append(r["t"])
    return {k: "\n".join(v)[:sample_chars] for k, v in sorted(out.items())}


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS, doc_chars: int = DOC_CHARS, max_languages: int = MAX_LANGUAGES) -> tuple:
    """(languages, symbol table, automata)."""
    found = samples(docs, doc_id, text, lang, sample_chars, doc_chars, max_languages)
    table = alphabet(list(found.values()))
    return list(found), table, [Compact(encode(s, table), int(table.max()) + 1) for s in found.values()]


def predict(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``: the share of the runner-up's phrases that the winner saves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def parsed(texts: pa.Array) -> pa.Array:
        languages, table, automata = shared.value
        langs, scores = [], []
        pending, chars = [], 0

        def flush():
            need = phrases(pending, automata)
            for row, t in zip(need, pending):
                if not languages or not t.any():
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                rest = np.delete(row, best)
                langs.append(languages[best])
                scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)

        for t in texts:
            pending.append(encode(t.as_py() or "", table))
            chars += len(pending[-1])
            if chars > 1 << 21:
                flush()
                pending, chars = [], 0
        flush()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select("*", parsed(F.col(text).cast("string")).alias("__parsed"))
    return out.select(*kept, "__parsed.lang_pred", "__parsed.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
