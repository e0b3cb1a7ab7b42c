"""Sets of word shingles, and the exact verification of candidates by their Jaccard similarity.

A text is the set of its hashed shingles of five words (fewer words are one shingle, no
words the empty set). Two texts are similar if their sets have a Jaccard similarity of at
least 0.8.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.text import tidy
from skyloom.plans.shared import materialize

SHINGLE = 5
SEED = 42
#: Shingles of a group that meet in one task; larger groups are dealt to blocks of about so many.
BLOCK = 1 << 18

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _FACTORS[4]
    h = (h ^ (h >> np.uint64(33))) * _FACTORS[1]
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word of a whole text, hashes of the distinct words, their counts)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(w, SEED) for w in index), np.uint64, len(index))
    return found[at], found, np.bincount(at, minlength=len(index))


def shingles_of(h: np.ndarray) -> np.ndarray:
    """The distinct hashed shingles of words with these hashes, ascending."""
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1 if len(h) else 0
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out + h[j : j + n] * _FACTORS[j])
    return np.unique(out).view(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    return shingles_of(word_hashes(text)[0])


def signature(found: np.ndarray) -> int:
    """A number that equal sets share."""
    h = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >= 1 << 63 else h


def _with_sets(batches):
    """(sig, s, g, blocks) of rows (sig, text, g, blocks), some hundred at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            made = pa.array([shingle_set(t.as_py()) for t in part.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), made, part.column(2), part.column(3)], names=["sig", "s", "g", "blocks"])
        tidy()


def forest(sigs: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Links that connect what links of a similarity of at least 0.8 connect, one fewer than texts at most; across the sides alone, or within the one side."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sigs, sides, sets = sigs[order], sides[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets], np.int64)
    starts, last = np.concatenate(([0], np.cumsum(n))), np.searchsorted(4 * n, 5 * n, side="right")  # else 0.8 is out of reach
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark, root, out = np.zeros(ids.max() + 1, np.int32), np.arange(len(n)), []
    for i in range(len(n)):
        a, z = i + 1, int(last[i])
        open_ = root[a:z] != root[i]
        found = np.flatnonzero(open_ if within else open_ & (sides[a:z] != sides[i])) + a
        if not len(found):
            continue
        a, z = int(found[0]), int(found[-1]) + 1
        mark[ids[starts[i] : starts[i + 1]]] = 1
        both = np.add.reduceat(mark[ids[starts[a] : starts[z]]], starts[a:z] - starts[a])[found - a]
        mark[ids[starts[i] : starts[i + 1]]] = 0
        hits = found[9 * both.astype(np.int64) >= 4 * (n[i] + n[found])]
        joined, first = np.unique(root[hits], return_index=True)
        out += [(int(sigs[i]), int(sigs[j])) for j in hits[first]]
        root[np.isin(root, joined)] = root[i]
    return out


def _forests(batches):
    """Links of the rows (g, low, high, side, sig, s), sorted, of each (g, low, high)."""
    kind = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    now, held = None, []

    def made():
        sides, sigs, sets = (list(chain.from_iterable(part)) for part in zip(*held))
        pairs = forest(np.array(sigs, np.int64), sets, np.array(sides, np.int64), now[1] == now[2])
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=kind)

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            if a == z:
                continue
            key = tuple(keys[a].tolist())
            if now is not None and key != now:
                yield made()
                held = []
            now, part = key, batch.column(5).slice(a, z - a)
            cuts, flat = np.asarray(part.offsets) - part.offsets[0].as_py(), np.asarray(part.flatten())
            own = [flat[b:e].copy() for b, e in zip(cuts, cuts[1:])]  # a view would keep the whole batch
            held.append((batch.column(3).slice(a, z - a).to_pylist(), batch.column(4).slice(a, z - a).to_pylist(), own))
    if held:
        yield made()
    held.clear()
    tidy()


def similar(grouped: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that connect what links of a similarity of at least 0.8 within a group connect.

    ``grouped`` has for each node (sig, n, g) the ``__id`` and ``__h`` of a row of ``texts``.
    All pairs of a group are compared, but never made rows: a group of more than ``block``
    shingles is dealt to blocks, and each pair of blocks returns a forest.
    """
    blocks = grouped.groupBy("g").agg(F.ceil(F.sum(F.col("n").cast("long")) / F.lit(block)).cast("long").alias("blocks"))
    rows = grouped.join(blocks, "g").select("sig", "__id", "__h", "g", "blocks")
    found = texts.join(rows.hint("shuffle_hash"), ["__id", "__h"]).dropDuplicates(["sig"]).select("sig", "text", "g", "blocks")
    made = found.mapInArrow(_with_sets, "sig long, s array<long>, g long, blocks long").withColumn("side", F.expr("pmod(sig, blocks)"))
    pairs = F.expr("explode(transform(sequence(0L, blocks - 1), o -> struct(least(o, side) as low, greatest(o, side) as high)))")
    met = made.select("g", pairs.alias("p"), "side", "sig", "s").select("g", "p.low", "p.high", "side", "sig", "s")
    met = met.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high")
    return materialize(met.mapInArrow(_forests, "src long, dst long"), "similar")
