"""SimHash near-duplicates by segment popcounts and a grid range-join.

A fingerprint's 64 bits are cut into 32 segments of two bits. The bit counts of the segments
embed it in a grid where the Manhattan distance is a lower bound of the Hamming distance: a
flipped bit moves one count by one. The counts are kept in thermometer form (a count of c as
c low bits), so the Manhattan distance of two embeddings is the bit count of their exclusive
or.

Range join: the segments form m blocks. Fingerprints at most d bits apart differ in at most d
blocks, so they agree on all others, and meet in the grid cell that the counts of some m - d
blocks make up. Within a cell a pair is tested by the lower bound, then exactly. Cells of up
to ``FEW`` fingerprints send all links they hold, larger ones the shortest links that span
them, never more than one fewer than their members: a chain of links connects whatever a
link connects, and no group sends its pairs. A cell of more than ``dense`` fingerprints is
split again by the same embedding: pairs that meet in it because the blocks are untouched
differ in the left-out blocks only, so these are cut into d + 2 parts, two of which agree,
now with segments of one bit. Each split takes at least two fifths off what is left out; at
14 bits it ends, where a cell holds 2**14 fingerprints at most. Equal fingerprints are one
node from the start.

There are at least d + 3 blocks, more where cells of independent fingerprints would hold more
than ``EXPECTED``; what is connected does not depend on it.

``near_duplicates`` is that of one fingerprint over three-word shingles and two bits.

``filter_documents`` finds documents of similar wording. Their texts are sets of five-word
shingles, linked at a Jaccard similarity of 0.8 or more. One fingerprint of such shingles is
no help there: an edited word changes five shingles, and similar texts are nine bits apart.
So the candidates come from ``PRINTS`` fingerprints over single words, weighed by the
logarithm of their count, and the range join above in each of them: what links of at most
``WIDE`` bits in any of them connect is a group. All pairs of a group are then compared
exactly on their shingles, however many bits apart, but inside the tasks, which return
verified links that span what they hold: no pairs become rows, and no chain of links is
broken by the verification, as it would be if only links that span a cell were verified.
The README tells the recall.

Null and empty texts, and texts without words, have fingerprint zero and are linked like
any other; repeated rows count each; an empty table gives an empty result; extra columns
are ignored by :func:`near_duplicates` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm import shingles
from skyloom.llm.text import read, tidy
from skyloom.operators.components import connected_components
from skyloom.plans.shared import materialize, settled

NAME = "op9_segment_popcount_simhash"
ORACLE_SQL = None  # XXH64 with a seed is beyond the oracle's functions

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Cells of more fingerprints are split again; those of up to so many send all links; expected members of a cell, from which the number of blocks follows.
DENSE, FEW, EXPECTED = 4096, 8, 4
#: Left-out bits at which splitting ends.
LAST_BITS = 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints a text and bits in which one may differ, for the search of similar wording.
PRINTS, WIDE = 8, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded working memory for very long texts
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at : at + (1 << 16)].tolist())]
        total += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def _fingerprinted(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in text], pa.binary())


def fingerprints(text: Column) -> Column:
    """Fingerprints of a text column; declared not deterministic, so that the optimizer makes no second call."""
    return F.arrow_udf(_fingerprinted, "binary").asNondeterministic()(text)


def prints_of(hashes: np.ndarray, counts: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """``prints`` fingerprints of words with these hashes, a word of count c weighing 1 + log2 c in eighths."""
    total, steps = np.zeros(64 * prints, np.int64), np.arange(1, prints + 1, dtype=np.uint64) * _STEP
    order = np.argsort(counts, kind="stable")
    hashes, counts = hashes[order], counts[order]
    edges = [0, *(np.flatnonzero(np.diff(counts)) + 1).tolist(), len(counts)]
    for start, end in zip(edges, edges[1:]):
        if start == end:
            continue
        ones = np.zeros(64 * prints, np.int64)
        for a in range(start, end, 255):  # as many as a byte counts
            own = shingles.mixed(hashes[a : min(end, a + 255), None] + steps).astype(">u8").view(np.uint8)
            ones += np.add.reduce(np.unpackbits(own, axis=1), axis=0, dtype=np.uint8)
        total += int(np.rint(8 + 8 * np.log2(counts[start]))) * (2 * ones - (end - start))
    return np.packbits(total > 0).view(">u8").astype(np.uint64).view(np.int64)


def word_prints(text: str | None, prints: int = PRINTS) -> np.ndarray:
    """Fingerprints of the whole text's words."""
    return prints_of(*shingles.word_hashes(text)[1:], prints)


def _long(c):
    """The eight bytes as a signed 64-bit number."""
    hexed = F.hex(c)
    high, low = (F.conv(F.substring(hexed, p, 8), 16, 10).cast("long") for p in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _mask(v: int):
    return F.lit(_signed(v)).cast("long")


_LOW = int("01" * 32, 2)


def _thermometer(fp):
    """The embedding: each two-bit segment's count c as its c low bits."""
    shifted = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseOR(shifted).bitwiseAND(_mask(_LOW)), fp.bitwiseAND(shifted).bitwiseAND(_mask(_LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` even runs of the bits."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def layout(count: int, distance: int) -> list[tuple[int, int]]:
    """(bits that agree, bits left out) for each kind of cell, for so many fingerprints."""
    m = next((m for m in range(distance + 3, 12) if count <= EXPECTED * 2 ** (48 * (m - distance) / m)), 12)
    segments = _parts(list(range(32)), m)
    blocks = [sum(3 << 2 * s for s in range(32) if x >> s & 1) for x in segments]
    full = (1 << 64) - 1
    return [(full ^ sum(out), sum(out)) for out in combinations(blocks, distance)]


def split(kind: tuple[int, int], distance: int) -> list[tuple[int, int]]:
    """The kinds of cells that one kind is split into."""
    agree, left = kind
    parts = _parts([b for b in range(64) if left >> b & 1], distance + 2)
    return [(agree | left ^ sum(out), sum(out)) for out in combinations(parts, distance)]


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Shortest links that connect what links of at most ``distance`` bits connect, as places in ``fps``."""
    one, two = fps & np.uint64(_LOW), fps >> np.uint64(1) & np.uint64(_LOW)
    counts = one | two | (one & two) << np.uint64(1)  # the embedding
    left, best, source = np.arange(1, len(fps)), np.full(len(fps) - 1, 99, np.uint8), np.zeros(len(fps) - 1, np.int64)
    out, now = [], 0
    while len(left):
        bound = np.bitwise_count(counts[left] ^ counts[now])
        near = np.flatnonzero((bound <= distance) & (bound < best))
        exact = np.bitwise_count(fps[left[near]] ^ fps[now])
        better = exact < best[near]
        best[near[better]], source[near[better]] = exact[better], now
        k = int(best.argmin())
        now = int(left[k])
        if best[k] <= distance:
            out.append((now, int(source[k])))
        for x in (left, best, source):
            x[k] = x[-1]
        left, best, source = left[:-1], best[:-1], source[:-1]
    return out


def _spanned(distance: int):
    def run(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells:
            fps = np.sort(np.asarray(cell.values, np.int64).view(np.uint64))
            pairs = np.sort(fps.view(np.int64)[np.array(spanning(fps, distance), np.int64).reshape(-1, 2)], axis=1)
            out.append([{"src": int(b), "dst": int(a)} for a, b in pairs])
        return pa.array(out, pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64())])))

    return run


def _near(distance: int):
    def run(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells:
            fps = np.sort(np.asarray(cell.values, np.int64))
            own = fps.view(np.uint64)
            near = ((k, np.flatnonzero(np.bitwise_count(own[k + 1 :] ^ own[k]) <= distance) + k + 1) for k in range(len(fps)))
            out.append([{"src": int(b), "dst": int(fps[k])} for k, found in near for b in fps[found]])
        return pa.array(out, pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64())])))

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, dense: int = DENSE, whole: bool = False) -> DataFrame:
    """Links (k, src, dst), src above dst, of at most ``distance`` bits that connect all distinct (``k``, ``fp``) that such links of one k connect.

    With ``whole`` these are all links of so few bits: what is tested once more must not stand on a chain, which that test may break.
    """
    spark = nodes.sparkSession
    most = nodes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    kinds = layout(most or 0, distance)
    every = f"explode(flatten(transform(l, a -> transform(filter(l, b -> b.fp > a.fp and bit_count(a.t ^ b.t) <= {distance} and bit_count(a.fp ^ b.fp) <= {distance}), b -> struct(b.fp as src, a.fp as dst)))))"
    spanned = F.arrow_udf((_near if whole else _spanned)(distance), "array<struct<src:long,dst:long>>")
    t = _thermometer(F.col("fp"))
    rows = nodes.select("k", "fp", F.posexplode(F.array(*[t.bitwiseAND(_mask(agree)) for agree, _ in kinds])).alias("kind", "cell"))
    found = None
    while True:
        sizes = rows.groupBy("k", "kind", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        placed = materialize(rows.join(sizes.hint("merge"), ["k", "kind", "cell"]), "cells")
        last = all(left.bit_count() <= LAST_BITS for _, left in kinds)
        few = placed.where(F.col("n") <= FEW).groupBy("k", "kind", "cell").agg(F.collect_list(F.struct("fp", t.alias("t"))).alias("l"))
        many = placed.where((F.col("n") > FEW) & (F.lit(last) | (F.col("n") <= dense))).groupBy("k", "kind", "cell").agg(F.collect_list("fp").alias("l"))
        pairs = few.select("k", F.expr(every).alias("x")).unionByName(many.select("k", F.explode(spanned("l")).alias("x"))).select("k", "x.*")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = placed.where(F.col("n") > dense)
        if last or not crowded.limit(1).count():
            return found.distinct()
        finer = [[kind] if kind[1].bit_count() <= LAST_BITS else split(kind, distance) for kind in kinds]
        table, at = [], 0
        for old, x in enumerate(finer):
            table += [(old, at + i, _signed(agree)) for i, (agree, _) in enumerate(x)]
            at += len(x)
        kinds = [kind for x in finer for kind in x]
        # A few kinds a split, some thousands in all whatever the table holds.
        table = F.broadcast(spark.createDataFrame(table, "kind int, finer int, agree long"))
        rows = crowded.select("k", "kind", "fp").join(table, "kind").select("k", "fp", F.col("finer").alias("kind"), F.col("fp").bitwiseAND(F.col("agree")).alias("cell"))


def components(rows: DataFrame, fp: str = "fp", rank: str = "doc_id") -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest ``rank`` that is reachable."""
    nodes = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(rank).alias("own")), "nodes")
    linked = links(nodes.select(F.lit(0).alias("k"), "fp"))
    joined = nodes.join(connected_components(linked), F.col("fp") == F.col("node"), "left")
    joined = joined.select("fp", "own", F.coalesce("component", "fp").alias("root"))
    low = joined.groupBy("root").agg(F.min("own").alias("first"))
    return joined.select("fp", "root").join(low, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text).cast("string")).alias("raw"))
    rows = materialize(rows.select("doc_id", F.lower(F.hex("raw")).alias("fingerprint"), _long(F.col("raw")).alias("fp")), "simhash")
    return rows.join(components(rows), "fp").select("doc_id", "fingerprint", F.col("first").alias("component_id"))


def _printed(prints: int):
    def run(texts: pa.Array) -> pa.Array:
        sig, n, fps = [], [], []
        for t in texts:
            every, hashes, counts = shingles.word_hashes(t.as_py())
            found = shingles.shingles_of(every)
            sig.append(shingles.signature(found))
            n.append(len(found))
            fps.append(prints_of(hashes, counts, prints))
        out = pa.StructArray.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], names=["sig", "n", "fps"])
        del fps
        tidy()
        return out

    return run


def candidates(nodes: DataFrame, distance: int = WIDE, dense: int = DENSE) -> DataFrame:
    """Pairs (src, dst) of nodes (sig, n, fps) to verify: all that are at most ``distance`` bits apart in one of their fingerprints.

    As many as the square of a group of near copies: :func:`filter_documents` takes :func:`groups` instead.
    """
    members = materialize(nodes.where("n > 0").select(F.struct("sig", "n").alias("m"), F.posexplode("fps").alias("k", "fp")), "members")
    end = lambda fp, name: members.select("k", F.col("fp").alias(fp), F.col("m").alias(name))
    alike = end("fp", "x").join(end("fp", "y"), ["k", "fp"]).where("x.sig > y.sig").select("x", "y")
    close = materialize(links(members.select("k", "fp").distinct(), distance, dense, whole=True), "close")
    linked = close.join(end("src", "x"), ["k", "src"]).join(end("dst", "y"), ["k", "dst"]).select("x", "y")
    pairs = alike.unionByName(linked).where("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")  # else 0.8 is out of reach
    return pairs.select(F.greatest("x.sig", "y.sig").alias("src"), F.least("x.sig", "y.sig").alias("dst")).distinct()


def groups(nodes: DataFrame, distance: int = WIDE, dense: int = DENSE) -> DataFrame:
    """(node, component) of nodes (sig, n, fps) that pairs of at most ``distance`` bits in one of their fingerprints connect; nodes without such a pair are left out."""
    members = materialize(nodes.where("n > 0").select("sig", F.posexplode("fps").alias("k", "fp")), "members")
    held = materialize(members.groupBy("k", "fp").agg(F.min("sig").alias("low")), "held")
    end = lambda fp, name: held.select("k", F.col("fp").alias(fp), F.col("low").alias(name))
    alike = members.join(held, ["k", "fp"]).where("sig > low").select(F.col("sig").alias("src"), F.col("low").alias("dst"))
    close = links(held.select("k", "fp"), distance, dense)
    near = close.join(end("src", "x"), ["k", "src"]).join(end("dst", "y"), ["k", "dst"]).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return connected_components(alike.unionByName(near))


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prints: int = PRINTS, distance: int = WIDE, dense: int = DENSE, block: int = shingles.BLOCK) -> DataFrame:
    """One row of each group of documents of similar wording, that of the smallest id, with all its columns.

    Of repeated rows of that id and text one is kept. Texts are shuffled once; shingles are
    made again for the candidates alone.
    """
    body = F.col(text).cast("string")
    rows = docs.withColumns({"__id": F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")), "__h": F.xxhash64(body.isNull(), body)})
    made = F.arrow_udf(_printed(prints), "struct<sig:long,n:int,fps:array<long>>").asNondeterministic()
    found = rows.select(F.struct("__id", "__h").alias("rank"), made(body).alias("x"))
    found = materialize(found.select("rank", "x.*"), "prints")
    nodes = found.groupBy("sig").agg(F.min("rank").alias("own"), F.first("n").alias("n"), F.min_by("fps", "rank").alias("fps"))
    nodes = materialize(nodes, "nodes")
    named = nodes.select(F.col("sig").alias("node"), "n", F.col("own.__id").alias("__id"), F.col("own.__h").alias("__h"))
    grouped = materialize(groups(nodes, distance, dense).join(named, "node").select(F.col("node").alias("sig"), "n", F.col("component").alias("g"), "__id", "__h"), "grouped")
    linked = shingles.similar(grouped, rows.select("__id", "__h", body.alias("text")), block)
    joined = nodes.join(connected_components(linked), F.col("sig") == F.col("node"), "left").select("own", F.coalesce("component", "sig").alias("root"))
    first = joined.groupBy("root").agg(F.min("own").alias("own"))
    counts = found.groupBy("rank").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.join(first, F.col("rank") == F.col("own"), "left_semi")
    first = materialize(first.select(F.col("rank.__id").alias("__id"), F.col("rank.__h").alias("__h"), "__n"), "first")
    kept = rows.join(first.hint("merge"), ["__id", "__h"])  # the same plan at every size
    again = W.partitionBy("__id", "__h").orderBy(F.xxhash64(*docs.columns))
    several = kept.where("__n > 1").withColumn("__k", F.row_number().over(again)).where("__k = 1")
    return kept.where("__n = 1").select(*docs.columns).unionByName(several.select(*docs.columns)) if first.where("__n > 1").limit(1).count() else kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: near_duplicates(read(spark, sf_dir, "documents")), "near")
