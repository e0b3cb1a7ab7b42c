"""Exact substring deduplication: bytes of a repeated string go from all but its first document.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document
of smaller id. Three passes over the documents, which lie in one bucketed table, so texts
are shuffled once:

1. Each string of ``length`` bytes has an anchor, the least hashed gram of ``GRAM`` bytes in
   it, so equal strings have equal anchors. A batch of documents sends the fingerprints of
   its anchors, four bytes each and one for equal ones, to the part of the fingerprint space
   they fall in; the part answers with a bit for each: held by two documents or not.
2. Shared anchors are sent with their context, all strings around them; contexts whose bytes
   are equal are one, with their smallest and largest id, in a batch and again in a part. The
   part sorts the strings of its contexts as suffixes: blockwise, one bucket of suffixes at a
   time, long ties by the ranks of a difference cover (:mod:`skyloom.llm.suffix_array`).
   Neighbours in that order that agree on ``length`` bytes form a class, and the class has a
   smallest id. The batch gets back, per context, which of its strings have a class with an
   id below the context's smallest, and which with one below its largest.
3. The batch marks the bytes covered. Nothing is removed but by a class of the sort; hashes
   only choose what is compared.

Everything a task holds is a batch of documents or a part of the fingerprints, both of
bounded size; a string in a third of all documents is one context per batch.

Null texts are empty, and texts shorter than ``length`` lose nothing; equal ids never remove
from each other; null ids come last; an empty table gives an empty result; extra columns
are ignored. Rows are dealt to batches by id and text, so null or repeated ids crowd none.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.suffix_array import PERIOD, sort_suffixes
from skyloom.llm.text import read, tidy
from skyloom.plans.shared import delete, discard, materialize, shared_dir

NAME = "op6_difference_cover_dedup"

LENGTH = 50
GRAM = 20
BATCH_BYTES = 8 << 20
PART_ANCHORS = 1 << 18
#: Bytes of text per anchor, on average: half a window of grams.
SPACING = 16
_CHUNK = 1 << 16
_ROWS = 1 << 16
_PAD = 0xFF  # in no UTF-8 text
_LAST = np.iinfo(np.int64).max

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram, by doubling."""
    have = {1: data.astype(np.uint64) + np.uint64(1)}
    power = {1 << k: np.uint64(pow(int(_M1), 1 << k, 1 << 64)) for k in range(gram.bit_length())}
    size = 1
    while 2 * size <= gram:
        have[2 * size] = have[size][:-size] * power[size] + have[size][size:]
        size *= 2
    out, done = None, 0
    for s in sorted(have, reverse=True):
        while done + s <= gram:
            part = have[s]
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = out[:n] * power[s] + part[done : done + n]
            done += s
    return _mixed(out)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    out, size = keys, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - size :][: len(keys) - width + 1])


class Anchors:
    """Anchors of some documents' strings: place, first and last string, document, hash."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
        self.data, self.length, self.gram = data, length, gram
        cols: list[list] = [[], [], [], [], []]
        step = _CHUNK
        for a in range(0, max(0, len(data) - length + 1), step):
            b = min(len(data), a + step + length - 1)
            hashes = gram_hashes(data[a:b], gram)
            keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
            least = _least(keys, length - gram + 1)
            least &= np.uint64(0xFFFFFF)
            change = np.ones(len(least), bool)
            np.not_equal(least[1:], least[:-1], out=change[1:])
            first = np.searchsorted(starts, (a, a + len(least)))
            change[starts[first[0] : first[1]] - a] = True
            edge = np.flatnonzero(change)
            place, doc = least[edge].astype(np.int64), np.searchsorted(starts, edge + a, side="right") - 1
            # strings that run over the end of their document are at its end
            last = np.minimum(np.append(edge[1:], len(least)) - 1, ends[doc] - length - a)
            keep = edge + a + length <= ends[doc]
            edge, last, place, doc = edge[keep], last[keep], place[keep], doc[keep]
            for col, x in zip(cols, (place + a, edge + a, last + a, doc, hashes[place])):
                col.append(x)
        empty = np.empty(0, np.int64)
        self.place, self.first, self.last, self.doc = (np.concatenate([empty, *c]).astype(np.int64) for c in cols[:4])
        self.hash = np.concatenate([np.empty(0, np.uint64), *cols[4]])
        self.start, self.end = starts, ends

    @functools.cached_property
    def _padded(self) -> np.ndarray:
        edge = lambda n: np.full(n, _PAD, np.uint8)
        return np.concatenate((edge(self.length - self.gram), self.data, edge(self.length)))

    def contexts(self, pick: np.ndarray) -> np.ndarray:
        """Rows of the bytes around anchors, as far as a string that holds the anchor may reach, within the document."""
        before, size = self.length - self.gram, 2 * self.length - self.gram
        rows = np.lib.stride_tricks.sliding_window_view(self._padded, size)[self.place[pick]]
        lo = self.start[self.doc[pick]] - (self.place[pick] - before)
        hi = self.end[self.doc[pick]] - (self.place[pick] - before)
        cut = np.flatnonzero((lo > 0) | (hi < size))
        k = np.arange(size)
        part = rows[cut]
        part[(k < lo[cut, None]) | (k >= hi[cut, None])] = _PAD
        rows[cut] = part
        return rows


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    if rows.shape[1] % 8:
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    words = np.ascontiguousarray(rows).view(np.uint64)
    for k in range(words.shape[1]):
        h = _mixed((h ^ words[:, k]) * _M1 + np.uint64(k))
    return h


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct one, each row's place among these): hashes bring equal rows together, bytes tell."""
    order = np.argsort(_hash_rows(rows), kind="stable")
    new = np.ones(len(order), bool)
    for a in range(0, len(order) - 1, _ROWS):
        some = rows[order[a : a + _ROWS + 1]]
        new[a + 1 : a + len(some)] = (some[1:] != some[:-1]).any(1)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class Batch:
    """The documents of one batch and the order in which it names its anchors and contexts."""

    def __init__(self, table: pa.Table, parts: int, length: int, gram: int):
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST)
        self.ids = np.asarray(ids, dtype=np.int64)
        self.null = np.asarray(table.column("doc_id").is_null())
        buffers = text.buffers()
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        # Documents without bytes share their start with the next one, which is found first.
        self.anchors = a = Anchors(self.data, self.offsets[:-1], self.offsets[1:], length, gram)
        self.part = ((a.hash >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        code = self.part.astype(np.uint64) << np.uint64(32) | (a.hash & np.uint64(0xFFFFFFFF))
        self.codes, self.of = np.unique(code, return_inverse=True)
        self.owner = self.ids[a.doc]

    def several(self) -> np.ndarray:
        """Which fingerprints two documents of the batch hold."""
        low, high = np.full(len(self.codes), _LAST), np.full(len(self.codes), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.owner)
        np.maximum.at(high, self.of, self.owner)
        return low != high

    def split(self, parts_of: np.ndarray):
        """(part, from, to) of a list sorted by part."""
        edge = np.flatnonzero(np.diff(parts_of)) + 1
        bounds = [0, *edge.tolist(), len(parts_of)] if len(parts_of) else []
        return [(int(parts_of[a]), a, b) for a, b in zip(bounds, bounds[1:])]

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """Occurrences whose anchor another document holds, from the parts' bits."""
        bits = np.zeros(len(self.codes), bool)
        for part, a, b in self.split((self.codes >> np.uint64(32)).astype(np.int64)):
            if part in answers:
                bits[a:b] = np.unpackbits(np.frombuffer(answers[part], np.uint8), count=b - a).astype(bool)
        return np.flatnonzero(bits[self.of])

    def entries(self, pick: np.ndarray) -> tuple:
        """Distinct contexts of the occurrences ``pick``: an occurrence of each, its part, and each occurrence's context.

        Hashes bring equal contexts together, bytes tell whether they are.
        """
        hashes = np.empty(len(pick), np.uint64)
        for a in range(0, len(pick), _ROWS):
            hashes[a : a + _ROWS] = _hash_rows(self.anchors.contexts(pick[a : a + _ROWS]))
        order = np.lexsort((hashes, self.codes[self.of[pick]], self.part[pick]))
        new = np.ones(len(order), bool)
        for a in range(0, len(order) - 1, _ROWS):
            rows = self.anchors.contexts(pick[order[a : a + _ROWS + 1]])
            new[a + 1 : a + len(rows)] = (rows[1:] != rows[:-1]).any(1)
        new[1:] |= self.of[pick][order][1:] != self.of[pick][order][:-1]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        lead = pick[order[new]]
        return lead, self.part[lead], entry

    def range_of(self, pick: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest id that holds each context."""
        low, high = np.full(n, _LAST), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, entry, self.owner[pick])
        np.maximum.at(high, entry, self.owner[pick])
        return low, high


def _tidied(run, sides: int):
    """``run`` of a key and one or two tables, which leaves the worker small."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        tidy()
        return out

    def two(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        tidy()
        return out

    return one if sides == 1 else two


_ANCHORS = "batch int, part int, codes binary, several binary"
_BITS = "batch int, part int, kind int, answer binary"
_CONTEXTS = "batch int, part int, contexts binary, low binary, high binary, first binary, last binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(schema: list[tuple], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


_I, _B = pa.int32(), pa.binary()


def _anchor_rows(parts: int, length: int, gram: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = Batch(table, parts, length, gram)
        several, low = b.several(), (b.codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(key[0].as_py(), part, low[s:e].tobytes(), np.packbits(several[s:e]).tobytes()) for part, s, e in b.split((b.codes >> np.uint64(32)).astype(np.int64))]
        return _table([("batch", _I), ("part", _I), ("codes", _B), ("several", _B)], rows)

    return run


def _answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, np.uint32) for x in table.column("codes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table.column("several").to_pylist(), lists)]
    _, of, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    yes = n > 1
    yes[of[np.concatenate(several)]] = True
    rows, at = [], 0
    for batch, c in zip(table.column("batch").to_pylist(), lists):
        rows.append((batch, key[0].as_py(), 0, np.packbits(yes[of[at : at + len(c)]]).tobytes()))
        at += len(c)
    return _table([("batch", _I), ("part", _I), ("kind", _I), ("answer", _B)], rows)


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {p: a for p, k, a in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "answer"))) if k == kind}


def _context_rows(parts: int, length: int, gram: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = [("batch", _I), ("part", _I), ("contexts", _B), ("low", _B), ("high", _B), ("first", _B), ("last", _B)]
        if not docs.num_rows:
            return _table(schema, [])
        b = Batch(docs, parts, length, gram)
        pick = b.shared(_answers(answers, 0))
        lead, part_of, entry = b.entries(pick)
        a, n = b.anchors, len(lead)
        low, high = b.range_of(pick, entry, n)
        before = length - gram
        first, last = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
        np.minimum.at(first, entry, (a.first[pick] - a.place[pick] + before).astype(np.uint8))
        np.maximum.at(last, entry, (a.last[pick] - a.place[pick] + before).astype(np.uint8))
        rows = []
        for part, s, e in b.split(part_of):
            rows.append((key[0].as_py(), part, zlib.compress(a.contexts(lead[s:e]).tobytes(), 1), low[s:e].tobytes(), high[s:e].tobytes(), first[s:e].tobytes(), last[s:e].tobytes()))
        return _table(schema, rows)

    return run


def classes(rows: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """For each context and each of its strings the smallest id of an equal string; the largest number where there is no string or no sort."""
    n, size = rows.shape
    out = np.full((n, size - length + 1), _LAST, np.int64)
    span = np.arange(size - length + 1)
    inside = (span >= first[:, None]) & (span <= last[:, None])
    # Equal strings have equal anchors: a context of one document, alone with its anchor's gram, needs no sorting.
    gram = np.ascontiguousarray(rows[:, size - length : length])
    _, of, many = np.unique(_hash_rows(gram), return_inverse=True, return_counts=True)
    c, o = np.nonzero(inside & ((many[of] > 1) | (high > low))[:, None])
    if not len(c):
        return out
    # Equal strings lie at the same place of their contexts. Contexts as long as a multiple of
    # the cover's period give them the same residue, hence one shift into the sample.
    wide = -(-size // PERIOD) * PERIOD
    text = np.full((n, wide), _PAD, np.uint8)
    text[:, :size] = rows
    text = text.reshape(-1)
    at = sort_suffixes(text, c * wide + o, depth=length)
    same = np.zeros(len(at), bool)
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    for a in range(0, len(at) - 1, 1 << 17):
        b = min(len(at) - 1, a + (1 << 17))
        near = strings[at[a : b + 1]]
        same[a + 1 : b + 1] = (near[1:] == near[:-1]).all(1)
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(low[at // wide], heads)
    out[at // wide, at % wide] = np.repeat(least, np.diff(np.append(heads, len(at))))
    return out


def _answer_contexts(length: int, gram: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = 2 * length - gram
        counts = [len(x) // 8 for x in table.column("low").to_pylist()]
        rows = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8).reshape(-1, size) for x in table.column("contexts").to_pylist()])
        low, high = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("low", "high"))
        first, last = (np.concatenate([np.frombuffer(x, np.uint8) for x in table.column(c).to_pylist()]) for c in ("first", "last"))
        lead, of = _distinct(rows)
        n = len(lead)
        lows, highs, lo, hi = np.full(n, _LAST), np.full(n, np.iinfo(np.int64).min), np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
        np.minimum.at(lows, of, low)
        np.maximum.at(highs, of, high)
        np.minimum.at(lo, of, first)
        np.maximum.at(hi, of, last)
        least = classes(rows[lead], lows, highs, lo, hi, length)[of]
        gone = np.packbits(np.concatenate((least < low[:, None], least < high[:, None]), axis=1), axis=1)
        out, at = [], 0
        for batch, n in zip(table.column("batch").to_pylist(), counts):
            out.append((batch, key[0].as_py(), 1, gone[at : at + n].tobytes()))
            at += n
        return _table([("batch", _I), ("part", _I), ("kind", _I), ("answer", _B)], out)

    return run


def _marked(b: Batch, answers: pa.Table, length: int, gram: int) -> np.ndarray:
    """Bytes of the batch to remove."""
    pick = b.shared(_answers(answers, 0))
    gone = np.zeros(len(b.data) + 1, np.int32)
    if not len(pick):
        return gone[:-1] > 0
    lead, part_of, entry = b.entries(pick)
    spots, a = length - gram + 1, b.anchors
    masks, got = np.zeros((len(lead), 2 * spots), bool), _answers(answers, 1)
    for part, s, e in b.split(part_of):
        masks[s:e] = np.unpackbits(np.frombuffer(got[part], np.uint8).reshape(e - s, -1), axis=1, count=2 * spots).astype(bool)
    low, _ = b.range_of(pick, entry, len(lead))
    # Of a context's ids the smallest asks the first mask; for all others its smallest is a smaller one, so they ask
    # whether the class has an id below the largest.
    later = b.owner[pick] > low[entry]
    starts = np.zeros(len(b.data) + 1, bool)
    base = a.place[pick] - (length - gram)
    span = np.arange(spots)
    for s in range(0, len(pick), 1 << 17):
        k = slice(s, s + (1 << 17))
        own = (base[k, None] + span >= a.first[pick[k], None]) & (base[k, None] + span <= a.last[pick[k], None])
        both = masks[entry[k]]
        q, o = np.nonzero(own & np.where(later[k, None], both[:, spots:], both[:, :spots]))
        starts[base[k][q] + o] = True
    at = np.flatnonzero(starts)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + length, -1)
    return np.cumsum(gone[:-1]) > 0


def _results(parts: int, length: int, gram: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        if not docs.num_rows:
            return _table(schema, [])
        b = Batch(docs, parts, length, gram)
        gone = _marked(b, answers, length, gram)
        rows = []
        for k, (s, e) in enumerate(zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())):
            cut = gone[s:e]
            n = int(cut.sum())
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if n else 0
            left = b.data[s:e][~cut] if n else b.data[s:e]
            rows.append((None if b.null[k] else int(b.ids[k]), e - s, n, spans, hashlib.sha256(left.tobytes()).hexdigest()))
        return _table(schema, rows)

    return run


def _texts(parts: int, length: int, gram: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = [("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))]
        if not docs.num_rows:
            return _table(schema, [])
        b = Batch(docs, parts, length, gram)
        gone = _marked(b, answers, length, gram)
        rows = []
        for k, (s, e) in enumerate(zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[s:e].astype(np.int8), [0]))))
            rows.append((None if b.null[k] else int(b.ids[k]), b.data[s:e][~gone[s:e]].tobytes(), edge.reshape(-1, 2).tolist()))
        return _table(schema, rows)

    return run


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, part_anchors: int = PART_ANCHORS, texts: bool = False) -> DataFrame:
    """Per document the bytes removed, or with ``texts`` the bytes kept and the spans removed."""
    size = 2 * length - gram
    if not 0 < gram <= length or size > 255:
        raise ValueError("a context, twice the length less the gram, may have 255 bytes")
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // (SPACING * part_anchors)), min(4 * tasks, -(-total // (1 << 16))))  # work for every task
    buckets = int(min(10_000, max(batches, tasks)))
    name = f"skyloom_batches_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    spread = narrow.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(batches, buckets))).cast("int"))
    try:
        spread.repartition(buckets, "batch").write.bucketBy(buckets, "batch").option("compression", "zstd").option("path", path).saveAsTable(name)
        table = spark.table(name)
        anchors = table.groupBy("batch").applyInArrow(_tidied(_anchor_rows(parts, length, gram), 1), _ANCHORS)
        bits = materialize(anchors.groupBy("part").applyInArrow(_tidied(_answer_anchors, 1), _BITS), "bits")
        sent = table.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(_tidied(_context_rows(parts, length, gram), 2), _CONTEXTS)
        masks = materialize(sent.groupBy("part").applyInArrow(_tidied(_answer_contexts(length, gram), 1), _BITS), "masks")
        both = bits.unionByName(masks)
        finish, schema = (_texts, "doc_id long, kept binary, spans array<array<long>>") if texts else (_results, _RESULT)
        out = materialize(table.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(_tidied(finish(parts, length, gram), 2), schema), "deduplicated")
        discard(bits)
        discard(masks)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))


ORACLE_SQL = None  # byte positions of UTF-8 text are beyond the oracle; held against brute force
