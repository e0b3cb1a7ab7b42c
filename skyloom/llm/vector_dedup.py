"""Near-duplicate vectors by small-world graphs, one per shard.

Vectors of a label are dealt by hash into shards. A shard's vectors form a hierarchical
navigable small-world graph, built and searched for whole batches at once. Every vector
queries every shard of its label, its own included. A query whose beam is full of links is
repeated with a wider beam. Before, a sample of the queries (ids divisible by 50, 32 at least)
is held against brute force: the mean share of its own links that a query finds, and how
many queries find their nearest vector. Beams widen until these reach ``RECALL`` and
``NEAREST``; a group with many links counts no more than any other query, and without any
link the nearest vectors still count. A beam that has grown to a quarter of the shard takes
in all of it, so widening ends. :func:`search` returns these figures with the links.

Links found are verified with cosines in double precision. A pair of shards returns a link
count per vector and a spanning forest of its links, so a dense group of k vectors sends
O(k) rows. Equal vectors of a label are one node with a multiplicity. Components are the
union over all shard pairs.

A label has 16 shards, of ``SHARD_ROWS`` to ``MOST_ROWS`` vectors, and more shards where that
is not enough. To query every shard takes work in proportion to vectors times shards, so
shards are as large as a task's memory allows: one of 32,768 vectors takes 1.1 kB a vector
at 64 numbers, a pair of them two bits a pair of vectors besides. Graphs of a large label
travel in blocks of up to eight, each of which meets every other block once.

Vectors that are null, zero, or hold null or non-finite components, and vectors with a null
label or id, link with nothing and are components of their own; vectors of different length
never link; repeated rows of one id count as separate vectors, each with its own links, and
share a component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.text import read
from skyloom.operators.components import connected_components
from skyloom.plans.shared import materialize, settled

NAME = "op10_hnsw_vector_dedup"
ORACLE_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (WITH RECURSIVE w(s, d) AS (SELECT s, d FROM l UNION SELECT w.s, l.d FROM w JOIN l ON w.d = l.s) SELECT s, min(d) AS m FROM w GROUP BY s)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.s = vec_id)::BIGINT AS n_links, least(vec_id, coalesce((SELECT m FROM r WHERE r.s = vec_id), vec_id))::BIGINT AS component_id,
  vec_id = least(vec_id, coalesce((SELECT m FROM r WHERE r.s = vec_id), vec_id)) AS kept FROM v
"""

THRESHOLD = 0.98
SHARD_ROWS, MOST_ROWS = 4096, 32_768
LINKS = 12
BEAM = 48
#: What the audit asks for: mean share of a query's links, share of queries that find their nearest vector.
RECALL, NEAREST = 0.999, 0.9


class Layer:
    """One level of the graph: nodes, and for each the rows of its neighbours (-1: none)."""

    def __init__(self, width: int):
        self.nodes = np.empty(0, np.int64)
        self.near = np.empty((0, width), np.int32)
        self.sims = np.empty((0, width), np.float32)

    def add(self, vectors: np.ndarray, new: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Appends nodes with their candidates (rows of this layer) and the links back."""
        old, width, half = len(self.nodes), self.near.shape[1], self.near.shape[1] // 2
        self.nodes = np.concatenate((self.nodes, new))
        self.near = np.concatenate((self.near, np.full((len(new), width), -1, np.int32)))
        self.sims = np.concatenate((self.sims, np.full((len(new), width), -2, np.float32)))
        inner = vectors[new] @ vectors[new].T
        np.fill_diagonal(inner, -2)
        rows = np.concatenate((found, np.broadcast_to(old + np.arange(len(new)), inner.shape)), 1)
        sims = np.concatenate((sims, inner), 1)
        order = np.argsort(-sims, 1)[:, : 3 * width]
        rows, sims = np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)
        for k in range(len(new)):
            own = np.flatnonzero((sims[k] > -2) & (rows[k] >= 0))
            if not len(own):
                continue
            r, s = rows[k, own], sims[k, own]
            cross = vectors[self.nodes[r]] @ vectors[self.nodes[r]].T
            kept: list[int] = []
            for c in range(len(r)):  # diverse links first: nearer to the node than to any link before
                if len(kept) == half:
                    break
                if not kept or s[c] > cross[c, kept].max():
                    kept.append(c)
            rest = [c for c in range(len(r)) if c not in kept][: width - len(kept)]
            kept += rest if len(kept) + len(rest) <= width else []
            at = old + k
            self.near[at, : len(kept)], self.sims[at, : len(kept)] = r[kept], s[kept]
            for c in kept[: half + 2]:
                self._back(int(r[c]), at, float(s[c]), half)

    def _back(self, at: int, to: int, sim: float, half: int) -> None:
        """A link back takes a free place, or that of the farthest in the second half if it is nearer."""
        row = self.near[at]
        if (row == to).any():
            return
        free = np.flatnonzero(row < 0)
        spot = int(free[0]) if len(free) else half + int(self.sims[at, half:].argmin())
        if len(free) or self.sims[at, spot] < sim:
            row[spot], self.sims[at, spot] = to, sim

    def search(self, vectors: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best rows found from the rows ``start``, and their similarities, best first."""
        n, b = len(self.nodes), len(queries)
        if n <= max(beam, 128):
            sims = queries @ vectors[self.nodes].T
            rows = np.argsort(-sims, 1)[:, :beam]
            return rows, np.take_along_axis(sims, rows, 1)
        seen = np.zeros((b, n), bool)
        each = np.arange(b)[:, None]
        rows, sims = self._scored(vectors, queries, start, seen, each)
        done = np.zeros(rows.shape, bool)
        while True:
            width = min(beam, rows.shape[1])
            top = np.argpartition(-sims, width - 1, 1)[:, :width]
            rows, sims, done = (np.take_along_axis(x, top, 1) for x in (rows, sims, done))
            open_ = np.where(done | (rows < 0), -np.inf, sims)
            k = min(wide, open_.shape[1])
            pick = np.argpartition(-open_, k - 1, 1)[:, :k]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            chosen = np.where(live, np.take_along_axis(rows, pick, 1), -1)
            around = np.where(chosen[:, :, None] >= 0, self.near[chosen], -1).reshape(b, -1)
            new, near = self._scored(vectors, queries, around, seen, each)
            rows, sims = np.concatenate((rows, new), 1), np.concatenate((sims, near), 1)
            done = np.concatenate((done, np.zeros(new.shape, bool)), 1)
        order = np.argsort(-sims, 1)
        return np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)

    def _scored(self, vectors, queries, rows, seen, each):
        rows = np.sort(rows.astype(np.int64), 1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
        rows[seen[each, rows] & (rows >= 0)] = -1
        fresh = rows >= 0
        q, c = np.nonzero(fresh)
        sims = np.full(rows.shape, -np.inf, np.float32)
        if len(q):
            at = rows[q, c]
            seen[q, at] = True
            sims[q, c] = np.einsum("nd,nd->n", queries[q], vectors[self.nodes[at]])
        return rows, sims


class Graph:
    """Layers over unit vectors; the top layer comes last."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 5):
        self.vectors = vectors
        rng = np.random.default_rng(seed)
        n = len(vectors)
        level = np.minimum((-np.log(rng.random(n)) / np.log(16)).astype(int), 4)
        order = rng.permutation(n)
        self.layers = [Layer(2 * links if h == 0 else links) for h in range(int(level.max(initial=0)) + 1)]
        at = 0
        while at < n:
            part = order[at : at + int(np.clip(at // 2, 32, 256))]
            rows = None
            for h in range(len(self.layers) - 1, -1, -1):
                layer, found, sims = self.layers[h], np.empty((len(part), 0), np.int64), np.empty((len(part), 0), np.float32)
                if len(layer.nodes):
                    found, sims = layer.search(vectors, vectors[part], self._entry(h, rows, len(part)), beam)
                rows = layer.nodes[found] if found.shape[1] else None
                mine = level[part] >= h
                if mine.any():
                    layer.add(vectors, part[mine], found[mine], sims[mine])
            at += len(part)
            self._index()

    def _index(self) -> None:
        self.row = []
        for layer in self.layers:
            row = np.full(len(self.vectors), -1, np.int64)
            row[layer.nodes] = np.arange(len(layer.nodes))
            self.row.append(row)

    def _entry(self, h: int, nodes: np.ndarray | None, b: int) -> np.ndarray:
        """Rows of layer h to start from: what the layer above found, else its first nodes."""
        first = np.broadcast_to(np.arange(min(8, len(self.layers[h].nodes))), (b, min(8, len(self.layers[h].nodes))))
        if nodes is None or not nodes.shape[1]:
            return first
        return np.concatenate((self.row[h][nodes[:, :8]], first), 1)

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query's beam, best first."""
        nodes = None
        for h in range(len(self.layers) - 1, -1, -1):
            rows, sims = self.layers[h].search(self.vectors, queries, self._entry(h, nodes, len(queries)), beam if h == 0 else 8)
            nodes = np.where(rows >= 0, self.layers[h].nodes[np.maximum(rows, 0)], -1)
        return nodes, sims

    def within(self, queries: np.ndarray, least: float, beam: int):
        """(first query, links found as a boolean matrix of queries and nodes) for one chunk of queries after the other."""
        n = len(self.vectors)
        for a in range(0, len(queries), 256):
            part = queries[a : a + 256]
            out, todo, width = np.zeros((len(part), n), bool), np.arange(len(part)), beam
            while len(todo):
                if 4 * width >= n:
                    out[todo] = part[todo] @ self.vectors.T >= least
                    break
                nodes, sims = self.near(part[todo], width)
                hit = (sims >= least) & (nodes >= 0)
                q, c = np.nonzero(hit)
                out[todo[q], nodes[q, c]] = True
                todo, width = todo[hit.sum(1) >= width - 2], 4 * width
            yield a, out


def _units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def build(ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> bytes:
    """A shard as bytes: node ids, the smallest id of each node's rows, vectors, multiplicities, graph."""
    order = np.lexsort((ids, own))
    graph = Graph(_units(vectors[order].astype(np.float64)))
    return pickle.dumps((ids[order], own[order], vectors[order], copies[order], [(x.nodes, x.near) for x in graph.layers]), protocol=5)


class Shard:
    def __init__(self, blob: bytes):
        self.ids, self.own, vectors, self.copies, layers = pickle.loads(blob)
        self.exact = vectors.astype(np.float64)
        self.norms = np.linalg.norm(self.exact, axis=1)
        self.graph = Graph.__new__(Graph)
        self.graph.vectors, self.graph.layers = _units(self.exact), []
        for nodes, near in layers:
            layer = Layer(near.shape[1])
            layer.nodes, layer.near = nodes, near
            self.graph.layers.append(layer)
        self.graph._index()

    def audited(self) -> np.ndarray:
        """The rows whose queries are held against brute force."""
        some = np.flatnonzero(self.own % 50 == 0)
        if len(some) >= 32:
            return some
        return np.unique(np.concatenate((some, np.linspace(0, len(self.ids) - 1, min(len(self.ids), 32)).astype(int))))


def audit(queries: np.ndarray, graph: Graph, least: float, beam: int, own: np.ndarray | None = None) -> tuple[float, float]:
    """(mean share of its links that a query finds, share of queries that find their nearest vector); ``own`` are the queries' nodes where they are of the graph."""
    sims = queries @ graph.vectors.T
    if own is not None:
        sims[np.arange(len(queries)), own] = -2
    truth = sims >= least
    some = truth.any(1)
    found = np.concatenate([out for _, out in graph.within(queries, least, beam)])
    links = float(((found & truth).sum(1)[some] / truth.sum(1)[some]).mean()) if some.any() else 1.0
    if 4 * beam >= len(graph.vectors):
        return links, 1.0
    best, nearest = sims.max(1), 0
    for a in range(0, len(queries), 256):
        nodes, _ = graph.near(queries[a : a + 256], beam)
        got = np.where(nodes >= 0, np.take_along_axis(sims[a : a + 256], np.maximum(nodes, 0), 1), -3).max(1)
        nearest += int((got >= best[a : a + 256] - 1e-6).sum())
    return links, nearest / max(1, len(queries))


def _answers(queries: Shard, target: Shard, same: bool, least: float) -> tuple[np.ndarray, tuple]:
    """Packed links that the queries find in the target, and the audit (beam, queries audited, links, nearest)."""
    rows, beam = queries.audited(), BEAM
    while True:
        links, nearest = audit(queries.graph.vectors[rows], target.graph, least, beam, rows if same else None)
        if 4 * beam >= len(target.ids) or links >= RECALL and nearest >= NEAREST:
            break
        beam *= 2
    out = np.empty((len(queries.ids), -(-len(target.ids) // 8)), np.uint8)
    for a, found in target.graph.within(queries.graph.vectors, least, beam):
        out[a : a + len(found)] = np.packbits(found, axis=1)
    return out, (beam, len(rows), links, nearest)


def linked(one: Shard, other: Shard, same: bool, threshold: float = THRESHOLD):
    """Verified links of two shards: (row of the first, rows of the other) one by one, and the audits of both directions.

    Both query each other: a link counts if either finds it.
    """
    least = threshold - 1e-5
    there, audits = _answers(one, other, same, least)
    audits = [audits]
    back = there
    if not same:
        back, more = _answers(other, one, False, least)
        audits.append(more)

    def rows():
        n, m = len(one.ids), len(other.ids)
        for a in range(0, n, 512):
            found = np.unpackbits(there[a : a + 512], axis=1, count=m).astype(bool)
            found |= np.unpackbits(back[:, a // 8 : (a + 512) // 8], axis=1)[:, : len(found)].T.astype(bool)
            if same:
                found[np.arange(len(found)), np.arange(len(found)) + a] = False
            for k in np.flatnonzero(found.any(1)):
                at = np.flatnonzero(found[k])
                cos = other.exact[at] @ one.exact[a + k] / (other.norms[at] * one.norms[a + k])
                at = at[cos >= threshold]
                if len(at):
                    yield a + int(k), at

    return rows(), audits


def _connect(label: np.ndarray, i: int, at: np.ndarray) -> list[int]:
    """Joins node i to those ``at`` in ``label``; one of each group that was apart."""
    groups, first = np.unique(label[at], return_index=True)
    new = groups != label[i]
    if not new.any():
        return []
    label[np.isin(label, groups[new])] = label[i]
    return at[first[new]].tolist()


_BUILT = "label string, dim int, of int, shard int, blob binary"
_FOUND = "id long, n long, other long, first int, second int, beam int, audited int, links double, nearest double"


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    vectors = np.array(table.column("e").combine_chunks().values, dtype=np.float32 if pa.types.is_float32(table.column("e").type.value_type) else np.float64).reshape(len(ids), -1)
    blob = build(ids, table.column("own").to_numpy(), vectors, table.column("copies").to_numpy())
    return pa.table({"label": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "of": pa.array([key[2].as_py()], pa.int32()), "shard": pa.array([key[3].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _pair(one: Shard, other: Shard, same: bool, threshold: float, name: tuple[int, int]) -> list[tuple]:
    """Rows of ``_FOUND``: a count per linked vector, a forest of links, the audits."""
    n = len(one.ids)
    counts, more = np.zeros(n, np.int64), np.zeros(len(other.ids), np.int64)
    label, ids = np.arange(n if same else n + len(other.ids)), one.ids if same else np.concatenate((one.ids, other.ids))
    shift, out = 0 if same else n, []
    none = (None,) * 6
    links, audits = linked(one, other, same, threshold)
    for i, at in links:
        counts[i] += other.copies[at].sum()
        more[at] += one.copies[i]
        out += [(int(ids[i]), 0, int(ids[k]), *none) for k in _connect(label, i, at + shift)]
    for shard, c in ((one, counts),) if same else ((one, counts), (other, more)):
        out += [(int(shard.ids[k]), int(c[k]), None, *none) for k in np.flatnonzero(c)]
    return out + [(None, None, None, *(name if k == 0 else name[::-1]), *a) for k, a in enumerate(audits)]


def _query_blocks(threshold: float):
    types = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.float64()] * 2
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        blobs: dict[int, dict[int, bytes]] = {}
        for block, shard, blob in zip(*(table.column(c).to_pylist() for c in ("block", "shard", "blob"))):
            blobs.setdefault(block, {})[shard] = blob
        out = []
        for x, blob in sorted(blobs.get(i, {}).items()):
            one = Shard(blob)
            for y, blob in sorted(blobs.get(j, {}).items()):
                if i != j or x <= y:
                    out += _pair(one, one if x == y else Shard(blob), x == y, threshold, (x, y))
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) of every row, and the audits (first, second, beam, audited, links, nearest): shard ``first`` queried ``second``."""
    e = F.col(embedding)
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(sound & F.col(label).isNotNull() & F.col(vec_id).isNotNull(), e).alias("e"))
    nodes = rows.where("e IS NOT NULL").groupBy("label", "e").agg(F.min("vec_id").alias("own"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumns({"dim": F.size("e"), "id": F.monotonically_increasing_id()}), "vectors")  # numbered as written
    c = F.count(F.lit(1))
    size = F.least(F.lit(max(shard_rows, most_rows)), F.greatest(F.lit(shard_rows), F.floor(c / 16)))
    large = nodes.groupBy("label", "dim").agg(c.alias("c"), F.ceil(c / size).cast("int").alias("of")).where(F.col("of") > 1).drop("c")
    dealt = nodes.join(large, ["label", "dim"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("e"), F.col("of")).cast("int"))
    built = dealt.select("label", "dim", "of", "shard", "id", "own", "e", "copies").groupBy("label", "dim", "of", "shard").applyInArrow(_build_shard, _BUILT)
    wide = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("of") / 16))).cast("int")  # shards in a block
    built = materialize(built.withColumn("block", F.floor(F.col("shard") / wide).cast("int")), "graphs")
    # Each block meets every block of its label once, itself included.
    blocks = built.select("label", "dim", "block").distinct()
    ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    pairs = blocks.select("label", "dim", F.col("block").alias("i")).join(blocks.select("label", "dim", F.col("block").alias("j")), ["label", "dim"]).where("i <= j")
    both = pairs.select("label", "dim", "i", "j", ends).join(built.drop("of"), ["label", "dim", "block"])
    found = materialize(both.groupBy("label", "dim", "i", "j").applyInArrow(_query_blocks(threshold), _FOUND), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # Rows of one id are of one component, whatever their vectors.
    named = rows.where("e IS NOT NULL").join(nodes.select("label", "e", "id"), ["label", "e"]).select("vec_id", "id")
    several = named.groupBy("vec_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    edges = found.where("other IS NOT NULL").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    edges = edges.unionByName(named.join(several, "vec_id").select(F.col("id").alias("src"), F.col("lo").alias("dst")))
    nodes = nodes.join(counts, "id", "left").join(connected_components(edges), F.col("id") == F.col("node"), "left")
    nodes = nodes.select("label", "e", "own", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    first = nodes.groupBy("c").agg(F.min("own").alias("component_id"))
    out = rows.join(nodes.drop("own").join(first, "c"), ["label", "e"], "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id")).cast("long")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return out, found.where("beam IS NOT NULL").select("first", "second", "beam", "audited", "links", "nearest")


def near_duplicates(vectors: DataFrame, **kw) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; arguments as of :func:`search`."""
    return search(vectors, **kw)[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: near_duplicates(read(spark, sf_dir, "embeddings")), "near")
