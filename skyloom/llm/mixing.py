"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are counted by membership pattern, a flow
routes each pattern's words to the sources' quotas (a repeated epoch of a pattern costs
more than the one before it, so texts repeat as little as possible), and the flow of each
pattern is turned into documents taken in a seeded order.

Rows travel without their texts. Positions in the seeded order come from sums over hash
buckets, so a pattern that holds a third of all rows is spread over 65,536 groups. What
reaches the driver is one row per pattern, of which ``max_patterns`` are allowed.

Null sizes count as 0, a null source is a source of its own, repeated rows count each,
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.text import read, word_count
from skyloom.plans.shared import materialize, settled

NAME = "op1_min_cost_mixing"
ORACLE_SQL = None  # the flow and the seeded order are beyond SQL

MAX_PATTERNS = 20_000
SEED = 17
_NULL = "\x00"  # stands for the null source inside


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * float(sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def min_cost_flow(capacity: dict, quotas: dict, epochs: int) -> dict:
    """{(pattern, source): words} that fills the quotas at the least repetition cost.

    The e-th pass over a pattern costs e per word. Successive shortest paths with
    potentials; each step saturates a quota or one epoch of a pattern.
    """
    patterns, sources = list(capacity), list(quotas)
    where = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[list]] = [[] for _ in range(2 + len(patterns) + len(sources))]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    routes = {}
    for i, p in enumerate(patterns):
        for e in range(epochs):
            arc(0, 2 + i, capacity[p], e + 1)
        for s in p:
            if s in where:
                routes[p, s] = (2 + i, len(graph[2 + i]))
                arc(2 + i, where[s], epochs * capacity[p], 0)
    for s in sources:
        arc(where[s], 1, int(quotas[s]), 0)
    high = [0] * len(graph)
    while True:
        far, back, heap = [float("inf")] * len(graph), [None] * len(graph), [(0, 0)]
        far[0] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and d + cost + high[a] - high[b] < far[b]:
                    far[b], back[b] = d + cost + high[a] - high[b], (a, k)
                    heapq.heappush(heap, (far[b], b))
        if back[1] is None:
            break
        high = [h + (f if f < float("inf") else 0) for h, f in zip(high, far)]
        while _send(graph, high):  # along every shortest path before the distances are computed again
            pass
    return {key: sent for key, (a, k) in routes.items() if (sent := graph[graph[a][k][0]][graph[a][k][3]][1])}


def _send(graph, high) -> bool:
    """A blocking flow along arcs of reduced cost 0, level by level; False if none is left."""
    level, queue = {0: 0}, [0]
    for a in queue:
        for b, room, cost, _ in graph[a]:
            if room and b not in level and cost + high[a] - high[b] == 0:
                level[b] = level[a] + 1
                queue.append(b)
    if 1 not in level:
        return False
    at, path, a = [0] * len(graph), [], 0
    while True:
        if a == 1:
            room = min(arc[1] for arc in path)
            for arc in path:
                arc[1] -= room
                graph[arc[0]][arc[3]][1] += room
            path, a = [], 0
            continue
        while at[a] < len(graph[a]):
            arc = graph[a][at[a]]
            if arc[1] and level.get(arc[0]) == level[a] + 1 and arc[2] + high[a] - high[arc[0]] == 0:
                break
            at[a] += 1
        else:
            if not path:
                return True
            last = path.pop()
            a = graph[last[0]][last[3]][0]
            at[a] += 1
            continue
        path.append(arc)
        a = arc[0]


def _placed(rows: DataFrame) -> DataFrame:
    """``pos``: the words before a row, in its pattern's seeded order."""
    sums = rows.groupBy("__pid", "__bucket").agg(F.sum("__size").alias("__sum")).withColumn("__page", F.shiftright("__bucket", 8))
    earlier = lambda by, *group: F.coalesce(F.sum("__sum").over(W.partitionBy(*group).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = sums.groupBy("__pid", "__page").agg(F.sum("__sum").alias("__sum"))  # 256 of a pattern, with 256 buckets each
    pages = pages.select("__pid", "__page", earlier("__page", "__pid").alias("__paged"))
    sums = sums.withColumn("__base", earlier("__bucket", "__pid", "__page")).join(pages, ["__pid", "__page"])
    sums = sums.select("__pid", "__bucket", (F.col("__base") + F.col("__paged")).alias("__base"))
    inner = W.partitionBy("__pid", "__bucket").orderBy("__hash", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(sums, ["__pid", "__bucket"])
    return out.withColumn("__pos", F.col("__base") + F.coalesce(F.sum("__size").over(inner), F.lit(0))).drop("__base")


def _taken_too(rows: DataFrame, fill: DataFrame) -> DataFrame:
    """One more copy of the rows ``fill``, for the last source of their pattern. A repeated row is left out."""
    on = ["__id", "__hash", "__size", "__pid"]
    alone = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    once = fill.select(*on).distinct().join(alone, on).withColumn("__more", F.lit(1))
    last = F.array(F.expr("__parts[size(__parts) - 1].source"))
    won = F.when(F.col("__more") == 1, F.concat("__won", last)).otherwise(F.col("__won"))
    return materialize(rows.join(once, on, "left").withColumn("__won", won).drop("__more"), "mix")


def mix(docs: DataFrame, quotas: dict, doc_id: str = "doc_id", size: str = "size", sources: str = "sources", epochs: int = 2, seed: int = SEED, fills: int = 3, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(doc_id, size, sources, copies, taken, taken_for): how often the mix takes each row, and for which source.

    ``sources`` is an array column, ``quotas`` the words wanted of each source. Copies are
    whole texts; what rounding leaves open is filled with later texts that fit, at last with
    the one text nearest in size.
    """
    spark = docs.sparkSession
    key = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(sources), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(_NULL)))))
    quotas = {_NULL if k is None else k: v for k, v in quotas.items()}
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"), key.alias("__key"))
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(seed), F.col("__id").cast("string"), "__size"))  # null ids are spread by size
    rows = materialize(rows.withColumn("__bucket", F.shiftrightunsigned("__hash", 48).cast("int")), "mix")
    counted = rows.groupBy("__key").agg(F.sum("__size").alias("s")).limit(max_patterns + 1).collect()
    if len(counted) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r["__key"]): int(r["s"]) for r in counted}
    flow = min_cost_flow({p: c for p, c in capacity.items() if c}, quotas, epochs)
    plan = []
    for n, (p, c) in enumerate(sorted(capacity.items())):
        at, parts = 0, []
        for s in p:
            if f := flow.get((p, s)):
                parts.append((s, at, at + f))
                at += f
        plan.append((list(p), n, c, at, parts))
    table = spark.createDataFrame(plan, "__key array<string>, __pid int, __all long, __flow long, __parts array<struct<source:string,lo:long,hi:long>>")
    table = F.broadcast(table)  # max_patterns rows at most
    rows = _placed(rows.join(table, "__key"))

    def lot(e):
        lo = F.lit(e) * F.col("__all") + F.col("__pos")
        mid = lo + F.col("__size") / 2
        fits = lo + F.col("__size") <= F.col("__flow")
        return F.when(fits & (F.col("__size") > 0), F.filter("__parts", lambda x: (x["lo"] <= mid) & (mid < x["hi"]))[0]["source"])

    rows = materialize(rows.withColumn("__won", F.array_compact(F.array(*map(lot, range(epochs))))), "mix")
    for k in range(fills + 1):
        gap = rows.groupBy("__pid").agg((F.first("__flow") - F.sum(F.col("__size") * F.size("__won"))).alias("__gap"))
        open_ = rows.join(F.broadcast(gap), "__pid").where((F.size("__won") < epochs) & (F.col("__size") > 0))  # gap: a row per pattern
        if k < fills:
            fill = _placed(open_.where(F.col("__size") <= F.col("__gap")).drop("__pos")).where(F.col("__pos") + F.col("__size") <= F.col("__gap"))
        else:  # one more text, though it goes beyond, if that is nearer
            off = F.struct(F.abs(F.col("__size") - F.col("__gap")).alias("off"), "__hash", "__id", "__size")
            near = open_.where(F.col("__size") < 2 * F.col("__gap")).groupBy("__pid").agg(F.min(off).alias("x"))
            fill = near.select("__pid", "x.*")
        rows = _taken_too(rows, fill)
    named = lambda c: F.transform(c, lambda x: F.when(x != _NULL, x))
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), named("__key").alias("sources"), F.size("__won").alias("copies"), (F.col("__size") * F.size("__won")).alias("taken"), named("__won").alias("taken_for"))


def source_quotas(totals: Iterable[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict:
    """Sources by code point, null last, weigh ``weights`` in turn."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in ordered]
    shares = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    return {name: t for (name, _), t in zip(ordered, shares)}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: _query(spark, sf_dir), "mixed")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.array("source").alias("sources")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_PATTERNS + 1).collect()
    quotas = source_quotas([(r["source"], int(r["s"])) for r in totals])
    mixed = mix(sized, quotas)
    rows = [(r["source"], int(r["s"]), float(quotas[r["source"]])) for r in totals]
    targets = F.broadcast(spark.createDataFrame(rows, "name string, source_size long, target double"))  # MAX_PATTERNS rows at most
    out = mixed.join(targets, F.col("sources")[0].eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
