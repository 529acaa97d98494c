"""Traffic assignment: shortest paths, all-or-nothing loading, successive averages, merge of sources.

Paths come from one tree for each origin. Below ``BROADCAST_EDGES`` edges (counted first) the
graph is sent to the executors and origins are spread over them; beyond it, distances and
flows move along the edges in supersteps, without any broadcast. Ties go to fewer hops, then
to the smaller predecessor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.operators.network import CONNECTOR
from viaflux.params import Params
from viaflux.storage import Scratch, ship_package

BROADCAST_EDGES = 1_000_000


def with_cost(edges: DataFrame, p: Params) -> DataFrame:
    """Congested minutes; connectors cost almost nothing."""
    t0, cap = F.coalesce("free_flow_time", S.num(1)), F.coalesce("capacity", S.num(S.CAPACITY_DEFAULT))
    return edges.withColumn("cost", F.when(F.col("direction") == CONNECTOR, S.num(0.001)).otherwise(S.bpr(t0, F.coalesce("assigned_volume", S.num(0)), cap, p.bpr_alpha, p.bpr_beta)))


def cheapest_parallel(edges: DataFrame) -> DataFrame:
    """(src, dst, key, cost): of parallel edges the cheapest, the first of equal ones."""
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("cost", "edge_seq", "key")).alias("e"))
    return best.select("src", "dst", "e.key", "e.cost")


def _tree(adjacent: dict[int, list[tuple[int, str, float]]], origin: int) -> dict[int, tuple[float, int, int | None, str | None]]:
    best: dict[int, tuple[float, int, int | None, str | None]] = {}
    heap: list[tuple[float, int, int, int, str | None]] = [(0.0, 0, -1, origin, None)]
    while heap:
        cost, hops, pred, node, key = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (cost, hops, None if pred < 0 else pred, key)
        for to, k, c in adjacent.get(node, ()):
            if to not in best:
                heapq.heappush(heap, (cost + c, hops + 1, node, to, k))
    return best


def _adjacency(simple: DataFrame) -> dict[int, list[tuple[int, str, float]]]:
    """The whole graph on the driver; callers have counted its edges."""
    out: dict[int, list[tuple[int, str, float]]] = {}
    for r in simple.toPandas().itertuples(index=False):
        out.setdefault(int(r.src), []).append((int(r.dst), r.key, float(r.cost)))
    return out


def _fits(simple: DataFrame, limit: int) -> bool:
    return simple.limit(limit + 1).count() <= limit


def shortest_paths(simple: DataFrame, origins: DataFrame, scratch: Scratch, limit: int = BROADCAST_EDGES) -> DataFrame:
    """(origin, node, cost, hops, pred, key): the tree of every origin in ``origins(origin)``."""
    spark = simple.sparkSession
    if not _fits(simple, limit):
        return _relaxed(simple, origins, scratch)
    ship_package(spark)
    graph = spark.sparkContext.broadcast(_adjacency(simple))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o in b["origin"]:
                rows = [(int(o), n, c, h, p, k) for n, (c, h, p, k) in _tree(graph.value, int(o)).items()]
                yield pd.DataFrame(rows, columns=["origin", "node", "cost", "hops", "pred", "key"]).astype({"pred": "Int64"})

    return origins.select("origin").distinct().repartition("origin").mapInPandas(run, "origin long, node long, cost double, hops int, pred long, key string")


def _relaxed(simple: DataFrame, origins: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by supersteps: every node takes the best offer of its predecessors until none is better."""
    none = F.lit(None)
    state = scratch.write(origins.select("origin").distinct().select("origin", F.col("origin").alias("node"), S.num(0).alias("cost"), F.lit(0).alias("hops"), none.cast("long").alias("pred"), none.cast("string").alias("key"), F.lit(True).alias("new")), "paths")
    while True:
        front = state.where("new").select("origin", F.col("node").alias("src"), F.col("cost").alias("base"), F.col("hops").alias("h"))
        offers = front.join(simple, "src").select("origin", F.col("dst").alias("node"), (F.col("base") + F.col("cost")).alias("cost"), (F.col("h") + 1).alias("hops"), F.col("src").alias("pred"), "key", F.lit(True).alias("new"))
        both = state.withColumn("new", F.lit(False)).unionByName(offers)
        best = both.groupBy("origin", "node").agg(F.min(F.struct("cost", "hops", F.coalesce("pred", F.lit(-1)).alias("p"), "new", "pred", "key")).alias("b"))
        nxt = scratch.write(best.select("origin", "node", "b.cost", "b.hops", "b.pred", "b.key", "b.new"), "paths")
        scratch.drop(state)
        state = nxt
        if state.where("new").isEmpty():
            return state.drop("new")


def all_or_nothing(simple: DataFrame, od: DataFrame, scratch: Scratch, limit: int = BROADCAST_EDGES) -> DataFrame:
    """(src, dst, key, flow): all flows on their shortest paths; pairs without a path load nothing."""
    spark = simple.sparkSession
    wanted = od.where((F.col("flow") > 0) & (F.col("origin") != F.col("dest")))
    if not _fits(simple, limit):
        return _walked(simple, wanted, scratch)
    ship_package(spark)
    graph = spark.sparkContext.broadcast(_adjacency(simple))
    by_origin = wanted.groupBy("origin").agg(F.collect_list(F.struct("dest", "flow")).alias("to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for origin, to in zip(b["origin"], b["to"]):
                tree = _tree(graph.value, int(origin))
                load = {n: 0.0 for n in tree}
                for x in to:
                    if x["dest"] in load:
                        load[x["dest"]] += x["flow"]
                rows = []
                for n in reversed(tree):  # the tree is in order of cost: farther nodes first
                    _, _, pred, key = tree[n]
                    if pred is not None and load[n] > 0:
                        load[pred] += load[n]
                        rows.append((pred, n, key, load[n]))
                if rows:
                    yield pd.DataFrame(rows, columns=["src", "dst", "key", "flow"])

    links = by_origin.repartition("origin").mapInPandas(run, "src long, dst long, key string, flow double")
    return links.groupBy("src", "dst", "key").agg(F.sum("flow").alias("flow"))


def _walked(simple: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Flows walk back from the destinations to the origins, hop by hop."""
    tree = scratch.write(_relaxed(simple, wanted.select("origin"), scratch), "trees")
    at = scratch.write(wanted.groupBy("origin", F.col("dest").alias("node")).agg(F.sum("flow").alias("flow")), "walk")
    loads: list[DataFrame] = []
    while True:
        step = scratch.write(at.join(tree.where(F.col("pred").isNotNull()), ["origin", "node"]).select("origin", "pred", "node", "key", "flow"), "step")
        if step.isEmpty():
            break
        loads.append(step.groupBy(F.col("pred").alias("src"), F.col("node").alias("dst"), "key").agg(F.sum("flow").alias("flow")))
        at = scratch.write(step.groupBy("origin", F.col("pred").alias("node")).agg(F.sum("flow").alias("flow")), "walk")
    out = wanted.limit(0).select(F.col("origin").alias("src"), F.col("dest").alias("dst"), F.lit("").alias("key"), "flow")
    for x in loads:
        out = out.unionByName(x)
    return out.groupBy("src", "dst", "key").agg(F.sum("flow").alias("flow"))


def msa_step(edges: DataFrame, aux: DataFrame, step: int) -> DataFrame:
    """Successive average of assigned volumes with auxiliary flows, one row of ``aux`` for each (src, dst, key); the step size is 1 / (step + 1)."""
    lam = 1.0 / (step + 1)
    e = edges.join(aux.withColumnRenamed("flow", "aux_flow"), ["src", "dst", "key"], "left")
    return e.withColumn("assigned_volume", F.coalesce("assigned_volume", S.num(0)) * (1 - lam) + F.coalesce("aux_flow", S.num(0)) * lam).drop("aux_flow").select(*edges.columns)


def assign(edges: DataFrame, od: DataFrame, p: Params, scratch: Scratch, limit: int = BROADCAST_EDGES) -> DataFrame:
    """edges with assigned_volume and cost after successive averages."""
    od = scratch.write(od, "od")
    first = edges.withColumn("cost", F.coalesce("free_flow_time", S.num(1)))
    flows = all_or_nothing(cheapest_parallel(first), od, scratch, limit)
    e = scratch.write(first.join(flows, ["src", "dst", "key"], "left").withColumn("assigned_volume", F.coalesce("flow", S.num(0))).drop("flow"), "assigned")
    before = e.agg(F.sum("assigned_volume")).first()[0] or 0.0
    for k in range(1, p.assign_steps + 1):
        costed = with_cost(e, p)
        e = scratch.write(msa_step(costed, all_or_nothing(cheapest_parallel(costed), od, scratch, limit), k), "assigned")
        now = e.agg(F.sum("assigned_volume")).first()[0] or 0.0
        if before > 0 and abs(now - before) / before < p.assign_gap:
            break
        before = now
    return with_cost(e, p)


def merge_sources(edges: DataFrame) -> DataFrame:
    """edges with a volume from the best source, its name, and the ratio to capacity; connectors stay as they are."""
    road, vol = F.col("direction") != CONNECTOR, F.col("volume")
    assigned, cap = F.coalesce("assigned_volume", S.num(0)), F.coalesce("capacity", S.num(S.CAPACITY_DEFAULT))
    source = F.when(vol.isNull() & (assigned > 0), "assigned").when(vol.isNotNull() & F.col("fixed"), "observed").when(vol.isNotNull(), "propagated").otherwise("estimated")
    volume = F.when(vol.isNotNull(), vol).when(assigned > 0, assigned).otherwise(cap * 0.15)
    e = edges.withColumns({"vmd_source": F.when(road, source), "volume": F.when(road, volume).otherwise(vol)})
    return e.withColumn("vc_ratio", F.when(road, F.when(cap > 0, F.coalesce(F.col("volume") / F.nullif(cap, S.num(0)), S.num(0))).otherwise(S.num(0))))
