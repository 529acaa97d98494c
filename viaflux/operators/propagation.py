"""Flow conservation over the graph in synchronous supersteps.

All node sums come from the state at the start of a step. Each unknown edge gets at most
one proposal from either end; the end with the smaller node id wins. Edges with a volume
are never changed. Neighbour means need no join of edges with edges: the neighbours of u->v
are the edges out of v and into u, so two node sums give their mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.operators.network import CONNECTOR
from viaflux.params import Params
from viaflux.storage import Scratch


def _roads(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("direction") != CONNECTOR)


def node_balance(edges: DataFrame) -> DataFrame:
    """(node_id, and for in and out: edges, known edges, sum of volumes, capacity of unknown edges, capacity of known ones)."""
    cap, vol = F.coalesce("capacity", S.num(S.CAPACITY_DEFAULT)).alias("cap"), F.col("volume").alias("vol")
    inc = _roads(edges).select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit("out").alias("side"), cap, vol), F.struct(F.col("dst").alias("node_id"), F.lit("in").alias("side"), cap, vol))).alias("e")).select("e.*")
    known = F.col("vol").isNotNull()
    aggs = []
    for side in ("in", "out"):
        here = F.col("side") == side
        aggs += [
            F.count_if(here).alias(f"n_{side}"),
            F.count_if(here & known).alias(f"known_{side}"),
            F.coalesce(F.sum(F.when(here, F.col("vol"))), S.num(0)).alias(f"sum_{side}"),
            F.coalesce(F.sum(F.when(here & ~known, F.col("cap"))), S.num(0)).alias(f"free_cap_{side}"),
            F.coalesce(F.sum(F.when(here & known, F.col("cap"))), S.num(0)).alias(f"known_cap_{side}"),
        ]
    return inc.groupBy("node_id").agg(*aggs)


def _proposals(balance: DataFrame, ratio: float, source: str, target: str, key: str) -> DataFrame:
    """At each node, from the known side ``source`` to the unknown edges of ``target``: a rate by capacity, or a single value."""
    known, total, flow = F.col(f"known_{source}"), F.col(f"n_{source}"), F.col(f"sum_{source}")
    other, unknown = F.col(f"sum_{target}"), F.col(f"n_{target}") - F.col(f"known_{target}")
    share = known / F.greatest(total, F.lit(1))
    whole = flow / F.greatest(share, S.num(0.1))
    rest = F.greatest(whole - other, whole * 0.1)
    spread = (share >= F.lit(ratio)) & (known > 0) & (unknown > 0) & (F.col(f"free_cap_{target}") > 0)
    single = (known > 0) & (unknown == 1)
    return balance.select(
        F.col("node_id").alias(key),
        F.when(spread, rest / F.nullif(F.col(f"free_cap_{target}"), S.num(0))).alias(f"{key}_rate"),
        F.when(single, F.greatest(flow - other, flow * 0.2, S.num(1))).alias(f"{key}_single"),
    )


def propagate_step(edges: DataFrame, ratio: float) -> DataFrame:
    """edges after one superstep; ``new_volume`` (null where nothing new) tells what was set."""
    b = node_balance(edges)
    e = edges.join(_proposals(b, ratio, "in", "out", "src"), "src", "left").join(_proposals(b, ratio, "out", "in", "dst"), "dst", "left")
    cap = F.coalesce("capacity", S.num(S.CAPACITY_DEFAULT))
    offer = lambda k: F.coalesce(F.when(F.col(f"{k}_rate").isNotNull(), F.greatest(F.col(f"{k}_rate") * cap, S.num(1))), F.col(f"{k}_single"))
    pick = F.when(F.col("src") < F.col("dst"), F.coalesce(offer("src"), offer("dst"))).otherwise(F.coalesce(offer("dst"), offer("src")))
    new = F.when((F.col("direction") != CONNECTOR) & F.col("volume").isNull() & ~F.col("fixed"), pick)
    out = e.withColumn("new_volume", new).withColumn("volume", F.coalesce("volume", "new_volume"))
    return out.select(*edges.columns, "new_volume")


def coverage(edges: DataFrame) -> DataFrame:
    """One row: edges, known edges, share."""
    return _roads(edges).agg(F.count(F.lit(1)).alias("edges"), F.count("volume").alias("edges_known")).withColumn("coverage", F.col("edges_known") / F.greatest(F.col("edges"), F.lit(1)))


def propagate(edges: DataFrame, p: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges, frames) after all passes; frames(iteration, coverage, edges_known, new_count: distinct keys that got a volume).

    One row of counts comes to the driver for each step.
    """
    start = coverage(edges).first()
    known, total = start["edges_known"], max(start["edges"], 1)
    rows = [(0, known / total, known, 0)]
    for ratio in p.known_ratios:
        for _ in range(p.propagation_steps):
            state = scratch.write(propagate_step(edges, ratio), "flow")
            new = state.where(F.col("new_volume").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).first()
            if not new["n"]:
                scratch.drop(state)
                break
            known += new["n"]
            rows.append((len(rows), round(known / total, 4), known, new["keys"]))
            if hasattr(edges, "scratch_path"):
                scratch.drop(edges)
            keep = state.drop("new_volume")
            keep.scratch_path = state.scratch_path
            edges = keep
    return edges, edges.sparkSession.createDataFrame(rows, "iteration int, coverage double, edges_known long, new_count long")


def _neighbours(edges: DataFrame) -> DataFrame:
    """edges with n_near, sum_near, cap_near of known neighbours."""
    b = node_balance(edges)
    ahead = b.select(F.col("node_id").alias("dst"), F.col("known_out").alias("n1"), F.col("sum_out").alias("s1"), F.col("known_cap_out").alias("c1"))
    behind = b.select(F.col("node_id").alias("src"), F.col("known_in").alias("n2"), F.col("sum_in").alias("s2"), F.col("known_cap_in").alias("c2"))
    e = edges.join(ahead, "dst", "left").join(behind, "src", "left")
    plus = lambda a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0))
    return e.select(*edges.columns, plus("n1", "n2").alias("n_near"), plus("s1", "s2").alias("sum_near"), plus("c1", "c2").alias("cap_near"))


def neighbor_fill_step(edges: DataFrame) -> DataFrame:
    """Unknown edges get the mean of their known neighbours, scaled by capacity (twice at most)."""
    e = _neighbours(edges)
    n = F.nullif(F.col("n_near").cast("double"), S.num(0))
    scale = F.coalesce("capacity", S.num(S.CAPACITY_DEFAULT)) / F.greatest(F.col("cap_near") / n, S.num(1))
    fill = F.greatest(F.col("sum_near") / n * F.least(scale, S.num(2)), S.num(1))
    take = (F.col("direction") != CONNECTOR) & F.col("volume").isNull() & (F.col("n_near") > 0)
    return e.withColumn("volume", F.when(take, fill).otherwise(F.col("volume"))).select(*edges.columns)


def neighbor_fill(edges: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    known = edges.agg(F.count("volume")).first()[0]
    for _ in range(p.fill_sweeps):
        edges = scratch.write(neighbor_fill_step(edges), "fill")
        now = edges.agg(F.count("volume")).first()[0]
        if now == known:
            break
        known = now
    return edges


def smooth_step(edges: DataFrame, weight: float = 0.7) -> DataFrame:
    """Volumes that are not fixed move towards the mean of their neighbours."""
    e = _neighbours(edges)
    mean = F.col("sum_near") / F.nullif(F.col("n_near").cast("double"), S.num(0))
    take = (F.col("direction") != CONNECTOR) & ~F.col("fixed") & F.col("volume").isNotNull() & (F.col("n_near") > 0)
    return e.withColumn("volume", F.when(take, F.col("volume") * weight + mean * (1 - weight)).otherwise(F.col("volume"))).select(*edges.columns)
