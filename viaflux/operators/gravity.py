"""Zones, trip generation and the production-constrained gravity model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.operators.network import CONNECTOR, node_degree
from viaflux.params import Params


def zone_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with an outgoing edge and its importance; connectors count with their capacity."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(
        F.bool_or(F.coalesce("is_urban", F.lit(False))).alias("is_urban"),
        F.bool_or(F.coalesce("is_federal", F.lit(False))).alias("is_federal"),
        F.sum(F.coalesce("capacity", S.num(0))).alias("total_capacity"),
        F.bool_or("fixed").alias("has_observed"),
        F.coalesce(F.sum("volume"), S.num(0)).alias("total_volume"),
        F.avg(F.when(F.col("fixed") & (F.col("direction") != CONNECTOR), F.col("volume"))).alias("observed_mean"),
    )
    points = lambda c, n: F.when(F.col(c), F.lit(n)).otherwise(0)
    score = F.col("degree") * 10 + F.col("total_capacity") / 1000 + points("is_urban", 50) + points("is_federal", 30) + points("has_observed", 40) + F.col("total_volume") / 1000
    return out.join(node_degree(edges), "node_id").join(nodes.select("node_id", "lat", "lon"), "node_id").withColumn("score", score)


def zones(scored: DataFrame, n: int) -> DataFrame:
    """The n most important nodes; equal scores by node id."""
    return scored.orderBy(F.desc("score"), "node_id").limit(n)


def trip_generation(z: DataFrame, p: Params) -> DataFrame:
    """(node_id, lat, lon, production, attraction): the mean observed volume, else by capacity; both are equal."""
    factor = F.when(F.col("is_urban"), S.num(p.urban_trip_factor)).otherwise(S.num(1)) * F.when(F.col("is_federal"), S.num(p.federal_trip_factor)).otherwise(S.num(1))
    base = F.coalesce("observed_mean", F.col("total_capacity") * p.trip_base_rate * factor)
    t = z.withColumn("production", base).withColumn("attraction", base)
    totals = t.agg(F.sum("production").alias("tp"), F.sum("attraction").alias("ta"))  # one row
    balanced = F.when(F.col("ta") > 0, F.col("attraction") * (F.col("tp") / F.nullif(F.col("ta"), S.num(0)))).otherwise(F.col("attraction"))
    return t.crossJoin(F.broadcast(totals)).select("node_id", "lat", "lon", "production", balanced.alias("attraction"))


def impedance(trips: DataFrame, p: Params) -> DataFrame:
    """(origin, dest, production, attraction, cost, f) for pairs of different zones within reach.

    Zones are at most ``max_zones`` rows, so the pairs are bounded by its square.
    """
    o = trips.select(F.col("node_id").alias("origin"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "production")
    d = trips.select(F.col("node_id").alias("dest"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "attraction")
    cost = F.greatest(S.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), S.num(p.gravity_min_km))
    pairs = o.crossJoin(F.broadcast(d)).where(F.col("origin") != F.col("dest")).withColumn("cost", cost).where(F.col("cost") <= p.gravity_max_km)
    return pairs.select("origin", "dest", "production", "attraction", "cost", F.pow("cost", S.num(-p.gravity_gamma)).alias("f"))


def gravity(pairs: DataFrame) -> DataFrame:
    """(origin, dest, flow), production-constrained."""
    weight = F.col("attraction") * F.col("f")
    total = F.sum(weight).over(Window.partitionBy("origin"))
    return pairs.withColumn("total", total).where("total > 0").select("origin", "dest", (F.col("production") * weight / F.col("total")).alias("flow"))


def significant(od: DataFrame, share: float = 0.1) -> DataFrame:
    """Flows above the exact percentile of positive flows."""
    cut = od.where("flow > 0").agg(F.percentile("flow", share).alias("cut"))  # one row
    return od.crossJoin(F.broadcast(cut)).where(F.col("flow") > F.coalesce("cut", S.num(0))).select("origin", "dest", "flow")


def od_matrix(nodes: DataFrame, edges: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones, trips, od)."""
    z = zones(zone_scores(nodes, edges), p.max_zones)
    t = trip_generation(z, p)
    return z, t, significant(gravity(impedance(t, p)), p.flow_percentile)


def desire_lines(od: DataFrame, nodes: DataFrame, n: int = 200) -> DataFrame:
    """The n largest flows with the places of both ends."""
    top = od.orderBy(F.desc("flow"), "origin", "dest").limit(n)
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    return top.join(at("origin"), "origin").join(at("dest"), "dest").select("origin", "dest", "flow", "origin_lat", "origin_lon", "dest_lat", "dest_lon")
