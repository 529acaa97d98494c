"""Writers of the JSON files that the web map reads.

A file is one JSON document by contract. Its rows are ordered and joined to text by the
executor that writes it; marts beyond one machine are written with ``as_lines`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.operators import marts as M


def array_text(rows: DataFrame, item: str, order: str) -> DataFrame:
    """One row with column ``text``: the JSON texts of ``item`` in order, in brackets."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])
    return rows.agg(F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]")).alias("text"))


def _write(df: DataFrame, path: str) -> None:
    df.select("text").coalesce(1).write.mode("overwrite").text(path)


def as_lines(rows: DataFrame, path: str) -> None:
    """Many JSON documents, one a line, in as many files as there are partitions."""
    rows.write.mode("overwrite").json(path)


def _collection(features: DataFrame, order: str) -> DataFrame:
    return array_text(features, "feature", order).select(F.concat(F.lit('{"type":"FeatureCollection","features":'), "text", F.lit("}")).alias("text"))


def write_segments(mart: DataFrame, path: str) -> None:
    _write(_collection(M.segment_features(mart), "seg_idx"), path)


def write_count_points(points: DataFrame, path: str) -> None:
    _write(_collection(M.point_features(points), "sre"), path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n = nodes.select("node_id", F.to_json(F.struct(F.col("node_id").alias("id"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"))).alias("item"))
    e = M.network_edges(edges).select("sre", F.to_json(F.struct("sre", "src", "dst", "volume", "vmd_source")).alias("item"))
    text = array_text(n, "item", "node_id").select(F.col("text").alias("a")).crossJoin(array_text(e, "item", "sre").select(F.col("text").alias("b")))  # one row each
    _write(text.select(F.concat(F.lit('{"nodes":'), "a", F.lit(',"edges":'), "b", F.lit("}")).alias("text")), path)


def write_frames(frames: DataFrame, path: str) -> None:
    rows = frames.select("iteration", F.to_json(F.struct("iteration", "coverage", "edges_known", "new_count")).alias("item"))
    _write(array_text(rows, "item", "iteration"), path)


def write_gravity(zones: DataFrame, lines: DataFrame, od: DataFrame, path: str) -> None:
    z = zones.select("node_id", F.to_json(F.struct(F.col("node_id").alias("id"), "degree", "is_urban", "is_federal", "has_observed", "total_capacity", F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"))).alias("item"))
    d = lines.select(F.struct((-F.col("flow")).alias("f"), "origin", "dest").alias("o"), F.to_json(F.struct("origin", "dest", F.bround("flow", 1).alias("flow"), "origin_lat", "origin_lon", "dest_lat", "dest_lon")).alias("item"))
    one = array_text(z, "item", "node_id").select(F.col("text").alias("a")).crossJoin(array_text(d, "item", "o").select(F.col("text").alias("b"))).crossJoin(od.agg(F.bround(F.sum("flow"), 0).alias("t")))  # one row each
    _write(one.select(F.concat(F.lit('{"zones":'), "a", F.lit(',"desire_lines":'), "b", F.lit(',"total_trips":'), F.coalesce(F.col("t").cast("string"), F.lit("0")), F.lit("}")).alias("text")), path)


def write_report(metrics: DataFrame, scatter: DataFrame, parameters: dict[str, float], path: str) -> None:
    s = scatter.select("edge_seq", F.to_json(F.struct("sre", "observed", "estimated", "geh", "residual")).alias("item"))
    m = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("m"))
    pairs: list[Column] = [x for k, v in parameters.items() for x in (F.lit(k), S.num(round(v, 4)))]
    given = F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}")
    one = m.crossJoin(array_text(s, "item", "edge_seq"))  # one row each
    _write(one.select(F.concat(F.lit('{"metrics":'), "m", F.lit(',"scatter_data":'), "text", F.lit(',"parameters":'), given, F.lit("}")).alias("text")), path)
