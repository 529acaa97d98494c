"""The whole estimation as one plan of plans: counts, network, propagation, demand, assignment, fit, marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.operators import assignment, counts, evaluate, gravity, marts, network, propagation, rules
from viaflux.params import Params
from viaflux.sources import sinks
from viaflux.storage import Scratch


@dataclass
class Estimate:
    segments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    frames: DataFrame
    zones: DataFrame
    od: DataFrame
    metrics: DataFrame
    scatter: DataFrame


@dataclass
class Prepared:
    """What no calibrated parameter but capacity changes: computed once and reused."""

    segments: DataFrame
    by_direction: DataFrame


def prepare(raw_counts: DataFrame, segments: DataFrame, scratch: Scratch) -> Prepared:
    clean = scratch.write(counts.cleaned(raw_counts), "counts")
    return Prepared(scratch.write(counts.with_volumes(segments, counts.segment_totals(clean)), "segments"), scratch.write(counts.direction_means(clean), "directions"))


def run(ready: Prepared, p: Params, scratch: Scratch) -> Estimate:
    segments = scratch.write(rules.capacity(ready.segments, p), "capacity")
    nodes, edges = network.build(segments, p, scratch)
    edges = scratch.write(network.pinned(edges, ready.by_direction), "pinned")
    edges, frames = propagation.propagate(edges, p, scratch)
    edges = propagation.neighbor_fill(edges, p, scratch)
    edges = scratch.write(propagation.smooth_step(edges, p.smooth_weight), "smooth")
    zones, _, od = gravity.od_matrix(nodes, edges, p)
    zones, od = scratch.write(zones, "zones"), scratch.write(od, "od")
    edges = scratch.write(assignment.merge_sources(assignment.assign(edges, od, p, scratch)), "merged")
    points = scratch.write(evaluate.scatter(edges), "scatter")
    return Estimate(segments, nodes, edges, frames, zones, od, evaluate.fit_metrics(points), points)


def held_out_metrics(ready: Prepared, p: Params, scratch: Scratch, folds: int = 5) -> DataFrame:
    """(fold, metrics): regions take turns in being hidden, then their edges are compared with what was estimated."""
    rows = None
    seg = evaluate.held_out_folds(ready.segments, folds)
    for fold in range(folds):
        hidden = F.col("fold") == fold
        known = seg.withColumn("vmd", F.when(~hidden, F.col("vmd"))).withColumn("has_vmd", F.col("vmd").isNotNull())
        seen = ready.by_direction.join(seg.where(hidden).select("sre").distinct(), "sre", "left_anti")
        e = run(Prepared(scratch.write(known.drop("fold"), "known"), seen), p, scratch).edges
        truth = ready.by_direction.join(seg.where(hidden).select("sre").distinct(), "sre", "left_semi").groupBy("sre", F.col("sentido").alias("direction")).agg(F.min("vmd").alias("truth"))
        s = evaluate.scatter(e.join(truth, ["sre", "direction"]).withColumns({"observed_vmd": F.col("truth"), "fixed": F.lit(True)})).withColumn("fold", F.lit(fold))
        rows = s if rows is None else rows.unionByName(s)
    return evaluate.fit_metrics(scratch.write(rows, "held_out"), "fold")


def publish(e: Estimate, folder: str, parameters: dict[str, float] | None = None) -> None:
    """The six files of the web map under ``folder``."""
    sinks.write_segments(marts.segment_mart(e.segments, e.edges), f"{folder}/segments.geojson")
    sinks.write_count_points(marts.count_points(e.segments), f"{folder}/count_points.geojson")
    sinks.write_network(e.nodes, e.edges, f"{folder}/network_graph.json")
    sinks.write_frames(e.frames, f"{folder}/propagation_frames.json")
    sinks.write_gravity(e.zones, gravity.desire_lines(e.od, e.nodes), e.od, f"{folder}/gravity_model.json")
    sinks.write_report(e.metrics, e.scatter, parameters or {}, f"{folder}/calibration_report.json")
