"""Marts for the web map, and the queries of its dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaflux.functions import geometry as G
from viaflux.functions import scalars as S
from viaflux.operators.network import CONNECTOR

# --- fixed values: class edges of the histograms and fit badges
VOLUME_EDGES = (0, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000)
RATIO_EDGES = (0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.85, 1.0)
GEH_EDGES = (0, 1, 2, 3, 5, 7, 10, 15, 20)
SOURCES = ("observed", "propagated", "assigned", "estimated")


def sre_volumes(edges: DataFrame) -> DataFrame:
    """(sre, vmd, vmd_source, vc_ratio): sum, first source and largest ratio over a segment's edges with a volume."""
    e = edges.where((F.col("direction") != CONNECTOR) & F.col("volume").isNotNull())
    return e.groupBy("sre").agg(F.sum("volume").alias("edge_vmd"), F.min_by("vmd_source", "edge_seq").alias("edge_source"), F.max("vc_ratio").alias("edge_vc"))


def segment_mart(segments: DataFrame, edges: DataFrame) -> DataFrame:
    s = segments.join(sre_volumes(edges), "sre", "left")
    found = F.col("edge_vmd").isNotNull()
    return s.select(
        "seg_idx", "sre", S.safe_int("go").alias("go"), S.safe_int("regional").alias("regional"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("classe", "revest", "situacao")],
        S.safe_float("extensao").alias("extensao"), F.bround(F.when(found, F.col("edge_vmd")).otherwise(S.safe_float("vmd")), 1).alias("vmd"),
        F.when(found, F.coalesce("edge_source", F.lit("unknown"))).when(F.col("has_vmd"), "observed").otherwise("estimated").alias("vmd_source"),
        F.bround(F.when(found, F.coalesce("edge_vc", S.num(0))).otherwise(S.num(0)), 3).alias("vc_ratio"), S.safe_float("capacity").alias("capacity"), S.safe_float("free_flow_speed").alias("free_flow_speed"),
        S.truthy_network("federal").alias("is_federal"), S.truthy_network("perim_urb").alias("is_urban"), *[S.safe_float(c).alias(c) for c in ("pct_heavy", "pct_light", "pct_moto") if c in segments.columns],
        *[F.col(c) for c in ("geometry",) if c in segments.columns],
    )


def count_points(segments: DataFrame) -> DataFrame:
    """Observed segments with the station's place; where its latitude is missing, the centroid's."""
    s = segments.where("has_vmd")
    gone = F.col("latitude").isNull()
    return s.select("sre", S.safe_float("vmd").alias("vmd"), S.safe_float("vmdc").alias("vmdc"), S.safe_int("go").alias("go"), S.safe_int("regional").alias("regional"), *[S.safe_float(c).alias(c) for c in ("pct_heavy", "pct_light", "pct_moto")],
        F.when(gone, F.col("lat_centroid")).otherwise(F.col("latitude")).alias("lat"), F.when(gone, F.col("lon_centroid")).otherwise(F.col("longitude")).alias("lon"))


def network_edges(edges: DataFrame) -> DataFrame:
    """One edge for each segment: the first."""
    e = edges.where(F.col("direction") != CONNECTOR)
    first = e.groupBy("sre").agg(F.min("edge_seq").alias("edge_seq"))
    return e.join(first, ["sre", "edge_seq"], "left_semi").select("sre", "src", "dst", S.safe_float("volume").alias("volume"), "vmd_source")


def coalesced_mart(segments: DataFrame, observed: DataFrame, estimates: DataFrame) -> DataFrame:
    """Observed volume, else the estimate of an earlier run, else zero, with the label of its source."""
    est = estimates.where(~F.col("vmd_source").eqNullSafe(F.lit("observed")) & S.known_text("sre").isNotNull()).select("sre", F.col("vmd").alias("est_vmd"), F.col("vmd_source").alias("est_source"))
    s = segments.join(observed.select("sre", F.col("vmd").alias("obs_vmd")), "sre", "left").join(est, "sre", "left")
    v = F.coalesce("obs_vmd", "est_vmd", S.num(0))
    label = F.when(F.col("obs_vmd").isNotNull(), "observed").when(F.col("est_vmd") > 0, F.coalesce("est_source", F.lit("estimated"))).otherwise("estimated")
    return s.select("seg_idx", "sre", F.bround(v, 1).alias("vmd"), label.alias("vmd_source"))


def feature(geometry: Column, *props: Column | str) -> Column:
    """A GeoJSON feature as text; geometry is GeoJSON text."""
    body = F.to_json(F.struct(*props), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), body, F.lit("}"))


def segment_features(mart: DataFrame) -> DataFrame:
    props = [c for c in mart.columns if c not in ("geometry", "seg_idx")]
    return mart.where(~G.is_empty(F.col("geometry"))).select("seg_idx", feature(G.to_geojson(G.rounded(F.col("geometry"))), *props).alias("feature"))


def point_features(points: DataFrame) -> DataFrame:
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return points.select("sre", feature(geometry, *[c for c in points.columns if c not in ("lat", "lon")]).alias("feature"))


# --- dashboard


def _filled(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def km_by_class(mart: DataFrame) -> DataFrame:
    return mart.groupBy(_filled("classe", "Outro").alias("classe")).agg(F.sum(F.coalesce("extensao", S.num(0))).alias("km")).orderBy(F.desc("km"), "classe")


def count_by_surface(mart: DataFrame) -> DataFrame:
    return mart.groupBy(_filled("revest", "N/D").alias("revest")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "revest")


def coverage_counts(mart: DataFrame) -> DataFrame:
    seen = F.col("vmd_source").eqNullSafe(F.lit("observed"))
    return mart.agg(F.count_if(seen).alias("observed"), F.count_if(~seen).alias("to_estimate"))


def dashboard_totals(mart: DataFrame) -> DataFrame:
    src = F.when(F.col("vmd_source").isin(*SOURCES), F.col("vmd_source")).otherwise("estimated")
    t = mart.agg(F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce("extensao", S.num(0))).alias("km"), *[F.count_if(src == s).alias(f"n_{s}") for s in SOURCES])
    return t.withColumn("coverage_pct", F.col("n_observed") * 100 / F.greatest(F.col("segments"), F.lit(1)))


def histogram(rows: DataFrame, value: Column, edges: tuple[float, ...]) -> DataFrame:
    """(bin, low, n): left-closed bins, the last one open; empty bins stay, values under the first go."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "bin int, low double")
    counts = rows.select(S.volume_class(F.coalesce(value, S.num(0)), edges).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def mean_composition(mart: DataFrame) -> DataFrame:
    m = mart.where(F.col("pct_light").isNotNull())
    return m.agg(*[(F.avg(F.coalesce(f"pct_{c}", S.num(0))) * 100).alias(c) for c in ("light", "heavy", "moto")], F.count(F.lit(1)).alias("n"))


def zone_types(zones: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_urban"), "urban").when(F.col("is_federal"), "federal").otherwise("other")
    return zones.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def source_mix(mart: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("vmd_source"))
    return mart.where(F.col("vmd_source").isin(*SOURCES)).groupBy("vmd_source").agg(F.count(F.lit(1)).alias("n")).withColumn("position", order.cast("int")).orderBy("position")


def regional_mean(mart: DataFrame) -> DataFrame:
    return mart.where(F.col("regional").isNotNull() & (F.col("regional") != 0)).groupBy("regional").agg(F.avg(F.coalesce("vmd", S.num(0))).alias("mean_vmd")).orderBy(F.desc("mean_vmd"), "regional")


def filter_segments(mart: DataFrame, source: str = "all", low: float = 0, high: float | None = None, regional: str = "all", road_class: str = "all") -> DataFrame:
    v = F.coalesce("vmd", S.num(0))
    out = mart.where((v >= low) & (v <= (high or 999999)))
    for c, want in (("vmd_source", source), ("regional", regional), ("classe", road_class)):
        if want != "all":
            out = out.where(F.col(c).cast("string") == want)
    return out


def search_segments(mart: DataFrame, query: str, n: int = 20) -> DataFrame:
    """Segments whose key or highway contains the text, or whose region is it; the first n in file order."""
    q = query.strip().upper()
    if len(q) < 2:
        return mart.limit(0)
    hit = F.upper("sre").contains(q) | F.col("go").cast("string").contains(q) | (F.col("regional").cast("string") == q)
    return mart.where(hit).orderBy("seg_idx").limit(n)


def distinct_options(mart: DataFrame) -> DataFrame:
    """(kind, value): what the filter lists offer."""
    r = mart.where(F.col("regional").isNotNull() & (F.col("regional") != 0)).select(F.lit("regional").alias("kind"), F.col("regional").cast("string").alias("value"))
    c = mart.where(F.nullif(F.col("classe"), F.lit("")).isNotNull()).select(F.lit("classe").alias("kind"), F.col("classe").alias("value"))
    return r.unionAll(c).distinct()


def geh_by_segment(mart: DataFrame, scatter: DataFrame) -> DataFrame:
    """Observed segments with the GEH of their last scatter row, zero without one."""
    last = scatter.groupBy("sre").agg(F.max_by("geh", "edge_seq").alias("geh"))
    return mart.where(F.col("vmd_source") == "observed").join(last, "sre", "left").select("sre", F.coalesce("geh", S.num(0)).alias("geh"))


def scatter_extent(scatter: DataFrame) -> DataFrame:
    return scatter.agg(F.max(F.greatest("observed", "estimated")).alias("extent"))


def fit_badges(metrics: DataFrame) -> DataFrame:
    grade = lambda c, good, fair: F.when(F.col(c) >= good, "good").when(F.col(c) >= fair, "fair").otherwise("poor")
    return metrics.select(grade("r2", 0.8, 0.5).alias("r2_badge"), F.when(F.col("geh_pct_under_5") >= 85, "good").otherwise("fair").alias("geh_badge"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def segment_detail(mart: DataFrame, sre: str) -> DataFrame:
    return mart.where(F.col("sre") == sre)


def cumulative_frames(frames: DataFrame) -> DataFrame:
    """(iteration, new_count, total_new): running sum over at most some hundred steps."""
    n = frames.select("iteration", "new_count")
    return n.withColumn("total_new", F.sum("new_count").over(Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)))


def frame_phase(coverage: Column) -> Column:
    return F.when(coverage < 0.5, "propagation").when(coverage < 0.95, "fill").otherwise("complete")
