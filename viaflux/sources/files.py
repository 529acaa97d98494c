"""Readers of the input files; every one has an explicit schema, and a missing optional source is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaflux.functions import geometry as G
from viaflux.functions import scalars as S

COUNTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("origem", "codigo_rodovia")]
    + [T.StructField("data", T.DateType()), T.StructField("sentido", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("latitude_km_inicial", "longitude_km_inicial")]
    + [T.StructField("regional", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in S.VEHICLES]
)
INVENTORY = "row_idx long, sre string, go string, classe string, situacao string, revest string, federal string, principal string, perim_urb string, regional int, extensao double, km_inicial double, km_final double, inicio string, fim string, jurisdicao string, coin_1 string, coin_2 string, coin_f1 string, coin_f2 string, geom string"
ESTIMATES = "sre string, vmd double, vmd_source string, vc_ratio double"


def read_counts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Classified counts with row_seq, which follows the order of the file.

    CSV columns are matched by the header, so classes may be absent or in any order.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).csv(path)  # text columns; the types below are cast, nothing is inferred
        df = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in COUNTS.fields if f.name in raw.columns])
    return _nan_to_null(df).withColumn("row_seq", F.monotonically_increasing_id())


def read_inventory(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Road inventory; texts are trimmed. Spreadsheets are read where pandas can, on the driver."""
    if fmt == "xlsx":
        import pandas as pd

        pdf = pd.read_excel(path)  # needs an optional spreadsheet engine
        df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
        df = df.withColumn("row_idx", F.monotonically_increasing_id())
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).schema(INVENTORY).csv(path)
    df = _nan_to_null(df)
    return df.withColumns({f.name: F.trim(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def read_geometries(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, json_geometry) of a GeometryCollection, by position."""
    doc = spark.read.option("wholetext", True).text(path)
    items = F.from_json(F.get_json_object("value", "$.geometries"), "array<string>")
    return doc.select(F.posexplode(items).alias("i", "g")).select(F.col("i").cast("long").alias("row_idx"), G.from_geojson(F.col("g")).alias("json_geometry"))


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """Properties of an earlier segments file; an empty table if there is none."""
    try:
        doc = spark.read.option("multiLine", True).schema(f"features array<struct<properties:struct<{ESTIMATES.replace(' string', ':string').replace(' double', ':double')}>>>").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ESTIMATES)
    return doc.select(F.explode("features.properties").alias("p")).select("p.*")


def with_geometry(inventory: DataFrame, geometries: DataFrame | None, prefer: str = "wkt") -> DataFrame:
    """Rows that have a geometry, from text or by position, with its source, centroid and ends."""
    g = inventory.withColumn("wkt_geometry", G.from_wkt(F.col("geom")))
    g = g.join(geometries, "row_idx", "left") if geometries is not None else g.withColumn("json_geometry", F.lit(None).cast(G.GEOMETRY))
    first, second = ("wkt", "json") if prefer == "wkt" else ("json", "wkt")
    g = g.withColumn("geometry", F.coalesce(f"{first}_geometry", f"{second}_geometry")).withColumn("geom_source", F.when(F.col(f"{first}_geometry").isNotNull(), first).otherwise(second))
    g = g.drop("wkt_geometry", "json_geometry").where(~G.is_empty(F.col("geometry")))
    c, a, b = G.centroid(F.col("geometry")), G.first_point(F.col("geometry")), G.last_point(F.col("geometry"))
    return g.withColumns({"lat_centroid": c["y"], "lon_centroid": c["x"], "lat_inicial": a["y"], "lon_inicial": a["x"], "lat_final": b["y"], "lon_final": b["x"], "seg_idx": F.col("row_idx")})


def register(spark: SparkSession, paths: dict[str, str]) -> None:
    """Each path (Parquet) as a temporary view; one that is missing fails at once."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def _nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df
