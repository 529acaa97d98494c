"""Road views over the driver's star-schema tables, as SQL that Spark and DuckDB read alike.

``VIEWS`` maps a view to its text; a text may use the views before it. Each view's numbers
are exact in both engines (integers, halves of powers of ten as doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SRE = "concat('SRE', lpad(CAST({} AS STRING), 6, '0'))"

VIEWS: dict[str, str] = {
    "fx_segments": f"""
SELECT s.*,
  CAST(node_a - node_a % 25 AS DOUBLE) / 125 - 19 + CAST(jit AS DOUBLE) / 2000 AS lat_inicial,
  CAST(node_a % 25 AS DOUBLE) / 5 - 53 + CAST(jit AS DOUBLE) / 2000 AS lon_inicial,
  CAST(node_b - node_b % 25 AS DOUBLE) / 125 - 19 + CAST(jit AS DOUBLE) / 2000 AS lat_final,
  CAST(node_b % 25 AS DOUBLE) / 5 - 53 + CAST(jit AS DOUBLE) / 2000 AS lon_final
FROM (SELECT q.*,
    CASE WHEN size % 2 = 0 THEN node_a - node_a % 25 + (node_a % 25 + 1) % 25 ELSE (node_a + 25) % 625 END AS node_b
  FROM (SELECT CAST(p_partkey AS BIGINT) AS seg_idx, {_SRE.format("p_partkey")} AS sre, CAST(substr(p_brand, 7) AS INT) AS go,
      p_retailprice AS km_inicial, CAST(p_size AS DOUBLE) AS extensao, p_size AS size,
      CASE p_type WHEN 'STANDARD' THEN 'Rodovias Radiais' WHEN 'ECONOMY' THEN 'longitudinais' WHEN 'MEDIUM' THEN 'Transversais'
        WHEN 'PROMO' THEN 'Diagonais' WHEN 'LARGE' THEN 'Ligacao' ELSE 'Acesso' END AS classe,
      CASE WHEN p_partkey % 10 < 5 THEN 'PAV' WHEN p_partkey % 10 < 7 THEN 'imp ' WHEN p_partkey % 10 = 7 THEN 'LEN' WHEN p_partkey % 10 = 8 THEN 'EOP' ELSE 'XXX' END AS situacao,
      CASE p_partkey % 4 WHEN 0 THEN 'TSD' WHEN 1 THEN 'n/d' WHEN 2 THEN '' ELSE 'nan' END AS revest,
      CASE WHEN p_partkey % 7 = 0 THEN 'Sim' WHEN p_partkey % 7 = 1 THEN 'true' ELSE 'Nao' END AS federal,
      CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE 'n' END AS principal,
      CASE WHEN p_partkey % 5 = 0 THEN 'SIM' ELSE 'nao' END AS perim_urb,
      CAST(p_partkey % 20 + 1 AS INT) AS regional,
      CASE WHEN p_partkey % 11 = 0 THEN {_SRE.format("p_partkey + 1")} WHEN p_partkey % 11 = 1 THEN 'nan' END AS coin_1,
      CAST((p_partkey * 37) % 625 AS BIGINT) AS node_a, CAST(p_partkey % 3 AS BIGINT) AS jit
    FROM part) q) s""",
    "fx_counts": f"""
SELECT CAST(event_id AS BIGINT) AS row_seq, CASE WHEN user_id % 5 = 4 THEN 'OUT' ELSE 'DPL' END AS origem,
  concat(' ', {_SRE.format("user_id")}, '  ') AS codigo_rodovia, CAST(ts AS DATE) AS data,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'CRESCENTE' ELSE 'DECRESCENTE' END AS sentido,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 10 - 20 END AS latitude_km_inicial,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) / 10 - 50 END AS longitude_km_inicial,
  CAST(user_id % 20 + 1 AS INT) AS regional,
  CASE WHEN event_id % 4 = 0 THEN floor(value * 100) END AS passeio,
  CASE WHEN event_id % 4 = 1 THEN floor(value * 100) END AS moto,
  CASE WHEN event_id % 4 = 2 THEN floor(value * 100) END AS veh_2c,
  CASE WHEN event_id % 4 = 3 THEN floor(value * 100) END AS veh_3s3
FROM events""",
    "fx_clean": """
SELECT row_seq, trim(codigo_rodovia) AS sre, data, sentido, latitude_km_inicial, longitude_km_inicial, regional,
  coalesce(veh_2c, 0) + coalesce(veh_3s3, 0) AS heavy, coalesce(passeio, 0) AS light, coalesce(moto, 0) AS moto,
  coalesce(passeio, 0) + coalesce(moto, 0) + coalesce(veh_2c, 0) + coalesce(veh_3s3, 0) AS total
FROM fx_counts WHERE origem = 'DPL'""",
    "fx_total": """
SELECT sre, avg(t) AS vmd FROM (SELECT sre, data, sum(total) AS t FROM fx_clean GROUP BY sre, data) d GROUP BY sre""",
    "fx_dir": """
SELECT sre, sentido, avg(t) AS vmd FROM (SELECT sre, sentido, data, sum(total) AS t FROM fx_clean GROUP BY sre, sentido, data) d GROUP BY sre, sentido""",
    "fx_nodes": """
SELECT node_id, CAST(node_id - node_id % 25 AS DOUBLE) / 125 - 19 AS lat, CAST(node_id % 25 AS DOUBLE) / 5 - 53 AS lon
FROM (SELECT DISTINCT node_id FROM (SELECT node_a AS node_id FROM fx_segments UNION ALL SELECT node_b FROM fx_segments) u) d""",
    "fx_edges": """
SELECT e.*, CASE WHEN known THEN CAST(100 + (seg_idx * 13 + n * 7) % 1000 AS DOUBLE) END AS observed_vmd,
  CASE WHEN known OR seg_idx % 9 = 0 THEN CAST(100 + (seg_idx * 13 + n * 7 + CASE WHEN seg_idx % 2 = 0 THEN 0 ELSE 40 END) % 1000 AS DOUBLE) END AS volume, known AS fixed,
  CAST(seg_idx % 4 * 50 AS DOUBLE) AS assigned_volume
FROM (SELECT seg_idx * 2 AS edge_seq, node_a AS src, node_b AS dst, concat(sre, '_C') AS key, sre, 'CRESCENTE' AS direction, seg_idx, 0 AS n,
    CAST(500 * (1 + seg_idx % 8) AS DOUBLE) AS capacity, extensao / 2 AS free_flow_time, seg_idx % 7 = 0 AS is_federal, seg_idx % 5 = 0 AS is_urban, seg_idx % 6 = 0 AS known, regional
  FROM fx_segments WHERE node_a <> node_b
  UNION ALL
  SELECT seg_idx * 2 + 1, node_b, node_a, concat(sre, '_D'), sre, 'DECRESCENTE', seg_idx, 1,
    CAST(500 * (1 + seg_idx % 8) AS DOUBLE), extensao / 2, seg_idx % 7 = 0, seg_idx % 5 = 0, seg_idx % 6 = 0, regional
  FROM fx_segments WHERE node_a <> node_b
  UNION ALL
  SELECT 1099511627776 + seg_idx, node_a, (node_b + 1) % 625, concat('coin_', CAST(seg_idx AS STRING)), 'connection', 'CONN', seg_idx, 0,
    99999.0, 0.001, NULL, NULL, false, NULL
  FROM fx_segments WHERE seg_idx % 50 = 3) e""",
    "fx_mart": """
SELECT seg_idx, sre, go, CASE WHEN regional = 7 THEN NULL ELSE regional END AS regional, CASE WHEN seg_idx % 13 = 0 THEN '' ELSE classe END AS classe,
  CASE WHEN seg_idx % 17 = 0 THEN NULL ELSE trim(revest) END AS revest, extensao,
  CASE WHEN seg_idx % 19 = 0 THEN NULL ELSE CAST((seg_idx * seg_idx * 7) % 60000 AS DOUBLE) / 2 END AS vmd,
  CASE seg_idx % 5 WHEN 0 THEN 'observed' WHEN 1 THEN 'propagated' WHEN 2 THEN 'assigned' WHEN 3 THEN 'estimated' ELSE 'other' END AS vmd_source,
  CAST(seg_idx % 140 AS DOUBLE) / 100 AS vc_ratio,
  CASE WHEN seg_idx % 3 = 0 THEN NULL ELSE CAST(seg_idx % 50 AS DOUBLE) / 64 END AS pct_light,
  CASE WHEN seg_idx % 4 = 0 THEN NULL ELSE CAST(seg_idx % 30 AS DOUBLE) / 64 END AS pct_heavy, CAST(seg_idx % 8 AS DOUBLE) / 64 AS pct_moto
FROM fx_segments""",
    "fx_scatter": """
SELECT edge_seq, sre, observed_vmd AS observed, volume AS estimated, abs(volume - observed_vmd) / sqrt((volume + observed_vmd) / 2) AS geh, volume - observed_vmd AS residual
FROM fx_edges WHERE fixed AND direction <> 'CONN'""",
}
NEEDS = ("part", "events")


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views over the tables of a folder, without touching the session's catalog names for long."""
    for t in NEEDS:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    out: dict[str, DataFrame] = {}
    for name, text in VIEWS.items():
        out[name] = spark.sql(text)
        out[name].createOrReplaceTempView(name)
    return out


def raw_counts(views: dict[str, DataFrame]) -> DataFrame:
    """fx_counts with the vehicle columns under their file names."""
    return views["fx_counts"].withColumnsRenamed({"veh_2c": "2c", "veh_3s3": "3s3"})


def inventory(views: dict[str, DataFrame]) -> DataFrame:
    """fx_segments as inventory rows with a WKT text (every seventh cut off) and a JSON fallback by position."""
    s = views["fx_segments"]
    xy = lambda a, b: F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string"))
    wkt = F.concat(F.lit("LINESTRING ("), xy("lon_inicial", "lat_inicial"), F.lit(", "), xy("lon_final", "lat_final"), F.lit(")"))
    return s.withColumn("row_idx", F.col("seg_idx")).withColumn("geom", F.when(F.col("seg_idx") % 7 == 0, F.substring(wkt, 1, 20)).otherwise(wkt))


def json_geometries(views: dict[str, DataFrame]) -> DataFrame:
    from viaflux.functions import geometry as G

    point = lambda a, b: F.array(F.col(a), F.col(b))
    text = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(point("lon_inicial", "lat_inicial"), point("lon_final", "lat_final")).alias("coordinates")))
    return views["fx_segments"].select(F.col("seg_idx").alias("row_idx"), G.from_geojson(text).alias("json_geometry"))


def with_sql(body: str) -> str:
    """body (a SELECT, perhaps with more WITH parts in ``views``) over the views it names, for DuckDB."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in need:
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(body)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in need]
    text = body.strip()
    if not parts:
        return text
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return f"{head}{', '.join(parts)}, {text[len(head):]}"
    return f"WITH {', '.join(parts)} {text}"
