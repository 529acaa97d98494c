"""Daily mean volumes from classified counts.

Raw rows are 15-minute counts by road segment, direction and day, one column for each vehicle
class; columns that are absent count as zero. Every aggregate is declared once over the
narrowed columns, so scans read only what is used and partial sums go into the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S

COORDS = {"latitude": "latitude_km_inicial", "longitude": "longitude_km_inicial", "regional": "regional"}


def cleaned(raw: DataFrame, origin: str = "DPL") -> DataFrame:
    """Rows of one origin with trimmed key, total, heavy, light and motorcycle counts. Null keys go."""
    have = [c for c in S.VEHICLES if c in raw.columns]
    pick = lambda names: S.row_total([c for c in names if c in have])
    return raw.where((F.col("origem") == origin) & F.col("codigo_rodovia").isNotNull()).select(
        "row_seq", F.trim("codigo_rodovia").alias("sre"), "codigo_rodovia", "data", "sentido", *COORDS.values(),
        pick(S.VEHICLES).alias("total"), pick(S.HEAVY).alias("heavy"), pick(S.LIGHT).alias("light"), pick(S.MOTORCYCLE).alias("moto"),
    )


def daily_volume_total(counts: DataFrame) -> DataFrame:
    """(sre, vmd): mean over days of the day's total of both directions."""
    daily = counts.groupBy("sre", "data").agg(F.sum("total").alias("total"))
    return daily.groupBy("sre").agg(F.avg("total").alias("vmd"))


def daily_volume_directional(counts: DataFrame) -> DataFrame:
    """(sre, sentido, vmd): the same for each direction, over the days it was counted."""
    daily = counts.where(F.col("sentido").isNotNull()).groupBy("sre", "sentido", "data").agg(F.sum("total").alias("total"))
    return daily.groupBy("sre", "sentido").agg(F.avg("total").alias("vmd"))


def composition_split(counts: DataFrame) -> DataFrame:
    """(sre, pct_heavy, pct_light, pct_moto): ratios of means, null where nothing was counted."""
    means = counts.groupBy("sre").agg(*[F.avg(c).alias(c) for c in ("total", "heavy", "light", "moto")])
    return means.select("sre", *[S.ratio_or_null(c, "total").alias(f"pct_{c}") for c in ("heavy", "light", "moto")])


def first_values(counts: DataFrame) -> DataFrame:
    """(sre, latitude, longitude, regional, go): of each column the first value in file order that is not null."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_seq"))).alias(n) for n, c in {**COORDS, "go": "codigo_rodovia"}.items()]
    return counts.groupBy("sre").agg(*first).withColumn("go", S.leading_number("go"))


def segment_totals(counts: DataFrame) -> DataFrame:
    """Total volume, composition and place of every counted segment."""
    return daily_volume_total(counts).join(composition_split(counts), "sre", "left").join(first_values(counts), "sre", "left").withColumn("sentido", F.lit("TOTAL"))


def direction_means(counts: DataFrame) -> DataFrame:
    return daily_volume_directional(counts).join(first_values(counts), "sre", "left")


def snapshot_totals(raw: DataFrame) -> DataFrame:
    """Sums and first values by segment from a volume snapshot (one row for each direction); zero totals give zero shares."""
    have = [c for c in S.VEHICLES if c in raw.columns]
    rows = raw.where(F.col("sre").isNotNull()).withColumns({
        "sre": F.trim("sre"),
        **{n: S.row_total([c for c in names if c in have]) for n, names in {"heavy": S.HEAVY, "light": S.LIGHT, "moto_v": S.MOTORCYCLE, "total": S.VEHICLES}.items()},
    })
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_seq"))).alias(c)
    out = rows.groupBy("sre").agg(*[F.coalesce(F.sum(c), S.num(0)).alias(c) for c in ("vmd", "vmdc", "heavy", "light", "moto_v", "total")], *[first(c) for c in ("latitude", "longitude", "regional", "origem")])
    return out.select("sre", "vmd", "vmdc", "latitude", "longitude", "regional", "origem", *[S.ratio_or_zero(c, "total").alias(p) for c, p in (("heavy", "pct_heavy"), ("light", "pct_light"), ("moto_v", "pct_moto"))])


def with_volumes(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """segments with the observed volume where there is one; columns of the same name keep the segments' value."""
    vol = totals.select("sre", *[F.col(c).alias(c if c not in segments.columns else f"{c}_vol") for c in ("vmd", "pct_heavy", "pct_light", "pct_moto", "latitude", "longitude") if c in totals.columns])
    out = segments.join(vol, "sre", "left").withColumn("has_vmd", F.col("vmd").isNotNull())
    return out.withColumn("vmdc", F.when(F.col("has_vmd"), F.col("vmd") * F.coalesce("pct_heavy", S.num(0))))
