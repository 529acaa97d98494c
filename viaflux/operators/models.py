"""Regression baselines over segment features: forests, boosted trees, inverse distances, clusters, and their ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaflux.functions import scalars as S


def regional_features(segments: DataFrame) -> DataFrame:
    """segments with mean and median volume of their region, the highway's count and length, and the place along it."""
    w = lambda c: Window.partitionBy(c)
    first, last = F.min("km_inicial").over(w("go")), F.max("km_inicial").over(w("go"))
    return segments.withColumns({
        "regional_mean": F.avg("vmd").over(w("regional")), "regional_median": F.percentile("vmd", 0.5).over(w("regional")),
        "go_segments": F.count(F.lit(1)).over(w("go")), "go_km": F.sum("extensao").over(w("go")), "go_position": F.coalesce(S.ratio_or_null(F.col("km_inicial") - first, last - first), S.num(0)),
    })


#: Known places that are weighed together.
KNOWN_BLOCK = 4096


def idw(targets: DataFrame, known: DataFrame, power: float = 2.0) -> DataFrame:
    """(id, idw): mean of all known volumes weighted by inverse distance in km; null for a target without a place.

    The distinct target places are the queries, the known places stand in blocks: a target meets a
    block as one row and takes its sums from it, so rows grow with targets times blocks. Known points at
    one place are one with their sum; those without a place or volume do not count.
    """
    k = known.where("lat is not null and lon is not null and vmd is not null").groupBy("lat", "lon").agg(F.sum("vmd").alias("total"), F.count("vmd").alias("n"))
    blocks = max(1, -(-k.count() // KNOWN_BLOCK))
    rows = k.groupBy(F.pmod(F.xxhash64("lat", "lon"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(F.col("lat").alias("klat"), F.col("lon").alias("klon"), "total", "n")).alias("ks"))
    places = targets.where("lat is not null and lon is not null").select("lat", "lon").distinct()

    def weight(x):
        return F.pow(F.greatest(S.haversine_km(F.col("lat"), F.col("lon"), x["klat"], x["klon"]), S.num(0.001)), S.num(-power))

    total = lambda c: F.aggregate("ks", S.num(0), lambda a, x: a + weight(x) * x[c])
    met = places.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(rows, "block").select("lat", "lon", total("total").alias("up"), total("n").alias("down"))
    means = met.groupBy("lat", "lon").agg((F.sum("up") / F.sum("down")).alias("idw"))
    return targets.join(means, ["lat", "lon"], "left").select("id", "idw")


def _imputed(train: DataFrame, features: list[str]):
    """A function that puts the median of train where a feature is unknown, so that every row keeps an estimate (0 where train knows none)."""
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    medians = train.agg(*[F.percentile(known(c), 0.5).alias(c) for c in features]).first()
    filled = lambda c: F.coalesce(known(c), S.num(medians[c] if medians[c] is not None else 0))
    return lambda df: df.withColumns({f"__f_{c}": filled(c) for c in features})


def tree_predictions(train: DataFrame, test: DataFrame, features: list[str], label: str = "vmd", kind: str = "forest", seed: int = 42) -> DataFrame:
    """test with ``prediction`` of a random forest or of boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    full, names = _imputed(train, features), [f"__f_{c}" for c in features]
    assemble = VectorAssembler(inputCols=names, outputCol="__x")
    model = (RandomForestRegressor if kind == "forest" else GBTRegressor)(featuresCol="__x", labelCol=label, seed=seed)
    return model.fit(assemble.transform(full(train))).transform(assemble.transform(full(test))).drop("__x", *names)


def cluster_means(train: DataFrame, test: DataFrame, features: list[str], k: int = 8, label: str = "vmd", seed: int = 42) -> DataFrame:
    """test with the mean label of its cluster (the nearest built-in relative of a self-organising map)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    full, names = _imputed(train, features), [f"__f_{c}" for c in features]
    assemble = VectorAssembler(inputCols=names, outputCol="__raw")
    a = assemble.transform(full(train))
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(a)
    model = KMeans(featuresCol="__x", k=k, seed=seed, predictionCol="__c").fit(scale.transform(a))
    place = lambda df: model.transform(scale.transform(assemble.transform(full(df)))).drop("__raw", "__x", *names)
    means = place(train).groupBy("__c").agg(F.avg(label).alias("prediction"))
    return place(test).join(F.broadcast(means), "__c", "left").drop("__c")  # k rows


def ensemble_weights(scores: DataFrame) -> DataFrame:
    """(model, weight) in proportion to the better of R2 and 0.01; one row for each model."""
    w = F.greatest(F.col("r2"), S.num(0.01))
    return scores.crossJoin(F.broadcast(scores.agg(F.sum(w).alias("total")))).select("model", (w / F.col("total")).alias("weight"))
