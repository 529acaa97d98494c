"""Capacity, free-flow speed and time of road segments from rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.params import Params


def capacity(segments: DataFrame, p: Params = Params()) -> DataFrame:
    """segments with surface, class_group, capacity, free_flow_speed and free_flow_time (minutes)."""
    federal, principal, urban = S.truthy_rule("federal"), S.truthy_rule("principal"), S.truthy_rule("perim_urb")
    surface, group = S.surface_group("situacao", "revest"), S.class_group("classe", federal)
    base = F.when(surface == "PAV", S.lookup(group, S.PAVED_CAPACITY, S.PAVED_CAPACITY["other"])).otherwise(S.lookup(surface, S.UNPAVED_CAPACITY, S.UNPAVED_CAPACITY["LEN"]))
    if p.cap_mult:
        base = base * S.lookup(F.lower(group), p.cap_mult, 1.0)
    for flag, factor in ((urban, p.urban_cap_mult), (principal, p.principal_cap_mult), (surface != "PAV", p.unpaved_cap_mult)):
        base = base * F.when(flag, S.num(factor)).otherwise(S.num(1))
    road = F.when(surface == "PAV", F.when(federal, "federal").otherwise("state")).otherwise(surface)
    speed = F.when(urban, S.lookup(road, {k: v[1] for k, v in S.SPEEDS.items()}, 20)).otherwise(S.lookup(road, {k: v[0] for k, v in S.SPEEDS.items()}, 20))
    out = segments.withColumns({"surface": surface, "class_group": group, "capacity": F.greatest(base, S.num(100)), "free_flow_speed": F.greatest(speed * p.speed_mult, S.num(10))})
    minutes = F.col("extensao") / F.col("free_flow_speed") * 60
    return out.withColumn("free_flow_time", F.when(minutes <= 0, S.num(0.1)).otherwise(minutes))
