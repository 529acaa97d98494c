"""Column expressions: cleaning, safe casts, classification rules, distances, costs, fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: vehicle classes of the count files, and the rule tables

LIGHT = ("passeio", "van", "pickup")
MOTORCYCLE = ("moto",)
HEAVY = (
    "2cb", "3cb", "4cb", "2sb1", "2ib2", "2c", "3c", "4c", "4cd", "2s1", "2s2", "3s1", "2s3", "3s2", "2i2", "2i3",
    "2j3", "3i2", "3s3", "3i3", "3j3", "4r4", "2c2", "2c3", "3c2", "3c3", "3d3", "3d4", "3q4", "3q6", "3t6",
)
VEHICLES = LIGHT + MOTORCYCLE + HEAVY

#: Vehicles a day and direction on paved roads by class group, then on the other surfaces.
PAVED_CAPACITY = {"federal": 8000, "Radiais": 6000, "Longitudinais": 5000, "Transversais": 4500, "Diagonais": 4500, "Ligacoes": 3000, "other": 2500}
UNPAVED_CAPACITY = {"IMP": 1500, "LEN": 800}
#: km/h outside and inside towns.
SPEEDS = {"federal": (80, 60), "state": (70, 50), "IMP": (40, 30), "LEN": (25, 20)}
PAVED_SITUATIONS = ("DUP", "PAV")
PAVED_COVERS = ("CBUQ", "TSD", "TSD+MICRO", "PF", "AA", "PMF", "PMQ")
PLANNED_SITUATIONS = ("EOP", "EOD", "PLA")
NAMED_CLASSES = ("Radiais", "Longitudinais", "Transversais", "Diagonais")

# --- defaults where an edge carries no value
CAPACITY_DEFAULT = 3000.0
CONNECTOR_CAPACITY = 99999.0


def num(x: float) -> Column:
    """A double literal."""
    return F.lit(float(x))


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def row_total(names: list[str]) -> Column:
    """Sum over columns with null as zero; zero for no column."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{n}`").cast("double"), num(0)) for n in names], num(0))


def ratio_or_null(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_col(a), F.nullif(as_col(b), num(0)))


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(ratio_or_null(a, b), num(0))


def leading_number(x: Column | str) -> Column:
    """Digits at the start of a text as a double, else null."""
    return F.nullif(F.regexp_extract(as_col(x), r"^(\d+)", 1), F.lit("")).try_cast("double")


def safe_float(x: Column | str, default: float | None = 0.0, digits: int = 2) -> Column:
    """Null, NaN and what is no number give the default; else rounded half to even."""
    v = as_col(x).try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    return F.bround(F.coalesce(v, F.lit(default).cast("double")), digits)


def safe_int(x: Column | str) -> Column:
    """Truncated towards zero; null, NaN and what is no number give null."""
    v = as_col(x).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v).try_cast("int")


def known_text(x: Column | str) -> Column:
    """Null for blank and for the texts that stand for a missing value."""
    t = F.trim(as_col(x).cast("string"))
    return F.when(t.isin("", "nan", "None"), None).otherwise(t)


def strict_int(x: Column | str) -> Column:
    """Null unless the text is an integer as it stands."""
    t = known_text(x)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def truthy_rule(x: Column | str) -> Column:
    """Flags as the capacity rules read them."""
    return F.coalesce(F.lower(as_col(x).cast("string")).isin("s", "sim", "true", "1"), F.lit(False))


def truthy_network(x: Column | str) -> Column:
    """Flags as the network and the exports read them."""
    return F.coalesce(F.lower(as_col(x).cast("string")).isin("s", "sim"), F.lit(False))


def surface_group(situation: Column | str, cover: Column | str) -> Column:
    s, c = (F.coalesce(F.upper(F.trim(as_col(x).cast("string"))), F.lit("")) for x in (situation, cover))
    return F.when(s.isin(*PAVED_SITUATIONS) | c.isin(*PAVED_COVERS), "PAV").when((s == "IMP") | (c == "IMP"), "IMP").when(s == "LEN", "LEN").when(s.isin(*PLANNED_SITUATIONS), "PAV").otherwise("IMP")


def class_group(road_class: Column | str, federal: Column) -> Column:
    c = F.coalesce(F.trim(as_col(road_class).cast("string")), F.lit(""))
    out = F.when(federal, "federal")
    for name in NAMED_CLASSES:
        out = out.when(F.lower(c).contains(name.lower()), name)
    return out.when(c.contains("Liga") | c.contains("liga"), "Ligacoes").otherwise("other")


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), num(default))
    for k, v in table.items():
        out = out.when(key == k, num(v))
    return out.otherwise(num(default))


def project_m(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    lat, lon = as_col(lat), as_col(lon)
    return lat * 111320.0, lon * 111320.0 * F.cos(F.radians(lat))


def degree_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance in degrees, times km of a degree of latitude."""
    return F.sqrt(F.pow(lat1 - lat2, num(2)) + F.pow(lon1 - lon2, num(2))) * 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), num(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), num(2))
    return num(6371.0) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bpr(t0: Column, volume: Column, capacity: Column, alpha: Column | float, beta: Column | float) -> Column:
    a, b = (x if isinstance(x, Column) else num(x) for x in (alpha, beta))
    return F.when(capacity <= 0, t0 * 10).otherwise(t0 * (1 + a * F.pow(volume / F.nullif(capacity, num(0)), b)))


def geh(estimated: Column, observed: Column) -> Column:
    d = F.sqrt((estimated + observed) / 2)
    return F.abs(estimated - observed) / F.when(d == 0, num(1)).otherwise(d)


def volume_class(v: Column, edges: tuple[float, ...]) -> Column:
    """Index of the last edge not above v (left-closed classes, the last one open); null below the first."""
    out = F.when(F.lit(False), F.lit(0))
    for i in range(len(edges) - 1, -1, -1):
        out = out.when(v >= num(edges[i]), F.lit(i))
    return out


def symbol_size(v: Column) -> Column:
    return F.greatest(num(4), F.least(num(14), F.log10(v + 1) * 3))
