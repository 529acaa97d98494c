"""Parameters of an estimation run, with the bounds of those that are calibrated."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    gravity_gamma: float = 1.5
    bpr_alpha: float = 0.15
    bpr_beta: float = 4.0
    urban_trip_factor: float = 2.0
    federal_trip_factor: float = 1.5
    trip_base_rate: float = 0.3
    urban_cap_mult: float = 1.5
    principal_cap_mult: float = 1.3
    unpaved_cap_mult: float = 1.0
    cap_mult: dict[str, float] = field(default_factory=dict)  # by class group in lower case
    speed_mult: float = 1.0
    cluster_eps_m: float = 500.0
    stitch_gap_km: float = 50.0
    propagation_steps: int = 100
    known_ratios: tuple[float, ...] = (1.0, 0.5, 0.3)
    fill_sweeps: int = 10
    smooth_weight: float = 0.7
    max_zones: int = 100
    gravity_min_km: float = 1.0
    gravity_max_km: float = 300.0
    flow_percentile: float = 0.1
    assign_steps: int = 15
    assign_gap: float = 0.02

    def with_values(self, **values: float) -> Params:
        return replace(self, **values)


#: Calibrated parameters: lower and upper bound.
BOUNDS: dict[str, tuple[float, float]] = {
    "gravity_gamma": (0.5, 3.0),
    "bpr_alpha": (0.05, 0.5),
    "bpr_beta": (2.0, 6.0),
    "urban_trip_factor": (1.0, 4.0),
    "federal_trip_factor": (1.0, 3.0),
    "trip_base_rate": (0.1, 0.6),
    "urban_cap_mult": (1.0, 2.5),
    "principal_cap_mult": (1.0, 2.0),
}
