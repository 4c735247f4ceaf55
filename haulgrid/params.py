"""Limits and factors of the planning problem."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the problem statement.
DEPOT_CAP = 20_000.0
REFINERY_CAP = 100_000.0
MAX_DEPOTS = 25
MAX_REFINERIES = 5
MIN_SHARE = 0.8
TRANSPORT_FACTOR = 0.001
BALANCE_TOLERANCE = 1e-3
PLANNING_MARGIN = 1e-2
LOCATION_YEAR = 20182019

# Fixed values of the analyses: quota thresholds (lower, upper), catchments, neighbour spacing, one-tier plan.
DEPOT_QUOTA = (8_000, 15_000)
DEPOT_QUOTA_OLD = (5_000, 17_000)
REFINERY_QUOTA = (20_000, 87_000)
CATCHMENT_BAND = (15_000.0, 20_000.0)
CURVE_RADIUS, CURVE_POINTS = 50.0, 20
SPACING_FLAG = 0.079621
DIRECT_CAP, DIRECT_RADIUS = 5_000.0, 100.0
# Longest arcs of a cluster's own plan and of a plan with open plants.
CLUSTER_RADIUS, OPEN_RADIUS = 10_000.0, 1_000.0


@dataclass(frozen=True)
class Params:
    depot_cap: float = DEPOT_CAP
    refinery_cap: float = REFINERY_CAP
    max_depots: int = MAX_DEPOTS
    max_refineries: int = MAX_REFINERIES
    min_share: float = MIN_SHARE
    factor: float = TRANSPORT_FACTOR
    tolerance: float = BALANCE_TOLERANCE
    margin: float = PLANNING_MARGIN
    location_year: int = LOCATION_YEAR
    years: tuple[int, ...] = (2018, 2019)
