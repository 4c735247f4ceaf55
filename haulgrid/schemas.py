"""Declared schemas of the long tables and of the text files they are read from."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


_long, _int, _double, _text = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

SITES = _struct(idx=_long, lat=_double, lon=_double)
HISTORY = _struct(idx=_long, yr=_int, biomass=_double)
DIST = _struct(i=_long, j=_long, d=_double)
FLOWS = _struct(data_type=_text, yr=_int, src=_long, dst=_long, value=_double)
SOLUTION = _struct(name=_text, value=_double)
LABELS = _struct(idx=_long, cluster=_long)
FORECAST_FILE = _struct(Date=_text, Latitude=_double, Longitude=_double, Forecast=_double)
SUBMISSION_FILE = _struct(
    year=_int, data_type=_text, source_index=_double, destination_index=_double, value=_double
)

# The data types of a submission and the variable prefix each one comes from.
FORECAST = "biomass_forecast"
BIOMASS = "biomass_demand_supply"
PELLET = "pellet_demand_supply"
DEPOT = "depot_location"
REFINERY = "refinery_location"
PREFIXES = {"b": BIOMASS, "p": PELLET, "x": DEPOT, "r": REFINERY}
