"""Column expressions for dates, solver variable names and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulgrid.schemas import PREFIXES


def year_of(date_text: Column) -> Column:
    return F.year(F.to_timestamp(date_text)).cast("int")


def flow_name(prefix: str, yr: Column, src: Column, dst: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), yr, src, dst)


def location_name(prefix: str, idx: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), idx)


def name_part(name: Column, position: int) -> Column:
    """Part of a `_`-joined key; null when the key is too short or the part is no number."""
    return F.get(F.split(name, "_"), position).try_cast("bigint")


def data_type_of(name: Column) -> Column:
    prefix = F.get(F.split(name, "_"), 0)
    label = F.lit(None).cast("string")
    for short, full in PREFIXES.items():
        label = F.when(prefix == short, F.lit(full)).otherwise(label)
    return label


def degree_distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    dlat, dlon = lat_a - lat_b, lon_a - lon_b
    return F.sqrt(dlat * dlat + dlon * dlon)
