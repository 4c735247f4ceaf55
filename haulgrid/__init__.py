"""Spatial supply-chain analytics as Spark DataFrame jobs."""

from haulgrid.params import Params

__all__ = ["Params"]
