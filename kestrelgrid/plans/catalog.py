"""Imports every query module, so that the registry is complete."""

from . import composed, ecosystem, exchange, helpers, occurrence, raster, spatial
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "composed", "ecosystem", "exchange", "helpers", "occurrence", "raster", "spatial"]
