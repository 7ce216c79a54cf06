"""Registered queries over the tables."""

from . import boxes, engines, flow, measures, pages, rasters, scored, sequences, shapes, streams, texts, validation  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
