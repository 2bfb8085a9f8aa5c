"""All queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from wardline.plans import decisions, extras, graphs, intel, links, mechanisms, more, risk, texts  # noqa: F401
from wardline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
