"""The registered queries: operators bound to the tables at hand, with their SQL."""

from panelforge.plans import basics, models, panels, streams, summaries  # noqa: F401
from panelforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
