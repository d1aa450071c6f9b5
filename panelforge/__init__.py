"""PySpark operators for panels of timestamped observations (key x time x measures)."""

from panelforge.binding import Binding

__all__ = ["Binding"]
