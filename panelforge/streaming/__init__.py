"""Panels as streams: deduplication and daily means with a watermark."""

from panelforge.streaming.panels import arrivals, daily_means, deduped, finished

__all__ = ["arrivals", "daily_means", "deduped", "finished"]
