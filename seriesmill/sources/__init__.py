"""Sources: whatever the wire delivers, as canonical points."""

from seriesmill.sources.registry import Tagging, source, spool_delay, union

__all__ = ["Tagging", "source", "spool_delay", "union"]
