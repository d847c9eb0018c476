"""driftline: process-monitoring analytics as Spark jobs."""

from driftline.schema import Limits, Roles

__all__ = ["Limits", "Roles"]
